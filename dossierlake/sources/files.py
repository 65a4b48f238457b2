"""Sources and sinks: raw document stores, event files, CSV content, partitioned artefacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from dossierlake.operators.ingest import content_checksum, parse_storage_path


def scan_raw_documents(spark: SparkSession, root: str) -> DataFrame:
    """Files below root/raw/{type}/{Y}/{M}/{D}/{doc}/{file} with the parts of their paths, bytes and checksum."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.withColumn("p", parse_storage_path(F.col("path"))).select("p.*", "length", "content", content_checksum(F.col("content")).alias("checksum_sha256"))


def scan_events(lines: DataFrame, schema: StructType, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(events, bad): rows of JSON text that parse under the schema, and those that do not, for the dead letters."""
    marked = StructType([*schema.fields]).add("_corrupt", "string")
    parsed = lines.withColumn("event", F.from_json(value, marked, {"columnNameOfCorruptRecord": "_corrupt"}))
    # the parser stops at the end of the first value: inside an array, whatever follows it is an error or a second value
    alone = F.coalesce(F.size(F.from_json(F.concat(F.lit("["), F.col(value), F.lit("]")), "array<string>")), F.lit(-1)) == 1
    bad = F.col("event").isNull() | F.col("event._corrupt").isNotNull() | ~alone
    return parsed.where(~bad).select(*[c for c in lines.columns if c != value], "event.*").drop("_corrupt"), parsed.where(bad).drop("event")


def write_artefacts(rows: DataFrame, path: str, created: str = "created_at") -> None:
    """Parquet partitioned by submission type and date."""
    dated = rows.withColumns({"y": F.year(created), "m": F.month(created), "d": F.dayofmonth(created)})
    dated.write.partitionBy("submission_type", "y", "m", "d").parquet(path)


#: a record: runs of characters other than quotes and line ends, and quoted strings, which may hold line ends
CSV_RECORD = r'(?:[^"\r\n]++|"(?:[^"]++|"")*+"|")++'
DELIMITERS = (",", "\t", ";", "|")


def _cells(record: Column, delimiter: str) -> Column:
    """Cells of a CSV record; quotes around a cell go, doubled ones inside it become one."""
    d = "\\t" if delimiter == "\t" else f"[{delimiter}]"
    # a delimiter in front of the first cell as well: no match is empty
    cells = F.regexp_extract_all(F.concat(F.lit(delimiter), record), F.lit(rf'{d}("(?:[^"]++|"")*+"|[^{d.strip("[]")}]*+)'), F.lit(1))
    return F.transform(cells, lambda c: F.when(c.rlike(r'(?s)^".*"$') & (F.length(c) > 1), F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c))


def csv_tables(files: DataFrame, delimiter: str = "delimiter", content: str = "content", id_col: str = "doc_id", max_rows: int = 10_000) -> DataFrame:
    """Cells of CSV content: (id, row_no, cells) for at most max_rows rows a file, as the format's reader has it.

    Byte-order marks go, text that is not UTF-8 is read as Latin-1, blank rows are skipped, and rows are padded or cut
    to the width of the first.  Row 0 is the header where there is more than one row.  Delimiters other than comma, tab,
    semicolon and bar are read as commas.
    """
    utf8 = F.decode(content, "ISO-8859-1")
    utf8 = F.when(F.is_valid_utf8(F.col(content).cast("string")), F.regexp_replace(F.col(content).cast("string"), "^\ufeff", "")).otherwise(utf8)
    records = files.select(id_col, F.col(delimiter).alias("d"), F.regexp_extract_all(utf8, F.lit(CSV_RECORD), F.lit(0)).alias("records"))
    cells = lambda r: F.when(F.col("d") == "\t", _cells(r, "\t")).when(F.col("d") == ";", _cells(r, ";")).when(F.col("d") == "|", _cells(r, "|")).otherwise(_cells(r, ","))
    filled = F.filter(F.transform("records", cells), lambda row: F.exists(row, lambda c: F.trim(c) != ""))
    rows = records.select(id_col, F.slice(filled, 1, max_rows).alias("rows"))
    width = lambda: F.size(F.get("rows", F.lit(0)))
    padded = lambda row: F.slice(F.concat(row, F.array_repeat(F.lit(""), width())), F.lit(1), width())
    return rows.select(id_col, F.posexplode(F.transform("rows", padded)).alias("row_no", "cells"))
