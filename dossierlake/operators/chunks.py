"""Chunking of texts and tables, chunk links, run records, quality flags."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from dossierlake.functions.spans import let

UNDERLINE = r"^[-_]{4,}$"
HEADING = r"^(#{1,6})\s+(.+)$|^(\d+(?:\.\d+)*)\.?\s+([A-Z].+)$|^([A-Z\s0-9.,&-]{5,100})$"
CHARS_PER_TOKEN, MIN_SECTION, MAX_CHUNK = 4.0, 200, 1000
SIZE, OVERLAP, SEPARATORS = 3200, 600, ("\n\n", "\n", ".", " ", "")
TABLE_ROWS, PART_ROWS = 50, 25


def _title(line: Column) -> Column:
    """Title of a heading line: after # marks, after a number, or the whole line."""
    marked, numbered = F.regexp_extract(line, r"^(#{1,6})\s+(.+)$", 2), F.regexp_extract(line, r"^(\d+(?:\.\d+)*)\.?\s+([A-Z].+)$", 2)
    return F.coalesce(F.nullif(marked, F.lit("")), F.nullif(numbered, F.lit("")), line)


def split_sections(text: Column) -> Column:
    """array<struct<title, body>>: heading lines stay in their body, underlines go, a preamble has no title.

    One fold over line numbers keeps only where sections begin; bodies are cut from the lines afterwards.
    """
    head = "struct<at:int,title:string,under:boolean>"

    def sections(lines: Column) -> Column:
        at = lambda i: F.coalesce(F.trim(F.get(lines, i)), F.lit(""))

        def step(acc: Column, i: Column) -> Column:
            line = at(i)
            under = (line != "") & at(i + 1).rlike(UNDERLINE)
            entry = F.struct(i.alias("at"), F.when(under, line).otherwise(_title(line)).alias("title"), under.alias("under"))
            new = F.concat(acc["heads"], F.array(entry)).cast(f"array<{head}>")
            return (
                F.when(acc["skip"], F.struct(F.lit(False).alias("skip"), acc["heads"].alias("heads")))
                .when(under, F.struct(F.lit(True).alias("skip"), new.alias("heads")))
                .when(line.rlike(HEADING), F.struct(F.lit(False).alias("skip"), new.alias("heads")))
                .otherwise(F.struct(F.lit(False).alias("skip"), acc["heads"].alias("heads")))
            )

        start = F.struct(F.lit(False).alias("skip"), F.array().cast(f"array<{head}>").alias("heads"))
        found = F.aggregate(F.sequence(F.lit(0), F.size(lines) - 1), start, step, lambda a: a["heads"])
        preamble = F.array(F.struct(F.lit(0).alias("at"), F.lit(None).cast("string").alias("title"), F.lit(False).alias("under"))).cast(f"array<{head}>")

        def bodies(hs: Column) -> Column:
            def body(h: Column, k: Column) -> Column:
                end = F.coalesce(F.get(hs, k + 1)["at"], F.size(lines))
                cut = F.slice(lines, h["at"] + 1, end - h["at"])
                return F.struct(h["title"].alias("title"), F.when(h["under"], F.array_join(F.concat(F.array(F.trim(F.get(cut, F.lit(0)))), F.slice(cut, F.lit(3), F.size(cut))), "\n")).otherwise(F.array_join(cut, "\n")).alias("body"))

            return F.transform(hs, body)

        return let(found, lambda hs: let(F.when(F.coalesce(F.get(hs, F.lit(0))["at"], F.lit(1)) == 0, hs).otherwise(F.concat(preamble, hs)), bodies))

    return let(F.split(F.coalesce(text, F.lit("")), "\n", -1), sections)


def merge_small_sections(sections: Column) -> Column:
    """Left fold: while the last section has fewer than 200 estimated tokens the next one joins it."""
    kind = "array<struct<title:string,body:string>>"

    def step(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.struct(last["title"].alias("title"), F.concat(last["body"], F.lit("\n\n"), s["body"]).alias("body"))
        return F.when(F.size(acc) == 0, F.array(s).cast(kind)).when(F.length(last["body"]) / CHARS_PER_TOKEN < MIN_SECTION, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(joined)).cast(kind)).otherwise(F.concat(acc, F.array(s)).cast(kind))

    return F.aggregate(sections, F.array().cast(kind), step)


def split_long(text: str, size: int = SIZE, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most `size` characters cut at the coarsest separator that occurs, neighbours sharing up to `overlap`."""
    sep = next((s for s in separators if not s or s in text), "")
    finer = separators[separators.index(sep) + 1 :] or ("",)
    raw = list(text) if not sep else [p + sep for p in text.split(sep)[:-1]] + [text.split(sep)[-1]]
    parts = [q for p in raw if p for q in (split_long(p, size, 0, finer) if len(p) > size else [p])]
    out, now, length = [], [], 0
    for p in parts:
        if now and length + len(p) > size:
            out.append("".join(now))
            while now and (length > overlap or length + len(p) > size):
                length -= len(now.pop(0))
        now.append(p)
        length += len(p)
    return [x for x in [*out, "".join(now)] if x.strip()]


@F.pandas_udf(ArrayType(StringType()))
def _split_long(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(lambda t: None if t is None else split_long(t))


def chunk_text(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row a chunk: id, chunk_id, chunk_index, section_title, text, token_count, char_count.

    Only sections over 1,000 estimated tokens pass through Python.
    """
    merged = docs.where(F.trim(text) != "").select(id_col, F.posexplode(merge_small_sections(split_sections(F.col(text)))).alias("no", "s")).select(id_col, "no", "s.title", "s.body").where(F.trim("body") != "")
    long_body = F.when(F.floor(F.length("body") / CHARS_PER_TOKEN) > MAX_CHUNK, F.col("body"))
    pieces = merged.withColumn("parts", _split_long(long_body)).select(id_col, "no", "title", F.posexplode(F.coalesce("parts", F.array("body"))).alias("part", "text"))
    index = F.row_number().over(W.partitionBy(id_col).orderBy("no", "part")) - 1
    return pieces.withColumn("chunk_index", index).select(
        id_col, F.format_string("%s-%05d", F.col(id_col).cast("string"), "chunk_index").alias("chunk_id"), "chunk_index", F.col("title").alias("section_title"), "text",
        F.floor(F.length("text") / CHARS_PER_TOKEN).cast("int").alias("token_count"), F.length("text").alias("char_count"),
    )


def chunk_links(chunks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """chunks plus total_chunks and the ids of the neighbours."""
    w = W.partitionBy(id_col).orderBy("chunk_index")
    return chunks.withColumns({"total_chunks": F.count("*").over(W.partitionBy(id_col)), "prev_chunk_id": F.lag("chunk_id").over(w), "next_chunk_id": F.lead("chunk_id").over(w)})


def chunk_tables(tables: DataFrame) -> DataFrame:
    """Tables (doc_id, table_no, page, headers, rows) as chunks; over 50 rows they are cut into parts of 25."""
    n = F.size("rows")
    parts = F.when(n > TABLE_ROWS, F.ceil(n / PART_ROWS)).otherwise(1).cast("int")
    each = tables.withColumn("parts", parts).withColumn("part", F.explode(F.sequence(F.lit(1), F.col("parts"))))
    cut = each.withColumn("sub", F.when(F.col("parts") == 1, F.col("rows")).otherwise(F.slice("rows", (F.col("part") - 1) * PART_ROWS + 1, F.lit(PART_ROWS))))
    preamble = F.concat(
        F.format_string("The following table has %d rows and %d columns.", F.size("sub"), F.size("headers")),
        F.when(F.size("headers") > 0, F.concat(F.lit(" The columns are: "), F.array_join("headers", ", "), F.lit("."))).otherwise(""),
        F.when(F.col("parts") > 1, F.format_string(" This is part %d of %d for this table.", "part", "parts")).otherwise(""),
    )
    index = F.row_number().over(W.partitionBy("doc_id").orderBy("table_no", "part")) - 1
    return cut.withColumn("chunk_index", index).select(
        "doc_id", F.format_string("%s-%05d", "doc_id", "chunk_index").alias("chunk_id"), "chunk_index", "table_no", "part", preamble.alias("preamble"), F.size("sub").alias("n_rows"), F.format_string("Table on page %d", "page").alias("section_title")
    )


def chunks_to_text(chunks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Non-empty chunk texts, stripped and in order, joined by blank lines."""
    per = chunks.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))).alias("c"))
    return per.select(id_col, F.array_join(F.filter(F.transform("c", lambda x: F.trim(x["text"])), lambda x: x != ""), "\n\n").alias("text"))


def extraction_confidence(ocr_used: Column, ocr_mean: Column, language_confidence: Column, n_warnings: Column) -> Column:
    lost = F.when(ocr_used, 0.15 + F.greatest(F.lit(0.0), 0.8 - ocr_mean)).otherwise(0.0) + F.when(language_confidence < 0.8, 0.1).otherwise(0.0) + 0.05 * n_warnings
    return F.round(F.greatest(F.lit(0.0), 1 - lost), 3)


def quality_flags(confidence: Column, n_tables: Column, multilingual: Column, ocr_used: Column, language: Column, warnings: Column) -> Column:
    has = lambda word: F.exists(warnings, lambda w: F.contains(w, F.lit(word)))
    return F.struct(
        (confidence < 0.7).alias("needs_review"), (confidence < 0.5).alias("low_confidence"), (n_tables > 0).alias("has_tables"), multilingual.alias("is_multilingual"), ocr_used.alias("ocr_used"),
        has("ENCRYPTED").alias("encrypted"), has("CORRUPTED").alias("corrupted"), (language != "en").alias("needs_translation"), has("PII").alias("has_pii"),
    )


def processing_log_rows(docs: DataFrame, chunks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One run row a document: chunks, characters, tokens; documents without chunks failed."""
    per = chunks.groupBy(id_col).agg(F.count("*").alias("chunk_count"), F.sum("char_count").alias("chars"), F.sum("token_count").alias("tokens"))
    joined = docs.select(id_col).join(per, id_col, "left")
    return joined.select(id_col, F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), F.coalesce("chars", F.lit(0)).alias("chars"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.when(F.col("chunk_count").isNull(), "failed").otherwise("processed").alias("status"))


def processing_log(runs: DataFrame, chunks: DataFrame, version: str = "1.0.0", id_col: str = "doc_id") -> DataFrame:
    """The row that each run leaves behind: all of it for a run that ended well, id, version and error for one that failed.

    runs: id, error, ocr_used, ocr_pages, ocr_mean, page_count, word_count, table_count, language, language_confidence,
    multilingual, extractors_used, changes and warnings (arrays of text), started_at, finished_at.
    """
    per = chunks.groupBy(F.col(id_col).alias("_id")).agg(F.count("*").alias("_chunks"))
    rows = runs.join(per, F.col(id_col) == F.col("_id"), "left")
    confidence = extraction_confidence(F.col("ocr_used"), F.col("ocr_mean"), F.col("language_confidence"), F.size("warnings"))
    rows = rows.withColumn("extraction_confidence", confidence).withColumn("chunk_count", F.coalesce("_chunks", F.lit(0)))
    flags = F.to_json(quality_flags(F.col("extraction_confidence"), F.col("table_count"), F.col("multilingual"), F.col("ocr_used"), F.col("language"), F.col("warnings")))
    rows = rows.withColumns({"flags": flags, "normalisation_changes": F.to_json("changes"), "processing_duration_ms": F.unix_millis(F.col("finished_at").cast("timestamp")) - F.unix_millis(F.col("started_at").cast("timestamp"))})
    kept = ("extraction_confidence", "ocr_used", "ocr_pages", "page_count", "word_count", "chunk_count", "table_count", "language", "extractors_used", "normalisation_changes", "flags", "processing_duration_ms")
    fine = F.col("error").isNull()
    return rows.select(id_col, F.lit(version).alias("pipeline_version"), *[F.when(fine, F.col(c)).alias(c) for c in kept], F.col("error").alias("error_detail"))


def processed_submissions(submissions: DataFrame, log: DataFrame, now: Column, id_col: str = "doc_id") -> DataFrame:
    """Submissions after their runs: processed with confidence, chunks and time; those whose run failed stay as they are,
    since only the retries' end makes a submission failed."""
    done = log.where("error_detail is null").select(F.col(id_col).alias("_id"), F.col("extraction_confidence").alias("_c"), F.col("chunk_count").alias("_n"))
    rows = submissions.join(done, F.col(id_col) == F.col("_id"), "left")
    good = F.col("_id").isNotNull()
    return rows.withColumn("status", F.when(good, "processed").otherwise(F.col("status"))).withColumns({"preprocessing_confidence": F.col("_c"), "chunk_count": F.col("_n"), "preprocessed_at": F.when(good, now)}).drop("_id", "_c", "_n")
