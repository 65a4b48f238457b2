"""The corpus pipeline: documents through quality, line, near-duplicate and leak filters to token digests.

Each stage reads what its predecessor kept, as Parquet in the shared folder.  All but the last return the columns of
documents.  An empty table passes through; rows with null ids or texts are handled as the operators say.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossierlake.llm import bpe, decontaminate, line_dedup, quality, simhash_dedup
from dossierlake.llm.common import written
from dossierlake.llm.queries import table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the blocks of lines that an earlier one holds; a document that is all repeats stays, empty."""
    cleaned = line_dedup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.when(F.col("removed_lines").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return cleaned.select(docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return simhash_dedup.near_dedup(docs)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def token_digests(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of each document."""
    import public_tokenizers as tok

    return bpe.encode_digests(docs, tok.path("byte_bpe_50k.tiktoken"), tok.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_quality),
    ("lines", without_repeated_lines),
    ("near_duplicates", one_of_each_group),
    ("decontamination", without_leaks),
    ("tokens", token_digests),
]

#: No stage but the leak filter could be said in SQL: a trained classifier comes first.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
