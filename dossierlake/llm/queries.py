"""Queries of this subpackage: thin digests of the operators over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dossierlake.llm import bpe, centroids, decontaminate, embedding_dedup, line_dedup, merkle, pii, quality, secrets, simhash_dedup, sql, unigram, url_filter, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tok

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_digests(docs, tok.path("byte_bpe_50k.tiktoken"), tok.PATTERN)


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.vector_groups(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark"))


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash_dedup.simhash_groups(docs).select("doc_id", "fingerprint", "component_id")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digest(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digest(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_digest(table(spark, sf_dir, "pages"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tok

    return unigram.token_digest(table(spark, sf_dir, "documents"), tok.path("piece_bpe_32k.model"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.merkle_digest(table(spark, sf_dir, "documents"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_digest(table(spark, sf_dir, "embeddings"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_digest(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_secrets": op2_secrets,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_decontamination": op4_decontamination,
    "op5_simhash_dedup": op5_simhash_dedup,
    "op6_line_dedup": op6_line_dedup,
    "op7_warc": op7_warc,
    "op8_quality": op8_quality,
    "op9_token_counts": op9_token_counts,
    "op10_pii": op10_pii,
    "op11_merkle": op11_merkle,
    "op12_centroids": op12_centroids,
    "op13_url_filter": op13_url_filter,
    "pipeline": pipeline,
}

#: DuckDB SQL of those that SQL can express
ORACLE: dict[str, str] = sql.ORACLE
