"""Vector collections, nearest neighbours, duplicate candidates, an embedding cache and a default embedder."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dossierlake.functions.hooks import hook
from dossierlake.functions.spans import let
from dossierlake.operators.dashboards import at

COLLECTIONS = {"drug": "drug_applications", "medical_device": "medical_devices", "clinical_trial": "clinical_trials", "sae": "adverse_events"}
NEIGHBOURS, SIMILAR = 6, 0.92
#: Bytes of the vectors of a block of the corpus, and of a block of queries, that meet in one task
BLOCK_BYTES, QUERY_BYTES = 16 << 20, 32 << 20
#: Slack of products of unit vectors for rounding
EPS = 1e-9


def collection_of(kind: Column) -> Column:
    out = F.lit("misc_documents")
    for k, v in COLLECTIONS.items():
        out = F.when(kind == k, v).otherwise(out)
    return out


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalise(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return let(norm, lambda n: F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(F.transform(v, lambda x: F.lit(0.0))))


def hashed_words(text: Column, dim: int = 64) -> Column:
    """Hashed words, square roots of counts, unit length.  No words: zeros."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\p{L}+"), F.lit(0))
    every = F.sequence(F.lit(0), F.lit(dim - 1))
    # sorted, with each slot once more: a slot's count is the distance to where the next one begins, less one
    slots = F.array_sort(F.concat(F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(dim))), every.cast("array<bigint>")))
    begins = lambda s: F.concat(F.transform(every, lambda j: F.array_position(s, j.cast("bigint"))), F.array((F.size(s) + 1).cast("bigint")))
    counts = lambda p: F.transform(every, lambda j: F.sqrt((F.get(p, j + 1) - F.get(p, j) - 1).cast("double")))
    return let(let(let(slots, begins), counts), l2_normalise)


def embed_texts(text: Column, dim: int = 64) -> Column:
    """Embedding of a text by the model plugged in as `embed`, else by hashed words."""
    return hook("embed", lambda t: hashed_words(t, dim))(text)


def _by_length(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Length -> (matrix of the finite vectors of that length, where they stand)."""
    column, out = column.combine_chunks(), {}
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    for n in np.unique(sizes[sizes > 0]).tolist():
        here = np.flatnonzero(sizes == n)
        x = column.take(pa.array(here)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(here), n)
        fine = np.isfinite(x).all(axis=1)
        out[n] = x[fine], here[fine]
    return out


def nearest_in_block(k: int, metric: str) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The k nearest of a block of the corpus for each query of a block: products in blocks, then exact sums of those near enough.

    Pairs without a distance (null, non-finite, of two lengths) come last, the smallest ids first.
    """

    def run(queries: pa.Table, members: pa.Table) -> pa.Table:
        names, ids = queries.column("query_id").to_pylist(), members.column("vec_id").to_pylist()
        asked, held = _by_length(queries.column("qv")), _by_length(members.column("v"))
        order = sorted(range(len(ids)), key=lambda j: ids[j])
        out: list[tuple] = [(names[i], ids[j], None) for i in set(range(len(names))) - {i for _, at in asked.values() for i in at.tolist()} for j in order[:k]]
        for n, (q, whose) in asked.items():
            x, there = held.get(n, (np.zeros((0, n)), np.zeros(0, dtype=int)))
            seen = set(there.tolist())
            blind = [j for j in order if j not in seen][:k] if len(seen) < k else []
            half = np.einsum("ij,ij->i", x, x) / 2 if metric == "l2" else np.zeros(len(x))
            for at in range(0, len(q), 256):
                sims = q[at : at + 256] @ x.T - half
                least = np.partition(sims, -k, axis=1)[:, -k] if k < len(x) else np.full(len(sims), -np.inf)
                slack = EPS * (1 + np.abs(sims).max(axis=1, initial=0)) if metric == "l2" else np.full(len(sims), EPS)
                for i, row in enumerate(sims):
                    near, own = np.flatnonzero(row >= least[i] - slack[i]), q[at + i]
                    # summed row by row, so that equal vectors are at equal distances
                    d = 1 - np.einsum("ij,j->i", x[near], own) if metric == "cosine" else np.einsum("ij,ij->i", x[near] - own, x[near] - own)
                    best = sorted((float(v), ids[there[j]]) for v, j in zip(d, near, strict=True))[:k]
                    out += [(names[whose[at + i]], j, v) for v, j in best] + [(names[whose[at + i]], ids[j], None) for j in blind[: k - len(best)]]
        columns = list(zip(*out, strict=True)) or [[], [], []]
        kinds = [queries.schema.field("query_id").type, members.schema.field("vec_id").type, pa.float64()]
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("query_id", "vec_id", "distance"), columns, kinds, strict=True)})

    return run


def knn_exact(queries: DataFrame, corpus: DataFrame, k: int = NEIGHBOURS, metric: str = "cosine") -> DataFrame:
    """The k nearest corpus vectors of each query in its collection: query_id, vec_id, distance, rank.

    Inputs have vec_id, collection and v.  Both sides are cut into blocks of a checked size and each block of queries meets
    each block of its collection, a task each, so no task holds a collection.  All pairs are compared, by matrix products;
    each task hands on at most k rows a query.
    """
    # lengths are taken once a vector, before the pairs
    ready = l2_normalise if metric == "cosine" else lambda v: v
    q = queries.select(F.col("vec_id").alias("query_id"), "collection", ready(F.col("v").cast("array<double>")).alias("qv"))
    corpus = corpus.select("vec_id", "collection", ready(F.col("v").cast("array<double>")).alias("v"))
    blocks = lambda df, v, most: max(1, -(-df.agg(F.coalesce(F.sum(F.size(v)), F.lit(0))).first()[0] * 8 // most))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    part, block = blocks(queries, "v", QUERY_BYTES), blocks(corpus, "v", BLOCK_BYTES)
    q = q.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(part)).cast("int")).withColumn("block", every(block))
    corpus = corpus.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(block)).cast("int")).withColumn("part", every(part))
    on = ["collection", "part", "block"]
    kinds = f"query_id {q.schema['query_id'].dataType.simpleString()}, vec_id {corpus.schema['vec_id'].dataType.simpleString()}, distance double"
    known = F.col("collection").isNotNull()
    found = q.where(known).groupBy(*on).cogroup(corpus.where(known).groupBy(*on)).applyInArrow(nearest_in_block(k, metric), kinds)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("distance").asc_nulls_last(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def duplicate_candidates(neighbours: DataFrame, least: float = SIMILAR) -> DataFrame:
    """Of the nearest, those other than the query itself with similarity 1 - distance of at least `least`."""
    return neighbours.where(F.col("query_id") != F.col("vec_id")).select("query_id", "vec_id", F.round(1 - F.col("distance"), 4).alias("similarity")).where(F.col("similarity") >= least)


def doc_vector(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """A document's vector is that of its first chunk."""
    return chunks.where("chunk_index = 0").select("doc_id", "chunk_id").join(vectors, "chunk_id")


def embedding_cache_join(texts: DataFrame, cache: DataFrame, now: str, ttl_days: int = 7, embed=embed_texts) -> DataFrame:
    """texts (id, text) with vectors: from the cache by content hash while fresh, else embedded, each distinct text once."""
    hashed = texts.withColumn("hash", F.sha2("text", 256))
    fresh = cache.where(F.col("cached_at") >= at(now) - F.make_interval(days=F.lit(ttl_days))).select("hash", F.col("v"), F.lit(True).alias("hit"))
    misses = hashed.select("hash", "text").dropDuplicates(["hash"]).join(fresh.select("hash"), "hash", "left_anti")
    made = misses.select("hash", embed(F.col("text")).alias("v"), F.lit(False).alias("hit"))
    return hashed.join(fresh.unionByName(made), "hash")


def vector_metadata(chunks: DataFrame) -> DataFrame:
    """Flat metadata of chunks as a vector store takes it."""
    return chunks.select("chunk_id", F.col("doc_id").cast("string").alias("doc_id"), "chunk_index", F.coalesce("section_title", F.lit("")).alias("section_title"), "token_count")
