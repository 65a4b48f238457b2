"""Nearest neighbours through an inverted-file index, with a bound that proves the answer.

Per collection, coarse centroids are fitted by spherical k-means on a bounded sample; every vector of the corpus goes to
the posting list of its nearest centroid, and each list keeps its radius, the widest angle between its centroid and a
member.  A query first reads the `probes` lists whose centroids are nearest.  A list that it did not read holds nothing
nearer than the angle to its centroid less its radius; exact search then reads the lists whose bound does not exceed the
k-th distance found so far, and no others, so the answer is that of comparing all.

Posting lists are directories of one table.  Lists are cut into parts of BLOCK vectors and the queries of a list into
parts of QUERIES, and each part meets each in a task of its own; a task hands on at most k rows a query.  So neither a
crowded list nor one that all queries read is gathered, and what is moved is the corpus once and a query once a list.

Cases: vectors that are null, of another length than their collection's first, or hold null or non-finite components are left out on either
side; a zero vector is at distance 1 of everything; equal distances are ordered by vec_id; an empty corpus gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dossierlake.functions.scratch import scratch_path, written
from dossierlake.operators.vectors import NEIGHBOURS, l2_normalise

#: Vectors a collection that centroids are fitted on, and lists a collection at most
SAMPLE, LISTS = 4_096, 1_024
#: Vectors, and queries, that meet in one task
BLOCK, QUERIES = 8_192, 2_048
#: Rows of a batch that leaves the routing of queries
ROUTED = 8_192
#: Slack of bounds for rounding
EPS = 1e-9


@dataclass(frozen=True)
class Index:
    """postings: (collection, list, part, vec_id, u); zeros: (collection, vec_id); lists: (collection, list, radius, parts)."""

    postings: DataFrame
    zeros: DataFrame
    lists: DataFrame
    centroids: dict[str, np.ndarray]
    radii: dict[str, np.ndarray]


def _usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, collection, u): unit vectors, or zeros."""
    v = F.col("v")
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.coalesce(fine, F.lit(False)) & F.col("collection").isNotNull()).select("vec_id", "collection", l2_normalise(v.cast("array<double>")).alias("u"))


def _is_zero(u: Column) -> Column:
    return ~F.exists(u, lambda x: x != 0)


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Unit centroids of unit vectors; a centroid that loses its members takes the vector farthest from its own."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        sims = x @ c.T
        own = sims.argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        norm = np.linalg.norm(sums, axis=1)
        alone = np.flatnonzero(norm < 1e-12)
        c = np.where(norm[:, None] < 1e-12, c, sums / np.maximum(norm, 1e-12)[:, None])
        far = np.argsort(sims.max(axis=1))[: len(alone)]
        c[alone[: len(far)]] = x[far]
    return c


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as a matrix, without a Python number for each component."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def build_index(corpus: DataFrame, lists: int | None = None, sample: int = SAMPLE) -> Index:
    """Index of corpus (vec_id, collection, v), in the shared folder; collections are few, as they are here."""
    units = _usable(corpus)
    lengths = {r["collection"]: r["dim"] for r in units.groupBy("collection").agg(F.min_by(F.size("u"), "vec_id").alias("dim")).collect()}
    dim = F.lit(-1)
    for name, n in lengths.items():
        dim = F.when(F.col("collection") == name, n).otherwise(dim)
    units = units.where(F.size("u") == dim)
    zeros = written(units.where(_is_zero(F.col("u"))).select("collection", "vec_id"), "knn-zeros")
    rows = units.where(~_is_zero(F.col("u")))
    counts = {r["collection"]: r["n"] for r in rows.groupBy("collection").agg(F.count("*").alias("n")).collect()}
    centroids = {}
    for name, n in counts.items():
        # the smallest hashes of a collection: the same rows whatever the partitions
        held = rows.where(F.col("collection") == name).orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("u").collect()
        x = np.array([r["u"] for r in held])
        centroids[name] = kmeans(x, max(1, min(lists or isqrt(n), LISTS, len(x))))

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = np.array(batch.column("collection").to_pylist(), dtype=object)
            own, angle = np.zeros(len(names), dtype=np.int32), np.zeros(len(names))
            for name in set(names):
                at = np.flatnonzero(names == name)
                sims = _matrix(batch.column("u").take(pa.array(at))) @ centroids[name].T
                own[at] = sims.argmax(axis=1)
                angle[at] = np.arccos(np.clip(sims.max(axis=1), -1, 1))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("collection"), batch.column("u"), pa.array(own), pa.array(angle)], names=["vec_id", "collection", "u", "list", "angle"])

    ident = rows.schema["vec_id"].dataType.simpleString()
    placed = written(rows.mapInArrow(assign, f"vec_id {ident}, collection string, u array<double>, list int, angle double"), "knn-placed")
    # a row a list
    sizes = placed.groupBy("collection", "list").agg(F.max("angle").alias("radius"), F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    sizes = written(sizes, "knn-lists")
    radii = {name: np.full(len(c), -1.0) for name, c in centroids.items()}
    for r in sizes.collect():
        radii[r["collection"]][r["list"]] = r["radius"]
    path = scratch_path(corpus.sparkSession, "knn-postings")
    parted = placed.join(F.broadcast(sizes.select("collection", "list", "parts")), ["collection", "list"]).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
    parted.select("collection", "list", "part", "vec_id", "u").repartition("collection", "list", "part").write.partitionBy("collection", "list").parquet(path)
    kind = f"part int, vec_id {ident}, u array<double>, collection string, list int"
    return Index(corpus.sparkSession.read.schema(kind).parquet(path), zeros, sizes, centroids, radii)


def _bounds(angles: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """Least distance that a member of each list can have; lists without members are out of reach."""
    return np.where(radii < 0, np.inf, 1 - np.cos(np.clip(angles - radii, 0, np.pi)))


def _route(queries: DataFrame, index: Index, probes: int, second: bool) -> DataFrame:
    """(query_id, collection, list, qu): the lists that a query reads first, or, given kth, those that it must read still."""
    centroids, radii = index.centroids, index.radii

    def routed(batch: pa.RecordBatch, rows: list[int], lists: list[int]) -> pa.RecordBatch:
        at = pa.array(rows, pa.int64())
        return pa.RecordBatch.from_arrays([batch.column("query_id").take(at), batch.column("collection").take(at), pa.array(lists, pa.int32()), batch.column("qu").take(at)], names=["query_id", "collection", "list", "qu"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, rows, lists = batch.column("collection").to_pylist(), [], []
            kth = batch.column("kth").to_pylist() if second else None
            for i in range(batch.num_rows):
                c, u = centroids.get(names[i]), batch.column("qu")[i].values.to_numpy(zero_copy_only=False)
                if c is None or len(u) != c.shape[1]:
                    continue
                angles = np.arccos(np.clip(c @ u, -1, 1))
                there = np.flatnonzero(radii[names[i]] >= 0)
                order = there[np.argsort(angles[there], kind="stable")]
                wanted = order[:probes]
                if second:
                    rest = order[probes:]
                    bound = _bounds(angles[rest], radii[names[i]][rest])
                    wanted = rest[bound <= (np.inf if kth[i] is None else kth[i] + EPS)]
                rows += [i] * len(wanted)
                lists += wanted.tolist()
                # a query that nothing rules out goes to every list, so what a batch of them becomes has no bound of its own
                if len(rows) >= ROUTED:
                    yield routed(batch, rows, lists)
                    rows, lists = [], []
            yield routed(batch, rows, lists)

    ident = queries.schema["query_id"].dataType.simpleString()
    return written(queries.mapInArrow(run, f"query_id {ident}, collection string, list int, qu array<double>"), "knn-routed")


def _nearest(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The k nearest of a part of a list for each query of a part of its queries."""

    def run(queries: pa.Table, members: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if queries.num_rows and members.num_rows:
            x, ids = _matrix(members.column("u").combine_chunks()), members.column("vec_id").to_pylist()
            names, q = queries.column("query_id").to_pylist(), _matrix(queries.column("qu").combine_chunks())
            for at in range(0, len(q), 256):
                sims = q[at : at + 256] @ x.T
                least = np.partition(sims, -k, axis=1)[:, -k] if k < len(x) else np.full(len(sims), -np.inf)
                for i, row in enumerate(sims):
                    near = np.flatnonzero(row >= least[i] - EPS)
                    # summed row by row, so that equal vectors are at equal distances
                    d = 1 - np.einsum("ij,j->i", x[near], q[at + i])
                    out += [(names[at + i], ids[j], float(v)) for v, _, j in sorted((v, ids[j], j) for v, j in zip(d, near, strict=True))[:k]]
        columns = list(zip(*out, strict=True)) or [[], [], []]
        kinds = [queries.schema.field("query_id").type, members.schema.field("vec_id").type, pa.float64()]
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("query_id", "vec_id", "distance"), columns, kinds, strict=True)})

    return run


def _probe(routed: DataFrame, index: Index, k: int) -> DataFrame:
    """(query_id, vec_id, distance): at most k rows a query and part of a list."""
    asked = written(routed.groupBy("collection", "list").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("qparts")).join(F.broadcast(index.lists.select("collection", "list", "parts")), ["collection", "list"]), "knn-asked")
    # a row a list
    asked = F.broadcast(asked)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = routed.join(asked, ["collection", "list"]).withColumn("qpart", F.pmod(F.xxhash64("query_id"), F.col("qparts")).cast("int")).withColumn("part", every("parts"))
    right = index.postings.join(asked.drop("parts"), ["collection", "list"]).withColumn("qpart", every("qparts"))
    on = ["collection", "list", "part", "qpart"]
    kinds = f"query_id {routed.schema['query_id'].dataType.simpleString()}, vec_id {index.postings.schema['vec_id'].dataType.simpleString()}, distance double"
    left, right = left.select(*on, "query_id", "qu").groupBy(*on), right.select(*on, "vec_id", "u").groupBy(*on)
    return left.cogroup(right).applyInArrow(_nearest(k), kinds)


def _top(found: DataFrame, k: int) -> DataFrame:
    return found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("distance", "vec_id"))).where(F.col("rank") <= k)


def _smallest(ids: DataFrame, k: int) -> DataFrame:
    """The k smallest ids of each collection."""
    return ids.withColumn("r", F.row_number().over(W.partitionBy("collection").orderBy("vec_id"))).where(F.col("r") <= k).drop("r")


def search(index: Index, queries: DataFrame, k: int = NEIGHBOURS, probes: int = 4, exact: bool = True) -> DataFrame:
    """The k nearest of each query (vec_id, collection, v) in its collection: query_id, vec_id, distance, rank.

    distance is 1 - cosine.  exact=False reads the first `probes` lists only.
    """
    q = _usable(queries).select(F.col("vec_id").alias("query_id"), "collection", F.col("u").alias("qu"))
    blank = _is_zero(F.col("qu"))
    some = written(q.where(~blank), "knn-queries")
    found = written(_top(_probe(_route(some, index, probes, False), index, k), k).drop("rank"), "knn-found")
    if exact:
        kth = found.groupBy("query_id").agg(F.when(F.count("*") >= k, F.max("distance")).alias("kth"))
        rest = _probe(_route(some.join(kth, "query_id", "left"), index, probes, True), index, k)
        found = found.unionByName(rest)
    # zero vectors are at distance 1: of a collection's, only the k smallest ids can count, and likewise all ids for a zero query
    level = lambda rows, ids: rows.select("query_id", "collection").join(F.broadcast(_smallest(ids, k)), "collection").select("query_id", "vec_id", F.lit(1.0).alias("distance"))
    found = found.unionByName(level(some, index.zeros)).unionByName(level(q.where(blank), index.postings.select("collection", "vec_id").unionByName(index.zeros)))
    return _top(found, k)
