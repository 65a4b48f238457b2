"""Centroid clustering of integer vectors by a bisector tournament.

For each pair of centroids i < j the bisecting plane is an integer normal n = 2 (c_j - c_i) and a threshold
t = |c_j|^2 - |c_i|^2; a vector x is nearer to c_j where n.x - t > 0, and i wins where the sign is zero or negative.
Distances order the centroids totally (ties by number), so each of k - 1 tests eliminates a loser for good: a bracket
of neighbours, whose left side always has the smaller number.  Only the winner's distance is computed, exactly.

A round is one pass over the table: each task hands back, per cluster, a count and exact sums, which Spark adds up; k
rows reach the driver.  Planes and centroids are k * k * dim integers, whatever the table's size.

Arithmetic is exact.  Where 64 bits can't hold a test, a distance or a sum, workers compute with Python's integers, and sums
travel as several digits of base 10**LIMB.  A distance or inertia beyond a long is null.

Cases: vectors that are null, of another length, or hold null or non-finite components are left out; repeated rows count
each; a null id hashes as an empty one; equal hashes are ordered by the vectors; with fewer vectors than k there are as
many centroids as vectors; no vectors give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from hashlib import sha256
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossierlake.llm.common import written

#: Decimal digits of a part of a sum that travels as decimals
LIMB = 20
#: Vectors of a block of tests
ROWS = 4_096
SCALE = 256


def whole(x: float, scale: int = SCALE) -> int:
    """floor(scale * x), exact for every finite double."""
    return floor(x * scale) if abs(x) < 2**52 else int(x) * scale


@dataclass(frozen=True)
class Planes:
    """Centroids (k, dim), normals (k, k, dim) and thresholds (k, k) of the pairs i < j."""

    centroids: np.ndarray
    normals: np.ndarray
    thresholds: np.ndarray


def planes(centroids: list[list[int]], narrow: bool) -> Planes:
    c = np.array(centroids, dtype=np.int64 if narrow else object).reshape(len(centroids), -1)
    square = (c * c).sum(axis=1)
    return Planes(c, 2 * (c[None, :, :] - c[:, None, :]), square[None, :] - square[:, None])


def nearest(x: np.ndarray, p: Planes) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance to it) of each row of x."""
    n, k = len(x), len(p.centroids)
    left = np.broadcast_to(np.arange(k), (n, k))
    while left.shape[1] > 1:
        pairs = left.shape[1] // 2
        i, j = left[:, 0 : 2 * pairs : 2], left[:, 1 : 2 * pairs : 2]
        winners = []
        for m in range(pairs):
            a, b = i[:, m], j[:, m]
            # in the first rounds of the bracket all vectors meet the same pair
            if (a[0] == a).all() and (b[0] == b).all():
                side = x @ p.normals[a[0], b[0]] - p.thresholds[a[0], b[0]]
            else:
                side = (x * p.normals[a, b]).sum(axis=1) - p.thresholds[a, b]
            winners.append(np.where(side > 0, b, a))
        rest = [left[:, -1]] if left.shape[1] % 2 else []
        left = np.stack([*winners, *rest], axis=1)
    won = left[:, 0]
    off = x - p.centroids[won]
    return won, (off * off).sum(axis=1)


def _vectors(column: pa.Array, dim: int, narrow: bool) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    if narrow:
        return np.floor(flat * SCALE).astype(np.int64)
    return np.array([[whole(v) for v in row] for row in flat.tolist()], dtype=object).reshape(-1, dim)


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def kept(vectors: DataFrame, dim: int, vec: str = "embedding") -> DataFrame:
    """Rows whose vector has dim components, none null or non-finite."""
    c = F.col(vec)
    fine = (F.size(c) == dim) & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(c.isNotNull() & F.coalesce(fine, F.lit(False)))


def seeds(rows: DataFrame, k: int, salt: str) -> list[list[int]]:
    """The vectors of the k smallest hashes of their salted ids."""
    tag = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = rows.select(tag.alias("h"), "x").orderBy("h", "x").limit(k).collect()
    return [[whole(v) for v in r["x"]] for r in first]


def _sums(p: Planes, dim: int, narrow: bool, limbs: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    k = len(p.centroids)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, totals = np.zeros(k, dtype=np.int64), [[0] * dim for _ in range(k)]
        for batch in _blocks(batches):
            x = _vectors(batch.column("x"), dim, narrow)
            won, _ = nearest(x, p)
            counts += np.bincount(won, minlength=k)
            for c in np.unique(won):
                # sums of a block stay within 64 bits in a narrow table; those of a task are Python's integers
                totals[c] = [a + int(b) for a, b in zip(totals[c], x[won == c].sum(axis=0), strict=True)]
        rows = [(c, int(counts[c]), [limb for t in totals[c] for limb in split(t, limbs)]) for c in range(k) if counts[c]]
        if rows:
            number, count, sums = zip(*rows, strict=True)
            kind = pa.decimal128(38, 0)
            yield pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), pa.array(count, pa.int64()), pa.array([[_decimal(v) for v in s] for s in sums], pa.list_(kind))], names=["cluster", "n", "sums"])

    return run


def _decimal(v: int):
    from decimal import Decimal

    return Decimal(v)


def split(value: int, limbs: int) -> list[int]:
    """Digits of base 10**LIMB, lowest first, all of the value's sign."""
    sign, value, out = (-1 if value < 0 else 1), abs(value), []
    for _ in range(limbs - 1):
        value, low = divmod(value, 10**LIMB)
        out.append(sign * low)
    return [*out, sign * value]


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, salt: str = "2:", id_col: str = "vec_id", vec: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """((vec_id, cluster, distance) of each kept vector, final centroids); the rows are written."""
    rows = kept(vectors, dim, vec).select(F.col(id_col).alias("vec_id"), F.col(vec).cast("array<double>").alias("x"))
    size = rows.agg(F.max(F.array_max(F.transform("x", F.abs))).alias("most"), F.count("*").alias("n")).first()
    largest = whole(size["most"]) + SCALE if size["n"] else 0
    # |n.x| and |t| stay below 8 * dim * largest^2, sums of a block below ROWS * largest
    narrow = largest.bit_length() * 2 + (8 * dim).bit_length() < 63 and size["n"] is not None
    limbs = 1 + max(0, len(str(largest)) - LIMB) // LIMB + (0 if narrow else 1)
    centroids = seeds(rows, k, salt) if size["n"] else []
    spark = vectors.sparkSession
    if not centroids:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long").withColumn("vec_id", F.col("vec_id").cast(rows.schema["vec_id"].dataType)), []
    kind = "cluster int, n long, sums array<decimal(38,0)>"
    for _ in range(rounds):
        part = rows.select("x").mapInArrow(_sums(planes(centroids, narrow), dim, narrow, limbs), kind)
        # one aggregate a component, summed on the map side first: at most k rows leave a task
        for r in part.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(dim * limbs)]).collect():
            parts = [int(r[f"s{i}"]) for i in range(dim * limbs)]
            centroids[r["cluster"]] = [sum(parts[d * limbs + e] * 10 ** (LIMB * e) for e in range(limbs)) // r["n"] for d in range(dim)]
    last = planes(centroids, narrow)

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches):
            won, off = nearest(_vectors(batch.column("x"), dim, narrow), last)
            far = pa.array([int(d) if d < 2**63 else None for d in off] if not narrow else off, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(won.astype(np.int32)), far], names=["vec_id", "cluster", "distance"])

    ident = rows.schema["vec_id"].dataType.simpleString()
    return written(rows.mapInArrow(assign, f"vec_id {ident}, cluster int, distance long"), "clusters"), centroids


def cluster_digest(vectors: DataFrame, **params) -> DataFrame:
    """Per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, cluster_size."""
    rows, centroids = cluster(vectors, **params)
    spark = vectors.sparkSession
    total = F.when(F.count("distance") == F.count("*"), F.sum(F.col("distance").cast("decimal(38,0)")))

    def long(c: Column) -> Column:
        return F.when(c < F.lit(2**63).cast("decimal(38,0)"), c).cast("long")

    by = [(r["cluster"], r["t"], r["n"]) for r in rows.groupBy("cluster").agg(total.alias("t"), F.count("*").alias("n")).collect()]
    every = None if any(t is None for _, t, _ in by) else sum(int(t) for _, t, _ in by)
    fits = lambda t: int(t) if t is not None and t < 2**63 else None
    found = [(c, fits(t), n, fits(every), sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, t, n in by]
    side = spark.createDataFrame(found, "cluster int, cluster_inertia long, cluster_size long, inertia long, centroid_sha256 string")
    # at most k rows
    return rows.join(F.broadcast(side), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "cluster_size")
