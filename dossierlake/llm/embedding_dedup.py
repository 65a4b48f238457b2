"""Near-duplicate vectors through a forest of random-projection trees.

Each tree splits a bounded sample again and again at the median of its projections on a random direction of that
level; every vector of the table then walks down, and goes both ways where it lies within `spill` of the split.  Depth
and number of trees grow with the logarithm of the table, so leaves stay of one size and the work is nearly linear.
Within leaves all cosines are computed in double precision by blocks, and pairs at or above the threshold are links.

Equal vectors are collapsed first.  A pair that shares several leaves, of one tree or of many, is counted in the
first of them only, which each leaf can tell by walking its linked members down again; so links are counted without
being written out, and a leaf hands on just one count per member and an edge from each member to one neighbour per
local component.  Leaves of more than `block` members are compared in pairs of blocks, a task each, so that a dense
cluster that no split can part is neither cut short nor gathered in one place.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, erf, exp, log, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from dossierlake.llm.common import connected_components, drop_written, id_side, written


@dataclass(frozen=True)
class Forest:
    """Directions (trees, depth, dim) and, per tree and level, the split of each node, or one split for all of them."""

    directions: np.ndarray
    splits: list[list[np.ndarray]]
    spill: float

    def leaves(self, unit: np.ndarray) -> list[np.ndarray]:
        """Per vector the sorted leaf numbers, tree by tree; a leaf is tree << 32 | path."""
        rows, codes = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for t, splits in enumerate(self.splits):
            at, node = np.arange(len(unit)), np.zeros(len(unit), dtype=np.int64)
            for level, cut in enumerate(splits):
                # einsum sums each row in the same order however many rows come along, so that a vector always walks the same way
                p = np.einsum("ij,j->i", unit, self.directions[t, level])
                off = p[at] - (cut[node] if len(cut) > 1 else cut[0])
                left, right = off < self.spill, off >= -self.spill
                at, node = np.concatenate([at[left], at[right]]), np.concatenate([node[left] * 2, node[right] * 2 + 1])
            rows.append(at)
            codes.append((t << 32) + node)
        rows, codes = np.concatenate(rows), np.concatenate(codes)
        order = np.lexsort((codes, rows))
        counts = np.bincount(rows, minlength=len(unit))
        return np.split(codes[order], np.cumsum(counts)[:-1]) if len(unit) else []


def plan_forest(rows: int, leaf: int, threshold: float, recall: float) -> tuple[int, int, float]:
    """(trees, depth, spill as a share of the spread of a projection) for so many vectors.

    The projections of two unit vectors at the threshold differ with a spread of pair = sqrt(2 - 2 * threshold) times
    that of a projection.  With a spill of a quarter of pair to either side, a split parts them for good where they
    differ by half of pair or more on either side of it.  The depth grows until a leaf is expected to hold `leaf`
    vectors; the trees are as many as it takes to miss a pair at the threshold in all of them with odds of 1 - recall.
    """
    pair = sqrt(max(2 - 2 * threshold, 1e-12))
    spill, a = pair / 4, 0.5
    density = exp(-a * a / 2) / sqrt(2 * pi)
    missed = pair / sqrt(2 * pi) * 2 * (density - a * (1 - erf(a / sqrt(2))) / 2)
    both = min(0.5, 2 * spill / sqrt(2 * pi))  # share of vectors that go both ways
    depth, size = 0, float(rows)
    while size > leaf and depth < 31:
        depth, size = depth + 1, size * (1 + both) / 2
    found = (1 - missed) ** depth
    return (1 if depth == 0 else max(4, ceil(log(1 - recall) / log(1 - found)))), depth, spill


def fit_forest(sample: np.ndarray, trees: int, depth: int, spill: float, seed: int) -> Forest:
    """Random directions, split at the medians of the sample in each node; where a node would have fewer than 16 of the
    sample, at the median of the whole sample on that level's direction."""
    rng = np.random.default_rng(seed)
    dim = sample.shape[1] if sample.ndim == 2 and sample.shape[1] else 1
    directions = rng.standard_normal((trees, max(depth, 1), dim))
    directions /= np.linalg.norm(directions, axis=2, keepdims=True)
    splits = []
    for t in range(trees):
        node, levels = np.zeros(len(sample), dtype=np.int64), []
        for level in range(depth):
            p = sample @ directions[t, level]
            if len(sample) >> level <= 16:
                levels.append(np.array([np.median(p) if len(p) else 0.0]))
                continue
            cut = np.full(1 << level, np.median(p))
            order = np.argsort(node, kind="stable")
            edges = np.searchsorted(node[order], np.arange((1 << level) + 1))
            for n in range(1 << level):
                if edges[n] < edges[n + 1]:
                    cut[n] = np.median(p[order[edges[n] : edges[n + 1]]])
            node = node * 2 + (p >= cut[node])
            levels.append(cut)
        splits.append(levels)
    return Forest(directions, splits, spill / sqrt(dim))


def units(matrix: np.ndarray) -> np.ndarray:
    """Rows of finite vectors, none of them zero, scaled to length one in double precision."""
    x = matrix.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True, initial=0.0)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def unit_rows(vectors: list, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(usable, unit): which vectors are of this length, finite and not zero, and those scaled to length one."""
    out, ok = np.zeros((len(vectors), dim)), np.zeros(len(vectors), dtype=bool)
    for i, v in enumerate(vectors):
        if v is None or len(v) != dim:
            continue
        x = np.array(v, dtype=np.float64)  # null components become NaN
        if np.isfinite(x).all() and x.any():
            out[i], ok[i] = x, True
    if ok.any():
        out[ok] = units(out[ok])
    return ok, out


def usable(column: str):
    """True for a vector without null or non-finite components and not all zero."""
    v = F.col(column)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return v.isNotNull() & fine & F.exists(v, lambda x: x != 0)


def _compare(unit: np.ndarray, weights: np.ndarray, forest: Forest, here: int, split: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(links per member, local root per member) over pairs whose first common leaf is this one.

    A member's leaves are walked again from its vector, for members with a link only.  split > 0: the first `split` members against the rest; 0: all against all.
    """
    n = len(unit)
    a, b = (np.arange(split), np.arange(split, n)) if split else (np.arange(n), np.arange(n))
    links, root = np.zeros(n, dtype=np.int64), np.arange(n)
    near = unit[a] @ unit[b].T >= threshold
    if not split:
        np.fill_diagonal(near, False)
    ra, ca = np.nonzero(near)
    if not len(ra):
        return links, root
    # members of each earlier leaf: pairs that meet there are counted there
    touched = np.unique(np.concatenate([a[ra], b[ca]]))
    earlier: dict[int, list[int]] = {}
    for i, leaves in zip(touched.tolist(), forest.leaves(unit[touched]), strict=True):
        for x in leaves.tolist():
            if x >= here:
                break
            earlier.setdefault(x, []).append(i)
    counted = near.copy()
    for members in earlier.values():
        if len(members) > 1:
            m = np.array(members)
            if split:
                counted[np.ix_(m[m < split], m[m >= split] - split)] = False
            else:
                counted[np.ix_(m, m)] = False
    np.add.at(links, a, counted @ weights[b])
    if split:
        np.add.at(links, b, weights[a] @ counted)
    # components of what is near here, by taking the smallest root of the neighbours until nothing changes
    left, right = a[ra], b[ca]
    while True:
        before = root.copy()
        low = np.minimum(root[left], root[right])
        np.minimum.at(root, left, low)
        np.minimum.at(root, right, low)
        root = root[root]
        if (root == before).all():
            return links, root


def vector_groups(
    table: DataFrame,
    vector: str = "embedding",
    id_col: str = "vec_id",
    threshold: float = 0.9,
    recall: float = 0.995,
    leaf: int = 1_024,
    sample: int = 32_768,
    block: int = 2_048,
    seed: int = 17,
) -> DataFrame:
    """Every row of table with its links and component: (id, n_links, component_id, kept).

    n_links counts the other rows with cosine >= threshold that the forest finds (copies of the same vector included),
    component_id is the smallest id reachable over links, itself included.  Null or zero vectors, those with null or
    non-finite components, and those of another length than most link with nothing and form their own component.
    Ids may be of any type that orders; rows that repeat an id are rows of their own; a null id names a component only
    where no member has another.  An empty table gives no rows.

    The forest is fitted on at most `sample` distinct vectors, those with the smallest hashes; all rows are indexed.
    Depth and number of trees follow from the number of vectors (plan_forest).
    """
    spark = table.sparkSession
    kind = table.schema[vector].dataType.elementType.simpleString()
    kind = kind if kind == "float" else "double"
    rows = table.select(F.col(id_col).alias("id"), F.col(vector).cast(f"array<{kind}>").alias("v")).withColumn("ok", F.coalesce(usable("v"), F.lit(False)))
    rows = written(rows, "vectors")
    sizes = rows.where("ok").groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim = sizes["d"] if sizes else 0
    fine = F.col("ok") & (F.size("v") == dim)
    keyed = rows.where(fine).select("id", F.transform("v", lambda x: x + F.lit(0).cast(kind)).alias("key"))
    classes = keyed.groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("copies"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    chosen = classes.orderBy(F.xxhash64("key")).limit(sample).select("key").toPandas()["key"]
    fit = unit_rows(list(chosen), dim)[1] if dim else np.zeros((0, 1))
    trees, depth, spill = plan_forest(classes.count(), leaf, threshold, recall)
    shared = spark.sparkContext.broadcast(fit_forest(fit, trees, depth, spill, seed))  # bounded by the sample
    width = np.dtype(np.float32 if kind == "float" else np.float64)

    @F.arrow_udf(StructType([StructField("raw", BinaryType()), StructField("leaves", ArrayType(LongType()))]))
    def route(vectors: pa.Array) -> pa.Array:
        raw = vectors.flatten().to_numpy(zero_copy_only=False).astype(width).reshape(-1, dim)
        leaves = [x for at in range(0, len(raw), 1024) for x in shared.value.leaves(units(raw[at : at + 1024]))]
        return pa.StructArray.from_arrays([pa.array([r.tobytes() for r in raw], pa.binary()), pa.array(leaves, pa.list_(pa.int64()))], names=["raw", "leaves"])

    routed = written(classes.select("node", "copies", route("key").alias("r")).select("node", "copies", "r.raw", "r.leaves"), "routed")
    counts = routed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count()
    large = counts.where(F.col("count") > block).select("leaf", F.ceil(F.col("count") / block).cast("int").alias("parts"))
    # a member of a leaf of p parts belongs to one part and visits each pair that its part is in
    placed = routed.select("node", "copies", "raw", F.explode("leaves").alias("leaf")).join(id_side(large, "leaves"), "leaf", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("node", "leaf"), F.col("parts")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    placed = placed.select("node", "copies", "raw", "leaf", "part", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))

    def leaf_pairs(key: tuple, members: pa.Table) -> pa.Table:
        here, low, high = (k.as_py() for k in key)
        members = members.sort_by([("part", "ascending"), ("node", "ascending")])
        unit = units(np.frombuffer(b"".join(members["raw"].to_pylist()), dtype=width).reshape(-1, dim))
        split = int(np.sum(members["part"].to_numpy() == low)) if low != high else 0
        node = members["node"].to_numpy()
        if low != high and split in (0, len(node)):
            links, root = np.zeros(len(node), dtype=np.int64), np.arange(len(node))
        else:
            links, root = _compare(unit, members["copies"].to_numpy(), shared.value, here, split, threshold)
        keep = (links > 0) | (root != np.arange(len(node)))
        return pa.table({"node": node[keep], "links": links[keep], "root": node[root[keep]]})

    found = written(placed.groupBy("leaf", "low", "high").applyInArrow(leaf_pairs, "node long, links long, root long"), "links")
    linked = found.groupBy("node").agg(F.sum("links").alias("links"))
    parts = connected_components(found.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v")))
    group = classes.join(linked, "node", "left").join(parts, "node", "left")
    group = written(group.select("key", "first", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("part")), "groups")
    firsts = written(group.groupBy("part").agg(F.min("first").alias("component_id")), "firsts")
    named = written(group.join(firsts, "part").select("key", "n_links", "component_id"), "named")
    for t in (classes, routed, found, group, firsts):
        drop_written(t)
    inside = keyed.join(named, "key").select("id", "n_links", "component_id")
    alone = rows.where(~fine).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return inside.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
