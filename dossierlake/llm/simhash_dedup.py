"""SimHash near-duplicates through a segment-popcount embedding.

A fingerprint is cut into 2-bit segments and mapped to their bit counts.  The Manhattan distance of two such vectors
never exceeds the Hamming distance of the fingerprints, so a range join under it loses no link.  With links at three
or fewer differing bits, one of the two 32-bit halves has distance one at most: each half is a grid of unit cells,
where a fingerprint visits its own cell and, if its bit count is odd, the neighbouring cells, so that two
fingerprints one apart always meet (their counts differ in parity).  Pairs that meet are verified by exact Hamming
distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from dossierlake.llm.common import connected_components, drop_written, id_side, small_batches, written

#: ASCII white space of the word definition [^\x20\x09-\x0D]+
SPACES = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Whole text to its words, A-Z lower-cased; null and blank texts have none."""
    whole = F.coalesce(text, F.lit(""))
    # in ASCII texts lower() changes A-Z alone, at a fraction of the time
    low = F.when(F.length(whole) == F.octet_length(whole), F.lower(whole)).otherwise(F.translate(whole, UPPER, LOWER))
    return F.filter(F.split(low, SPACES, -1), lambda w: w != "")


def shingle_hashes(tokens: Column, size: int) -> Column:
    """XXH64 (seed 42) of each run of `size` words, repeats included; fewer words give one shingle, none give none."""
    n = F.size(tokens)
    starts = F.when(n > 0, F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda at: F.xxhash64(F.array_join(F.slice(tokens, at, size), " ")))


def majority_bits(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in more than half of the hashes; no hashes give 0."""
    ones, h = np.zeros(64, dtype=np.int64), np.ascontiguousarray(hashes, dtype="<i8").view(np.uint8).reshape(-1, 8)
    for at in range(0, len(h), 1 << 16):  # bounded memory for very long texts
        ones += np.unpackbits(h[at : at + (1 << 16)], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<i8")[0])


def _each(hashes: pa.Array) -> Iterator[np.ndarray]:
    """The rows of an array of arrays of longs."""
    flat, ends = hashes.flatten().to_numpy(zero_copy_only=False), np.cumsum(pc.list_value_length(hashes).to_numpy(zero_copy_only=False)).tolist()
    return (flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True))


@F.arrow_udf(LongType())
def majority(hashes: pa.Array) -> pa.Array:
    return pa.array([majority_bits(h) for h in _each(hashes)], pa.int64())


def fingerprints(docs: DataFrame, text: str = "text", id_col: str = "doc_id", shingle: int = 3) -> DataFrame:
    """(id, fp long) of every row; null and blank texts have fingerprint zero."""
    tokens = docs.select(F.col(id_col), words(F.col(text)).alias("w"))  # a column of its own: a lambda would split again for each element
    return tokens.select(id_col, majority(shingle_hashes(F.col("w"), shingle)).alias("fp"))


def _cells(fp: Column, half: int) -> Column:
    """Unit grid cells that a fingerprint visits in one half: its own, and its neighbours if its bit count is odd.

    The bit counts (0, 1 or 2) of the 16 segments are packed back into 2 bits each; the last bit names the half.
    """
    bits = F.shiftrightunsigned(fp, 32 * half).bitwiseAND(F.lit(0xFFFFFFFF))
    even = F.lit(0x55555555)
    own = bits.bitwiseAND(even) + F.shiftright(bits, 1).bitwiseAND(even)
    count = [F.shiftright(own, 2 * i).bitwiseAND(F.lit(3)) for i in range(16)]
    steps = [F.when(c < 2, own + F.lit(1 << (2 * i))) for i, c in enumerate(count)] + [F.when(c > 0, own - F.lit(1 << (2 * i))) for i, c in enumerate(count)]
    near = F.when(F.bit_count(bits) % 2 == 1, F.array(own, *steps)).otherwise(F.array(own))
    return F.transform(F.array_compact(near), lambda c: c * 2 + half)


def hamming_links(prints: DataFrame, radius: int = 3) -> DataFrame:
    """Pairs (u, v), u < v as signed longs, of distinct fingerprints `fp` at Hamming distance <= radius.

    prints has one row per distinct fp.  The radius must be 3 or less: two halves then leave one at distance <= 1.
    A pair that meets in several cells is repeated; the components do not mind.
    """
    if radius > 3:
        raise ValueError("the two-half grid is complete up to radius 3")
    visits = prints.select("fp", F.explode(F.concat(_cells(F.col("fp"), 0), _cells(F.col("fp"), 1))).alias("cell"))
    a, b = visits.select(F.col("fp").alias("u"), "cell"), visits.select(F.col("fp").alias("v"), "cell")
    near = (F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius)
    return a.join(b, "cell").where(near).select("u", "v")


def simhash_groups(docs: DataFrame, text: str = "text", id_col: str = "doc_id", shingle: int = 3, radius: int = 3) -> DataFrame:
    """Every row of docs with its fingerprint and group: (id, fp long, fingerprint hex, component_id).

    component_id is the smallest id reachable over links of `radius` or fewer differing bits, itself included.
    Copies share a fingerprint and are collapsed before any pair is formed, so a huge group of copies costs one row
    in the join.  Empty and null texts share fingerprint zero and are linked like any other.  Repeated ids keep all
    their rows; a null id stays a row but never names a group unless its whole group has none; no rows give no rows.
    """
    small_batches(docs.sparkSession)
    prints = written(fingerprints(docs, text, id_col, shingle), "simhash")
    classes = written(prints.groupBy("fp").agg(F.min(id_col).alias("first_id")), "classes")
    parts = connected_components(hamming_links(classes, radius))
    group = classes.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("part", F.coalesce("component", "fp"))
    group = written(group.select("fp", "part", "first_id"), "groups")
    heads = written(group.groupBy("part").agg(F.min("first_id").alias("component_id")), "heads")
    named = written(group.join(heads, "part").select("fp", "component_id"), "named")
    for t in (classes, group, heads):
        drop_written(t)
    return prints.join(named, "fp").select(id_col, "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Documents up to which all pairs of one key are formed as rows, and documents of a block where more hold it.
FEW, BLOCK = 100, 400
#: One document of SHARE is counted to order the shingles, and at most FREQUENT of them are kept as frequent ones.  Any
#: order loses no pair; a good one makes fewer candidates.
SHARE, FREQUENT = 16, 200_000
#: Odd constants of the shingle hash (those of the splitmix64 generator)
MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], dtype=np.uint64)


def word_hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def shingle_set(hashes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of `size` words, given as hashes; fewer words give one, none give none."""
    x = np.ascontiguousarray(hashes, dtype=np.int64).view(np.uint64)
    size = min(size, len(x))
    if not size:
        return np.zeros(0, dtype=np.int64)
    out = x[: len(x) - size + 1].copy()
    for k in range(1, size):
        out = out * MIX[0] + x[k : len(x) - size + 1 + k]
    out = (out ^ (out >> np.uint64(30))) * MIX[1]
    out = (out ^ (out >> np.uint64(27))) * MIX[2]
    return np.unique((out ^ (out >> np.uint64(31))).view(np.int64))


def parity(members: np.ndarray) -> np.ndarray:
    """The set's parity vector as longs: 2n to 4n bits for n members, a power of two, 64 at least."""
    width = max(64, 1 << (2 * len(members) - 1).bit_length())
    return np.packbits(np.bincount(members & (width - 1), minlength=width) & 1, bitorder="little").view("<i8")


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *(len(x) for x in parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *parts])))


def distinct_shingles(size: int):
    """UDF of word hashes: the shingle set."""

    @F.arrow_udf(ArrayType(LongType()))
    def shingles(hashes: pa.Array) -> pa.Array:
        return _lists([shingle_set(h, size) for h in _each(hashes)])

    return shingles


def frequent_shingles(tokens: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the shingles that more than three documents of a sample hold, and those numbers; at most FREQUENT."""
    part = tokens.where(F.pmod(F.xxhash64("id"), F.lit(SHARE)) == 0)
    each = part.select(F.explode_outer(distinct_shingles(shingle)(F.col("h"))).alias("h")).where("h is not null")
    top = each.groupBy("h").agg(F.count("*").alias("n")).where("n > 3").orderBy(F.desc("n"), "h").limit(FREQUENT).toPandas().sort_values("h")
    return top["h"].to_numpy(np.int64), top["n"].to_numpy(np.int64)


def sketcher(frequent: tuple[np.ndarray, np.ndarray], shingle: int, similarity: float):
    """UDF of a text's word hashes: number of distinct shingles, their SimHash, their parity vector, and keys.

    The keys are the first n - ceil(similarity * n) + 1 of n distinct shingles, rarest first, then by hash: two sets
    at the similarity share at least ceil(similarity * n) for either n, so that their keys have one in common.
    A bit of the parity vector tells whether an odd number of shingles falls on it; two vectors differ in no more bits
    than the sets differ in members.
    """
    known, often = frequent

    @F.arrow_udf(StructType([StructField("n", IntegerType()), StructField("fp", LongType()), StructField("odd", ArrayType(LongType())), StructField("keys", ArrayType(LongType()))]))
    def sketch(hashes: pa.Array) -> pa.Array:
        sizes, prints, odd, keys = [], [], [], []
        for h in _each(hashes):
            x = shingle_set(h, shingle)
            sizes.append(len(x))
            prints.append(majority_bits(x))
            odd.append(parity(x) if len(x) else x)
            take = len(x) - ceil(similarity * len(x) - 1e-9) + 1 if len(x) else 0
            if len(known) and len(x):
                at = np.minimum(np.searchsorted(known, x), len(known) - 1)
                x = x[np.argsort(np.where(known[at] == x, often[at], 0), kind="stable")]
            keys.append(x[:take])
        return pa.StructArray.from_arrays([pa.array(sizes, pa.int32()), pa.array(prints, pa.int64()), _lists(odd), _lists(keys)], names=["n", "fp", "odd", "keys"])

    return sketch


def _shared_keys(sketches: DataFrame) -> DataFrame:
    """(key, node, n, holders) of the keys that several nodes have: counted by partial sums, then joined back."""
    keyed = sketches.select("node", "n", F.explode("keys").alias("key"))
    sizes = written(keyed.groupBy("key").agg(F.count("*").alias("holders")).where("holders > 1"), "sizes")
    shared = written(keyed.join(sizes, "key"), "shared")
    drop_written(sizes)
    return shared


def _fits(similarity: float) -> Column:
    return F.least("n_u", "n_v") >= similarity * F.greatest("n_u", "n_v")


def _first_pairs(heads: DataFrame, shared: DataFrame, similarity: float) -> DataFrame:
    """(u, v): pairs within three bits of each other's SimHash, and each holder of a key with the key's first one."""
    prints = written(heads.groupBy("fp").agg(F.min("node").alias("first")), "prints")
    near = hamming_links(prints)
    ends = [prints.select(F.col("fp").alias(x), F.col("first").alias(f"first_{x}")) for x in "uv"]
    near = near.join(ends[0], "u").join(ends[1], "v").select(F.col("first_u").alias("u"), F.col("first_v").alias("v"))
    equal = heads.join(prints, "fp").select(F.col("first").alias("u"), F.col("node").alias("v"))
    firsts = written(shared.groupBy("key").agg(F.min(F.struct("node", "n")).alias("f")), "firsts")
    star = shared.join(firsts, "key").select(F.col("f.node").alias("u"), F.col("f.n").alias("n_u"), F.col("node").alias("v"), F.col("n").alias("n_v"))
    every = near.unionByName(equal).unionByName(star.where(_fits(similarity)).select("u", "v"))
    pairs = written(every.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "first-pairs")
    drop_written(prints)
    drop_written(firsts)
    return pairs


def _possible(pairs: DataFrame, heads: DataFrame, similarity: float) -> DataFrame:
    """Pairs whose sizes and parity vectors leave the similarity possible; no pair that reaches it is lost."""
    side = lambda x: heads.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("odd").alias(f"odd_{x}"))
    both = pairs.join(side("u"), "u").join(side("v"), "v")
    total = F.col("n_u") + F.col("n_v")
    least = F.ceil(total * (similarity / (1 + similarity)) - 1e-9)
    # sizes that fit differ by one doubling of the width at most: the wider vector is folded onto itself
    xor = lambda a, b: a.bitwiseXOR(b)
    folded = lambda x: F.zip_with(F.slice(x, F.lit(1), (F.size(x) / 2).cast("int")), F.slice(x, (F.size(x) / 2).cast("int") + 1, (F.size(x) / 2).cast("int")), xor)
    narrow = lambda x, y: F.when(F.size(x) > F.size(y), folded(F.col(x))).otherwise(F.col(x))
    differ = F.aggregate(F.zip_with(narrow("odd_u", "odd_v"), narrow("odd_v", "odd_u"), xor), F.lit(0), lambda s, x: s + F.bit_count(x))
    return written(both.where(_fits(similarity)).where(differ <= total - 2 * least).select("u", "v"), "possible")


def _sets(rows: DataFrame, heads: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """(node, s): whole shingle sets of some nodes, from their texts."""
    wanted = id_side(heads.join(nodes.distinct(), "node", "left_semi").select("id", "body", "node"), "wanted")
    kept = rows.join(wanted, ["id", "body"]).select("node", word_hashes(F.col("text")).alias("h"))
    sets = written(kept.select("node", distinct_shingles(shingle)(F.col("h")).alias("s")).dropDuplicates(["node"]), "sets")
    drop_written(wanted)
    return sets


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs whose shingle sets have a Jaccard similarity of at least `similarity`."""
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("s").alias("su")), "u").join(sets.select(F.col("node").alias("v"), F.col("s").alias("sv")), "v")
    met = both.select("u", "v", F.size(F.array_intersect("su", "sv")).alias("m"), (F.size("su") + F.size("sv")).alias("t"))
    return written(met.where(F.col("m") >= similarity * (F.col("t") - F.col("m"))).select("u", "v"), "links")


def _open_keys(shared: DataFrame, links: DataFrame) -> DataFrame:
    """shared plus `group`, of the keys whose holders are not one group yet."""
    parts = written(connected_components(links), "parts")
    held = written(shared.join(parts, "node", "left").select("key", "node", "n", "holders", F.coalesce("component", "node").alias("group")), "held")
    keys = written(held.groupBy("key").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low < high").select("key"), "open-keys")
    rows = written(held.join(keys, "key"), "open")
    for t in (parts, held, keys):
        drop_written(t)
    return rows


def _few_pairs(rows: DataFrame, similarity: float) -> DataFrame:
    """(u, v), u < v: all pairs of different groups that share a key of at most FEW holders."""
    few = rows.where(F.col("holders") <= FEW)
    a, b = (few.select("key", *[F.col(c).alias(f"{c}_{x}") for c in ("node", "n", "group")]) for x in "uv")
    pairs = a.join(b, "key").where((F.col("node_u") < F.col("node_v")) & (F.col("group_u") != F.col("group_v")) & _fits(similarity))
    return written(pairs.select(F.col("node_u").alias("u"), F.col("node_v").alias("v")).distinct(), "pairs")


def _cells_that_meet(member: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(placed, sides): each member's cell, and the cells of each comparison.

    A crowd's members are parted by size (a factor of 1 / similarity a step, so that only neighbouring steps can be
    similar), then by group where it has BLOCK members or more (a group is not compared with itself), then by chance
    into blocks of about BLOCK.
    """
    big = member.groupBy("crowd", "step", "group").count().where(F.col("count") >= BLOCK).select("crowd", "step", "group", F.col("group").alias("lot"))
    member = member.join(big, ["crowd", "step", "group"], "left").withColumn("lot", F.coalesce("lot", F.lit(-1)))
    counts = member.groupBy("crowd", "step", "lot").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = written(member.join(counts, ["crowd", "step", "lot"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")), "placed")
    cells = counts.select("crowd", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "step", "lot")
    a, b = (cells.select("crowd", F.struct("step", "lot", "block").alias(x)) for x in "ab")
    meets = a.join(b, "crowd").where("a <= b and b.step - a.step <= 1 and not (a.lot = b.lot and a.lot >= 0)")
    meets = written(meets.withColumn("unit", F.monotonically_increasing_id()), "meets")
    sides = F.when(F.col("a") == F.col("b"), F.array(F.struct(F.lit(2).alias("side"), F.col("a").alias("c"))))
    sides = sides.otherwise(F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("c")), F.struct(F.lit(1).alias("side"), F.col("b").alias("c"))))
    return placed, meets.select("unit", "crowd", F.explode(sides).alias("x")).select("unit", "crowd", "x.side", "x.c.step", "x.c.lot", "x.c.block")


def _crowd_links(rows: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links between different groups among the holders of crowded keys.

    Documents that share a crowded key, directly or through others, are a crowd; each crowd is compared once, whole,
    in pairs of blocks, a task each, so that no pair is left out and no row is made for a pair: a task hands on one
    edge for each two groups that it joins.
    """
    firsts = rows.groupBy("key").agg(F.min("node").alias("first"))
    crowds = written(connected_components(rows.join(firsts, "key").select(F.col("first").alias("u"), F.col("node").alias("v"))), "crowds")
    member = rows.select("node", "n", "group").distinct().join(crowds.withColumnRenamed("component", "crowd"), "node")
    member = member.withColumn("step", F.floor(F.log("n") / F.log(F.lit(1.0001 / similarity))).cast("int"))
    placed, sides = _cells_that_meet(member)
    placed = placed.join(sides, ["crowd", "step", "lot", "block"]).join(sets, "node").select("unit", "side", "node", "group", "s")

    def compare(rows: pa.Table) -> pa.Table:
        side, ids, group = rows["side"].to_numpy(), rows["node"].to_numpy(), rows["group"].to_numpy()
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        both = _overlaps(rows["s"].combine_chunks(), left, right)
        n = np.asarray(pc.list_value_length(rows["s"]).to_numpy())
        linked = both >= similarity * (n[left][:, None] + n[right][None, :] - both)
        root = {g: g for g in group.tolist()}

        def top(g: int) -> int:
            while root[g] != g:
                root[g] = root[root[g]]
                g = root[g]
            return g

        out = []
        for i, j in zip(*(x.tolist() for x in np.nonzero(linked & (group[left][:, None] != group[right][None, :]))), strict=True):
            a, b = top(int(group[left[i]])), top(int(group[right[j]]))
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((int(ids[left[i]]), int(ids[right[j]])))
        return pa.table({"u": pa.array([min(x) for x in out], pa.int64()), "v": pa.array([max(x) for x in out], pa.int64())})

    found = written(placed.groupBy("unit").applyInArrow(compare, "u long, v long"), "met")
    drop_written(crowds)
    return found


def _overlaps(sets: pa.Array, left: np.ndarray, right: np.ndarray, width: int = 4096) -> np.ndarray:
    """Numbers of common members of the sets at `left` and at `right`; only members of two sets or more take part."""
    sets = sets.chunk(0) if isinstance(sets, pa.ChunkedArray) else sets
    owner = np.repeat(np.arange(len(sets)), np.asarray(pc.list_value_length(sets).to_numpy(zero_copy_only=False)))
    _, member, count = np.unique(sets.flatten().to_numpy(zero_copy_only=False), return_inverse=True, return_counts=True)
    use = count[member] > 1
    owner, member = owner[use], (np.cumsum(count > 1) - 1)[member[use]]
    order = np.argsort(member, kind="stable")
    owner, member = owner[order], member[order]
    out = np.zeros((len(left), len(right)), dtype=np.float64)
    for at in range(0, int(member[-1]) + 1 if len(member) else 0, width):
        lo, hi = np.searchsorted(member, [at, at + width])
        m = np.zeros((len(sets), width), dtype=np.float32)
        m[owner[lo:hi], member[lo:hi] - at] = 1
        out += m[left] @ m[right].T
    return out


def _groups(docs: DataFrame, text: str, id_col: str, shingle: int, similarity: float) -> DataFrame:
    """(id, body, first_id, first_body) of every row with an id: itself and the first document of its group.

    A document is an id and a text; `body` is the hash of the text, so that rows that repeat an id with another text
    are documents of their own, and rows that repeat both are one.
    """
    small_batches(docs.sparkSession)
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("body"), F.col(text).alias("text"))
    tokens = rows.select("id", "body", word_hashes(F.col("text")).alias("h"))
    sketch = sketcher(frequent_shingles(tokens, shingle), shingle, similarity)
    # word sequences are equal if their hashes are: 128 bits of them
    same = F.unhex(F.md5(F.concat_ws(" ", F.col("h").cast("array<string>"))))
    made = tokens.select("id", "body", same.alias("same"), sketch(F.col("h")).alias("s"))
    every = written(made.select(F.monotonically_increasing_id().alias("node"), "id", "body", "same", "s.n", "s.fp", "s.odd", "s.keys"), "every")
    # one row for each word sequence; its number is the node
    heads = written(every.groupBy("same").agg(F.min(F.struct("id", "body", "node", "n", "fp", "odd")).alias("f")).select("same", "f.*"), "heads")
    some = heads.where("n > 0")
    chosen = id_side(some.select("node"), "chosen")
    shared = _shared_keys(every.join(chosen, "node", "left_semi").select("node", "n", "keys"))

    first = _first_pairs(some, shared, similarity)
    possible = _possible(first, some, similarity)
    sets = _sets(rows, some, possible.select(F.explode(F.array("u", "v")).alias("node")), shingle)
    links = [_verified(possible, sets, similarity)]
    done = [chosen, first, possible, sets]

    still = _open_keys(shared, links[0])
    pairs = _few_pairs(still, similarity)
    possible = _possible(pairs, some, similarity)
    crowded = written(still.where(F.col("holders") > FEW), "crowded")
    needed = possible.select(F.explode(F.array("u", "v")).alias("node")).unionByName(crowded.select("node"))
    sets = _sets(rows, some, needed, shingle)
    links.append(_verified(possible, sets, similarity))
    if not crowded.isEmpty():
        links.append(_crowd_links(crowded, sets, similarity))
    done += [still, pairs, possible, crowded, sets, shared]

    parts = written(connected_components(reduce(DataFrame.unionByName, links)), "parts")
    named = heads.join(parts, "node", "left").select("same", "id", "body", F.coalesce("component", "node").alias("group"))
    firsts = named.groupBy("group").agg(F.min(F.struct("id", "body")).alias("f"))
    named = named.join(firsts, "group").select("same", F.col("f.id").alias("first_id"), F.col("f.body").alias("first_body"))
    result = written(every.join(named, "same").select("id", "body", "first_id", "first_body").distinct(), "near")
    for t in (*done, *links, every, heads, parts):
        drop_written(t)
    return result


def near_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id, component_id) of every row: groups linked by a Jaccard similarity of word shingles of at least `similarity`.

    1. Equal word sequences are collapsed.
    2. SimHash fingerprints of the distinct shingles that the segment-popcount grid finds within three bits are
       candidates; so is each holder of a key (a prefix of the shingles, rarest first) with the key's first holder.
    3. A fingerprint at three bits does not find all pairs at the similarity, keys do.  So wherever the holders of a
       key are not one group yet, all pairs of different groups are candidates too: as rows where at most FEW hold
       it, in blocks, a task each, where more do.
    4. Candidates pass a lossless bound (sizes, and parity vectors, whose Manhattan distance never exceeds that of the
       sets), and are verified on the whole shingle sets.

    Texts without words are one group.  Rows with a null id are left out; rows that repeat an id with another text are
    documents of their own.  An empty table gives no rows.
    """
    groups = _groups(docs, text, id_col, shingle, similarity)
    return groups.select(F.col("id").alias(id_col), F.col("first_id").alias("component_id")).distinct()


def near_dedup(docs: DataFrame, text: str = "text", id_col: str = "doc_id", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one document of each near-duplicate group: that with the smallest id; columns unchanged.

    Rows that repeat both id and text are one document and stay or go together; rows with a null id stay.
    """
    groups = _groups(docs, text, id_col, shingle, similarity)
    gone = groups.where("id <> first_id or body <> first_body").select(F.col("id").alias("_gone_id"), F.col("body").alias("_gone_body")).distinct()
    gone = id_side(gone, "gone")
    same = (docs[id_col] == gone["_gone_id"]) & (F.xxhash64(F.coalesce(docs[text], F.lit(""))) == gone["_gone_body"])
    return docs.join(gone, same, "left_anti")
