"""Merkle manifest of a dataset: an append log of tree nodes in postorder, proofs read from it by closed-form addresses.

Rows become leaves; the leaves of a group (here a source) ascend by id and form a tree of fan-out 16, and the roots of
the groups form one more tree of the same kind.  Builders take aligned blocks of 16**LEVELS leaves, a task many blocks,
and append nodes as they complete: a leaf, then each node that it closes.  A node's place in that log follows from the
number of leaves alone (`address`), so nothing is searched for: a proof names its siblings by position.  Blocks' top
nodes are the leaves of the next round of builders.  Proofs go the other way: the few blocks of the top round hand each
of their elements its siblings up to the root, and the round below appends its own in front.

Numbering is a range sort and a count per partition; no group is ever gathered in one task, whatever its share.

Cases: a null field is `-`; rows with a null id come first, equal ids are ordered by their leaves; repeated rows are
leaves of their own; a null group is a group, the first; a lone leaf is its group's root, a lone group's root the root;
an empty table has no root and gives no rows.  Columns that are not named are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructField, StructType

from dossierlake.llm.common import written

#: log2 of the fan-out: 16 children
BITS = 4
#: Levels that one builder closes: blocks of 256 elements
LEVELS = 2
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows of an Arrow batch handed back
ROWS = 4_096


# --- closed forms ------------------------------------------------------------------------------------------------


def height(n: int) -> int:
    """Levels above the leaves of a tree of n leaves."""
    h = 0
    while n > 1:
        n, h = -(-n // (1 << BITS)), h + 1
    return h


def address(level: int, number: int, n: int) -> int:
    """Place in postorder of a node, the number-th of its level (level 0: leaves), in a tree of n leaves.

    The node follows its last leaf e and the nodes below it that e closes; before e stand e leaves and, of each level k
    above, the e >> 4k nodes that were full by then.
    """
    e = min((number + 1) << (BITS * level), n) - 1
    place, full = e + level, e >> BITS
    while full:
        place, full = place + full, full >> BITS
    return place


def run_of(level: int, number: int, n: int) -> tuple[int, int]:
    """(first number, members) of the run that holds a node of a level."""
    there = -(-n // (1 << (BITS * level)))
    first = number >> BITS << BITS
    return first, min(1 << BITS, there - first)


def steps(number: int, n: int) -> Iterator[tuple[int, int]]:
    """(place within its run, members of the run) of a leaf and of each of its ancestors below the root."""
    for level in range(height(n)):
        first, members = run_of(level, number, n)
        yield number - first, members
        number >>= BITS


def combine(digests: str) -> str:
    return sha256(digests.encode()).hexdigest()


def fold(digest: str, siblings: str, path: Iterable[tuple[int, int]]) -> str:
    """The root that a leaf and its siblings, concatenated level by level, lead to."""
    at = 0
    for place, members in path:
        cut, end = at + 64 * place, at + 64 * (members - 1)
        digest, at = combine(siblings[at:cut] + digest + siblings[cut:end]), end
    return digest


# --- leaves and their numbers ------------------------------------------------------------------------------------


def leaf_digest(fields: Iterable[Column]) -> Column:
    """Digest of a row: each field `-` if null, else its UTF-8 byte count, a colon and its value."""
    texts = [c.cast("string") for c in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def ranked(rows: DataFrame, keys: list[str], tag: str) -> DataFrame:
    """rows plus rank, 0 and up in the order of the keys (null first), written: a range sort and a count per partition."""
    order = [F.col(k).asc_nulls_first() for k in keys]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = placed.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    placed = written(placed, tag)
    # a number per partition of the sort
    before, total = [], 0
    for part, n in sorted(map(tuple, placed.groupBy("part").count().collect())):
        before.append((part, total))
        total += n
    offsets = placed.sparkSession.createDataFrame(before, "part int, before long")
    return placed.join(F.broadcast(offsets), "part").withColumn("rank", F.col("at") + F.col("before")).drop("part", "at", "before")


# --- workers -----------------------------------------------------------------------------------------------------


def _blocks(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Consecutive rows that agree in their first columns; a block is bounded by its 16**LEVELS elements and their nodes."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:keys] != key:
                if rows:
                    yield key, rows
                key, rows = row[:keys], []
            rows.append(row[keys:])
    if rows:
        yield key, rows


def _batches(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    for row in rows:
        held.append(row)
        if len(held) >= ROWS:
            yield batch()
            held = []
    if held:
        yield batch()


NODE = "gid long, block long, level int, position long, number long, n long, digest binary"


def _builder(base: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Worker of a round whose elements are the nodes of level `base`."""
    schema = pa.schema([("gid", pa.int64()), ("block", pa.int64()), ("level", pa.int32()), ("position", pa.int64()), ("number", pa.int64()), ("n", pa.int64()), ("digest", pa.binary())])

    def nodes(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        for (gid, block, n), rows in _blocks(batches, 3):
            top, last = min(LEVELS, height(n) - base), -(-n // (1 << (BITS * base))) - 1
            pending: list[list[str]] = [[] for _ in range(top + 1)]
            for number, digest in rows:
                if base == 0:
                    yield gid, block, 0, address(0, number, n), number, n, digest
                pending[0].append(digest.hex())
                for up in range(1, top + 1):
                    if (number + 1) & ((1 << (BITS * up)) - 1) and number != last:
                        break
                    closed, pending[up - 1] = combine("".join(pending[up - 1])), []
                    pending[up].append(closed)
                    above = number >> (BITS * up)
                    yield gid, block, base + up, address(base + up, above, n), above, n, bytes.fromhex(closed)

    return lambda batches: _batches(nodes(batches), schema)


def _siblings(base: int, rows: list[tuple], n: int) -> Callable[[int], str]:
    """For an element's number: its siblings within the block, level by level, taken from the block's log by address."""
    log = {at: digest for kind, at, digest, *_ in rows if kind == 1}
    runs: dict[tuple[int, int], str] = {}

    def of(number: int) -> str:
        out = []
        for level in range(base, min(base + LEVELS, height(n))):
            first, members = run_of(level, number, n)
            text = runs.get((level, first))
            if text is None:
                text = runs[level, first] = "".join(log[address(level, first + k, n)].hex() for k in range(members))
            place = 64 * (number - first)
            out.append(text[:place] + text[place + 64 :])
            number >>= BITS
        return "".join(out)

    return of


# --- the trees ---------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Trees:
    """The logs of the rounds of builders, (gid, block, level, position, number, n, digest), and the largest height."""

    logs: list[DataFrame]
    rounds: int

    def roots(self) -> DataFrame:
        """(gid, n, digest) of each tree: the node of its last address."""
        out = None
        for r, log in enumerate(self.logs):
            # a tree's top stands in the round that closes it, that of a lone leaf in the first
            tops = log.where((F.col("number") == 0) & (F.col("n") <= F.expr(f"shiftleft(1L, {BITS} * level)")) & ((F.col("level") == 0) | (F.col("n") > F.expr(f"shiftleft(1L, {BITS} * (level - 1))"))))
            tops = tops.select("gid", "n", "digest")
            out = tops if r == 0 else out.unionByName(tops)
        return out


def build(elements: DataFrame, largest: int, tag: str) -> Trees:
    """Append logs of the trees over elements (gid, number, n, digest); n is the size of the tree, the largest known."""
    rounds = max(1, -(-height(largest) // LEVELS))
    logs: list[DataFrame] = []
    for r in range(rounds):
        base = r * LEVELS
        if r:
            elements = logs[-1].where(F.col("level") == base).where(F.col("n") > 1 << (BITS * base)).select("gid", "number", "n", "digest")
        blocks = elements.select("gid", F.expr(f"shiftright(number, {BITS * LEVELS})").alias("block"), "n", "number", "digest")
        blocks = blocks.repartition("gid", "block").sortWithinPartitions("gid", "block", "number")
        logs.append(written(blocks.mapInArrow(_builder(base), NODE), tag))
    return Trees(logs, rounds)


UPPER = "gid long, block long, n long, siblings string, top string"


def prove(trees: Trees, above: DataFrame, leaves: DataFrame, leaf_round: Callable, kind: StructType) -> DataFrame:
    """Proofs of the leaves, by rounds from the top.

    above: (gid, n, siblings, top), what stands above each tree's root and the root's digest.  leaves: (gid, number, n,
    id, shown).  leaf_round makes the rows of the last round from (gid, n, upper siblings, top, rows of leaves, siblings
    within the block).
    """
    top = above.select("gid", "n", "siblings", "top", F.lit(0).cast("long").alias("block"))
    empty, ident = F.lit(None), leaves.schema["id"].dataType
    for r in reversed(range(trees.rounds)):
        base = r * LEVELS
        nodes = trees.logs[r] if r == 0 else trees.logs[r].unionByName(trees.logs[r - 1].where(F.col("level") == base).withColumn("block", F.expr(f"shiftright(number, {BITS * LEVELS})")))
        high = F.col("n") > (1 << (BITS * base)) if r else F.lit(True)
        wanted = leaves if r == 0 else trees.logs[r - 1].where(F.col("level") == base).select("gid", "number", "n", empty.cast(ident).alias("id"), empty.cast("binary").alias("shown"))
        # trees too low for this round pass their upper row on
        now, low = top.where(high), top.where(~high)
        rows = (
            now.select("gid", "block", "n", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("at"), empty.cast("binary").alias("digest"), empty.cast(ident).alias("id"), "siblings", "top")
            .unionByName(nodes.where(high).select("gid", "block", "n", F.lit(1).alias("kind"), F.col("position").alias("at"), "digest", empty.cast(ident).alias("id"), empty.cast("string").alias("siblings"), empty.cast("string").alias("top")))
            .unionByName(wanted.where(high).select("gid", F.expr(f"shiftright(number, {BITS * LEVELS})").alias("block"), "n", F.lit(2).alias("kind"), F.col("number").alias("at"), F.col("shown").alias("digest"), "id", empty.cast("string").alias("siblings"), empty.cast("string").alias("top")))
        )
        rows = rows.repartition("gid", "block").sortWithinPartitions("gid", "block", "kind", "at")
        if r:
            made = rows.mapInArrow(_prover(base, _upper_rows, _arrow(StructType.fromDDL(UPPER))), UPPER)
            top = made.unionByName(low)
        else:
            return rows.mapInArrow(_prover(0, leaf_round, _arrow(kind)), kind)
    raise AssertionError("a tree has at least one round")


def _arrow(kind: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(kind)


def _prover(base: int, make: Callable, schema: pa.Schema) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def proofs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        for (gid, _, n), rows in _blocks(batches, 3):
            upper, top = next((r[4], r[5]) for r in rows if r[0] == 0)
            yield from make(gid, n, upper, top, [(at, digest, ident) for kind, at, digest, ident, *_ in rows if kind == 2], _siblings(base, rows, n), rows)

    return lambda batches: _batches(proofs(batches), schema)


def _upper_rows(gid: int, n: int, upper: str, top: str, wanted: list[tuple], siblings: Callable[[int], str], _: list[tuple]) -> Iterator[tuple]:
    for number, _shown, _id in wanted:
        yield gid, number, n, siblings(number) + upper, top


# --- manifest of a table -----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Manifest:
    """Leaves (gid, number, n, id, leaf, shown), groups (group, gid, n), their trees, the tree of groups, and the root."""

    leaves: DataFrame
    groups: DataFrame
    trees: Trees
    over: Trees
    n_groups: int
    root: str


def manifest(docs: DataFrame, fields: Iterable[str] = FIELDS, id_col: str = "doc_id", group: str = "source", tampered: Callable[[DataFrame], Column] | None = None) -> Manifest | None:
    """Build the trees over a table; None if it is empty.

    tampered: the digest that a row shows when it is checked, null where it shows its own leaf.
    """
    cols = [F.col(f) for f in fields]
    shown = tampered(docs) if tampered else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.col(group).alias("grp"), F.unhex(leaf_digest(cols)).alias("leaf"), F.unhex(shown).alias("shown"))
    leaves = ranked(written(rows.withColumn("tie", F.monotonically_increasing_id()), "leaves"), ["grp", "id", "leaf", "tie"], "ranked").drop("tie")
    groups = leaves.groupBy("grp").agg(F.min("rank").alias("start"), F.count("*").alias("n"))
    groups = ranked(written(groups, "groups"), ["start"], "groups").withColumnRenamed("rank", "gid")
    size = groups.agg(F.count("*").alias("k"), F.max("n").alias("n")).first()
    if not size["k"]:
        return None
    side = groups.withColumnRenamed("grp", "g")
    leaves = leaves.join(side, F.col("grp").eqNullSafe(F.col("g"))).select("gid", (F.col("rank") - F.col("start")).alias("number"), "n", "id", "leaf", "shown")
    trees = build(leaves.select("gid", "number", "n", F.col("leaf").alias("digest")), size["n"], "log")
    roots = trees.roots()
    over = build(roots.select(F.lit(0).cast("long").alias("gid"), F.col("gid").alias("number"), F.lit(size["k"]).cast("long").alias("n"), "digest"), size["k"], "rootlog")
    root = over.roots().first()["digest"].hex()
    return Manifest(leaves, groups, trees, over, size["k"], root)


PROOF = [("leaf", StringType()), ("subroot", StringType()), ("root", StringType()), ("proof_sha256", StringType()), ("folded_root", StringType()), ("verified", BooleanType()), ("n_siblings", IntegerType())]


def verified_proofs(made: Manifest) -> DataFrame:
    """A row per leaf: id, leaf, subroot, root, proof_sha256, folded_root, verified, n_siblings.

    The folded root is recomputed from the digest that the row shows and the siblings in its proof.
    """
    n_groups, root = made.n_groups, made.root
    subroots = made.trees.roots().select(F.lit(0).cast("long").alias("gid"), F.col("gid").alias("number"), F.lit(n_groups).cast("long").alias("n"), F.struct("n", "gid").alias("id"), F.col("digest").alias("shown"))
    lone = made.trees.roots().schema["n"].dataType
    ident = StructType([StructField("n", lone), StructField("gid", LongType())])

    def group_rows(gid: int, n: int, upper: str, top: str, wanted: list[tuple], siblings: Callable, _: list[tuple]) -> Iterator[tuple]:
        for number, shown, at in wanted:
            yield number, at["n"], siblings(number) + upper, shown.hex()

    above = StructType([StructField("gid", LongType()), StructField("n", LongType()), StructField("siblings", StringType()), StructField("top", StringType())])
    first = made.leaves.sparkSession.createDataFrame([(0, n_groups, "", root)], above)
    subroots = subroots.withColumn("id", F.col("id").cast(ident))
    over = written(prove(made.over, first, subroots, group_rows, above), "above")

    def leaf_rows(gid: int, n: int, upper: str, top: str, wanted: list[tuple], siblings: Callable, rows: list[tuple]) -> Iterator[tuple]:
        log = {at: digest for kind, at, digest, *_ in rows if kind == 1}
        higher = list(steps(gid, n_groups))
        for number, shown, ident in wanted:
            leaf, proof = log[address(0, number, n)].hex(), siblings(number) + upper
            folded = fold(shown.hex() if shown is not None else leaf, proof, [*steps(number, n), *higher])
            yield ident, leaf, top, root, combine(proof), folded, folded == root, len(proof) // 64

    kind = StructType([StructField("id", made.leaves.schema["id"].dataType), *(StructField(k, t) for k, t in PROOF)])
    return prove(made.trees, over, made.leaves.select("gid", "number", "n", "id", "shown"), leaf_rows, kind)


def case_folded(docs: DataFrame) -> Column:
    """Leaf of a row whose text lost its capitals A to Z, where 5 divides the CRC-32 of its id; null elsewhere."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, leaf_digest([lower if f == "text" else F.col(f) for f in FIELDS]))


def merkle_digest(docs: DataFrame) -> DataFrame:
    """Proof of every row of a table against its root, some shown with a tampered text."""
    made = manifest(docs, tampered=case_folded)
    if made is None:
        kind = StructType([StructField("doc_id", docs.schema["doc_id"].dataType), *(StructField(k, t) for k, t in PROOF)])
        return docs.sparkSession.createDataFrame([], kind)
    return verified_proofs(made).withColumnRenamed("id", "doc_id")
