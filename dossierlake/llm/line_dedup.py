"""Line dedup by pairwise alignment of overlapping documents.

1. Documents overlap where they share a line.  A rare line (held by few documents) pairs each holder with every
   earlier one; a common line pairs each holder with the earliest, so that pairs stay linear in lines however many
   documents hold it and each repeated line still meets its first holder.  A run of adjacent common lines that is just
   long enough to be a block also pairs each holder with the earliest holder of the run, since its lines may each have
   stood alone in some earlier document.
2. For each pair all lines that both hold are brought together and aligned by patience diff: lines that occur once on
   either side, longest increasing run of them, and the same again between those anchors.
3. Runs of aligned lines that stand together on both sides are blocks; blocks of at least `min_words` words are
   deleted from the later document (the one with the greater id).
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType

from dossierlake.llm.common import drop_written, small_batches, written

MIN_WORDS = 50
RARE = 8


def patience(left: dict[int, int], right: dict[int, int]) -> list[tuple[int, int]]:
    """Aligned (i, j) of two sequences given as position -> line number; positions without a line match nothing."""
    out: list[tuple[int, int]] = []
    todo = [(min(left, default=0), max(left, default=-1) + 1, min(right, default=0), max(right, default=-1) + 1)]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and left.get(a, -1) == right.get(c, -2):
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and left.get(b - 1, -1) == right.get(d - 1, -2):
            b, d = b - 1, d - 1
            out.append((b, d))
        if a >= b or c >= d:
            continue
        at: dict[int, list[int]] = {}
        for side, (lo, hi, seq) in enumerate(((a, b, left), (c, d, right))):
            for p in range(lo, hi) if hi - lo < 2 * len(seq) else sorted(p for p in seq if lo <= p < hi):
                if (k := seq.get(p)) is not None:
                    n = at.setdefault(k, [0, 0, 0, 0])
                    n[side] += 1
                    n[2 + side] = p
        pairs = sorted((n[2], n[3]) for n in at.values() if n[0] == n[1] == 1) or _by_turn(a, b, c, d, left, right)
        if not pairs:
            continue
        # longest increasing run of j
        tails: list[int] = []
        ends: list[int] = []
        back = [-1] * len(pairs)
        for x, (_, j) in enumerate(pairs):
            k = bisect_left(tails, j)
            back[x] = ends[k - 1] if k else -1
            tails[k:] = [j] if k == len(tails) else [j, *tails[k + 1 :]]
            ends[k:] = [x] if k == len(ends) else [x, *ends[k + 1 :]]
        chain, x = [], ends[-1]
        while x >= 0:
            chain.append(pairs[x])
            x = back[x]
        out += chain
        for (i, j), (i2, j2) in zip([(a - 1, c - 1), *chain[::-1]], [*chain[::-1], (b, d)], strict=True):
            todo.append((i + 1, i2, j + 1, j2))
    return sorted(out)


def _by_turn(a: int, b: int, c: int, d: int, left: dict[int, int], right: dict[int, int]) -> list[tuple[int, int]]:
    """Where no line stands once on both sides: the first of a line on one side with the first on the other, and so on."""
    turns: dict[int, tuple[list[int], list[int]]] = {}
    for side, (lo, hi, seq) in enumerate(((a, b, left), (c, d, right))):
        for p in range(lo, hi) if hi - lo < 2 * len(seq) else sorted(p for p in seq if lo <= p < hi):
            if (k := seq.get(p)) is not None:
                turns.setdefault(k, ([], []))[side].append(p)
    return sorted(pair for x, y in turns.values() for pair in zip(x, y, strict=False))


def common_blocks(later: list, earlier: list, words: list, raw: list, min_words: int) -> list[int]:
    """Raw line positions of the later document in aligned blocks of at least min_words words.

    Parallel lists, one entry a shared line: its positions among the non-blank lines of either document, its words,
    and its positions among all lines of the later document.
    """
    left = {p: k for k, ps in enumerate(later) for p in ps}
    right = {p: k for k, ps in enumerate(earlier) for p in ps}
    place = {p: r for ps, rs in zip(later, raw, strict=True) for p, r in zip(ps, rs, strict=True)}
    out, block, size, last = [], [], 0, None
    for i, j in [*patience(left, right), (None, None)]:
        if last is not None and (i, j) != (last[0] + 1, last[1] + 1):
            if size >= min_words:
                out += block
            block, size = [], 0
        if i is not None:
            block.append(place[i])
            size += words[left[i]]
        last = (i, j)
    return out


def run_hashes(at: list[int], keys: list[int], words: list[int], min_words: int) -> list[bytes]:
    """Hashes of the shortest runs of adjacent lines with min_words words, from each line on and up to each line.

    Together they cover every line of a longer block.  at: sorted positions; keys and words: their lines.
    """
    out, n = set(), len(at)
    for step in (1, -1):
        lo, size = 0, 0
        order = range(n)[::step]
        for k, x in enumerate(order):
            if k and at[x] != at[order[k - 1]] + step:
                lo, size = k, 0
            size += words[x]
            while size >= min_words:
                a, b = sorted((order[lo], x))
                out.add((a, b))
                size -= words[order[lo]]
                lo += 1
    return list({blake2b(b"".join(k.to_bytes(8, "little", signed=True) for k in keys[a : b + 1]), digest_size=16).digest() for a, b in out})


#: Lines handed on together by a task.
LINES = 20_000
#: Documents, and line numbers in all, up to which the lines to delete are broadcast to the texts.
FEW_DOCS, FEW_NUMBERS = 500_000, 4_000_000


def lines_of(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc struct<id, body>, key, at, raw, words): each different line of a document with an id, and where it stands.

    at counts non-blank lines, raw all lines, from 0; body is the hash of the text, so that rows that repeat an id with
    another text are documents of their own.
    """
    doc = F.struct(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("body"))
    rows = docs.where(F.col(id_col).isNotNull() & F.col(text).isNotNull()).select(doc.alias("doc"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, keys, ats, raws, words = [], [], [], [], []
            for i, text in enumerate(batch.column("text")):
                seen: dict[str, tuple[list[int], list[int]]] = {}
                at = 0
                for raw, line in enumerate(text.as_py().split("\n")):
                    if line := line.strip():
                        spots = seen.setdefault(line, ([], []))
                        spots[0].append(at)
                        spots[1].append(raw)
                        at += 1
                for line, (a, r) in seen.items():
                    owner.append(i)
                    keys.append(blake2b(line.encode("utf-8", "replace"), digest_size=16).digest())
                    ats.append(a)
                    raws.append(r)
                    words.append(len(line.split()))
                if len(owner) >= LINES or i == batch.num_rows - 1:
                    numbers = [pa.array(x, pa.list_(pa.int32())) for x in (ats, raws)]
                    columns = [batch.column("doc").take(pa.array(owner, pa.int64())), pa.array(keys, pa.binary()), *numbers, pa.array(words, pa.int32())]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc", "key", "at", "raw", "words"])
                    owner, keys, ats, raws, words = [], [], [], [], []

    return rows.mapInArrow(run, f"doc {rows.schema['doc'].dataType.simpleString()}, key binary, at array<int>, raw array<int>, words int")


def _run_pairs(common: DataFrame, min_words: int) -> DataFrame:
    """(doc, earlier): each holder of a run of common lines with the run's first holder."""

    @F.arrow_udf(ArrayType(BinaryType()))
    def runs(at: pa.Array, keys: pa.Array, words: pa.Array) -> pa.Array:
        return pa.array([run_hashes(*(x.as_py() for x in row), min_words) for row in zip(at, keys, words, strict=True)], pa.list_(pa.binary()))

    each = common.select("doc", F.explode("at").alias("at"), F.xxhash64("key").alias("key"), "words")
    lines = each.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("at", "key", "words"))).alias("x"), F.sum("words").alias("size")).where(F.col("size") >= min_words)
    held = written(lines.select("doc", F.explode_outer(runs(F.col("x.at"), F.col("x.key"), F.col("x.words"))).alias("run")).where("run is not null"), "runs")
    firsts = written(held.groupBy("run").agg(F.min("doc").alias("earlier"), F.count("*").alias("n")).where("n > 1").select("run", "earlier"), "firsts")
    pairs = written(held.join(firsts, "run").where("earlier < doc").select("doc", "earlier").distinct(), "run-pairs")
    drop_written(held)
    drop_written(firsts)
    return pairs


def repeated_lines(docs: DataFrame, text: str = "text", id_col: str = "doc_id", min_words: int = MIN_WORDS, rare: int = RARE, runs: bool = False) -> DataFrame:
    """(id, body, removed): for each document with something to delete, the hash of its text and its line numbers
    (from 0), sorted.

    Lines end at a newline, are compared without surrounding white space and by 128-bit digests; blank lines neither
    match nor part a block.  With `runs`, holders of a run of common lines also meet its first holder.  Null ids take
    no part; rows that repeat id and text are one document, rows that repeat an id with another text are two.

    The lines are written once, where they are; only those that several documents hold are shuffled again.
    """
    small_batches(docs.sparkSession)
    held = written(lines_of(docs, text, id_col), "lines")
    counts = written(held.groupBy("key").agg(F.count("*").alias("holders")).where("holders > 1"), "counts")
    # joined first, so that a hot line can be split; rows that repeat a document collapse on the way out
    met = written(held.join(counts, "key"), "met")
    shared = written(met.dropDuplicates(["doc", "key"]), "shared")
    firsts = written(shared.groupBy("key").agg(F.min("doc").alias("earlier")), "first-holders")

    few = shared.where(F.col("holders") <= rare).select("doc", "key")
    pairs = few.join(few.withColumnRenamed("doc", "earlier"), "key").where("earlier < doc").select("doc", "earlier")
    pairs = pairs.unionByName(shared.where(F.col("holders") > rare).join(firsts, "key").where("earlier < doc").select("doc", "earlier"))
    in_runs = [_run_pairs(shared.where(F.col("holders") > rare), min_words)] if runs else []
    for p in in_runs:
        pairs = pairs.unionByName(p)
    pairs = written(pairs.distinct(), "pairs")

    lines = shared.select("doc", "key", "at", "raw", "words")
    later = written(pairs.join(lines, "doc"), "later")
    both = later.join(lines.select(F.col("doc").alias("earlier"), "key", F.col("at").alias("at_e")), ["earlier", "key"])

    @F.arrow_udf(ArrayType(IntegerType()))
    def deleted(later: pa.Array, raw: pa.Array, earlier: pa.Array, words: pa.Array) -> pa.Array:
        rows = zip(later, earlier, words, raw, strict=True)
        return pa.array([common_blocks(*(x.as_py() for x in row), min_words) for row in rows], pa.list_(pa.int32()))

    row = F.struct(F.col("at").alias("l"), F.col("raw").alias("r"), F.col("at_e").alias("e"), F.col("words").alias("w"))
    pair = both.groupBy("doc", "earlier").agg(F.collect_list(row).alias("m"))
    # a pair whose common lines are too short together holds no block
    pair = pair.where(F.aggregate("m", F.lit(0), lambda a, x: a + x["w"] * F.size(x["l"])) >= min_words)
    gone = pair.select("doc", deleted(F.col("m.l"), F.col("m.r"), F.col("m.e"), F.col("m.w")).alias("gone"))
    # filtered after the aggregation: below it the filter would run the alignment a second time, in workers of its own
    result = gone.groupBy("doc").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("removed")).where(F.size("removed") > 0)
    result = written(result.select(F.col("doc.id").alias(id_col), "doc.body", "removed"), "removed")
    for t in (held, counts, met, shared, firsts, *in_runs, pairs, later):
        drop_written(t)
    return result


def dedup_lines(docs: DataFrame, text: str = "text", id_col: str = "doc_id", min_words: int = MIN_WORDS, rare: int = RARE) -> DataFrame:
    """docs with repeated blocks deleted from the later documents, and a column removed_lines array<int>.

    No row goes: a document whose lines all repeat keeps an empty text.  A null text stays null; documents without
    repeats keep their text byte for byte, and so do rows with a null id.  A column removed_lines is replaced.

    Texts stay where they are while the line numbers to delete are few (counted); beyond that they are shuffled once.
    """
    docs = docs.drop("removed_lines")
    gone = repeated_lines(docs, text, id_col, min_words, rare, runs=True).toDF("_gone_id", "_gone_body", "removed_lines")
    size = gone.agg(F.count("*").alias("docs"), F.coalesce(F.sum(F.size("removed_lines")), F.lit(0)).alias("numbers")).first()
    side = F.broadcast(gone) if size["docs"] <= FEW_DOCS and size["numbers"] <= FEW_NUMBERS else gone
    same = (docs[id_col] == gone["_gone_id"]) & (F.xxhash64(F.coalesce(docs[text], F.lit(""))) == gone["_gone_body"])
    joined = docs.join(side, same, "left").drop("_gone_id", "_gone_body")
    left = F.array_join(F.filter(F.split(F.col(text), "\n", -1), lambda x, i: ~F.array_contains("removed_lines", i)), "\n")
    return joined.withColumn(text, F.when(F.col("removed_lines").isNull(), F.col(text)).otherwise(left))


def line_digest(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_removed, removed_lines (comma-joined numbers), and length and hash of what stays."""
    cleaned = dedup_lines(docs.select("doc_id", "text"))
    removed = F.coalesce("removed_lines", F.array().cast("array<int>"))
    return cleaned.select(
        "doc_id",
        F.size(removed).cast("long").alias("n_removed"),
        F.array_join(removed.cast("array<string>"), ",").alias("removed_lines"),
        F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars_left"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"),
    )
