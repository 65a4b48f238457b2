"""Benchmark leaks: SimHash over item-sized windows, multi-index Hamming blocks, exact shingle similarity.

DataFrame functions only.  Similarity is the weighted Jaccard of two bags of five-word shingles (a shingle weighs as
often as it occurs): sum of minima over sum of maxima.  A window has as many words as the item; a document with fewer
words than the item is one window of its own length.

1. Seeds.  A window and an item of n shingles each that reach similarity t share at least 2nt/(1+t) of them, so at
   most a few positions of the window hold a shingle foreign to the item.  It is then enough to look up every k-th
   shingle of a document, k chosen from the benchmark so that each such window holds a looked-up position that
   belongs to the item; windows without one cannot reach t and are never built.
2. Windows of the item's size around the seeds that share enough shingles get a 64-bit SimHash.
3. Fingerprints are cut into radius + 1 blocks; two within the radius agree in one block at least, so an equality join
   on (item, block, value) finds them all.  A window is built for the item of its seed, and every item that it could
   match has seeds in it, so it meets that item's blocks only and no value is a hot key for all items of a size.
4. Pairs within the radius are verified by the exact weighted similarity; short whole documents are verified at once.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossierlake.functions.spans import let
from dossierlake.llm.common import id_side, written

SHINGLE = 5
#: At similarity 0.8 the expected distance is 10 bits with a spread of 3 (a window shares 8/9 of its shingles: an angle of
#: 27 degrees); more than 24 have odds below 1 in a million.
RADIUS = 24
#: Shingle rows of the benchmark up to which its tables are broadcast; beyond it they are joined by shuffles.
BROADCAST_ROWS = 1_000_000


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits, so that punctuation and case do not hide a leak; null has none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", -1), lambda w: w != "")


def _hash_at(tokens: Column, at: Column) -> Column:
    return F.xxhash64(F.array_join(F.slice(tokens, at + 1, SHINGLE), " "))


def _hashes(tokens: Column, step: int = 1) -> Column:
    """Hashes of the shingles that begin at words 0, step, 2*step ...; fewer than five words have none."""
    none = F.array().cast("array<long>")
    return F.when(F.size(tokens) < SHINGLE, none).otherwise(
        F.transform(F.sequence(F.lit(0), F.size(tokens) - SHINGLE, F.lit(step)), lambda at: _hash_at(tokens, at))
    )


def _needed(n: Column, threshold: float) -> Column:
    """Least number of shared shingles of two bags of n each that reach the threshold."""
    return _needed_of(2 * n, threshold)


def _needed_of(total: Column, threshold: float) -> Column:
    """The same for two bags of `total` together."""
    return F.ceil(total * (threshold / (1 + threshold)) - 1e-9).cast("int")


def simhash(hashes: Column) -> Column:
    """Majority bits of an array of hashes as a long.  Counts of two bits at a time share a long, 32 bits each."""
    lanes = [F.aggregate(hashes, F.lit(0).cast("long"), _lane(g)) for g in range(32)]

    def bits(counts: Column) -> Column:
        ones = lambda g, half: F.shiftright(F.get(counts, g + 1), 32 * half).bitwiseAND(F.lit(0x7FFFFFFF))
        bit = lambda g, half: F.when(ones(g, half) * 2 > F.get(counts, 0), F.lit(_signed(1 << (g + 32 * half)))).otherwise(F.lit(0).cast("long"))
        return _or([bit(g, half) for g in range(32) for half in (0, 1)])

    return let(F.array(F.size(hashes).cast("long"), *lanes), bits)


def _lane(g: int):
    return lambda acc, h: acc + F.shiftrightunsigned(h, g).bitwiseAND(F.lit(0x0000000100000001))


def _or(parts: list[Column]) -> Column:
    return parts[0] if len(parts) == 1 else _or(parts[: len(parts) // 2]).bitwiseOR(_or(parts[len(parts) // 2 :]))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _blocks(fp: Column, radius: int) -> list[Column]:
    edges = [64 * i // (radius + 1) for i in range(radius + 2)]
    return [F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(edges, edges[1:], strict=False)]


def _count(bag: Column, x: Column) -> Column:
    return F.size(F.filter(bag, lambda y: y == x))


def shared(a: Column, b: Column) -> Column:
    """Sum over the distinct members of the smaller of their two counts."""
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda s, x: s + F.least(_count(a, x), _count(b, x)))


def _body(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _windows(docs: DataFrame, benchmark: DataFrame, threshold: float, radius: int, text: str, id_col: str, item_id: str, item_text: str) -> DataFrame:
    """(id, body, item, n_words, start_word, similarity) of every window that reaches the threshold; body is the text's hash."""
    items = benchmark.select(F.col(item_id).alias("item"), words(F.col(item_text)).alias("w"))
    items = items.select("item", F.size("w").alias("n_words"), _hashes(F.col("w")).alias("item_h")).where(F.size("item_h") > 0)
    items = items.withColumn("n", F.size("item_h"))
    # for each stride k the looked-up positions that are left at the least of what a window (of n shingles, or fewer
    # where it is a short document) may lack
    sizes = F.sequence(F.ceil(F.col("n") * threshold - 1e-9).cast("int"), F.col("n"))
    left = lambda k: F.array_min(F.transform(sizes, lambda m: F.floor(m / k).cast("int") - (m - _needed_of(m + F.col("n"), threshold))))
    facts = items.agg(F.sum("n").alias("rows"), *[F.min(left(k)).alias(f"left_{k}") for k in (2, 3, 4)]).first()
    step = max([1, *(k for k in (2, 3, 4) if (facts[f"left_{k}"] or 0) >= 1)])
    small = F.broadcast if (facts["rows"] or 0) <= BROADCAST_ROWS else (lambda df: df)

    seeds = items.select("item", "n", F.explode(F.array_distinct("item_h")).alias("h"))
    tokens = docs.select(F.col(id_col).alias("id"), _body(F.col(text)).alias("body"), words(F.col(text)).alias("w"))
    # outer: from an inner explode the optimizer would infer a filter that splits and hashes every text again
    lookups = tokens.select("id", "body", "w", F.posexplode_outer(_hashes(F.col("w"), step)).alias("i", "h")).where("h is not null")
    if small is F.broadcast:
        hits = lookups.join(small(seeds), "h")
    else:  # only numbers are shuffled by hash; words come back to the positions that hit
        found = lookups.select("id", "body", "i", "h").join(seeds, "h").distinct()
        hits = tokens.dropDuplicates(["id", "body"]).withColumnsRenamed({"id": "_id", "body": "_body"})
        hits = hits.join(found, F.col("_id").eqNullSafe(F.col("id")) & (F.col("_body") == F.col("body")))
    hits = hits.withColumn("p", F.col("i") * step).withColumn("doc_n", F.size("w") - SHINGLE + 1)
    # words of the windows that may hold position p
    first = F.greatest(F.col("p") - F.col("n") + 1, F.lit(0))
    around = hits.select("id", "body", "item", "p", "doc_n", first.alias("at"), F.slice("w", first + 1, F.col("p") - first + F.col("n") + SHINGLE - 1).alias("w"))
    # written: windows and short documents both read it, and the texts are split and hashed once
    around = written(around.select("id", "body", "item", "p", "doc_n", "at", _hashes(F.col("w")).alias("h")), "around").join(small(items), "item")
    member = around.withColumn("m", F.transform("h", lambda x: F.array_contains("item_h", x)))
    starts = F.when(F.size("h") >= F.col("n"), F.sequence(F.lit(0), F.size("h") - F.col("n"))).otherwise(F.array().cast("array<int>"))
    # enough shared shingles, and p the first looked-up member: each window is built once
    enough = lambda r: F.size(F.filter(F.slice("m", r + 1, F.col("n")), lambda y: y)) >= _needed(F.col("n"), threshold)
    earlier = lambda r: F.exists(F.sequence(r, F.col("p") - F.col("at")), lambda j: F.get("m", j) & ((F.col("at") + j) % step == 0) & (F.col("at") + j < F.col("p")))
    begins = F.filter(starts, lambda r: (r <= F.col("p") - F.col("at")) & enough(r) & ~earlier(r))
    windows = member.select("id", "body", "item", "at", "n", "n_words", "h", F.explode_outer(begins).alias("r")).where("r is not null")
    windows = windows.select("id", "body", "item", "n", "n_words", (F.col("at") + F.col("r")).alias("start_word"), F.slice("h", F.col("r") + 1, F.col("n")).alias("win_h"))
    windows = windows.withColumn("fp", simhash(F.col("win_h")))

    def indexed(df: DataFrame, fp: str) -> DataFrame:
        return df.select("*", F.posexplode(F.array(*_blocks(F.col(fp), radius))).alias("block", "value"))

    index = indexed(items.select("item", "item_h", simhash(F.col("item_h")).alias("item_fp")).distinct(), "item_fp")
    near = indexed(windows, "fp").join(small(index), ["item", "block", "value"])
    # of the blocks in which the two agree the first counts
    alike = F.array_position(F.array(*[b == 0 for b in _blocks(F.col("fp").bitwiseXOR(F.col("item_fp")), radius)]), True)
    near = near.where((F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius) & (alike == F.col("block") + 1))
    both = shared(F.col("win_h"), F.col("item_h"))
    scored = near.select("id", "body", "item", "n_words", "start_word", "n", both.alias("both"))
    scored = scored.where(F.col("both") >= _needed(F.col("n"), threshold))
    scored = scored.withColumn("similarity", F.col("both") / (2 * F.col("n") - F.col("both")))
    # a document shorter than the item: `h` is all of it, and one of its looked-up members is enough
    short = member.where((F.size("h") < F.col("n")) & (F.size("h") == F.col("doc_n"))).select("id", "body", "item", "n", "item_h", "h", "m", "p")
    again = F.exists(F.sequence(F.lit(0), F.col("p")), lambda j: F.get("m", j) & (j % step == 0) & (j < F.col("p")))
    total = F.size("h") + F.col("n")
    short = short.where(~again & (F.size(F.filter("m", lambda y: y)) >= _needed_of(total, threshold)))
    short = short.select("id", "body", "item", (F.size("h") + SHINGLE - 1).alias("n_words"), F.lit(0).alias("start_word"), total.alias("total"), shared(F.col("h"), F.col("item_h")).alias("both"))
    short = short.where(F.col("both") >= _needed_of(F.col("total"), threshold)).withColumn("similarity", F.col("both") / (F.col("total") - F.col("both")))
    columns = ["id", "body", "item", "n_words", "start_word", "similarity"]
    return scored.select(columns).unionByName(short.select(columns))


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, radius: int = RADIUS, text: str = "text", id_col: str = "doc_id", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """Documents that hold a benchmark item: (id, item_id, similarity, start_word, n_words), the best window of each pair.

    Of equally similar windows the first counts.  Null and blank texts, and items of fewer than five words, match
    nothing.  Rows that repeat an id, and items that repeat one, report once, the best window of any.  An empty table
    on either side gives no rows.
    """
    found = _windows(docs, benchmark, threshold, radius, text, id_col, item_id, item_text)
    best = found.groupBy("id", "item").agg(F.max(F.struct("similarity", (-F.col("start_word")).alias("back"), "n_words")).alias("b"))
    return best.select(
        F.col("id").alias(id_col), F.col("item").alias(item_id), F.round("b.similarity", 6).alias("similarity"), (-F.col("b.back")).alias("start_word"), "b.n_words"
    )


def drop_leaks(docs: DataFrame, benchmark: DataFrame, **params) -> DataFrame:
    """docs without the documents that hold a benchmark item; columns unchanged.

    Each row is judged by its own text, also where its id is null or repeated.
    """
    known = {"threshold": 0.8, "radius": RADIUS, "text": "text", "id_col": "doc_id", "item_id": "item_id", "item_text": "text"} | params
    found = _windows(docs, benchmark, **known)
    bad = id_side(found.select(F.col("id").alias("_leaky_id"), F.col("body").alias("_leaky_body")).distinct(), "leaky")
    same = docs[known["id_col"]].eqNullSafe(bad["_leaky_id"]) & (_body(docs[known["text"]]) == bad["_leaky_body"])
    return docs.join(bad, same, "left_anti")
