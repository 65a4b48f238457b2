"""Regex spans with exact code point offsets, as native column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body or a lambda inside it uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sums(part: Column) -> Column:
    return F.aggregate(
        part,
        F.array().cast("array<int>"),
        lambda acc, x: F.concat(acc, F.array(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0)) + x)),
    )


def running_sum(lengths: Column, block: int = 256) -> Column:
    """Inclusive prefix sums of an integer array.

    Short arrays are folded directly.  Longer ones sum inside blocks and shift every block by the total before it,
    so that n values cost about n * block instead of n * n.  An empty array gives an empty array.
    """

    def blocked(values: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(1), F.size(values), F.lit(block)), lambda at: _sums(F.slice(values, at, block)))

        def shift(bs: Column) -> Column:
            ends = _sums(F.transform(bs, lambda b: F.element_at(b, -1)))
            return let(ends, lambda es: F.flatten(F.transform(bs, lambda b, i: F.transform(b, lambda x: x + F.coalesce(F.get(es, i - 1), F.lit(0))))))

        return let(blocks, shift)

    return let(lengths, lambda v: F.when(F.size(v) <= block, _sums(v)).otherwise(blocked(v)))


def regex_spans(text: Column, pattern: str, context: int = 0, needs: Column | None = None) -> Column:
    """All leftmost non-overlapping matches as array<struct<start,end,match,before>>, code points, end exclusive.

    The pattern must not match the empty string.  Gaps come from splitting by the same pattern, so that
    end_i = gaps up to i + matches up to i.  before holds up to `context` characters between the match and the one
    before it.  Null text gives an empty array.  needs: true for each text that
    holds a match, and cheaper to find out than the pattern.
    """

    def build(found: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), 1, F.size(found))
        pieces = F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("match"), F.right(g, F.lit(context)).alias("before")))

        def place(ps: Column) -> Column:
            ends = running_sum(F.transform(ps, lambda p: p["gap"] + F.length(p["match"])))
            return F.zip_with(
                ps,
                ends,
                lambda p, e: F.struct((e - F.length(p["match"])).alias("start"), e.alias("end"), p["match"].alias("match"), p["before"].alias("before")),
            )

        return let(pieces, place)

    none = F.array().cast("array<struct<start:int,end:int,match:string,before:string>>")
    if needs is None:
        # most texts hold no match: a single find decides, and a null text takes the last branch
        return F.when(text.rlike(pattern), let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), build)).otherwise(none)
    return F.when(needs, let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, build(found)).otherwise(none))).otherwise(none)


def span_list(kind: str | Column, spans: Column) -> Column:
    """kind:start:end strings of spans."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.transform(spans, lambda s: F.concat_ws(":", kind, s["start"].cast("string"), s["end"].cast("string")))
