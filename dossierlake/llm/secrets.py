"""Secrets: fixed patterns, and strings that a battery of randomness tests cannot tell from random ones.

DataFrame functions only.  Long runs of key characters are candidates.  Two questions are asked of each:

* Does it look random?  Under the uniform model of its inferred encoding, a chi-squared test of the alphabet, a runs
  test and a lag-one serial correlation each give a p-value; they are combined by Bonferroni.  The null is "random",
  so what is discovered is a string that is not: of those thrown away so, at most a share `alpha` is random.
* Is it something text would not hold?  Under a fixed model of letters in text, the surprise of the string has a
  known mean and variance per character, so its p-value sharpens with length.  The null is "text": of those kept, at
  most a share `fdr` is text.

Both rates are held by Benjamini-Hochberg cut-offs within each length class of the whole corpus, so that many short
candidates do not use up what few long ones may claim.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dossierlake.functions.spans import let, regex_spans
from dossierlake.llm.common import written

KINDS = ("assign", "access", "hex")
PATTERNS = {
    "assign": r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""",
    # AKIA[A-Z0-9]+ of 20 or more: runs end at the same place wherever they begin, so shorter ones hold no longer ones
    "access": r"AKIA[A-Z0-9]{16,}+",
    # [0-9a-f]+ of 24 or more
    "hex": r"[0-9a-f]{24,}+",
}
#: the key word and separators before the value of an assignment
ASSIGN_HEAD = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}+={0,2}"

#: encodings in the order tried: name, pattern of the whole string, alphabet (fixed values)
UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
ENCODINGS = [
    ("hex", "^[0-9a-f]+$", DIGITS + "abcdef"),
    ("HEX", "^[0-9A-F]+$", DIGITS + "ABCDEF"),
    ("base32", "^[A-Z2-7]+$", UPPER + "234567"),
    ("base36", "^[0-9a-z]+$", DIGITS + LOWER),
    ("base62", "^[0-9A-Za-z]+$", DIGITS + UPPER + LOWER),
    ("base64", "^[0-9A-Za-z+/]+$", UPPER + LOWER + DIGITS + "+/"),
    ("base64url", "^[0-9A-Za-z_-]+$", UPPER + LOWER + DIGITS + "-_"),
    ("mixed", "^.+$", UPPER + LOWER + DIGITS + "+/-_"),
]
#: shares of the letters a to z in text, in per cent (fixed values)
LETTERS = [8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.2, 0.8, 4.0, 2.4, 6.7, 7.5, 1.9, 0.1, 6.0, 6.3, 9.1, 2.8, 1.0, 2.4, 0.2, 2.0, 0.1]
#: share of lower case, upper case, digits and signs in runs of text
SHARES = {"lower": 0.93, "upper": 0.04, "digit": 0.02, "sign": 0.01}
P_BINS = 400  # tenths of -log10 p


def _text_model() -> dict[str, float]:
    """Surprise -ln p of each candidate character in text."""
    total = sum(LETTERS)
    p = {c: SHARES["lower"] * f / total for c, f in zip(LOWER, LETTERS, strict=True)}
    p |= {c: SHARES["upper"] * f / total for c, f in zip(UPPER, LETTERS, strict=True)}
    p |= dict.fromkeys(DIGITS, SHARES["digit"] / 10) | dict.fromkeys("+/_-", SHARES["sign"] / 4)
    return {c: -math.log(x) for c, x in p.items()}


def _tail(z: Column) -> Column:
    """Upper tail of the normal distribution, by a logistic of a cubic (error below 2e-4, exponential far out)."""
    return let(F.least(F.greatest(z, F.lit(-12.0)), F.lit(12.0)), lambda x: F.lit(1.0) / (F.lit(1.0) + F.exp(1.5976 * x + 0.07056 * x * x * x)))


def _battery(values: Column, k: Column) -> Column:
    """Smallest p-value of the three tests of symbol numbers 0..k-1 against the uniform distribution, times three."""
    n = F.size(values).cast("double")
    kd = k.cast("double")
    squares = F.aggregate(F.sequence(F.lit(0), k - 1), F.lit(0.0), lambda a, j: a + F.pow(F.size(F.filter(values, lambda v: v == j)), F.lit(2)))
    chi = (squares * kd / n - n - (kd - 1)) / F.sqrt(2 * (kd - 1) * (n - 1) / n)
    high = F.aggregate(values, F.lit(0.0), lambda a, v: a + F.when(v * 2 >= k, 1.0).otherwise(0.0))
    pairs = F.zip_with(F.slice(values, 1, F.size(values) - 1), F.slice(values, 2, F.size(values)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    runs = F.aggregate(pairs, F.lit(1.0), lambda s, p: s + F.when((p["a"] * 2 >= k) != (p["b"] * 2 >= k), 1.0).otherwise(0.0))
    mean = 2 * high * (n - high) / n + 1
    spread = F.sqrt(F.greatest((mean - 1) * (mean - 2) / (n - 1), F.lit(1e-9)))
    middle = (kd - 1) / 2
    serial = F.aggregate(pairs, F.lit(0.0), lambda s, p: s + (p["a"] - middle) * (p["b"] - middle)) / ((kd * kd - 1) / 12) / F.sqrt(n - 1)
    return 3 * F.least(_tail(chi), 2 * _tail(F.abs((runs - mean) / spread)), 2 * _tail(F.abs(serial)))


def _tested(match: Column) -> Column:
    """struct<encoding, odd, score, stratum>: tenths of -log10 p of the battery and of the text model, and the length class."""
    body = F.rtrim(match, F.lit("="))
    surprise = _text_model()
    weights = F.create_map(*[F.lit(x) for c, s in surprise.items() for x in (c, s)])
    shares = {c: math.exp(-s) for c, s in surprise.items()}
    mean = sum(shares[c] * s for c, s in surprise.items())
    spread = math.sqrt(sum(shares[c] * s * s for c, s in surprise.items()) - mean * mean)

    def test(b: Column) -> Column:
        name = alphabet = F.lit(None).cast("string")
        for n, pattern, letters in reversed(ENCODINGS):
            name = F.when(b.rlike(pattern), n).otherwise(name)
            alphabet = F.when(b.rlike(pattern), letters).otherwise(alphabet)
        chars = lambda s: F.filter(F.split(s, ""), lambda c: c != "")
        values = let(alphabet, lambda a: F.transform(chars(b), lambda c: F.call_function("instr", a, c) - 1))
        p_random = let(values, lambda v: let(F.length(alphabet), lambda k: _battery(v, k)))
        # a run in capitals only is judged as if it were lower case
        folded = F.when(b == F.upper(b), F.lower(b)).otherwise(b)
        z = (F.aggregate(chars(folded), F.lit(0.0), lambda a, c: a + F.coalesce(F.try_element_at(weights, c), F.lit(10.0))) - F.length(b) * mean) / (F.sqrt(F.length(b).cast("double")) * spread)
        score = F.least(F.floor(-10 * F.log10(_tail(z))), F.lit(P_BINS)).cast("int")
        odd = F.least(F.floor(-10 * F.log10(F.greatest(F.least(p_random, F.lit(1.0)), F.lit(1e-300)))), F.lit(P_BINS)).cast("int")
        return F.struct(name.alias("encoding"), odd.alias("odd"), score.alias("score"), F.floor(F.log2(F.length(b).cast("double"))).cast("int").alias("stratum"))

    return let(body, test)


def find_secrets(docs: DataFrame, text: str = "text", id_col: str = "doc_id", fdr: float = 0.001, alpha: float = 0.01) -> DataFrame:
    """(id, base, random): arrays of struct<start, kind_no, end> and of struct<start, end, encoding, score>.

    base holds the three fixed kinds over the whole text, sorted by start and kind; random holds the strings that the
    tests add, none of which overlaps a base span.  Code points, end exclusive.  Null and empty texts give empty
    arrays; repeated rows and ids keep all their rows; an empty table gives none.  The spans of all documents are
    written to the shared folder once; the cut-offs gathered from them are one number per length class (powers of two).
    """
    found = docs.select(F.col(id_col), *[regex_spans(F.col(text), p).alias(k) for k, p in PATTERNS.items()], regex_spans(F.col(text), CANDIDATE).alias("runs"))
    kept = {
        "assign": F.filter("assign", lambda s: F.length(F.regexp_replace(s["match"], ASSIGN_HEAD, "")) >= 6),
        "access": F.col("access"),
        "hex": F.col("hex"),
    }

    def numbered(spans: Column, no: int) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"], F.lit(no).alias("kind_no"), s["end"]))

    base = F.array_sort(F.concat(*[numbered(c, i) for i, c in enumerate(kept.values())]))
    spans = found.select(id_col, base.alias("base"), "runs")
    free = F.filter("runs", lambda r: ~F.exists("base", lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"])))
    spans = spans.select(id_col, "base", free.alias("runs"))
    tested = F.transform("runs", lambda r: F.struct(r["start"], r["end"], _tested(r["match"]).alias("t")))
    spans = written(spans.select(id_col, "base", tested.alias("runs")), "secrets")
    # at most one per power of two
    cuts, odd_cuts = ({r["stratum"]: r["cut"] for r in _cut_offs(spans, x, rate).collect()} for x, rate in (("score", fdr), ("odd", alpha)))

    def cut(stratum: Column, cuts: dict[int, int]) -> Column:
        out = F.lit(P_BINS + 1)
        for k, v in cuts.items():
            out = F.when(stratum == k, v).otherwise(out)
        return out

    chosen = F.filter("runs", lambda r: (r["t"]["odd"] < cut(r["t"]["stratum"], odd_cuts)) & (r["t"]["score"] >= cut(r["t"]["stratum"], cuts)))
    return spans.select(id_col, "base", F.transform(chosen, lambda r: F.struct(r["start"], r["end"], r["t"]["encoding"].alias("encoding"), r["t"]["score"].alias("score"))).alias("random"))


def _cut_offs(spans: DataFrame, score: str, fdr: float) -> DataFrame:
    """Per length class the least score that Benjamini-Hochberg lets pass: (stratum, cut)."""
    bins = spans.select(F.explode("runs.t").alias("t")).groupBy("t.stratum", F.col(f"t.{score}").alias("score")).count()
    above = W.partitionBy("stratum").orderBy(F.desc("score"))
    ranked = bins.select("stratum", "score", F.sum("count").over(above).alias("at_least"), F.sum("count").over(W.partitionBy("stratum")).alias("all"))
    passing = ranked.where(F.pow(F.lit(10.0), -F.col("score") / 10) <= fdr * F.col("at_least") / F.col("all"))
    return passing.groupBy("stratum").agg(F.min("score").alias("cut"))


def secret_digest(docs: DataFrame) -> DataFrame:
    """Per document the counts of the base kinds, the hash of the base spans, and all spans by start."""
    found = find_secrets(docs)
    kind = F.array(*[F.lit(k) for k in (*KINDS, "random")])
    name = lambda s: F.concat_ws(":", F.get(kind, s["kind_no"]), s["start"].cast("string"), s["end"].cast("string"))

    def count(no: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind_no"] == no)).cast("long")

    more = F.transform("random", lambda s: F.struct(s["start"], F.lit(len(KINDS)).alias("kind_no"), s["end"]))
    every = F.array_sort(F.concat("base", more))
    return found.select(
        "doc_id",
        *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(F.array_join(F.transform("base", name), ","), 256).alias("base_sha256"),
        F.array_join(F.transform(every, name), ",").alias("spans"),
        F.size("random").cast("long").alias("n_random"),
    )
