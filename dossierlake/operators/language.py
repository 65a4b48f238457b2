"""Languages by profiles of character n-grams: learned from labelled texts, scored as naive Bayes, told with a probability.

Profiles are counted on Spark over a bounded sample of each language and keep its most frequent n-grams by rank, so that
what reaches the driver and the workers is languages * SIZE numbers.  Only the two samples of a text that are scored
travel to Python, a batch of them at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dossierlake.functions.spans import let

#: Characters of a sample, and of the middle sample from which on it is asked too (fixed values)
CHARS, LEAST_MIDDLE = 2_000, 100
#: Longest n-gram; texts a language that are learned from; n-grams that its profile keeps; languages at most
ORDERS, ROWS, SIZE, LANGUAGES = 3, 300, 1_500, 64


def letters(text: Column) -> Column:
    """Small letters; whatever else stands between words is one space, also in front and behind."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " ")), F.lit(" "))


def grams(text: Column, orders: int = ORDERS) -> Column:
    """All n-grams of a text, shortest first, from its list of characters, so that none is searched for in the text."""

    def of(chars: Column, n: int) -> Column:
        whole = lambda i: F.concat(*[F.get(chars, i + k) for k in range(n)])
        return F.when(F.size(chars) >= n, F.transform(F.sequence(F.lit(0), F.greatest(F.size(chars) - n, F.lit(0))), whole)).otherwise(F.array().cast("array<string>"))

    return let(F.split(text, ""), lambda chars: F.concat(*[of(chars, n) for n in range(1, orders + 1)]))


@dataclass(frozen=True)
class Profiles:
    """Languages, sorted codes of n-grams, their log probabilities (n-grams, languages), and those of unseen ones by order."""

    languages: list[str]
    codes: np.ndarray
    logs: np.ndarray
    unseen: np.ndarray


def code(gram: str) -> int:
    out = 0
    for ch in gram:
        out = out << 21 | ord(ch)
    return out


def learn_profiles(labelled: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id", rows: int = ROWS, size: int = SIZE) -> Profiles:
    """Profiles of the most frequent languages of a labelled table, from the `rows` texts of each with the smallest hashes of their ids."""
    usable = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.xxhash64(id_col).alias("h"), F.substring(text, 1, CHARS).alias("t"))
    names = sorted(r["lang"] for r in usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect())
    held = usable.where(F.col("lang").isin(*names)).withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy("h", "t"))).where(F.col("r") <= rows)
    counts = held.select("lang", F.explode(grams(letters(F.col("t")))).alias("gram")).groupBy("lang", "gram").agg(F.count("*").alias("n"))
    order = W.partitionBy("lang", F.length("gram"))
    ranked = counts.withColumn("total", F.sum("n").over(order)).withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= size)
    kept = ranked.select("lang", "gram", "n", "total").collect()
    known = sorted({r["gram"] for r in kept}, key=code)
    at, col = {g: i for i, g in enumerate(known)}, {n: j for j, n in enumerate(names)}
    totals = np.ones((ORDERS + 1, len(names)))
    for r in kept:
        totals[len(r["gram"]), col[r["lang"]]] = r["total"]
    unseen = np.log(0.5 / (totals + 0.5 * size))
    logs = np.array([unseen[len(g)] for g in known]).reshape(len(known), len(names))
    for r in kept:
        n = len(r["gram"])
        logs[at[r["gram"]], col[r["lang"]]] = np.log((r["n"] + 0.5) / (totals[n, col[r["lang"]]] + 0.5 * size))
    return Profiles(names, np.array([code(g) for g in known], dtype=np.int64), logs, unseen)


def score(text: str, p: Profiles) -> tuple[str, float] | None:
    """(language, probability) of a text of letters and spaces; None without a letter or a language.

    Each character stands in an n-gram of every order, so sums are divided by their number.
    """
    if not text.strip() or not p.languages:
        return None
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    total, codes = np.zeros(len(p.languages)), points
    for n in range(1, ORDERS + 1):
        if n > 1:
            codes = codes[:-1] << 21 | points[n - 1 :]
        if len(codes):
            slot = np.minimum(np.searchsorted(p.codes, codes), max(len(p.codes) - 1, 0))
            seen = p.codes[slot] == codes
            total += p.logs[slot[seen]].sum(axis=0) + (~seen).sum() * p.unseen[n]
    odds = np.exp((total - total.max()) / ORDERS)
    best = int(odds.argmax())
    return p.languages[best], float(odds[best] / odds.sum())


def detect_languages(docs: DataFrame, profiles: Profiles, text: str = "text") -> DataFrame:
    """docs plus language, probability and multilingual.

    The language and its probability are those of the first CHARS characters; a text is multilingual if as many from its
    middle on, more than LEAST_MIDDLE without the white space around them, tell another one.  A null or blank text is English for certain, one without letters English
    with probability 0.
    """

    @F.pandas_udf("language string, probability double, multilingual boolean")
    def detect(pairs: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for starts, middles, blanks in pairs:
            out = []
            for start, middle, blank in zip(starts, middles, blanks, strict=True):
                if blank:
                    out.append(("en", 1.0, False))
                    continue
                first = score(start, profiles)
                second = score(middle, profiles) if middle is not None else None
                out.append((*first, second is not None and second[0] != first[0]) if first else ("en", 0.0, False))
            yield pd.DataFrame(out, columns=["language", "probability", "multilingual"])

    t = F.col(text)
    middle = F.trim(F.substring(t, F.floor(F.length(t) / 2).cast("int") + 1, F.lit(CHARS)))
    blank = F.trim(F.coalesce(F.regexp_replace(t, r"\s+", " "), F.lit(""))) == ""
    found = detect(letters(F.coalesce(F.substring(t, 1, CHARS), F.lit(""))), letters(F.when(F.length(middle) > LEAST_MIDDLE, middle)), blank)
    told = docs.withColumn("_found", found)
    return told.select(*docs.columns, "_found.language", F.round("_found.probability", 3).alias("probability"), "_found.multilingual")
