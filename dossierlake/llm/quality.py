"""Quality classifier: similarity-weighted votes of labelled neighbours among latent-semantic vectors.

A text becomes hashed counts of its words and of their shapes, plus how often a word or line repeats the one before.
Inverse document frequencies and a truncated singular value decomposition are fitted on a bounded sample of labelled
training rows, whose latent vectors are broadcast.  Every document is then compared with all of them: cosine products
block by block, exactly, and the nearest vote with their similarity as weight.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from dossierlake.llm.common import small_batches

SHAPES, WORDS = 2_048, 2_048
REPEATED_WORD, REPEATED_LINE, EXTRA = SHAPES + WORDS, SHAPES + WORDS + 1, 2
WIDTH = SHAPES + WORDS + EXTRA
CACHE = 30_000
#: Documents of a block of cosine products
ROWS = 64
_known: dict[str, tuple[int, int]] = {}


def shape(word: str) -> str:
    """Runs of small letters, capitals and digits become a, A and 0; other characters stay."""
    out, last = [], ""
    for ch in word:
        c = "A" if ch.isupper() else "a" if ch.isalpha() else "0" if ch.isdigit() else ch
        if c != last or c not in "Aa0":
            out.append(c)
        last = c
    return "".join(out)


def _slots(word: str) -> tuple[int, int]:
    slots = _known.get(word)
    if slots is None:
        if len(_known) >= CACHE:
            _known.clear()
        slots = _known[word] = (zlib.crc32(shape(word).encode("utf-8", "replace")) % SHAPES, SHAPES + zlib.crc32(word.lower().encode("utf-8", "replace")) % WORDS)
    return slots


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(slots, values) of a whole text; values are square roots of shares, so length does not matter.  Empty: none."""
    words = (text or "").split()
    if not words:
        return np.zeros(0, dtype=np.int64), np.zeros(0)
    n = len(words)
    shapes: Counter = Counter()
    lexical: Counter = Counter()
    for word, count in Counter(words).items():
        s, w = _slots(word)
        shapes[s] += count
        lexical[w] += count
    lines = [x for x in text.split("\n") if x.strip()]
    shapes[REPEATED_WORD] = sum(map(eq, words, words[1:]))
    shapes[REPEATED_LINE] = n * (1 - len(set(lines)) / len(lines)) if len(lines) > 1 else 0
    at = np.array([*shapes, *lexical], dtype=np.int64)
    values = np.sqrt(np.array([*shapes.values(), *lexical.values()], dtype=np.float64) / n)
    values[len(shapes) :] *= LEXICAL
    return at, values


#: weight of the words themselves against their shapes
LEXICAL = 0.5


@dataclass(frozen=True)
class Model:
    """idf-weighted loadings (WIDTH, rank), unit latent vectors of the labelled sample and their labels."""

    loadings: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    neighbours: int

    def latent(self, texts: list) -> np.ndarray:
        out = np.zeros((len(texts), self.loadings.shape[1]))
        for i, t in enumerate(texts):
            at, values = features(t)
            if len(at):
                out[i] = values @ self.loadings[at]
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)

    def scores(self, texts: list) -> np.ndarray:
        """Weighted share of label 1 among the nearest; ties by sample order.  No similar neighbour: the sample's share."""
        prior = float(self.labels.mean()) if len(self.labels) else 0.5
        out = np.full(len(texts), prior)
        if not len(self.labels):
            return out
        unit = self.latent(texts)
        k = min(self.neighbours, len(self.labels))
        for a in range(0, len(texts), ROWS):
            cosine = unit[a : a + ROWS] @ self.vectors.T
            near = nearest(cosine, k)
            weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0.0) ** 8
            total = weight.sum(axis=1)
            vote = (weight * self.labels[near]).sum(axis=1)
            out[a : a + ROWS] = np.where(total > 0, np.divide(vote, total, out=np.zeros_like(vote), where=total > 0), prior)
        return np.clip(out, 0.0, 1.0)


def nearest(cosine: np.ndarray, k: int) -> np.ndarray:
    """(rows, k): columns of the k greatest of each row; of equal ones at the end the first in sample order."""
    near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
    least = np.take_along_axis(cosine, near, axis=1).min(axis=1)
    for i in np.flatnonzero((cosine >= least[:, None]).sum(axis=1) > k):
        over, tied = np.flatnonzero(cosine[i] > least[i]), np.flatnonzero(cosine[i] == least[i])
        near[i] = np.concatenate([over, tied[: k - len(over)]])
    return near


def fit(rows: list[tuple[list[int], list[float]]], labels: list[int], rank: int, neighbours: int, seed: int = 5) -> Model:
    """Latent model of the sample by a randomized singular value decomposition."""
    dense = np.zeros((len(rows), WIDTH), dtype=np.float32)
    for i, (at, values) in enumerate(rows):
        np.add.at(dense[i], at, values)
    idf = np.log((1 + len(rows)) / (1 + (dense > 0).sum(axis=0))) + 1
    dense *= idf.astype(np.float32)
    rank = max(1, min(rank, len(rows), WIDTH))
    rng = np.random.default_rng(seed)
    basis = dense @ rng.standard_normal((WIDTH, rank + 8)).astype(np.float32) if len(rows) else np.zeros((0, rank), dtype=np.float32)
    for _ in range(4):
        basis = np.linalg.qr(dense @ (dense.T @ np.linalg.qr(basis)[0]))[0] if len(rows) else basis
    right = np.linalg.svd(basis.T @ dense, full_matrices=False)[2][:rank] if len(rows) else np.zeros((rank, WIDTH))
    vectors = dense @ right.T
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors = np.divide(vectors, norm, out=np.zeros_like(vectors), where=norm > 0)
    return Model((right * idf).T.astype(np.float64), vectors.astype(np.float64), np.array(labels, dtype=np.float64), neighbours)


def held_out(id_col: str):
    """True for rows that labels are never learned from: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = 4_000, rank: int = 48, neighbours: int = 15, text: str = "text", id_col: str = "doc_id", label: str = "quality") -> Model:
    """Fit on at most `sample` labelled rows that are not held out: those whose ids have the smallest hashes.

    The sample reaches the driver as sparse features.  Null labels and labels without a document are left out; of
    repeated ones any counts.
    """
    usable = labels.where(F.col(label).isin(0, 1) & ~held_out(id_col)).groupBy(id_col).agg(F.max(label).alias("_label"))
    chosen = usable.orderBy(F.xxhash64(id_col), id_col).limit(sample)
    rows = docs.select(id_col, text).join(F.broadcast(chosen), id_col).select(F.col(id_col).alias("id"), F.col(text).alias("text"), F.col("_label").cast("int").alias("label"))
    # of rows that repeat an id one text counts, chosen before anything is collected
    rows = rows.groupBy("id", "label").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [features(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), pa.array([m[0] for m in made], pa.list_(pa.int64())), pa.array([m[1] for m in made], pa.list_(pa.float64()))],
                names=["id", "label", "slots", "vals"],
            )

    small_batches(docs.sparkSession)
    kind = rows.schema["id"].dataType.simpleString()
    got = rows.mapInArrow(run, f"id {kind}, label int, slots array<long>, vals array<double>").collect()
    got.sort(key=lambda r: r["id"])
    return fit([(r["slots"], r["vals"]) for r in got], [r["label"] for r in got], rank, neighbours)


def scorer(spark: SparkSession, model: Model):
    """UDF of a text: its score."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # bounded by the sample

    @F.arrow_udf(DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        parts = [shared.value.scores(texts.slice(at, ROWS).to_pylist()) for at in range(0, len(texts), ROWS)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return score


def score_documents(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """docs plus a score from 0 to 1 of every whole text, higher where label 1 is likelier; replaces a column `out`.

    Only the text enters the score, and only the text goes to Python.  Null and empty texts get the share of label 1
    in the sample, and 0.5 if that is empty.  Repeated rows keep their rows; an empty table stays empty.
    """
    return docs.drop(out).withColumn(out, scorer(docs.sparkSession, model)(F.col(text)))


def quality_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    scored = score_documents(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, text: str = "text", **params) -> DataFrame:
    """docs that score at least the threshold; columns unchanged, whatever their names."""
    score = scorer(docs.sparkSession, train(docs, labels, text=text, **params))
    return docs.where(score(F.col(text)) >= threshold)
