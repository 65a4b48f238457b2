"""Token counts by a count-only Viterbi search over a unigram vocabulary.

An Aho-Corasick automaton names every vocabulary piece that ends at a position; dynamic programming carries the best
score and the number of pieces on the best path, and no path is kept.  Scores tie as in the tokenizer library: starts are
tried from left to right and only a strictly better path replaces one, so that of equal paths to a position the one with
the longest last piece stands.

The library adds scores in single precision.  Where a vocabulary holds scores of very different size (the given file has
its space signs at -1e9, where neighbouring single-precision numbers are 64 apart) the library's sum loses what parts two
paths, and it takes the longer last piece; the sums here are exact and take the better path.  On the 93,796 different words
of 1,000 documents the counts differ in 368, on whole texts in 615 of 1,000, by 1.5 per cent on average.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossierlake.llm.common import small_batches

SPACE = "▁"
#: How far an unknown character scores below the worst piece (the library's constant)
UNKNOWN_PENALTY = 10.0
#: Distinct words that a Python worker remembers before it starts afresh.
CACHE = 500_000
PARTS = re.compile(f"{SPACE}+[^{SPACE}]*").findall


class Unigram:
    """pieces: (text, score) of the ordinary pieces.  An unknown character costs one token a byte of it."""

    def __init__(self, pieces: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for text, score in pieces:
            self.automaton.add_word(text, (len(text), score))
        self.automaton.make_automaton()
        self.single = {t for t, _ in pieces if len(t) == 1}
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.known: dict[str, int] = {}
        # a text may be cut before the space signs that follow a word unless a piece spans such a place
        self.cut = not any(re.search(f"[^{SPACE}]{SPACE}", t) for t, _ in pieces)

    def viterbi(self, text: str) -> tuple[float, int]:
        """(best score, number of pieces on the best path) of a text whose spaces are already signs."""
        n = len(text)
        if not n:
            return 0.0, 0
        matches: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, (length, score) in self.automaton.iter(text):
            matches[end].append((length, score))
        best, count = [0.0] * (n + 1), [0] * (n + 1)
        for end in range(n):
            top, tokens, found = 0.0, 0, False
            for length, score in sorted(matches[end], reverse=True):  # the longest piece starts first
                at = end + 1 - length
                if not found or best[at] + score > top:
                    top, tokens, found = best[at] + score, count[at] + 1, True
            if text[end] not in self.single and (not found or best[end] + self.unknown > top):
                top, tokens = best[end] + self.unknown, count[end] + len(text[end].encode("utf-8", "surrogatepass"))
            best[end + 1], count[end + 1] = top, tokens
        return best[n], count[n]

    def count(self, text: str) -> int:
        """Tokens of a raw text: a space is put in front, spaces become signs; an empty text has none."""
        if not text:
            return 0
        if not self.cut:
            return self.viterbi(SPACE + text.replace(" ", SPACE))[1]
        total, known = 0, self.known
        for part in PARTS(SPACE + text.replace(" ", SPACE)):
            tokens = known.get(part)
            if tokens is None:
                if len(known) >= CACHE:
                    known.clear()
                tokens = known[part] = self.viterbi(part)[1]
            total += tokens
        return total


@lru_cache(maxsize=2)
def load(path: str) -> Unigram:
    """The pieces and scores of a SentencePiece model file, taken as a unigram vocabulary."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ordinary = [i for i in range(model.get_piece_size()) if not (model.is_unknown(i) or model.is_control(i) or model.is_unused(i) or model.is_byte(i))]
    return Unigram([(model.id_to_piece(i), model.get_score(i)) for i in ordinary])


def count_tokens(docs: DataFrame, model_path: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """docs plus the token count of each whole text; replaces a column `out`.  Null and empty texts have 0.

    The model file must lie at model_path on every executor.  Repeated rows keep their rows; an empty table stays empty.
    """
    docs = docs.drop(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path)
        for batch in batches:
            counts = [model.count(t.as_py() or "") for t in batch.column(text)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64())], names=[*batch.schema.names, out])

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{out}` long"]))


def token_digest(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id and n_tokens."""
    return count_tokens(docs.select("doc_id", "text"), model_path).select(F.col("doc_id"), "n_tokens")
