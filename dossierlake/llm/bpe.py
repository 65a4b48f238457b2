"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches."""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossierlake.llm.common import small_batches

#: Distinct pieces that a Python worker remembers before it starts afresh.
CACHE = 50_000


def byte_chars() -> list[str]:
    """The byte-to-character table: printable Latin-1 bytes stand for themselves, the others follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    table = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [table[b] for b in range(256)]


class ByteBPE:
    """A byte-level BPE of the tokenizers library built from a rank file (base64 token, rank a line).

    Every way to cut a token into two tokens becomes a merge at that token's rank, which is how ranks are meant.
    """

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models, pre_tokenizers

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, filter(bytes.strip, lines))}
        self.chars = byte_chars()
        self.bytes_of = {c: b for b, c in enumerate(self.chars)}
        spell = lambda t: "".join(self.chars[b] for b in t)
        merges = [(spell(t[:i]), spell(t[i:])) for t in sorted(ranks, key=ranks.get) for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.model = Tokenizer(models.BPE(vocab={spell(t): r for t, r in ranks.items()}, merges=merges))
        self.model.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.pieces = regex.compile(pattern).findall
        self.iter_pieces = regex.compile(pattern).finditer
        #: decoding table by the reversed byte table
        self.table = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, i in self.model.get_vocab().items():
            self.table[i] = bytes(self.bytes_of[c] for c in token)
        self.known: dict[str, bytes] = {}

    def _learn(self, pieces: set[str]) -> None:
        if len(self.known) + len(pieces) > CACHE:
            self.known = {}
        new = [p for p in pieces if p not in self.known]
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            for p, e in zip(part, self.model.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self.known[p] = np.array(e.ids, dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Token ids of a text as little-endian unsigned 32-bit integers; each match of the pattern separately."""
        pieces = self.pieces(text)
        known = self.known
        try:
            return b"".join([known[p] for p in pieces])
        except KeyError:
            self._learn(set(pieces))
            return b"".join([self.known[p] for p in pieces])

    def decode(self, ids: np.ndarray) -> bytes:
        table = self.table
        return b"".join([table[i] for i in ids.tolist()])

    def offsets(self, text: str) -> list[tuple[int, int]]:
        """Per token the code points (start, end) that it touches; a character split over tokens belongs to each."""
        out = []
        for m in self.iter_pieces(text):
            self._learn({m[0]}) if m[0] not in self.known else None
            raw, at = m[0].encode(), 0
            # code point of each byte: those that begin one count up
            owner = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80) - 1 + m.start()
            for i in np.frombuffer(self.known[m[0]], "<u4"):
                end = at + len(self.table[i])
                out.append((int(owner[at]), int(owner[end - 1]) + 1))
                at = end
        return out


@lru_cache(maxsize=4)
def load(path: str, pattern: str) -> ByteBPE:
    """One tokenizer per worker process."""
    return ByteBPE(path, pattern)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", with_offsets: bool = False) -> DataFrame:
    """docs plus ids array<int> (and offsets array<struct<start,end>>); replaces columns of those names.

    Null texts count as empty and have no ids.  The rank file must lie at ranks_path on every executor.
    """
    kinds = {"ids": "array<int>"} | ({"offsets": "array<struct<start:int,end:int>>"} if with_offsets else {})
    docs = docs.drop(*kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(ranks_path, pattern)
        for batch in batches:
            texts = batch.column(text).to_pylist()
            got = [np.frombuffer(bpe.encode(t or ""), "<u4").astype("i4") for t in texts]
            columns = [pa.array(got, pa.list_(pa.int32()))]
            if with_offsets:
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                columns.append(pa.array([[{"start": s, "end": e} for s, e in bpe.offsets(t or "")] for t in texts], kind))
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *kinds])

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), *(f"{k} {v}" for k, v in kinds.items())]))


def decode_ids(tokens: DataFrame, ranks_path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """tokens plus decoded binary and decoded_text string.

    A token that holds part of a character is joined with its neighbours first; bytes that still form no character
    become U+FFFD in decoded_text and stay exact in decoded.  Null ids decode to nothing; an id outside the
    vocabulary is an error.
    """
    tokens = tokens.drop("decoded", "decoded_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(ranks_path, pattern)
        for batch in batches:
            raw = [bpe.decode(np.asarray(x or [], dtype="i8")) for x in batch.column(ids).to_pylist()]
            columns = [pa.array(raw, pa.binary()), pa.array([r.decode("utf-8", "replace") for r in raw], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "decoded", "decoded_text"])

    return tokens.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema), "decoded binary", "decoded_text string"]))


def encode_digests(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Per row: id, n_tokens, ids_sha256 and decoded_sha256 of the encoded and decoded whole text.

    Does in one pass over the batches what encode_documents and decode_ids do, without handing ids back to Spark.
    Null and empty texts have no tokens and the digests of no bytes; rows with null or repeated ids stay rows; an empty
    table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(ranks_path, pattern)
        for batch in batches:
            n, ids_hash, raw_hash = [], [], []
            for t in batch.column(text):
                ids = bpe.encode(t.as_py() or "")
                n.append(len(ids) // 4)
                ids_hash.append(hashlib.sha256(ids).hexdigest())
                raw_hash.append(hashlib.sha256(bpe.decode(np.frombuffer(ids, "<u4"))).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col), pa.array(n, pa.int64()), pa.array(ids_hash), pa.array(raw_hash)],
                names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text)).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
