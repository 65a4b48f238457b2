"""The vector index against all comparisons, language profiles on held-out texts, framed records of two encodings."""

import json
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType, StructType

from dossierlake.operators import knn_index
from dossierlake.operators.language import detect_languages, learn_profiles
from dossierlake.operators.vectors import knn_exact
from dossierlake.sources.frames import Schema, scan_frames

# --- index ---------------------------------------------------------------------------------------------------------

VECTORS = "vec_id long, collection string, v array<double>"


def clustered(n, dim=16, seed=3, groups=12, spread=0.15):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(groups, dim))
    return [(i, "ab"[i % 2], (middles[rng.integers(groups)] + spread * rng.normal(size=dim)).tolist()) for i in range(n)]


def plain(df):
    return sorted((r.query_id, r.rank, r.vec_id) for r in df.collect())


def test_exact_search_equals_all_comparisons(spark, monkeypatch):
    rows = clustered(240)
    # copies, zero vectors, a crowded direction
    rows += [(1000 + i, "a", rows[4][2]) for i in range(12)] + [(2000 + i, "ab"[i % 2], [0.0] * 16) for i in range(9)] + [(3000 + i, "a", [1.0, *[0.0] * 15]) for i in range(30)]
    df = spark.createDataFrame(rows, VECTORS)
    asked = df.where("vec_id % 7 = 0 or vec_id >= 2000")
    want = plain(knn_exact(asked, df, 5))
    index = knn_index.build_index(df)
    assert plain(knn_index.search(index, asked, 5, probes=2)) == want
    monkeypatch.setattr(knn_index, "BLOCK", 30)
    monkeypatch.setattr(knn_index, "QUERIES", 20)
    assert plain(knn_index.search(knn_index.build_index(df, lists=3), asked, 5, probes=1)) == want


def test_bound_prunes_and_few_probes_find_most(spark):
    df = spark.createDataFrame(clustered(2000, groups=60), VECTORS)
    asked = df.where("vec_id % 20 = 0")
    want = plain(knn_exact(asked, df, 6))
    index = knn_index.build_index(df)
    near = plain(knn_index.search(index, asked, 6, probes=3, exact=False))
    pairs = lambda rows: {(q, v) for q, _, v in rows}
    assert len(pairs(near) & pairs(want)) >= 0.95 * len(pairs(want))
    # the bound leaves most of the lists unread
    q = knn_index._usable(asked).select(F.col("vec_id").alias("query_id"), "collection", F.col("u").alias("qu"))
    kth = knn_index.search(index, asked, 6, probes=3, exact=False).groupBy("query_id").agg(F.max("distance").alias("kth"))
    more = knn_index._route(q.join(kth, "query_id"), index, 3, True).count()
    assert more < 0.4 * asked.count() * len(index.centroids["a"])


def test_vectors_that_can_not_be_compared_are_left_out(spark):
    rows = [(1, "a", [1.0, 0.0]), (2, "a", [0.9, 0.1]), (3, "a", None), (4, "a", []), (5, "a", [1.0]), (6, "a", [float("nan"), 1.0]), (7, "a", [None, 1.0]), (8, None, [1.0, 0.0]), (9, "b", [1.0])]
    df = spark.createDataFrame(rows, VECTORS)
    got = knn_index.search(knn_index.build_index(df), df, 3)
    assert plain(got) == [(1, 1, 1), (1, 2, 2), (2, 1, 2), (2, 2, 1), (9, 1, 9)]
    assert knn_index.search(knn_index.build_index(df.limit(0)), df, 3).collect() == []
    assert knn_index.search(knn_index.build_index(df), df.limit(0), 3).collect() == []


# --- languages -----------------------------------------------------------------------------------------------------


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    profiles = learn_profiles(docs.where(~held), rows=200)
    rows = detect_languages(docs.where(held), profiles).where("length(text) > 40").select("lang", "language", "probability", "multilingual").collect()
    right = [r for r in rows if r.lang == r.language]
    assert len(right) >= 0.97 * len(rows) > 200 and all(0.25 <= r.probability <= 1 for r in rows)
    assert sum(r.probability > 0.9 for r in right) > 0.9 * len(right)
    # where a text begins in one language and goes on in another
    best = {r.lang: r.text for r in docs.where(held & (F.length("text") > 1500)).dropDuplicates(["lang"]).collect()}
    mixed = [(i, best["en"][:1500] + " " + best[o][:1500]) for i, o in enumerate(("de", "fr", "es"))]
    found = detect_languages(spark.createDataFrame(mixed, "doc_id long, text string"), profiles).collect()
    assert all(r.language == "en" and r.multilingual for r in found)


def test_texts_without_letters(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "der Hund und die Katze", "de")], "doc_id long, text string, lang string")
    odd = spark.createDataFrame([(1, None), (2, ""), (3, " \n\t "), (4, "12 + 34 = 46"), (5, "und die Katze"), (6, "the dog"), (7, "x" * 100_000)], "doc_id long, text string")
    got = {r.doc_id: (r.language, r.probability, r.multilingual) for r in detect_languages(odd, learn_profiles(docs)).collect()}
    assert {i: got[i] for i in (1, 2, 3, 4)} == {1: ("en", 1.0, False), 2: ("en", 1.0, False), 3: ("en", 1.0, False), 4: ("en", 0.0, False)}
    assert got[5][0] == "de" and got[6][0] == "en" and len(got) == 7
    assert all(r.language == "en" for r in detect_languages(odd, learn_profiles(docs.limit(0))).collect())


# --- frames --------------------------------------------------------------------------------------------------------


def zigzag(n):
    n, out = (n << 1) ^ (n >> 63), b""
    while n > 0x7F:
        out, n = out + bytes([n & 0x7F | 0x80]), n >> 7
    return out + bytes([n])


def avro(kind, value, nullable):
    head = (zigzag(0) if value is None else zigzag(1)) if nullable else b""
    if value is None:
        return head
    text = lambda s: zigzag(len(s.encode())) + s.encode()
    body = {
        "long": lambda: zigzag(value), "int": lambda: zigzag(value), "string": lambda: text(value), "boolean": lambda: bytes([value]), "double": lambda: struct.pack("<d", value),
        "map": lambda: (zigzag(-len(value)) + zigzag(9) if len(value) > 1 else zigzag(len(value))) + b"".join(text(k) + text(v) for k, v in value.items()) + (zigzag(0) if value else b""),
    }[kind]()
    return head + body


def frame(number, body):
    return b"\x00" + struct.pack(">I", number) + body


ONE = StructType().add("id", "string", False).add("n", "long").add("ok", "boolean", False)
TWO = StructType().add("id", "string", False).add("n", "long").add("ok", "boolean", False).add("x", "double").add("tags", MapType(StringType(), StringType()), False)
READER = StructType().add("id", "string").add("n", "long").add("x", "double").add("tags", MapType(StringType(), StringType()))
DEFAULTS = {"x": -1.0, "tags": None}


def test_avro_and_json_bodies_of_two_versions(spark):
    rng, rows, want = random.Random(1), [], {}
    for i in range(200):
        rec = {"id": f"é{i}", "n": rng.choice([None, 0, -1, 63, 64, -(2**40), 2**62, i]), "ok": rng.random() < 0.5}
        two = rec | {"x": rng.choice([None, 0.5, -1e300]), "tags": {f"k{j}": "v" * j for j in range(rng.randrange(4))}}
        kinds = [("id", "string", False), ("n", "long", True), ("ok", "boolean", False), ("x", "double", True), ("tags", "map", False)]
        pick = i % 4
        body = [json.dumps(rec).encode(), b"".join(avro(k, rec[n], o) for n, k, o in kinds[:3]), json.dumps(two).encode(), b"".join(avro(k, two[n], o) for n, k, o in kinds)][pick]
        rows.append((i, frame([1, 70_000, 3, 4_000_000_000][pick], body)))
        want[i] = (rec["id"], rec["n"], two["x"] if pick > 1 else -1.0, two["tags"] if pick > 1 else None)
    schemas = [Schema(1, ONE), Schema(70_000, ONE, "avro"), Schema(3, TWO), Schema(4_000_000_000, TWO, "avro")]
    good, bad = scan_frames(spark.createDataFrame(rows, "line long, value binary"), schemas, READER, DEFAULTS)
    assert {r.line: (r.id, r.n, r.x, r.tags) for r in good.collect()} == want and bad.count() == 0


def test_broken_frames_are_dead_letters(spark):
    fine = b"".join([avro("string", "a", False), avro("long", 5, True), avro("boolean", True, False)])
    cases = {
        "TooShort": [None, b"", b"\x00\x00\x00\x00"], "BadMagic": [b"\x01" + frame(2, fine)[1:]], "UnknownSchema": [frame(9, fine), frame(9, b"")],
        "BadBody": [frame(2, fine[:-1]), frame(2, fine + b"x"), frame(2, b""), frame(2, zigzag(-4) + fine), frame(2, b"\xff" * 12), frame(2, zigzag(1) + b"\xff" + fine[2:]), frame(1, b"{"), frame(1, b'{"id":"a","ok":true} {}'), frame(1, b"\xff"), frame(1, b"")],
        "MissingField": [frame(1, b'{"n":1,"ok":true}'), frame(1, b'{"id":null,"ok":true}'), frame(1, b"{}")],
    }
    rows = [(i, v, e) for i, (e, v) in enumerate((e, v) for e, vs in cases.items() for v in vs)] + [(99, frame(2, fine), None)]
    df = spark.createDataFrame([(i, v) for i, v, _ in rows], "line long, value binary")
    good, bad = scan_frames(df, [Schema(1, ONE), Schema(2, ONE, "avro")], READER, DEFAULTS)
    assert {r.line: r.error for r in bad.collect()} == {i: e for i, _, e in rows if e} and [r.line for r in good.collect()] == [99]
    with pytest.raises(ValueError, match="schema 1 has no x"):
        scan_frames(df, [Schema(1, ONE)], READER, {"tags": None})
