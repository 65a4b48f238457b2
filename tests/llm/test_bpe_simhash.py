import base64
import hashlib
import random
import re

import numpy as np
import public_tokenizers as tok
import pytest
import tiktoken
import xxhash

from dossierlake.llm import bpe, simhash_dedup

RANKS = tok.path("byte_bpe_50k.tiktoken")
TEXTS = [None, "", " ", "a", "\n\n \t x", "héllo wörld 12345", "日本語🙂 and 👩‍👩‍👧", "the the the", "<|endoftext|> x", "=" * 500, "It's we'll ok", "ab " * 4000]


@pytest.fixture(scope="module")
def reference():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=tok.PATTERN, mergeable_ranks=ranks, special_tokens={})


def frame(spark, texts):
    return spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, ids int")


def test_encode_as_the_reference_library(spark, reference):
    rows = bpe.encode_digests(frame(spark, TEXTS), RANKS, tok.PATTERN).collect()
    for r in rows:
        text = TEXTS[r.doc_id] or ""
        ids = reference.encode_ordinary(text)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_round_trip_offsets_and_clashing_column(spark):
    encoded = bpe.encode_documents(frame(spark, TEXTS), RANKS, tok.PATTERN, with_offsets=True)
    for r in bpe.decode_ids(encoded, RANKS, tok.PATTERN).collect():
        text = TEXTS[r.doc_id] or ""
        assert r.decoded_text == text and bytes(r.decoded) == text.encode()
        assert len(r.offsets) == len(r.ids)
        assert all(0 <= o.start < o.end <= len(text) for o in r.offsets)
        assert not text or (r.offsets[0].start == 0 and r.offsets[-1].end == len(text))


def test_split_character_decodes_to_replacement(spark):
    first = np.frombuffer(bpe.load(RANKS, tok.PATTERN).encode("🙂"), "<u4")[:1].tolist()
    ids = spark.createDataFrame([(first,)], "ids array<int>")
    row = bpe.decode_ids(ids, RANKS, tok.PATTERN).first()
    assert "�" in row.decoded_text and bytes(row.decoded) == "🙂".encode()[: len(row.decoded)]


def test_empty_table(spark):
    assert bpe.encode_digests(frame(spark, TEXTS).limit(0), RANKS, tok.PATTERN).count() == 0
    assert simhash_dedup.simhash_groups(frame(spark, TEXTS).limit(0)).count() == 0


def brute_fp(text, size=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    shingles = [" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(prints):
    part = {i: i for i in prints}
    for i in prints:
        for j in prints:
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = sorted((part[i], part[j]))
                part = {k: a if v == b else v for k, v in part.items()}
    return part


def test_simhash_against_brute_force(spark):
    rng = random.Random(3)
    vocab = ["alpha", "Beta", "gam-ma", "δέλτα", "ÉCOLE", "x", "1,5"]
    texts = [*TEXTS, "Alpha beta", "ALPHA\x0bBETA", "alpha beta"]
    for _ in range(25):
        base = [rng.choice(vocab) + str(rng.randrange(40)) for _ in range(rng.randrange(1, 300))]
        for _ in range(4):
            copy = base[:]
            copy[rng.randrange(len(copy))] = "edit"
            texts.append(" ".join(copy))
        texts.append(" ".join(base))
    got = simhash_dedup.simhash_groups(frame(spark, texts)).collect()
    prints = {i: brute_fp(t) for i, t in enumerate(texts)}
    assert {r.doc_id: int(r.fingerprint, 16) for r in got} == prints
    assert {r.doc_id: r.component_id for r in got} == brute_groups(prints)


def test_links_are_complete(spark):
    rng = random.Random(5)
    prints = {0, 2**64 - 1}
    while len(prints) < 600:
        x = rng.getrandbits(64)
        prints.add(x)
        for _ in range(3):
            y = x
            for b in rng.sample(range(64), rng.randrange(1, 5)):
                y ^= 1 << b
            prints.add(y)
    signed = lambda x: x - 2**64 if x >> 63 else x
    got = {(r.u, r.v) for r in simhash_dedup.hamming_links(spark.createDataFrame([(signed(x),) for x in prints], "fp long")).collect()}
    want = {(a, b) for x in prints for y in prints if (a := signed(x)) < (b := signed(y)) and (x ^ y).bit_count() <= 3}
    assert got == want


def brute_similar(texts, size=5, least=0.8):
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    part = {i: i for i in texts}
    for i in texts:
        for j in texts:
            if i < j and part[i] != part[j] and (sets[i] == sets[j] or len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j])):
                a, b = sorted((part[i], part[j]))
                part = {k: a if v == b else v for k, v in part.items()}
    return part


def test_near_duplicates_against_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    texts = [None, "", "one two", "One two"]
    for _ in range(30):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.randrange(8, 250))]
        for k in range(4):
            copy = base[:]
            for _ in range(k * len(base) // 60):
                copy[rng.randrange(len(copy))] = "edit"
            texts.append(" ".join(copy if k else base[rng.randrange(2) :]))
    hub = [f"h{rng.randrange(900)}" for _ in range(200)]
    texts += [" ".join([f"x{k}" if i == 3 * k else w for i, w in enumerate(hub)]) for k in range(60)]
    df = frame(spark, texts)
    want = brute_similar(dict(enumerate(texts)))
    got = {r.doc_id: r.component_id for r in simhash_dedup.near_duplicates(df).collect()}
    assert got == want and len(set(want.values())) < len(want)
    kept = simhash_dedup.near_dedup(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == set(want.values())
    assert simhash_dedup.near_dedup(df.limit(0)).count() == 0


def test_hub_with_a_middle_id_joins_its_copies(spark):
    rng = random.Random(1)
    base = [f"h{i}" for i in range(200)]
    texts = []
    for k in range(120):
        copy = base[:]
        for at in rng.sample(range(200), 3) if k != 60 else ():
            copy[at] = f"x{k}.{at}"
        texts.append(" ".join(copy))
    want = brute_similar(dict(enumerate(texts)))
    assert len(set(want.values())) == 1
    got = {r.doc_id: r.component_id for r in simhash_dedup.near_duplicates(frame(spark, texts)).collect()}
    assert got == want


def test_pairs_that_share_a_frequent_passage_are_compared(spark):
    rng = random.Random(2)
    passage = [f"p{i}" for i in range(160)]
    own = [[f"d{d}.{i}" for i in range(40)] for d in range(60)]
    # 60 documents, each with a partner at 0.8 or more, share three quarters of their words; other pairs stay below
    texts = [" ".join(passage + w) for w in own] + [" ".join(passage + w[:-5]) for w in own]
    rng.shuffle(texts)
    want = brute_similar(dict(enumerate(texts)))
    assert len(set(want.values())) == 60
    got = {r.doc_id: r.component_id for r in simhash_dedup.near_duplicates(frame(spark, texts)).collect()}
    assert got == want


def test_a_line_repeated_often_does_not_part_near_copies(spark):
    rng = random.Random(4)
    texts = []
    for k in range(20):
        base = [f"w{rng.randrange(5000)}" for _ in range(200)]
        texts += [" ".join(base), " ".join(base + base[20:32] * 100)]
    want = brute_similar(dict(enumerate(texts)))
    assert len(set(want.values())) == 20
    got = {r.doc_id: r.component_id for r in simhash_dedup.near_duplicates(frame(spark, texts)).collect()}
    assert got == want
