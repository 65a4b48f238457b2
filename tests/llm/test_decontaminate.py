import random
import re
from collections import Counter

from dossierlake.llm import decontaminate as dec


def words(t):
    return [w for w in re.split(r"[^\w]+|_", (t or "").lower()) if w]


def bag(w):
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


def brute(docs, items):
    out = {}
    for d, t in docs:
        s = bag(words(t))
        for i, it in items:
            want = Counter(q := bag(words(it)))
            n, best = len(q), (0, 0)
            for at in range(len(s) - n + 1 if n else 0):
                both = sum((Counter(s[at : at + n]) & want).values())
                best = max(best, (both / (2 * n - both), -at))
            if best[0] >= 0.8:
                out[d, i] = (round(best[0], 6), -best[1])
    return out


def data():
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(300)] + ["é", "über"]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(say(rng.randrange(5, 60)))) for i in range(30)] + [(90, "too short"), (91, None), (92, ""), (93, "a b c d e a b c d e a b c d e a b c d e"), (94, " ".join(say(120)))]
    docs = [(0, None), (1, ""), (2, "a b c d e " * 30), (3, items[0][1].upper() + "!")]
    for k in range(60):
        w, i = items[rng.randrange(30)][1].split(), say(rng.randrange(0, 200))
        if k % 3 == 1:
            w[0] = "changed"
        if k % 3 == 2 and len(w) > 50:
            w[rng.randrange(len(w))] = "changed"
        docs.append((10 + k, " ".join(i + w + say(rng.randrange(0, 100)))))
    half = items[-1][1].split()
    docs += [(200, " ".join(half[60:] + half[:60])), (201, " ".join(half[:50] + ["x"] + half[50:])), (202, " ".join(say(400)))]
    return docs, items


def run(spark, docs, items, **kw):
    d = spark.createDataFrame([(a, b, "x") for a, b in docs], "doc_id long, text string, item string")
    b = spark.createDataFrame([(a, b, 1) for a, b in items], "item_id long, text string, id int")
    return d, b, {(r.doc_id, r.item_id): (r.similarity, r.start_word) for r in dec.find_leaks(d, b, **kw).collect()}


def test_against_brute_force(spark):
    docs, items = data()
    _, _, got = run(spark, docs, items)
    assert got == brute(docs, items) and len(got) > 30


def test_with_shuffle_joins_and_long_items_only(spark, monkeypatch):
    monkeypatch.setattr(dec, "BROADCAST_ROWS", 0)
    docs, items = data()
    items = [x for x in items if x[1] and len(x[1].split()) >= 15]
    _, _, got = run(spark, docs, items)
    assert got == brute(docs, items)


def test_drop_leaks_and_empty(spark):
    docs, items = data()
    d, b, got = run(spark, docs, items)
    kept = dec.drop_leaks(d, b)
    assert kept.columns == d.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({a for a, _ in docs} - {a for a, _ in got})
    assert dec.find_leaks(d.limit(0), b).count() == 0 and dec.find_leaks(d, b.limit(0)).count() == 0
    assert dec.drop_leaks(d, b.limit(0)).count() == len(docs)


def test_an_item_cut_by_one_word_is_a_whole_document(spark):
    items = [(n, " ".join(f"i{n}x{k}" for k in range(n))) for n in (9, 15, 30, 59)]
    docs, want = [], {}
    for n, text in items:
        w = text.split()
        for at, cut in enumerate((w[:-1], w[1:], w[: n // 2] + w[n // 2 + 1 :], w[: n // 2])):
            same = sum(cut[i : i + 5] in [w[k : k + 5] for k in range(n - 4)] for i in range(len(cut) - 4))
            similarity = same / (max(len(cut) - 4, 0) + n - 4 - same)
            docs.append((n * 10 + at, " ".join(cut)))
            if similarity >= 0.8:
                want[n * 10 + at, n] = (round(similarity, 6), 0)
    _, _, got = run(spark, docs, items)
    assert got == want and len(want) >= 8
