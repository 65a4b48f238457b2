import random
from collections import Counter

from dossierlake.llm import line_dedup as ld


def brute(docs, min_words, rare):
    """Plain version: every pair of the rule, patience by recursion."""
    lines = {d: [(i, x.strip()) for i, x in enumerate((t or "").split("\n")) if x.strip()] for d, t in docs}
    holders = {}
    for d, ls in lines.items():
        for _, x in ls:
            holders.setdefault(x, set()).add(d)
    pairs = set()
    for ds in holders.values():
        ds = sorted(ds)
        pairs |= {(b, a) for a in ds for b in ds if a < b} if len(ds) <= rare else {(b, ds[0]) for b in ds[1:]}

    def align(x, y):
        if not x or not y:
            return []
        if x[0][1] == y[0][1]:
            return [(x[0][0], y[0][0])] + align(x[1:], y[1:])
        if x[-1][1] == y[-1][1]:
            return align(x[:-1], y[:-1]) + [(x[-1][0], y[-1][0])]
        cx, cy = Counter(v for _, v in x), Counter(v for _, v in y)
        where = {v: k for k, (_, v) in enumerate(y)}
        u = [(k, where[v]) for k, (_, v) in enumerate(x) if cx[v] == 1 and cy[v] == 1]
        if not u:  # the first of a line with the first on the other side, and so on
            turn = lambda z: [(v, sum(w == v for _, w in z[:k])) for k, (_, v) in enumerate(z)]
            there = {t: k for k, t in enumerate(turn(y))}
            u = [(k, there[t]) for k, t in enumerate(turn(x)) if t in there]
        if not u:
            return []
        best = []
        for k, (a, b) in enumerate(u):
            prev = max((best[m] for m in range(k) if u[m][1] < b), key=len, default=[])
            best.append(prev + [(a, b)])
        length = max(map(len, best))
        # of equally long runs, that with the smallest end, then the latest predecessors' choice, is what piles give
        chain = piles(u)
        assert len(chain) == length
        out, pa, pb = [], 0, 0
        for a, b in chain:
            out += align(x[pa:a], y[pb:b]) + [(x[a][0], y[b][0])]
            pa, pb = a + 1, b + 1
        return out + align(x[pa:], y[pb:])

    def piles(u):
        tops = []
        links = {}
        for k, (_, b) in enumerate(u):
            p = next((i for i, t in enumerate(tops) if u[t][1] >= b), len(tops))
            links[k] = tops[p - 1] if p else None
            tops[p : p + 1] = [k]
        out, k = [], tops[-1]
        while k is not None:
            out.append(u[k])
            k = links[k]
        return out[::-1]

    gone = {}
    for later, earlier in pairs:
        x = [(k, v) for k, (_, v) in enumerate(lines[later])]
        y = [(k, v) for k, (_, v) in enumerate(lines[earlier])]
        both = {v for _, v in x} & {v for _, v in y}
        # outer lines that the other document does not hold match nothing
        cut = lambda z: z[min(i for i, (_, v) in enumerate(z) if v in both) : max(i for i, (_, v) in enumerate(z) if v in both) + 1]
        x, y = cut(x), cut(y)
        run = []
        for a, b in [*sorted(align(x, y)), (-9, -9)]:
            if run and (a, b) != (run[-1][0] + 1, run[-1][1] + 1):
                if sum(len(lines[later][k][1].split()) for k, _ in run) >= min_words:
                    gone.setdefault(later, set()).update(lines[later][k][0] for k, _ in run)
                run = []
            run.append((a, b))
    return {d: sorted(v) for d, v in gone.items()}


def data():
    rng = random.Random(13)
    pool = [" ".join(f"w{rng.randrange(90)}" for _ in range(rng.randrange(1, 14))) for _ in range(60)]
    docs = [(0, None), (1, ""), (2, "\n\n \n"), (3, "hot line of six words here\n" + pool[0])]
    for d in range(4, 60):
        ls = [rng.choice(pool) if rng.random() < 0.5 else f"own {d} {k}" for k in range(rng.randrange(1, 25))]
        if d % 4 == 0:
            ls[rng.randrange(len(ls)) :] = pool[10:20] + ["", "  "] + pool[20:24]
        if d % 3 == 0:
            ls.insert(0, "hot line of six words here")
        docs.append((d, "\n".join(ls)))
    docs += [(d + 100, t) for d, t in docs[10:20]]
    return docs


def test_against_brute_force(spark):
    docs = data()
    df = spark.createDataFrame([(d, t, "k") for d, t in docs], "doc_id long, text string, key string")
    for min_words, rare in ((50, 8), (8, 3), (1, 100)):
        got = {r.doc_id: r.removed for r in ld.repeated_lines(df, min_words=min_words, rare=rare).collect()}
        assert got == brute(docs, min_words, rare) and got


def test_text_that_stays(spark):
    docs = data()
    df = spark.createDataFrame([(d, t, "k") for d, t in docs] + [(None, docs[20][1], "k")], "doc_id long, text string, key string")
    got = {r.doc_id: r for r in ld.dedup_lines(df).collect()}
    gone = brute(docs, 50, 8)
    assert len(got) == len(docs) + 1
    for d, t in docs:
        want = t if d not in gone else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d])
        assert got[d].text == want
    assert ld.dedup_lines(df.limit(0)).count() == 0


def test_first_holder_keeps_a_passage_and_clean_documents_stay(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"intro {i}\n{passage}\noutro {i}") for i in range(40)] + [(100, "clean\nshort common"), (101, "other\nshort common")]
    got = {r.doc_id: r for r in ld.line_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].n_removed == 0 and all(got[i].removed_lines == "1" for i in range(1, 40))
    assert got[100].n_removed == got[101].n_removed == 0


def test_a_passage_of_lines_that_stood_alone_before(spark):
    lines = [" ".join(f"p{k}x{i}" for i in range(10)) for k in range(6)]
    rows = [(i, f"own {i}\n{lines[i % 6]}\nend {i}") for i in range(100)] + [(i, f"own {i}\n" + "\n".join(lines) + f"\nend {i}") for i in range(100, 174)]
    got = {r.id: r.removed for r in ld.repeated_lines(spark.createDataFrame(rows, "id long, text string"), id_col="id", runs=True).collect()}
    assert got == {i: [1, 2, 3, 4, 5, 6] for i in range(101, 174)}


def test_runs_cover_every_line_of_a_block():
    words = [30, 5, 30, 2, 60, 1, 1]
    assert len(ld.run_hashes(list(range(7)), list(range(7)), words, 50)) == 8  # lines 0-2, 1-4, 2-4, 3-4 and 4 forward; 4-6, 4-5 and 0-3 backward
    assert ld.run_hashes([0, 2], [1, 2], [30, 30], 50) == []


def test_a_passage_that_stands_twice(spark):
    passage = "\n".join(f"p{k} " * 30 for k in range(3))
    rows = [(1, f"one\n{passage}\nmiddle\n{passage}"), (2, f"two\n{passage}\nother\n{passage}\nend"), (3, f"three\n{passage}")]
    got = {r.id: r.removed for r in ld.repeated_lines(spark.createDataFrame(rows, "id long, text string"), id_col="id", runs=True).collect()}
    assert got == {2: [1, 2, 3, 5, 6, 7], 3: [1, 2, 3]}


def test_rows_that_repeat_an_id(spark):
    a = "\n".join(f"a{k} " * 30 for k in range(4))
    rows = [(1, "i\n" + a), (2, "j\n" + a), (2, "k\n" + a.replace("a", "b")), (2, "j\n" + a), (None, "j\n" + a), (4, None), (5, "")]
    got = sorted(((r.doc_id, r.text) for r in ld.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == sorted([(1, rows[0][1]), (2, "j"), (2, rows[2][1]), (2, "j"), (None, rows[4][1]), (4, None), (5, "")], key=repr)


def test_recall_against_all_pairs(spark):
    """Blocks by the rule against blocks by all pairs of documents: the rule finds nothing else and loses next to nothing."""
    rng = random.Random(21)
    pool = [" ".join(f"q{rng.randrange(400)}" for _ in range(rng.randrange(5, 25))) for _ in range(80)]
    docs = []
    for d in range(150):
        ls = [rng.choice(pool) if rng.random() < 0.3 else f"own {d} {k}" for k in range(rng.randrange(2, 20))]
        if d % 3 == 0:
            at = rng.randrange(60)
            ls[rng.randrange(len(ls)) :] = pool[at : at + rng.randrange(4, 14)]
        docs.append((d, "\n".join(ls)))
    got = {r.doc_id: set(r.removed) for r in ld.repeated_lines(spark.createDataFrame(docs, "doc_id long, text string"), runs=True).collect()}
    want = {d: set(v) for d, v in brute(docs, 50, 10**9).items()}
    found = sum(len(got.get(d, set()) & v) for d, v in want.items())
    assert all(v <= want.get(d, set()) for d, v in got.items())
    assert found >= 0.98 * sum(map(len, want.values())) > 100
