import hashlib
import zlib

import pytest

from dossierlake.llm import merkle


def H(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(r, text):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], text)))


def climb(nodes, at):
    """(root, siblings level by level, path) of a list of digests, by plain runs of 16."""
    proof, path = [], []
    while len(nodes) > 1:
        run = nodes[at // 16 * 16 : at // 16 * 16 + 16]
        path.append((run[: at % 16], run[at % 16 + 1 :]))
        proof += run[: at % 16] + run[at % 16 + 1 :]
        nodes, at = [H("".join(nodes[i : i + 16])) for i in range(0, len(nodes), 16)], at // 16
    return nodes[0], proof, path


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1]))) for s in order}
    subroots = [climb([leaf(r, r[1]) for r in trees[s]], 0)[0] for s in order]
    out = []
    for g, s in enumerate(order):
        leaves = [leaf(r, r[1]) for r in trees[s]]
        for i, r in enumerate(trees[s]):
            _, low, path = climb(leaves, i)
            root, high, over = climb(subroots, g)
            shown = r[1]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and shown is not None:
                shown = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in shown)
            folded = leaf(r, shown)
            for left, right in path + over:
                folded = H("".join(left) + folded + "".join(right))
            out.append((r[0], leaves[i], subroots[g], root, H("".join(low + high)), folded, folded == root, len(low + high)))
    return out


def frame(spark, rows):
    kind = "doc_id long, text string, lang string, source string, n_chars long, part int, at int, rank string, gid long, block int, level int, siblings string, leaf string"
    return spark.createDataFrame([(*r, 1, 2, "r", 3, 4, 5, "s", "l") for r in rows], kind)


def both(spark, rows, parts=3):
    got = merkle.merkle_digest(frame(spark, rows).repartition(parts))
    key = lambda r: tuple((x is not None, x) for x in r)
    return sorted((tuple(r) for r in got.collect()), key=key), sorted(brute(rows), key=key)


def test_addresses_are_postorder_positions():
    for n in [1, 2, 15, 16, 17, 31, 33, 255, 256, 257, 300, 4095, 4096, 4097, 5000]:
        log, pending, h = [], [0] * (merkle.height(n) + 1), merkle.height(n)
        for i in range(n):
            log.append((0, i))
            for level in range(1, h + 1):
                if (i + 1) % 16**level and i != n - 1:
                    break
                log.append((level, pending[level]))
                pending[level] += 1
        assert [merkle.address(level, number, n) for level, number in log] == list(range(len(log)))


def test_groups_of_every_size_against_plain_python(spark):
    sizes = {"a": 1, "b": 15, "c": 16, "d": 17, None: 20, "": 2, "é": 257, "hot": 700, **{f"s{i:02}": 1 for i in range(12)}}
    rows, n = [], 0
    for source, size in sizes.items():
        for _ in range(size):
            n += 1
            rows.append((n * 7919 % 100_003 - 500, ["Some Text", "plain", "ÄB é🙂", "", None][n % 5], [None, "en"][n % 2], source, [None, n][n % 3 > 0]))
    got, want = both(spark, rows)
    assert got == want
    assert 0 < sum(not r[6] for r in got) < len(got)


def test_awkward_rows(spark):
    same = (7, "Same", "en", "s", 4)
    rows = [same] * 40 + [(None, "A", None, None, None), (None, None, None, None, None), (None, "A", None, "s", 1), (5, "X" * 400_000, "en", "s", 1), (5, "other", "en", "s", 1), (0, "Zero", "x", "t", 0)]
    got, want = both(spark, rows)
    assert got == want


def test_one_row_and_no_rows(spark):
    got, want = both(spark, [(3, "Lone", "en", "s", 4)], 1)
    assert got == want and got[0][1] == got[0][2] == got[0][3] and got[0][4] == H("")
    empty = merkle.merkle_digest(frame(spark, [])).limit(5)
    assert empty.collect() == [] and empty.columns[:7] == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_log_is_whole_and_in_postorder(spark):
    rows = [(i, f"t{i}", "en", "s", i) for i in range(5000)]
    made = merkle.manifest(frame(spark, rows))
    log = [r for t in made.trees.logs for r in t.collect()]
    assert sorted(r["position"] for r in log) == list(range(5000 + 313 + 20 + 2 + 1)) and made.trees.rounds == 2
    assert max(log, key=lambda r: r["position"])["digest"].hex() == made.root
    assert merkle.verified_proofs(made).where("not verified").count() == 0


@pytest.mark.parametrize("n", [1, 16, 17, 300])
def test_fold_undoes_steps(n):
    digests = [H(str(i)) for i in range(n)]
    for at in {0, n // 2, n - 1}:
        root, proof, _ = climb(digests, at)
        assert merkle.fold(digests[at], "".join(proof), merkle.steps(at, n)) == root
        if n > 1:
            assert merkle.fold(H("x"), "".join(proof), merkle.steps(at, n)) != root
