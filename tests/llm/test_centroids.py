import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest

from dossierlake.llm import centroids as c


def brute(rows, k, rounds, dim):
    kept = [(i, [math.floor(Fraction(v) * 256) for v in x], x) for i, x in rows if x is not None and len(x) == dim and all(v is not None and math.isfinite(v) for v in x)]
    h = lambda i: hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest()
    cents = [q for _, q, _ in sorted(kept, key=lambda r: (h(r[0]), r[2]))[:k]]
    far = lambda q, m: sum((a - b) ** 2 for a, b in zip(q, m, strict=True))
    nearest = lambda q: min(range(len(cents)), key=lambda j: (far(q, cents[j]), j))
    for _ in range(rounds):
        members = {}
        for _, q, _ in kept:
            members.setdefault(nearest(q), []).append(q)
        for j, qs in members.items():
            cents[j] = [sum(col) // len(qs) for col in zip(*qs, strict=True)]
    won = [(i, nearest(q), q) for i, q, _ in kept]
    d = [far(q, cents[j]) for _, j, q in won]
    fit = lambda v: v if v is not None and v < 2**63 else None
    total = lambda ds: None if any(v >= 2**63 for v in ds) else fit(sum(ds))
    out = []
    for (i, j, _), x in zip(won, d, strict=True):
        own = [v for (_, m, _), v in zip(won, d, strict=True) if m == j]
        out.append((i, j, fit(x), total(own), total(d), hashlib.sha256(",".join(map(str, cents[j])).encode()).hexdigest(), len(own)))
    return out


def frame(spark, rows, kind="double"):
    return spark.createDataFrame([(i, x, 0, "c", 1.0) for i, x in rows], f"vec_id long, embedding array<{kind}>, label int, cluster string, x double")


def same(got, want):
    key = lambda r: tuple((v is not None, v) for v in r)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(want, key=key)


def vectors(n, dim, scale=1.0, seed=1):
    rng = random.Random(seed)
    return [(i, [rng.choice([-1, 0, 0.5, 1, rng.gauss(0, 1)]) * scale for _ in range(dim)]) for i in range(n)]


def test_against_plain_python_with_awkward_rows(spark):
    rows = vectors(300, 6)
    odd = [None, [], [1.0] * 5, [1.0] * 7, [1.0, None, 1.0, 1.0, 1.0, 1.0], [math.nan] + [0.0] * 5, [math.inf] + [0.0] * 5, [-math.inf] + [0.0] * 5]
    rows += [(1000 + i, x) for i, x in enumerate(odd)] + [(5, [9.0] * 6)] * 3 + [(None, [-0.001] * 6), (None, [0.0] * 6)]
    same(c.cluster_digest(frame(spark, rows), k=9, rounds=4, dim=6), brute(rows, 9, 4, 6))


def test_ties_go_to_the_smaller_number(spark):
    rows = [(i, [float(i % 3 - 1), 0.0]) for i in range(60)]
    same(c.cluster_digest(frame(spark, rows), k=12, rounds=2, dim=2), brute(rows, 12, 2, 2))
    p = c.planes([[0, 0], [2, 0], [0, 0], [4, 0]], True)
    won, far = c.nearest(np.array([[1, 0], [0, 0], [3, 0]]), p)
    assert won.tolist() == [0, 0, 1] and far.tolist() == [1, 0, 1]


@pytest.mark.parametrize("scale", [1e5, 1e9, 1e12, 1e30, 1e300])
def test_large_components_stay_exact(spark, scale):
    rows = vectors(40, 3, scale)
    same(c.cluster_digest(frame(spark, rows), k=5, rounds=3, dim=3), brute(rows, 5, 3, 3))


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = vectors(4, 3)
    same(c.cluster_digest(frame(spark, rows, "float"), k=40, rounds=5, dim=3), brute([(i, [float(np.float32(v)) for v in x]) for i, x in rows], 40, 5, 3))
    for none in ([], [(1, None)], [(2, [1.0])]):
        assert c.cluster_digest(frame(spark, none), k=4, dim=3).collect() == []


@pytest.mark.parametrize("k", [1, 2, 3, 7, 40])
def test_bracket_equals_least_distance(k):
    rng = np.random.default_rng(k)
    cents, x = rng.integers(-3, 4, (k, 4)), rng.integers(-3, 4, (500, 4))
    won, far = c.nearest(x, c.planes(cents.tolist(), True))
    d = ((x[:, None, :] - cents[None]) ** 2).sum(axis=2)
    assert (won == d.argmin(axis=1)).all() and (far == d.min(axis=1)).all()


def test_limbs():
    for v in (0, 5, -5, 10**20, -(10**45) - 3, 10**59 - 1):
        assert sum(p * 10 ** (c.LIMB * i) for i, p in enumerate(c.split(v, 3))) == v
