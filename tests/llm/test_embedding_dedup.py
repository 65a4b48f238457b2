import numpy as np
import pytest

from dossierlake.llm import embedding_dedup as emb


def data(n=900, dim=32, seed=4):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, dim))
    out = list(base)
    for i in range(0, n, 3):
        for _ in range(rng.integers(1, 4)):
            out.append(base[i] + rng.standard_normal(dim) * rng.uniform(0.05, 0.6))
    out += [base[1], base[1], base[1] * 3]
    near = base[2]
    out += [near + rng.standard_normal(dim) * 0.1 for _ in range(250)]
    rows = [[float(np.float32(x)) for x in v] for v in out]
    rows += [None, [0.0] * dim, [float("nan")] + [1.0] * (dim - 1), [None] + [1.0] * (dim - 1), [1.0, 2.0], [], [float("inf")] * dim]
    return rows


def brute(rows, dim, threshold=0.9):
    ok, unit = emb.unit_rows(rows, dim)
    near = (unit @ unit.T >= threshold) & ok[:, None] & ok[None, :]
    np.fill_diagonal(near, False)
    part = np.arange(len(rows))
    for _ in range(len(rows)):
        new = np.array([min([part[i], *part[near[i]]]) for i in range(len(rows))])
        if (new == part).all():
            break
        part = new
    return near.sum(1), part


@pytest.mark.parametrize("block", [2048, 40])
def test_against_brute_force(spark, block):
    rows = data()
    df = spark.createDataFrame([(i, v, "c") for i, v in enumerate(rows)], "vec_id long, embedding array<float>, leaf string")
    got = {r.vec_id: r for r in emb.vector_groups(df, leaf=64, block=block).collect()}
    links, part = brute(rows, 32)
    assert len(got) == len(rows)
    found = sum(got[i].n_links for i in got)
    assert all(got[i].n_links <= links[i] for i in got) and found >= 0.995 * links.sum()
    assert np.mean([got[i].component_id == part[i] for i in got]) > 0.995
    assert all(got[i].kept == (got[i].component_id == i) for i in got)


def test_empty_and_unusable_only(spark):
    df = spark.createDataFrame([(1, None), (2, [0.0, 0.0])], "vec_id long, embedding array<float>")
    assert [(r.vec_id, r.n_links, r.component_id, r.kept) for r in emb.vector_groups(df).orderBy("vec_id").collect()] == [(1, 0, 1, True), (2, 0, 2, True)]
    assert emb.vector_groups(df.limit(0)).count() == 0


def test_recall_with_default_parameters(spark):
    """Planted pairs between cosine 0.9 and 1 over several levels of splits."""
    rng = np.random.default_rng(8)
    n, dim = 6000, 48
    base = rng.standard_normal((n, dim))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    noise = rng.standard_normal((n, dim))
    noise -= (noise * base).sum(1, keepdims=True) * base
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    cosine = rng.uniform(0.9, 1.0, n)
    cosine[: n // 3] = 0.9005  # at the threshold, where most are missed
    rows = np.vstack([base, base * cosine[:, None] + noise * np.sqrt(1 - cosine**2)[:, None]]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<float>")
    assert emb.plan_forest(2 * n, 1024, 0.9, 0.995)[1] >= 4
    got = {r.vec_id: r.component_id for r in emb.vector_groups(df).collect()}
    found = np.array([got[i] == got[n + i] for i in range(n)])
    assert found[: n // 3].mean() >= 0.98 and found.mean() >= 0.99


def test_ids_of_any_type_null_and_repeated(spark):
    v, w = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [("b", v), ("a", v), ("a", w), (None, w), (None, [0.0, 0.0, 1.0]), (None, [0.0, 0.0, 2.0]), ("c", None)]
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in emb.vector_groups(spark.createDataFrame(rows, "vec_id string, embedding array<double>")).collect()), key=repr)
    assert got == sorted([("b", 1, "a", False), ("a", 1, "a", True), ("a", 1, "a", True), (None, 1, "a", True), (None, 1, None, True), (None, 1, None, True), ("c", 0, "c", True)], key=repr)
