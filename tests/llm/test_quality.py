import zlib

import numpy as np

from dossierlake.llm import quality

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality.quality_digest(docs, labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == r.quality for r in held]) > 0.95
    assert np.mean([r.predicted for r in held if r.quality == 1]) > 0.97


def test_blocked_votes_equal_plain_ones():
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(["Good", "text", "BAD!!", "x1", "and", "the"], 30)) for _ in range(400)]
    model = quality.fit([quality.features(t) for t in texts[:60]], [i % 2 for i in range(60)], 8, 5)
    unit = model.latent(texts)
    for u, got in zip(unit, model.scores(texts), strict=True):
        cosine = model.vectors @ u
        near = np.argsort(-cosine)[:5]
        weight = np.maximum(cosine[near], 0) ** 8
        assert abs(got - (weight * model.labels[near]).sum() / weight.sum()) < 1e-6


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 1.5), (2, "", 2.5), (None, "x " * 100_000, 3.5)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, None), (2, 7), (None, 1)], "doc_id long, quality int")
    got = quality.score_documents(docs, quality.train(docs, labels))
    assert got.columns == ["doc_id", "text", "score"] and [r.score for r in got.collect()] == [0.5, 0.5, 0.5]
    assert quality.keep_good(docs, labels).columns == docs.columns and quality.keep_good(docs, labels).count() == 3
    assert quality.quality_digest(docs.limit(0), labels).count() == 0


def test_equal_cosines_count_in_sample_order():
    cosine = np.array([[0.5, 0.9, 0.5, 0.5, 0.1], [0.3] * 5])
    assert [sorted(r) for r in quality.nearest(cosine, 2).tolist()] == [[0, 1], [0, 1]]


def test_an_id_with_many_rows_counts_once(spark):
    rows = [(1, "good words here"), (1, "another text"), *[(2, "BAD !!! ###")] * 50]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert len(quality.train(docs, labels).labels) == sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in (1, 2))
