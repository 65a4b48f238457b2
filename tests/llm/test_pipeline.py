import corpus_pipeline
import public_tokenizers as tok
from pyspark.sql import functions as F

from dossierlake.llm import bpe

SF = "/root/testdata/sf0.001"


def planted(spark):
    """Clean documents, copies, near copies, a leak and a shared passage, one table."""
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = [(i, f"Document {i} begins here.\n" + " ".join(f"word{i}x{k}" for k in range(120))) for i in range(20)]
    passage = " ".join(f"shared{k}" for k in range(60))
    rows = clean + [(100, clean[3][1]), (101, clean[4][1].replace("word4x60", "edited")), (102, clean[5][1] + " " + bench[0]), (103, f"One start.\n{passage}\n" + clean[6][1][::-1]), (104, f"Other start.\n{passage}\n" + clean[7][1][::-1])]
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long"), passage


def test_stages_catch_what_is_planted_and_leave_the_rest(spark):
    docs, passage = planted(spark)
    lines = corpus_pipeline.without_repeated_lines(spark, docs, SF)
    texts = {r.doc_id: r.text for r in lines.collect()}
    assert lines.columns == docs.columns and passage in texts[103] and passage not in texts[104] and texts[104].startswith("Other start.\n")
    once = corpus_pipeline.one_of_each_group(spark, docs, SF)
    gone = {r.doc_id for r in docs.collect()} - {r.doc_id for r in once.collect()}
    assert {100, 101} <= gone <= {100, 101, 102}  # 102 is a copy of 5 and a benchmark item
    clean = corpus_pipeline.without_leaks(spark, docs, SF)
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in clean.collect()} == {102}
    assert once.columns == docs.columns and clean.columns == docs.columns


def test_run_equals_its_stages(spark):
    got = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = stage(spark, docs, SF)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert docs.count() <= before
    model = bpe.load(tok.path("byte_bpe_50k.tiktoken"), tok.PATTERN)
    assert got == {r.doc_id: len(model.encode(r.text or "")) // 4 for r in docs.collect()} and 0 < len(got) < 200


def test_empty_documents_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def awkward(spark):
    """Null ids, null and blank texts, repeated rows, an id with two texts, a very long text, and columns with clashing names."""
    a = "\n".join(" ".join(f"a{k}x{i}" for i in range(30)) for k in range(4))
    b = "\n".join(" ".join(f"b{k}x{i}" for i in range(30)) for k in range(4))
    long = " ".join(f"w{i % 9973}" for i in range(150_000))
    rows = [(1, a), (2, a), (2, b), (2, b), (3, None), (4, ""), (5, "  \n "), (None, a), (None, None), (6, long), (7, long + " end")]
    names = ["id", "body", "node", "item", "doc", "removed_lines", "_quality_score", "same"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    return spark.createDataFrame([(i, t, None, "s", len(t or "")) + tuple(names) for i, t in rows], schema)


def test_stages_on_awkward_rows(spark):
    docs = awkward(spark)
    texts = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)
    before = texts(docs)
    good = corpus_pipeline.good_quality(spark, docs, SF)
    assert good.columns == docs.columns and set(texts(good)) <= set(before)
    lines = corpus_pipeline.without_repeated_lines(spark, docs, SF)
    a, b = (next(t for i, t in before if i == d and t and t[0] == c) for d, c in ((1, "a"), (2, "b")))
    assert lines.columns == docs.columns
    assert texts(lines) == sorted([x for x in before if x != (2, a)] + [(2, "")], key=repr)
    once = corpus_pipeline.one_of_each_group(spark, docs, SF)
    assert once.columns == docs.columns
    # 2 with text a and 7 are copies of 1 and 6; blank texts are one group, whose first is 3; null ids stay
    assert texts(once) == sorted([x for x in before if x != (2, a) and x[0] not in (4, 5, 7)], key=repr)
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    leaky = docs.limit(0).unionByName(docs).withColumn("text", F.when(F.col("doc_id").isNull() & F.col("text").isNotNull(), F.lit(bench)).otherwise(F.col("text")))
    clean = corpus_pipeline.without_leaks(spark, leaky, SF)
    assert clean.columns == docs.columns and clean.count() == len(before) - 1
    assert clean.where("doc_id is null").count() == 1
    assert corpus_pipeline.token_digests(spark, docs, SF).count() == len(before)
    assert b in [t for _, t in texts(once)]
