"""Queries that grew faster than their input: what each must not do again."""

from dossierlake.sources import xml


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_xml_tokens_stay_in_their_row(spark):
    df = spark.createDataFrame([(1, "<a x='1'><b>t</b></a>"), (2, "﻿"), (3, "<a/>"), (3, "<a/>")], "doc_id long, xml string")
    for made in (xml.xml_flatten(df), xml.fhir_flatten(df)):
        # the documents once for the check of their ids, their tokens never
        assert plan(made).count("Exchange hashpartitioning") == 1
    assert sorted(map(tuple, xml.xml_flatten(df).collect()), key=str) == [(1, 0, "a[@x]", "1"), (1, 1, "a.b", "t"), (2, 0, None, None), (3, 0, None, None)]


def test_exact_neighbours_are_matrix_products(spark):
    from dossierlake.operators.vectors import knn_exact

    nan = float("nan")
    rows = [(i, "a", [1.0, i / 10]) for i in range(9)] + [(20, "a", [2.0, 0.0]), (21, "a", None), (22, "a", [nan, 1.0]), (23, "b", [1.0]), (24, "b", [1.0, 2.0]), (25, "b", [3.0])]
    df = spark.createDataFrame(rows, "vec_id long, collection string, v array<double>")
    found = knn_exact(df.where("vec_id in (0, 21, 23)"), df, 3)
    assert "CoGroupsInArrow" in plan(found)
    got = sorted((r.query_id, r.rank, r.vec_id, None if r.distance is None else round(r.distance, 6)) for r in found.collect())
    assert got == [(0, 1, 0, 0.0), (0, 2, 20, 0.0), (0, 3, 1, 0.004963), (21, 1, 0, None), (21, 2, 1, None), (21, 3, 2, None), (23, 1, 23, 0.0), (23, 2, 25, 0.0), (23, 3, 24, None)]
    far = knn_exact(df.where("vec_id = 0"), df.where("vec_id < 20"), 2, "l2").collect()
    assert [(r.vec_id, round(r.distance, 9)) for r in far] == [(0, 0.0), (1, 0.01)]


def test_routing_leaves_in_bounded_batches(spark, monkeypatch):
    import random

    from dossierlake.operators import knn_index

    rng = random.Random(1)
    df = spark.createDataFrame([(i, "a", [rng.gauss(0, 1) for _ in range(16)]) for i in range(300)], "vec_id long, collection string, v array<double>")
    near = lambda: sorted(map(tuple, knn_index.search(knn_index.build_index(df), df.where("vec_id % 3 = 0")).select("query_id", "rank", "vec_id").collect()))
    want = near()
    monkeypatch.setattr(knn_index, "ROUTED", 5)
    assert near() == want and len(want) == 600


def test_frames_are_parsed_once(spark):
    from pyspark.sql.types import StructType

    from dossierlake.sources.frames import Schema, scan_frames

    kind = StructType().add("a", "long")
    df = spark.createDataFrame([(1, bytearray(b'\x00\x00\x00\x00\x01{"a":5}')), (2, bytearray(b"\x07"))], "line long, value binary")
    good, bad = scan_frames(df, [Schema(1, kind)], kind)
    for rows in (good, bad):
        # the filter on the error uses what was parsed, it does not hold a parser of its own
        assert not [line for line in plan(rows).splitlines() if "Filter" in line and "from_json" in line]
    assert [r.a for r in good.collect()] == [5] and [r.error for r in bad.collect()] == ["TooShort"]


def test_months_and_slices_are_written_by_many_tasks(spark, tmp_path):
    from pathlib import Path

    from pyspark.sql import functions as F

    from dossierlake.plans import bus
    from dossierlake.streaming import streams

    rows = spark.range(0, 4000, 1, 4).select("id", F.timestamp_seconds(1_704_067_200 + F.col("id") % 4 * 86_400).alias("produced_at"))
    table = bus.by_month(type("T", (), {"spark": spark, "event_log": rows}))
    assert len(table.inputFiles()) == 4 and table.count() == 4000
    got = streams.run_in_parts(rows.withColumnRenamed("produced_at", "ts"), "ts", str(tmp_path), lambda s: s.where("id % 2 = 1"), 2)
    assert got.count() == 2000 and len(list(Path(tmp_path, "in").glob("*.parquet"))) > 2


def test_texts_go_to_python_in_small_batches_and_only_where_needed(spark, monkeypatch):
    import unicodedata

    import pandas as pd
    from pyspark.sql import functions as F

    from dossierlake.operators import text

    # below U+0300 nothing changes, so that accents of Latin letters stay in the JVM
    assert all(unicodedata.normalize("NFC", chr(a) + chr(b)) == chr(a) + chr(b) for a in range(0x300) for b in range(0x300))

    @F.pandas_udf("string")
    def narrow(texts: pd.Series) -> pd.Series:
        here = texts.dropna()
        assert here.str.len().sum() < 12_000_000 and not here.str.startswith("caf\u00e9").any()
        return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))

    monkeypatch.setattr(text, "_nfc", narrow)
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    df = spark.range(0, 60, 1, 1).select("id", F.when(F.col("id") % 3 == 0, "caf\u00e9").otherwise(F.concat(F.repeat(F.lit("a"), 1_000_000), F.lit("e\u0301"))).alias("t"))
    got = df.select("id", F.right(text.nfc(F.col("t")), F.lit(1)).alias("end"), F.length(text.nfc(F.col("t"))).alias("n")).collect()
    assert {r.end for r in got} == {"\u00e9"} and {r.n for r in got} == {4, 1_000_001}


def test_regexes_run_only_where_a_cheap_test_lets_them(spark):
    import random

    from pyspark.sql import functions as F

    from dossierlake.functions.spans import regex_spans
    from dossierlake.operators import anonymise, summary, text

    def plainly(t):
        """What the steps do without their tests."""
        for p, r in ((text.CONTROL, ""), ("\r\n|\r", "\n"), ("\n{3,}", "\n\n"), (r"(?m)[^\S\n]+$", ""), (r"(\w)-\n([a-z])", "$1$2")):
            t = F.regexp_replace(t, p, r)
        t = F.regexp_replace(F.translate(t, "‘’‚‛“”„‟‒‑", "''''\"\"\"\"--"), "[–—]", " - ")
        t = F.regexp_replace(F.regexp_replace(t, "[ \t]+", " "), r"(?m)^[^\S\n]+|[^\S\n]+$", "")
        t = F.regexp_replace(t, r"\b(0[1-9]|[12]\d|3[01]|[1-9])[/-](0[1-9]|1[0-2]|[1-9])[/-](\d{4})\b", "$3-0$2-0$1")
        t = F.regexp_replace(t, r"\b(\d{4})-0?(\d{2})-0?(\d{2})\b", "$1-$2-$3")
        for i, m in enumerate(text.MONTHS, 1):
            t = F.regexp_replace(F.regexp_replace(t, rf"(?i)\b{m}\s+(\d{{1,2}}),?\s+(\d{{4}})\b", f"$2-{i:02d}-0$1"), rf"(?i)\b(\d{{1,2}})\s+{m}\s+(\d{{4}})\b", f"$2-{i:02d}-0$1")
        return F.regexp_replace(F.regexp_replace(t, r"\b(\d{4})-(\d{2})-0(\d{2})\b", "$1-$2-$3"), r"^\s+|\s+$", "")

    rng = random.Random(5)
    parts = [*" \t\n\r\x0b\x85  “–\x01-/.aZ9", " ", " ", "\n", "\r\n", "x-\ny", "7/3/2021", "31-12-1999", "2020-011-012", "March 5, 2020", "17 august 2019", "mAy 1 2020", "dismay", "MAY\n3,\t1999"]
    parts += ["1234 5678 9012", "ABCDE1234F", "U12345AB1234ABC123456", "+91-9876543210", "a.b@c.org", "Patient ID: X-1", "SUBJECT no 123", "dob 1/2/99", "Date Of Birth: 1-2-1999"]
    df = spark.createDataFrame([(i, "".join(rng.choice(parts) for _ in range(rng.randrange(14)))) for i in range(4000)] + [(-1, None)], "i int, t string").cache()
    t = F.col("t")
    assert df.where(~plainly(t).eqNullSafe(text.normalise_text(t, False))).count() == 0
    assert set(anonymise.NEEDS) == {k for k, _, _ in anonymise.PATTERNS}
    spans = [(regex_spans(t, p), regex_spans(t, p, needs=anonymise.NEEDS[k](t))) for k, p, _ in anonymise.PATTERNS]
    told = df.select(*[F.count_if(~a.eqNullSafe(b)) for a, b in spans], *[F.count_if(F.size(a) > 0) for a, _ in spans]).first()
    assert not any(told[: len(spans)]) and min(told[len(spans) :]) > 20
    # a test before each regex that a clean text does not need, and one lower-casing for all terms
    assert plan(df.select(text.normalise_text(t, False))).count("CASE WHEN") >= 11
    for c in (summary.risk_terms(t, F.lit("sae")), summary.missing_fields(t, F.lit("sae"))):
        assert "contains(lower(" not in plan(df.select(c)).lower()


def test_notifications_run_the_rules_once(spark):
    from dossierlake.operators import rules
    from dossierlake.plans.fixtures import Tables
    from dossierlake.plans.governance import rule_events

    made = plan(rules.compliance_notifications(rules.assess(rule_events(Tables(spark, "/root/testdata/sf0.001")))))
    # the filter uses the decision that was made, it does not hold the patterns again
    assert made.count("regexp_extract_all") == 7


def test_texts_of_a_pair_move_once(spark):
    from dossierlake.operators import summary

    rows = [(1, "a\nb\nb\n c ", "b\nc\nd"), (2, None, "x\n\nx"), (2, "x", None), (3, "", "same"), (3, "same", None)]
    df = spark.createDataFrame(rows, "pair_id long, text_a string, text_b string")
    diffs = summary.line_diff_bag(df)
    # neither the lines nor the report's groups are dealt again
    assert plan(summary.comparison_report(diffs)).count("Exchange") == 1
    assert sorted(map(tuple, diffs.collect())) == [(1, "a", -1), (1, "b", -1), (1, "d", 1), (2, "x", 1)]
    assert {r.pair_id: (r.added, r.removed) for r in summary.comparison_report(diffs).collect()} == {1: (1, 2), 2: (1, 0)}


def test_a_stage_of_the_chain_is_made_once(spark, tmp_path, monkeypatch):
    from dossierlake.streaming import chain

    made = []
    stage = chain.Stage("copies", ("raw.documents.ingested",), lambda rows: made.append(1) or rows.selectExpr("doc_id", "cast(null as string) as error"))
    monkeypatch.setattr(chain, "STAGES", (stage,))
    topics = chain.Chain(spark, str(tmp_path / "topics"))
    for i in range(2):
        spark.createDataFrame([(f"D{i}", "sae", "x")], chain.RAW).write.mode("append").parquet(f"{topics.root}/raw.documents.ingested")
        topics.start(stage).awaitTermination()
    assert sorted(r.doc_id for r in topics.read("copies").collect()) == ["D0", "D1"] and len(made) == 1
