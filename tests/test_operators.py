"""Literal cases and differential tests of the reference's operators."""

import csv
import hashlib
import io
import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from dossierlake.functions.spans import regex_spans, running_sum
from dossierlake.operators import anonymise, audit, bus, chunks, ingest, rules, summary, text, vectors
from dossierlake.operators.limiter import rate_block_state
from dossierlake.sources import files
from dossierlake.streaming import state, streams


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(f(F.col("t")).alias("x")).first().x


def test_spans_against_python(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice(["1234 ", "5678", "9012", "é", "🙂", " ", "ABCDE1234F", "a@b.co", "\n"]) for _ in range(rng.randrange(0, 30))) for _ in range(400)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for pattern in (r"\d{4}[\s-]?", "[A-Z]+", "é"):
        for r in df.select("i", regex_spans(F.col("t"), pattern).alias("s")).collect():
            want = [(m.start(), m.end(), m[0]) for m in re.finditer(pattern, texts[r.i] or "", re.ASCII)]
            assert [(s.start, s.end, s.match) for s in r.s] == want


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 1000])
def test_running_sum(spark, n):
    got = spark.createDataFrame([(list(range(n)),)], "a array<int>").select(running_sum(F.col("a")).alias("s")).first().s
    assert got == [i * (i + 1) // 2 for i in range(n)]


def test_identifiers_are_found_and_replaced(spark):
    t = "Patient ID PT-12345, Aadhaar 1234 5678 9012, phone +91 9876543210 and email reviewer@example.org were submitted."
    r = anonymise.anonymise(spark.createDataFrame([("D1", t)], "doc_id string, text string")).first()
    assert r.n_entities >= 4 and r.confidence > 0.85
    assert not any(v in r.anonymised_text for v in ("PT-12345", "1234 5678 9012", "9876543210", "reviewer@example.org"))
    tag = hashlib.sha256(b"D1:EMAIL:reviewer@example.org").hexdigest()[:6].upper()
    assert f"<EMAIL_4_{tag}>" in r.anonymised_text


def test_repeated_value_has_one_pseudonym(spark):
    r = anonymise.anonymise(spark.createDataFrame([("D", "Email a@b.co appears twice: A@b.co.")], "doc_id string, text string")).first()
    assert r.n_entities == 2 and len(set(r.pseudonyms)) == 1


def test_overlaps_keep_the_first_then_the_longest(spark):
    r = anonymise.anonymise(spark.createDataFrame([("D", "subject no 1234 5678 9012 end")], "doc_id string, text string")).first()
    ends = [(e.start, e.end) for e in r.entities]
    assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:], strict=False)) and ends[0][0] == 0


def test_adverse_event_is_critical(spark):
    df = spark.createDataFrame([("D", "sae", "Patient ID PT-1 had event date 2026-01-01. Outcome: death. Causality possible."), ("E", "drug", "Drug name is present only.")], "doc_id string, submission_type string, text string")
    got = {r.doc_id: r for r in summary.scorecard(df).collect()}
    assert (got["D"].priority, got["D"].severity, got["D"].requires_review) == ("critical", "death", True) and got["D"].risk_score >= 0.9
    assert "applicant_name" in got["E"].missing and got["E"].completeness < 1


def test_summary_of_three_sentences(spark):
    df = spark.createDataFrame([("D", "clinical_trial", "The protocol has one primary endpoint. Eligibility was set out in full. Adverse events were few and mild.")], "doc_id string, submission_type string, text string")
    r = summary.summarise(df).first()
    assert len(r.key_findings) == 3 and r.summary_confidence >= 0.7


def test_version_pair(spark):
    df = spark.createDataFrame([(1, "Drug\nDosage 5mg\nend", "Drug\nDosage 10mg\ncontraindication: none\nend")], "pair_id int, text_a string, text_b string")
    r = summary.comparison_report(summary.line_diff_bag(df)).first()
    assert (r.added, r.removed) == (2, 1) and "dosage" in r.sections


def test_leak_blocks(spark):
    df = spark.createDataFrame([("D", "drug", "documents.anonymised", "call 9876543210 now")], "doc_id string, submission_type string, topic string, text string")
    nulls = {c: F.lit(None).cast("string") for c in ("path", "summary", "severity", "priority", "report_type", "report_id")} | {"requires_review": F.lit(False), "n_entities": F.lit(0)}
    done = rules.assess(df.withColumn("leaks", anonymise.pii_leak_scan(F.col("text"))).withColumns(nulls))
    r = done.first()
    assert r.decision == "blocked" and r.findings[0].rule_id == "DPDP-PII-LEAK" and rules.compliance_notifications(done).count() == 1


@pytest.mark.parametrize("value,want", [("a.pdf", None), ("", "empty"), ("x" * 255, None), ("x" * 256, "too_long"), ("../a", "traversal"), ("/a", "absolute"), ("c:a", "absolute"), ("a?b", "characters")])
def test_file_names(spark, value, want):
    assert one(spark, value, ingest.validate_filename) == want


def test_zip_bombs(spark):
    def pack(*members):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for n, d in members:
                z.writestr(n, d)
        return bytearray(out.getvalue())

    rows = [(1, pack(("a", b"x" * 1_000_000))), (2, pack(("a", bytes(random.Random(1).randbytes(1000))))), (3, bytearray(b"no zip"))]
    df = spark.createDataFrame(rows, "doc_id int, content binary")
    assert {r.doc_id: r.reason for r in ingest.validate_zip_bomb(ingest.zip_members(df)).collect()} == {1: "ratio", 2: None, 3: "bad_zip"}


def test_normalise(spark):
    t = "\x00Café “quote”—x\r\n\r\n\r\n\r\ntreat-\nment  a\t b  \nfrom 7/3/2021, 45/3/2020, March 5, 2020 and 17 august 2019"
    got = one(spark, t, text.normalise_text)
    assert got == 'Café "quote" - x\n\ntreatment a b\nfrom 2021-03-07, 45/3/2020, 2020-03-05 and 2019-08-17'


def test_sections_and_chunks(spark):
    t = "intro\n# First heading\nbody\nUnder line\n-----\ntail\n2.1 Scope of it\nx"
    got = one(spark, t, chunks.split_sections)
    assert [(s.title, s.body) for s in got] == [(None, "intro"), ("First heading", "# First heading\nbody"), ("Under line", "Under line\ntail"), ("Scope of it", "2.1 Scope of it\nx")]
    long = "word " * 3000
    rows = chunks.chunk_links(chunks.chunk_text(spark.createDataFrame([("D", long), ("E", "  ")], "doc_id string, text string"))).orderBy("chunk_index").collect()
    assert len(rows) > 3 and all(r.char_count <= chunks.SIZE and r.total_chunks == len(rows) for r in rows)
    assert rows[0].next_chunk_id == rows[1].chunk_id == "D-00001" and rows[0].prev_chunk_id is None


def test_chain_detects_a_changed_row(spark):
    log = spark.createDataFrame([("k", i, f"p{i}") for i in range(50)], "doc string, id long, payload string")
    entries = audit.audit_chain_build(log, "doc", "id", "payload")
    assert audit.audit_chain_verify(entries, 7).count() == 0
    broken = entries.withColumn("entry_hash", F.when(F.col("id") == 20, F.sha2(F.lit("x"), 256)).otherwise(F.col("entry_hash")))
    assert [(r.id, r.reason) for r in audit.audit_chain_verify(broken, 7).collect()] == [(21, "prev_hash_mismatch")]


def test_files_round_trip(spark, tmp_path):
    folder = tmp_path / "raw/drug/2024/01/02/DOC-1"
    folder.mkdir(parents=True)
    (folder / "a.txt").write_bytes(b"hello")
    r = files.scan_raw_documents(spark, str(tmp_path)).first()
    assert (r.submission_type, r.doc_id, r.filename, r.checksum_sha256) == ("drug", "DOC-1", "a.txt", hashlib.sha256(b"hello").hexdigest())
    kind = spark.createDataFrame([], "a int, b string").schema
    good, bad = files.scan_events(spark.createDataFrame([('{"a": 1, "b": "x"}',), ("{oops",)], "value string"), kind)
    assert good.collect()[0].a == 1 and bad.count() == 1


def test_csv_rules(spark):
    rows = [(1, bytearray("﻿a;b\n1;2;3\n\n4\n".encode())), (2, bytearray("é;x\n".encode("latin-1")))]
    got = files.csv_tables(spark.createDataFrame(rows, "doc_id int, content binary").withColumn("delimiter", F.lit(";"))).collect()
    assert sorted((r.doc_id, r.row_no, tuple(r.cells)) for r in got) == [(1, 0, ("a", "b")), (1, 1, ("1", "2")), (1, 2, ("4", "")), (2, 0, ("é", "x"))]


def test_csv_against_the_format_s_reader(spark):
    rng = random.Random(12)
    cell = lambda: rng.choice(["x", "", " ", "a b", "é", "1.5", '"q"', '"a,b;c"', '"two\nlines"', '"say ""hi"""', '""'])
    texts = [",".join(cell() for _ in range(rng.randrange(1, 6))) for _ in range(300)]
    texts = ["\n".join(texts[i : i + rng.randrange(1, 5)]) for i in range(300)]
    rows = [(i, bytearray(t.encode()), ",") for i, t in enumerate(texts)]
    want = {}
    for i, t in enumerate(texts):
        kept = [r for r in csv.reader(io.StringIO(t, newline="")) if any(c.strip() for c in r)]
        want |= {(i, n): (r + [""] * len(kept[0]))[: len(kept[0])] for n, r in enumerate(kept)}
    got = files.csv_tables(spark.createDataFrame(rows, "doc_id int, content binary, delimiter string")).collect()
    assert {(r.doc_id, r.row_no): list(r.cells) for r in got} == want


def test_markup_that_is_broken(spark):
    rows = {1: "<p>a &amp; b<br>c</p", 2: "x < y <b >z</b><!-- <i>no</i> --> end", 3: None, 4: "<!doctype html>\n<a href='>'>", 5: "&amp;lt; &nbsp;"}
    got = {r.page_id: r.text for r in text.markup_recover_text(spark.createDataFrame(list(rows.items()), "page_id int, html string")).collect()}
    assert got == {1: "a & b\nc</p", 2: "x < y\nz\nend", 3: "", 4: "'>", 5: "&lt; \u00a0"}


def test_retry_stream_equals_batch(spark, tmp_path):
    from dossierlake.operators.bus import retry_route

    rng = random.Random(2)
    rows = [("t", f"d{rng.randrange(4)}", f"e{i:03d}", rng.random() < 0.7, float(i)) for i in range(80)]
    df = spark.createDataFrame(rows, "topic string, doc_id string, event_id string, failed boolean, ts double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    state.with_rocksdb(spark)
    stream = state.retry_route_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), ttl=None)
    got = streams.run_once(stream, spark, str(tmp_path / "run"))
    want = retry_route(df, order=("ts", "event_id"))
    assert sorted((r.event_id, r.attempt, r.target) for r in got.collect()) == sorted((r.event_id, r.attempt, r.target) for r in want.collect())


def test_plugged_in_models_are_used_where_the_library_asks(spark):
    from dossierlake.functions.hooks import hook, register_hook

    rows = spark.createDataFrame([("d", "see Ann here")], "doc_id string, text string")
    name = F.array(F.struct(F.lit(4).alias("start"), F.lit(-3).alias("neg_length"), F.lit(-0.8).alias("neg_confidence"), F.lit("PERSON").alias("kind"), F.lit(7).alias("end"), F.lit("Ann").alias("original")))
    register_hook("ner", lambda t: name)
    register_hook("embed", lambda t: F.array(F.length(t).cast("double")))
    register_hook("severity", lambda t: F.struct(F.lit("minor").alias("severity"), F.lit(0.1).alias("score")))
    try:
        r = anonymise.anonymise(rows).first()
        assert r.anonymised_text.startswith("see <PERSON_1_") and r.anonymised_text.endswith("> here")
        assert rows.select(vectors.embed_texts(F.col("text")).alias("v"), summary.sae_severity(F.col("text")).alias("s")).first() == ([12.0], ("minor", 0.1))
    finally:
        for n in ("ner", "embed", "severity"):
            register_hook(n, None)
    assert hook("embed", len) is len


def test_json_of_a_chain_has_sorted_keys_at_every_level(spark):
    rows = spark.sql("select 1 as b, named_struct('z', 1, 'a', array(named_struct('y', 2, 'x', 3))) as a")
    assert rows.select(audit.canonical(rows, "b", "a").alias("j")).first().j == '{"a":{"a":[{"x":3,"y":2}],"z":1},"b":1}'


def test_windows_of_a_busy_key_equal_one_window(spark):
    rng = random.Random(5)
    data = [(i, rng.choice(["a", "a", "b"]), rng.randrange(0, 4000)) for i in range(600)]
    rows = spark.createDataFrame(data, "req_id long, ip string, s long").select("req_id", "ip", F.timestamp_seconds("s").alias("ts"))
    got = {r.req_id: r.in_window for r in bus.sliding_rate(rows, "ip", 5, 60).collect()}
    assert got == {i: sum(p == ip and s - 60 < t <= s for _, p, t in data) for i, ip, s in data}


def test_alert_stretches_cross_bucket_edges(spark):
    rng = random.Random(6)
    times = sorted(rng.sample(range(20_000), 400))
    data = [(k, t, rng.random() < 0.9) for k in "xy" for t in times]
    rows = spark.createDataFrame(data, "k string, s long, on boolean").select("k", F.timestamp_seconds("s").alias("ts"), "on")
    want = set()
    for k in "xy":
        run = []
        for _, t, on in [d for d in data if d[0] == k] + [(k, None, False)]:
            if on:
                run.append(t)
                continue
            if run and run[-1] - run[0] >= 500:
                want.add((k, run[0], run[-1], len(run)))
            run = []
    for bucket in (300, 3000, 86_400):
        found = bus.sustained_alert(rows, F.col("on"), 500, "k", "ts", bucket).select("k", F.unix_timestamp("since"), F.unix_timestamp("until"), "samples").collect()
        assert {tuple(r) for r in found} == want and len(found) == len(want) > 3


def test_limiter_holds_no_more_than_it_needs(spark):
    rows = spark.createDataFrame([(i, "a", t) for i, t in enumerate([0, 1, 2, 3, 61, 62, 63, 200, 400])], "req_id long, ip string, s long")
    got = {r.req_id: r.outcome for r in rate_block_state(rows.select("req_id", "ip", F.timestamp_seconds("s").alias("ts")), 2, seconds=60, most=2, window=3600, block=300).collect()}
    assert got == {0: "ok", 1: "ok", 2: "limited_ip", 3: "limited_ip", 4: "blocked", 5: "blocked", 6: "blocked", 7: "blocked", 8: "ok"}


def test_neighbours_by_blocks_equal_neighbours_by_broadcast(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, "ab"[i % 2], [rng.gauss(0, 1) for _ in range(8)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, collection string, v array<double>")
    near = lambda: sorted((r.query_id, r.rank, r.vec_id) for r in vectors.knn_exact(df.where("vec_id % 3 = 0"), df).collect())
    want = near()
    monkeypatch.setattr(vectors, "BLOCK_BYTES", 3000)
    assert near() == want and len(want) == 600
