"""Streams with state: limits, retries, attempts, backlogs, keyed tables and the chain of topics."""

import random
from collections import deque
from itertools import groupby

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from dossierlake.operators import bus
from dossierlake.operators.limiter import rate_block_state
from dossierlake.streaming import state, streams, upsert
from dossierlake.streaming.chain import DEAD_LETTERS, STAGES, Chain, batch_chain

# --- limits --------------------------------------------------------------------------------------------------------


def plain_limiter(log, limit, user_limit, roles, seconds, most, window, block, allowed=()):
    """One pass over the log in time order."""
    ips, users, bad, until, out = {}, {}, {}, {}, {}

    def enter(windows, key, t, span):
        w = windows.setdefault(key, deque())
        while w and w[0] <= t - span:
            w.popleft()
        w.append(t)
        return len(w)

    for t, req, ip, user, role in sorted(log, key=lambda r: (r[0], r[1])):
        if ip in allowed:
            out[req] = "ok"
            continue
        if t < until.get(ip, -1):
            out[req] = "blocked"
            continue
        outcome = "ok"
        if enter(ips, ip, t, seconds) > limit:
            outcome = "limited_ip"
        elif user and enter(users, user, t, seconds) > (roles.get(role, user_limit)):
            outcome = "limited_user"
        if outcome != "ok" and enter(bad, ip, t, window) >= most:
            until[ip] = t + block
        out[req] = outcome
    return out


def log_frame(spark, log):
    rows = [(req, ip, float(t), user, role) for t, req, ip, user, role in log]
    return spark.createDataFrame(rows, "req_id long, ip string, s double, user_id string, role string").select("req_id", "ip", F.timestamp_micros((F.col("s") * 1_000_000).cast("long")).alias("ts"), "user_id", "role")


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_coupled_limits_equal_a_plain_limiter(spark, seed):
    rng = random.Random(seed)
    n_ips, n_users = rng.choice([(3, 4), (12, 5), (6, 30)])
    # bursts, so that ips and users are refused and blocked, and equal times
    log, t = [], 0.0
    for req in range(1500):
        t += rng.choice([0, 0.5, 1, 3, 30])
        ip = f"ip{min(rng.randrange(n_ips), rng.randrange(n_ips))}"
        log.append((t, req, ip, rng.choice([None, "", *[f"u{i}" for i in range(n_users)]]), rng.choice(["api_client", "x", None])))
    args = (6, 3, {"api_client": 5}, 20, 4, 200, rng.choice([100, 600, 5000]))
    want = plain_limiter(log, *args, allowed=("ip2",))
    rows = rate_block_state(log_frame(spark, log).repartition(4), *args, allowed=("ip2",)).collect()
    assert {r.req_id: r.outcome for r in rows} == want and len(rows) == len(log)
    assert {"ok", "blocked"} < set(want.values())
    assert sum(r.blocked_until is not None for r in rows) > 0


def test_refused_requests_are_counted(spark):
    log = [(t, i, "a", None, None) for i, t in enumerate([0, 1, 2, 61, 61.5])]
    got = {r.req_id: r.outcome for r in rate_block_state(log_frame(spark, log), limit=2).collect()}
    assert got == {0: "ok", 1: "ok", 2: "limited_ip", 3: "ok", 4: "limited_ip"}


def test_limiter_without_users_nulls_and_nothing(spark):
    log = [(t, i, None if i % 2 else "a", None, None) for i, t in enumerate(range(40))]
    rows = log_frame(spark, log).drop("user_id", "role")
    late = rows.limit(1).withColumns({"req_id": F.lit(99).cast("long"), "ts": F.lit(None).cast("timestamp")})
    got = {r.req_id: r.outcome for r in rate_block_state(rows.unionByName(late), limit=3, seconds=10, most=2, block=15).collect()}
    want = plain_limiter([(t, i, ip or "unknown", u, r) for t, i, ip, u, r in log], 3, 20, {}, 10, 2, 3600, 15)
    assert got == want | {99: "ok"}
    assert rate_block_state(rows.limit(0)).collect() == []


# --- attempts ------------------------------------------------------------------------------------------------------


def plain_attempts(rows, limit, ttl):
    out = {}
    for key, group in groupby(sorted(rows, key=lambda r: (r[0], r[1], r[4], r[2])), key=lambda r: r[:2]):
        n = first = 0
        for topic, _, event, failed, t in group:
            if n and ttl is not None and t - first >= ttl:
                n = 0
            n = n + 1 if failed else 0
            first = t if n == 1 else first
            if n:
                out[event] = (n, f"{topic}.retry.{n}" if n <= limit else "dlq")
    return out


RECORD = "topic string, doc_id string, event_id string, failed boolean, s long"


def records(spark, rows):
    return spark.createDataFrame(rows, RECORD).withColumn("ts", F.timestamp_seconds("s")).drop("s")


@pytest.mark.parametrize("ttl", [None, 50])
def test_attempts_of_a_batch(spark, ttl):
    rng = random.Random(8)
    rows = [(rng.choice("ab"), rng.choice("xyz"), f"e{i:04}", rng.random() < 0.8, rng.randrange(2000)) for i in range(900)]
    got = bus.retry_route_ttl(records(spark, rows), 3, ttl, order=("ts", "event_id")).collect()
    assert {r.event_id: (r.attempt, r.target) for r in got} == plain_attempts(rows, 3, ttl)


def test_attempts_of_a_stream_with_a_large_key_and_a_restart(spark, tmp_path):
    state.with_rocksdb(spark)
    rng = random.Random(9)
    rows = [("t", "hot", f"e{i:05}", rng.random() < 0.9, i // 2) for i in range(30_000)] + [("t", f"d{i % 7}", f"f{i:05}", rng.random() < 0.7, i * 9) for i in range(3000)]
    cut = 12_000
    halves = [[r for r in rows if r[4] < cut], [r for r in rows if r[4] >= cut]]
    out = []
    for half in halves:
        rng.shuffle(half)
        records(spark, half).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(records(spark, rows[:1]).schema).parquet(str(tmp_path / "in"))
        out = streams.run_once(state.retry_route_stream(source, 3, 600, expire=False), spark, str(tmp_path / "run")).collect()
    assert {r.event_id: (r.attempt, r.target) for r in out} == plain_attempts(rows, 3, 600)


def test_attempt_counters_of_silent_keys_go_by_the_wall_clock(spark, tmp_path):
    import time

    state.with_rocksdb(spark)
    path = str(tmp_path / "in")
    first = records(spark, [("t", "d", "e1", True, 1)])
    first.coalesce(1).write.mode("append").parquet(path)
    stream = state.retry_route_stream(spark.readStream.schema(first.schema).parquet(path), 3, 2)
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).start()

    def attempts_until(n):
        # the query never runs out of work, since its clock goes on
        for _ in range(60):
            found = {r.event_id: r.attempt for r in spark.read.schema("event_id string, attempt int").parquet(str(tmp_path / "out")).collect()} if (tmp_path / "out" / "_spark_metadata").exists() else {}
            if len(found) >= n:
                return found
            time.sleep(1)
        raise TimeoutError

    try:
        attempts_until(1)
        time.sleep(4)
        # two seconds have passed on the wall, none by the events' own times
        records(spark, [("t", "d", "e2", True, 1)]).coalesce(1).write.mode("append").parquet(path)
        assert attempts_until(2) == {"e1": 1, "e2": 1}
    finally:
        query.stop()


# --- retries that wait ---------------------------------------------------------------------------------------------


def test_retries_wait_their_time_and_leave_no_state(spark, tmp_path):
    state.with_rocksdb(spark)
    rng = random.Random(10)
    kind = "topic string, doc_id string, event_id string, attempt int, s long"
    rows = []
    for i in range(200):
        n = rng.choice([1, 2, 3])
        rows.append((f"a.b.retry.{n}", f"d{i % 9}", f"e{i}", n, rng.randrange(3000)))
    rng.shuffle(rows)
    ends = [[*rows[:70]], [*rows[70:150]], rows[150:], [("tick.retry.1", "tick", "tick", 1, 9000)], [("tick.retry.1", "tick", "tock", 1, 99_000)]]
    for part in ends:
        df = spark.createDataFrame(part, kind).withColumn("retry_ts", F.timestamp_seconds("s")).drop("s")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        got = streams.run_once(state.retry_timers(source, "1 hour"), spark, str(tmp_path / "run")).collect()
    delays = {1: 5, 2: 30, 3: 300}
    found = {r.event_id: (r.topic, r.due_ms) for r in got if r.doc_id != "tick"}
    assert found == {e: ("a.b", (s + delays[n]) * 1000) for _, _, e, n, s in rows} and len([r for r in got if r.doc_id != "tick"]) == len(rows)
    assert all(r.released_ms >= r.due_ms for r in got)
    held = spark.read.format("statestore").option("stateVarName", "waiting").load(str(tmp_path / "run" / "state"))
    assert {r.key.doc_id for r in held.select("key").collect()} <= {"tick"}


# --- backlog -------------------------------------------------------------------------------------------------------


def plain_alerts(rows, depths):
    pending, out = {}, []
    for topic, event, status, t in sorted(rows, key=lambda r: (r[3], r[1], r[2])):
        held = pending.setdefault(topic, set())
        if (status == "pending") == (event in held):
            continue
        if status == "pending":
            held.add(event)
            out += [(topic, event, len(held), s) for s, d in depths.items() if len(held) == d]
        else:
            held.remove(event)
    return sorted(out)


@pytest.mark.parametrize("parts", [1, 12])
def test_backlog_alerts_do_not_depend_on_batches(spark, tmp_path, parts):
    state.with_rocksdb(spark)
    rng = random.Random(11)
    rows, t = [], 0
    for i in range(240):
        t += 1
        topic = rng.choice(["a", "a", "b"])
        rows.append((topic, f"e{i}", "pending", t))
        if rng.random() < 0.6:
            rows.append((topic, f"e{rng.randrange(i + 1)}", rng.choice(["resolved", "dismissed", "pending"]), t))
    df = spark.createDataFrame(rows, "topic string, event_id string, status string, s long").withColumn("ts", F.timestamp_seconds("s"))
    want = plain_alerts(rows, {"WARNING": 10, "CRITICAL": 50})
    key = lambda r: (r.topic, r.event_id, r.depth, r.severity)
    assert sorted(map(key, bus.backlog_alerts(df, bucket=17).collect())) == want and len(want) > 2
    for n in range(parts):
        df.where((F.col("s") - 1) * parts / 240 >= n).where((F.col("s") - 1) * parts / 240 < n + 1).drop("s").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.drop("s").schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = streams.run_once(state.backlog_alerts_stream(source), spark, str(tmp_path / "run"))
    assert sorted(map(key, got.collect())) == want


# --- keyed tables --------------------------------------------------------------------------------------------------


def updates(spark, rows):
    return spark.createDataFrame(rows, "event_id long, seq long, status string, duration_ms int, error string")


def plain_fold(rows):
    out = {}
    for event, seq, *values in sorted(rows, key=lambda r: r[1]):
        old = out.setdefault(event, [None, None, None, None])
        out[event] = [v if v is not None else o for v, o in zip(values, old, strict=False)] + [seq if values[0] in ("success", "failed", "dlq", "dismissed") else old[3]]
    return {k: tuple(v) for k, v in out.items()}


def test_upserts_survive_a_crash_and_a_replay(spark, tmp_path, monkeypatch):
    rng = random.Random(12)
    rows = [(rng.randrange(60), i, rng.choice(["processing", "success", "failed", None]), rng.choice([None, i]), rng.choice([None, f"x{i}"])) for i in range(400)]
    table = upsert.KeyedTable(spark, str(tmp_path / "t"), StructType.fromDDL(upsert.STATUS), ("event_id",), buckets=5)
    read = lambda: {r.event_id: (r.status, r.duration_ms, r.error, r.completed_at) for r in table.read().collect()}
    assert read() == {}
    rng.shuffle(rows)
    batch = lambda n: upsert.status_rows(updates(spark, rows[n * 100 : n * 100 + 100]))
    assert table.apply(batch(0), 0, upsert.merge_status) and table.apply(batch(1), 1, upsert.merge_status)
    before = read()
    assert before == plain_fold(rows[:200])
    # the third batch dies between its files and its manifest
    with monkeypatch.context() as m:
        m.setattr(upsert.KeyedTable, "_commit", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            table.apply(batch(2), 2, upsert.merge_status)
    assert read() == before
    assert table.apply(batch(2), 2, upsert.merge_status)
    assert not table.apply(batch(2), 2, upsert.merge_status) and not table.apply(batch(0), 0, upsert.merge_status)
    assert table.apply(batch(3), 7, upsert.merge_status)
    assert read() == plain_fold(rows)
    assert table.vacuum() > 0 and read() == plain_fold(rows) and table.vacuum() == 0


def test_only_touched_buckets_are_written(spark, tmp_path):
    table = upsert.KeyedTable(spark, str(tmp_path / "t"), StructType.fromDDL("k long, v string, at long"), ("k",), buckets=8)
    rows = lambda data: spark.createDataFrame(data, "k long, v string, at long")
    merge = upsert.merge_latest("k", "at")
    table.apply(rows([(i, "old", i) for i in range(50)]), 0, merge)
    before = table.manifest()["buckets"]
    table.apply(rows([(3, "new", 99), (3, "older", -1), (4, "older", -1)]), 1, merge)
    after = table.manifest()["buckets"]
    assert 1 <= sum(before[b] != after[b] for b in after) <= 2
    assert {r.k: r.v for r in table.read().collect()} == {i: "new" if i == 3 else "old" for i in range(50)}
    table.apply(rows([]), 2, merge)
    assert table.manifest() == {"batch": 2, "buckets": after}


# --- the chain -----------------------------------------------------------------------------------------------------


def test_topics_equal_the_batch_chain_after_kills(spark, tmp_path):
    rng = random.Random(13)
    texts = ["Aadhaar 1234 5678 9012 of the patient id PT-00123, who died after the dose. Long enough to be read.", "Plain words about a device and its manufacturer, which is safe.", "mail a@b.org now, and call 9876543210 soon. Another sentence is here to be found.", "", None]
    rows = [(None if i % 11 == 0 else f"D{i}", rng.choice(["drug", "sae", "medical_device", "clinical_trial", "other", None]), rng.choice(texts)) for i in range(80)]
    raw = spark.createDataFrame(rows, "doc_id string, submission_type string, text string")
    chain = Chain(spark, str(tmp_path / "topics"))
    first, second = raw.randomSplit([1.0, 1.0], 3)
    feed = lambda df: df.coalesce(1).write.mode("append").parquet(f"{chain.root}/raw.documents.ingested")
    feed(first)
    # the first stage runs, the second is killed on its way; then all run, over more, and over nothing new
    chain.start(STAGES[0]).awaitTermination(60)
    query = chain.start(STAGES[1])
    query.awaitTermination(1)
    query.stop()
    feed(second)
    chain.run()
    chain.run()
    want = batch_chain(raw)
    plain = lambda df: sorted((str(r.asDict(recursive=True)) for r in df.collect()))
    for topic in [*[s.topic for s in STAGES], DEAD_LETTERS]:
        assert plain(chain.read(topic)) == plain(want[topic]), topic
    assert {r.error_type for r in want[DEAD_LETTERS].collect()} == {"MissingDocId", "UnknownType", "EmptyDocument"}
    assert want["compliance.decisions"].where("blocked").count() >= 0 and chain.read("compliance.decisions").count() > 30
