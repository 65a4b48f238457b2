"""Streams over the given tables, fed in parts, stopped and started again, and run to their end."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from dossierlake.functions.scratch import scratch_path
from dossierlake.operators.bus import backlog_alerts
from dossierlake.operators.limiter import rate_block_state
from dossierlake.plans.bus import ROUTE_TTL, UPDATES, fold_sql, status_updates
from dossierlake.plans.registry import query
from dossierlake.sources import files as f
from dossierlake.sources.frames import Schema, scan_frames
from dossierlake.sources.xml import fhir_flatten, xml_flatten
from dossierlake.streaming import state, upsert
from dossierlake.streaming import streams as s
from dossierlake.streaming.chain import DEAD_LETTERS, STAGES, Chain


def stream_of(rows, files: int = 4):
    """A table as a stream: written into a folder of the shared store, whose files are the stream's input."""
    path = scratch_path(rows.sparkSession, "stream-input")
    rows.repartition(files).write.parquet(path)
    return rows.sparkSession.readStream.schema(rows.schema).parquet(path)


def repeated(t):
    """Each event when it happens and again up to four days later, in part behind the watermark."""
    first = t.events.select("event_id", "user_id", "ts", F.col("ts").alias("arrival"))
    again = first.withColumn("arrival", F.col("ts") + F.make_interval(hours=(F.col("event_id") % 97).cast("int")))
    return first.unionByName(again)


query("stream_dedup", "select event_id, user_id from events")(
    lambda t: s.run_in_parts(repeated(t), "arrival", scratch_path(t.spark, "dedup"), lambda rows: s.stream_dedup(rows).select("event_id", "user_id"), 5)
)
query("rate_windows_stream", "select time_bucket(interval 1 minute, ts) - to_minutes(k) as window_start, count(*) as n from events, (select unnest([0,1,2,3,4]) as k) group by 1")(
    lambda t: s.run_once(s.rate_windows_stream(stream_of(t.events)), t.spark, scratch_path(t.spark, "rates"), "complete")
)

# --- the chain of topics -------------------------------------------------------------------------------------------

#: every thirteenth document is empty, every seventeenth of no known type, every nineteenth without an id
RAW_SQL = """select case when doc_num % 19 <> 0 then doc_id end as doc_id, case when doc_num % 17 = 0 then 'unknown' else submission_type end as submission_type, case when doc_num % 13 = 0 then '  ' else text end as text, doc_num from reg_text"""


def topics(t):
    """Rows of the topic tables after the chain ran twice: over half of the documents, then over the other half."""
    chain = Chain(t.spark, scratch_path(t.spark, "topics"))
    raw = t.reg_text.select(
        F.when(F.col("doc_num") % 19 != 0, F.col("doc_id")).alias("doc_id"), F.when(F.col("doc_num") % 17 == 0, "unknown").otherwise(F.col("submission_type")).alias("submission_type"),
        F.when(F.col("doc_num") % 13 == 0, "  ").otherwise(F.col("text")).alias("text"), "doc_num",
    )
    for half in (0, 1):
        raw.where(F.col("doc_num") % 2 == half).drop("doc_num").write.mode("append").parquet(f"{chain.root}/raw.documents.ingested")
        chain.run()
    out = chain.read(DEAD_LETTERS).select(F.lit(DEAD_LETTERS).alias("topic"), "doc_id", F.concat_ws("/", "original_topic", "error_type").alias("note"))
    for stage in STAGES:
        rows = chain.read(stage.topic).where("error is null")
        note = F.col("topic") if "topic" in rows.columns else F.lit(None).cast("string")
        out = out.unionByName(rows.select(F.lit(stage.topic).alias("topic"), "doc_id", note.alias("note")))
    return out


query(
    "stream_pipeline",
    f"""with raw as ({RAW_SQL}), e as (select doc_id, case when doc_id is null then 'MissingDocId' when submission_type = 'unknown' then 'UnknownType' when trim(text) = '' then 'EmptyDocument' end as error from raw)
    select 'dlq' as topic, doc_id, 'documents.preprocessed/' || error as note from e where error is not null
    union all select unnest(['documents.preprocessed', 'documents.anonymised', 'documents.classified']), doc_id, null from e where error is null
    union all select 'compliance.decisions', doc_id, unnest(['documents.anonymised', 'documents.summarised', 'documents.classified']) from e where error is null""",
)(topics)

# --- limits --------------------------------------------------------------------------------------------------------


def shared_log(t):
    """Requests of users who share ips, some of them by a client program."""
    return t.events.select(F.col("event_id").alias("req_id"), F.concat(F.lit("10.0.0."), (F.col("user_id") % 40).cast("string")).alias("ip"), (F.col("event_id") % 97).cast("string").alias("user_id"), F.when(F.col("event_type") == "purchase", "api_client").alias("role"), "ts")


query("rate_block_state")(lambda t: rate_block_state(shared_log(t), 8, 3, {"api_client": 4}, 86_400, 4, 5 * 86_400, 5 * 86_400))
#: one ip's requests folded in order: those of the last day, the violations of the last five, and the end of a block
STEP = """struct_pack(t := x.t, id := x.id, seen := case when x.t < s.until then s.seen else list_append(list_filter(s.seen, lambda y: y > x.t - 86400000000), x.t) end,
    bad := case when x.t >= s.until and len(list_filter(s.seen, lambda y: y > x.t - 86400000000)) >= 8 then list_append(list_filter(s.bad, lambda y: y > x.t - 432000000000), x.t) else s.bad end,
    until := case when x.t >= s.until and len(list_filter(s.seen, lambda y: y > x.t - 86400000000)) >= 8 and len(list_filter(s.bad, lambda y: y > x.t - 432000000000)) >= 3 then x.t + 432000000000 else s.until end,
    outs := list_append(s.outs, case when x.t < s.until then 'blocked' when len(list_filter(s.seen, lambda y: y > x.t - 86400000000)) >= 8 then 'limited_ip' else 'ok' end))"""
ZERO = "struct_pack(t := 0::bigint, id := 0::bigint, seen := []::bigint[], bad := []::bigint[], until := 0::bigint, outs := []::varchar[])"
query(
    "rate_block_ip",
    f"""select unnest(ids) as req_id, unnest(outs) as outcome from (select ids, list_reduce(list_prepend({ZERO}, r), lambda s, x: {STEP}).outs as outs from (
    select list(req_id order by t, req_id) as ids, list(struct_pack(t := t, id := req_id, seen := []::bigint[], bad := []::bigint[], until := 0::bigint, outs := []::varchar[]) order by t, req_id) as r
    from (select event_id as req_id, user_id % 40 as ip, epoch_us(ts) as t from events) group by ip))""",
)(lambda t: rate_block_state(shared_log(t).drop("user_id"), 8, 3, None, 86_400, 4, 5 * 86_400, 5 * 86_400).select("req_id", "outcome"))

# --- streams with state --------------------------------------------------------------------------------------------


def routed(t):
    state.with_rocksdb(t.spark)
    failures = t.event_log.select("topic", "doc_id", "event_id", (F.col("processing_status") == "failed").alias("failed"), F.col("produced_at").alias("ts"))
    rows = s.run_in_parts(failures, "ts", scratch_path(t.spark, "routed"), lambda x: state.retry_route_stream(x, 3, expire=False))
    return rows.select("event_id", F.col("attempt").cast("long").alias("attempt"), "target")


query("retry_route_stream", ROUTE_TTL)(routed)


def waiting(t):
    """Failures as retries that arrive in order of their ids within a day, and a last one that moves the clock past all."""
    state.with_rocksdb(t.spark)
    attempt = (F.col("off") % 3 + 1).cast("int")
    retries = t.event_log.where("processing_status = 'failed'").select(F.concat("topic", F.lit(".retry."), attempt.cast("string")).alias("topic"), "doc_id", "event_id", attempt.alias("attempt"), F.col("produced_at").alias("retry_ts"))
    tick = t.event_log.agg(F.max("produced_at").alias("m")).select(F.lit("tick.retry.1").alias("topic"), F.lit("tick").alias("doc_id"), F.lit("tick").alias("event_id"), F.lit(1).alias("attempt"), (F.col("m") + F.make_interval(days=F.lit(9))).alias("retry_ts"))
    rows = s.run_in_parts(retries.unionByName(tick), "retry_ts", scratch_path(t.spark, "waiting"), lambda x: state.retry_timers(x, "1 day"))
    return rows.where("doc_id <> 'tick'").select("event_id", F.col("topic").alias("original_topic"), "due_ms", (F.col("released_ms") >= F.col("due_ms")).alias("waited"))


query(
    "retry_timers",
    """select event_id, topic as original_topic, epoch_us(produced_at) // 1000 + case off % 3 + 1 when 1 then 5 when 2 then 30 else 300 end * 1000 as due_ms, true as waited from event_log where processing_status = 'failed'""",
)(waiting)


def changes(t):
    """Each dead letter when it came in, and again when it was settled, up to three days later; some are told twice."""
    came = t.dlq_events.select("event_id", F.col("original_topic").alias("topic"), F.lit("pending").alias("status"), F.col("failed_at").alias("ts"))
    number = F.substring("event_id", 3, 20).cast("long")
    later = F.col("failed_at") + F.make_interval(hours=(1 + number % 72).cast("int"))
    settled = t.dlq_events.where("status <> 'pending' or retry_count > 0").select("event_id", F.col("original_topic").alias("topic"), F.when(F.col("status") == "pending", "resolved").otherwise(F.col("status")).alias("status"), later.alias("ts"))
    return came.unionByName(settled).unionByName(came.where(number % 5 == 0).withColumn("ts", F.col("ts") + F.make_interval(mins=F.lit(1))))


CHANGES = """select event_id, original_topic as topic, 'pending' as status, failed_at as ts from dlq_events
    union all select event_id, original_topic, case when status = 'pending' then 'resolved' else status end, failed_at + to_hours(1 + cast(substr(event_id, 3) as bigint) % 72) from dlq_events where status <> 'pending' or retry_count > 0
    union all select event_id, original_topic, 'pending', failed_at + interval 1 minute from dlq_events where cast(substr(event_id, 3) as bigint) % 5 = 0"""
ALERTS = f"""with c as ({CHANGES}), d as (select topic, event_id, status, epoch_us(ts) as us, (status = 'pending')::int - coalesce(lag((status = 'pending')::int) over (partition by topic, event_id order by ts, status), 0) as delta from c),
    n as (select *, cast(sum(delta) over (partition by topic order by us, event_id, status rows unbounded preceding) as bigint) as depth from d where delta <> 0)
    select topic, event_id, us, depth, case depth when 10 then 'WARNING' else 'CRITICAL' end as severity from n where delta > 0 and depth in (10, 50)"""


def alerts(t):
    state.with_rocksdb(t.spark)
    return s.run_in_parts(changes(t), "ts", scratch_path(t.spark, "alerts"), state.backlog_alerts_stream)


query("dlq_alert_stream", ALERTS)(alerts)
query("backlog_alerts", ALERTS)(lambda t: backlog_alerts(changes(t)))


def statuses(t):
    """The status table after its updates came as a stream in six micro-batches, the last three after a restart."""
    rows, path = status_updates(t), scratch_path(t.spark, "statuses")
    table = upsert.KeyedTable(t.spark, f"{path}/table", StructType.fromDDL(upsert.STATUS), ("event_id",))
    for half in (0, 1):
        rows.where(F.col("seq") % 2 == half).repartition(3).write.mode("append").parquet(f"{path}/in")
        stream = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
        upsert.upsert_stream(upsert.status_rows(stream), table, upsert.merge_status, f"{path}/state").awaitTermination()
    return table.read().select("event_id", "status", "duration_ms", "error", "completed_at")


query("event_status_stream", fold_sql(UPDATES))(statuses)


def json_lines(t):
    """Events as lines of JSON text, some of them broken."""
    body = F.to_json(F.struct("event_id", "user_id", "event_type"))
    return t.events.select("event_id", F.when(F.col("event_id") % 9 == 4, F.concat(body, F.lit("}{"))).when(F.col("event_id") % 9 == 5, F.expr("substring(to_json(struct(event_type)), 1, 9)")).otherwise(body).alias("value"))


LINE = "event_id long, user_id long, event_type string"
query("scan_events", "select event_id, user_id, event_type from events where event_id % 9 <> 4 and event_id % 9 <> 5")(lambda t: f.scan_events(json_lines(t).select("value"), StructType.fromDDL(LINE))[0])
query("scan_events_bad", "select event_id from events where event_id % 9 = 4 or event_id % 9 = 5")(lambda t: f.scan_events(json_lines(t).withColumnRenamed("event_id", "line"), StructType.fromDDL(LINE))[1].select(F.col("line").alias("event_id")))


# --- framed events -------------------------------------------------------------------------------------------------


def framed(t):
    """Events as frames: two versions of a schema in turn, and some that are broken in one way or another."""
    n = F.col("event_id")
    old, new = F.to_json(F.struct("event_id", "user_id", F.col("event_type").alias("kind"))), F.to_json(F.struct("event_id", "user_id", F.col("event_type").alias("kind"), F.col("props").alias("source")))
    body = F.when(n % 2 == 0, old).otherwise(new)
    number = F.when(n % 10 == 9, 99).when(n % 2 == 0, 1).otherwise(258)
    frame = F.concat(F.when(n % 10 == 8, F.unhex(F.lit("07"))).otherwise(F.unhex(F.lit("00"))), F.unhex(F.lpad(F.hex(number), 8, "0")), F.when(n % 10 == 6, F.concat(body, F.lit("}{"))).otherwise(body).cast("binary"))
    return t.events.select(F.col("event_id").alias("line"), F.when(n % 10 == 7, F.substring(frame, 1, 4)).otherwise(frame).alias("value"))


def frames(t):
    first = StructType().add("event_id", "long", False).add("user_id", "long").add("kind", "string")
    second = StructType().add("event_id", "long", False).add("user_id", "long").add("kind", "string").add("source", "string")
    return scan_frames(framed(t), [Schema(1, first), Schema(258, second)], second, {"source": "bus"})


query("scan_frames", "select event_id as line, event_id, user_id, event_type as kind, case when event_id % 2 = 0 then 'bus' else props end as source from events where event_id % 10 < 6")(lambda t: frames(t)[0])
query("scan_frames_bad", "select event_id as line, case event_id % 10 when 6 then 'BadBody' when 7 then 'TooShort' when 8 then 'BadMagic' else 'UnknownSchema' end as error, case event_id % 10 when 6 then 1 when 9 then 99 end as schema_id from events where event_id % 10 > 5")(
    lambda t: frames(t)[1].select("line", "error", "schema_id")
)


def artefacts(t):
    """Submissions written by type and date, and one type of one month read back."""
    path = scratch_path(t.spark, "artefacts")
    f.write_artefacts(t.submissions.select("doc_id", "submission_type", "created_at", F.sha2("text", 256).alias("hash")), path)
    return t.spark.read.parquet(path).where("submission_type = 'sae' and m = 1").select("doc_id", "y", "m", "d", "hash")


query("write_artefacts", "select doc_id, cast(year(created_at) as int) as y, cast(month(created_at) as int) as m, cast(day(created_at) as int) as d, sha256(text) as hash from submissions where submission_type = 'sae' and month(created_at) = 1")(artefacts)
query(
    "csv_tables",
    """select o_custkey as doc_id, cast(row_number() over (partition by o_custkey order by line) as int) as row_no, line as cells from (select o_custkey, concat(cast(o_orderkey as varchar), '|', o_orderstatus) as line from orders)
    union all select distinct o_custkey, 0, 'order|status' from orders""",
)(
    lambda t: f.csv_tables(
        t.orders.groupBy(F.col("o_custkey").alias("doc_id")).agg(F.concat(F.lit("order;status\n"), F.array_join(F.array_sort(F.collect_list(F.concat_ws(";", F.col("o_orderkey").cast("string"), "o_orderstatus"))), "\n")).cast("binary").alias("content")).withColumn("delimiter", F.lit(";"))
    ).select("doc_id", "row_no", F.array_join("cells", "|").alias("cells"))
)


def clinical(t):
    """Each order as a document: a clinical resource, another kind of document, or a broken one."""
    kind = F.col("o_orderkey") % 4
    body = F.format_string(
        '<?xml version="1.0"?>\n<!-- order --><f:Patient xmlns:f="http://hl7.org/fhir"><f:id value=" %d "/><name><family value="%s"/>A &amp; <![CDATA[<B>]]></name><status>ok</status><id value="again"/><note>n&#233;<b/>tail</note></f:Patient>', F.col("o_orderkey"), "o_orderpriority"
    )
    other = F.format_string('<order><key>%d</key><key> </key><empty a=""/></order>', F.col("o_orderkey"))
    return t.orders.select(F.col("o_orderkey").alias("doc_id"), F.when(kind == 0, other).when(kind == 1, F.concat(other, F.lit("<x>"))).otherwise(body).alias("xml"))


query(
    "xml_flatten",
    """with o as (select o_orderkey as doc_id, o_orderpriority as p, o_orderkey % 4 as k from orders)
    select doc_id, unnest([0, 1, 2, 3, 4]) as seq, unnest(['Patient.id[@value]', 'Patient.name.family[@value]', 'Patient.status', 'Patient.id[@value]', 'Patient.note']) as path, unnest([cast(doc_id as varchar), p, 'ok', 'again', 'né']) as value from o where k > 1
    union all select doc_id, 0, 'order.key', cast(doc_id as varchar) from o where k = 0 union all select doc_id, 0, null, null from o where k = 1""",
)(lambda t: xml_flatten(clinical(t)))
query(
    "fhir_flatten",
    """with o as (select o_orderkey as doc_id, o_orderpriority as p from orders where o_orderkey % 4 > 1)
    select doc_id, unnest(['id.value', 'family.value', 'note']) as key, unnest([concat(' ', doc_id, ' '), p, 'né']) as value from o""",
)(lambda t: fhir_flatten(clinical(t)))
