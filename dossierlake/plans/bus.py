"""Queries over the message-bus operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossierlake.functions.scratch import scratch_path
from dossierlake.operators import bus as b
from dossierlake.plans.fixtures import NOW
from dossierlake.plans.registry import query

TS = f"timestamp '{NOW}'"


def window_start(minutes: int) -> str:
    return f"time_bucket(interval {minutes} minute, produced_at)"


query(
    "event_store_record",
    """select event_id, 'received' as status, case when length(props) <= 12 then props else concat('{"_truncated":true,"_preview":', cast(to_json(substr(props, 1, 12)) as varchar), '}') end as summary from events""",
)(lambda t: b.event_store_record(t.events, "props", 12).select("event_id", "status", "summary"))
UPDATES = """select off % 4000 as event_id, off as seq, case when off % 3 = 0 then null else processing_status end as status, case when off % 2 = 0 then processing_duration_ms end as duration_ms,
    case when processing_status = 'failed' then topic end as error from event_log"""


def fold_sql(updates: str) -> str:
    return f"""select event_id, arg_max(status, seq) filter (status is not null) as status, arg_max(duration_ms, seq) filter (duration_ms is not null) as duration_ms, arg_max(error, seq) filter (error is not null) as error,
    max(seq) filter (status in ('success','failed','dlq','dismissed')) as completed_at from ({updates}) group by 1"""


def status_updates(t):
    return t.event_log.select(
        (F.col("off") % 4000).alias("event_id"), F.col("off").alias("seq"), F.when(F.col("off") % 3 != 0, F.col("processing_status")).alias("status"),
        F.when(F.col("off") % 2 == 0, F.col("processing_duration_ms")).alias("duration_ms"), F.when(F.col("processing_status") == "failed", F.col("topic")).alias("error"),
    )


query("event_status_fold", fold_sql(UPDATES))(lambda t: b.event_status_fold(status_updates(t)))
query("insert_ignore", "select event_id, case when off % 3 <> 0 then topic else 'new' end as topic from event_log")(
    lambda t: b.insert_ignore(t.event_log.where("off % 3 <> 0"), t.event_log.where("off % 3 = 0 or off % 2 = 0").withColumn("topic", F.lit("new")), ["event_id", "produced_at"]).select("event_id", "topic")
)
query("upsert_latest", "select group_id, topic, part, case when part < 3 then committed_offset + 7 else committed_offset end as committed_offset from group_offsets")(
    lambda t: b.upsert_latest(t.group_offsets, t.group_offsets.where("part < 3").withColumn("committed_offset", F.col("committed_offset") + 7), ["group_id", "topic", "part"], "end_offset").select("group_id", "topic", "part", "committed_offset")
)
query("replace_chunks", "select doc_id, case when doc_num % 2 = 1 then 'new' else lang end as lang from submissions")(
    lambda t: b.replace_for_keys(t.submissions.where("doc_num % 4 <> 3").select("doc_id", "lang"), t.submissions.where("doc_num % 2 = 1").select("doc_id", F.lit("new").alias("lang")), "doc_id")
)
query("delete_document", "select vec_id, label from embeddings where vec_id % 10 <> 4")(lambda t: b.delete_keys(t.embeddings.select("vec_id", "label"), t.embeddings.where("vec_id % 10 = 4"), "vec_id"))
query("events_by_doc", "select event_id, topic from event_log where doc_id = 'DOC-000000000008'")(lambda t: b.events_by_doc(t.event_log, "DOC-000000000008").select("event_id", "topic"))
query(
    "events_by_topic",
    "select event_id from event_log where topic = 'documents.preprocessed' and processing_status = 'success' and produced_at >= timestamp '2024-01-05 00:00:00' and produced_at <= timestamp '2024-01-20 00:00:00' order by produced_at desc, event_id limit 100",
)(lambda t: b.events_by_topic(t.event_log, "documents.preprocessed", "success", "2024-01-05", "2024-01-20").select("event_id"))


def by_month(t):
    """The event log as the table that it is meant to be: partitioned by month, each task writing what it reads of a month."""
    path = scratch_path(t.spark, "events-by-month")
    t.event_log.withColumn("produced_month", F.date_format("produced_at", "yyyy-MM")).write.partitionBy("produced_month").parquet(path)
    return t.spark.read.parquet(path)


query("month_partition_scan", "select event_id from event_log where produced_at >= timestamp '2024-01-10 00:00:00' and produced_at < timestamp '2024-01-12 00:00:00'")(
    lambda t: b.month_partition_scan(by_month(t), "2024-01-10", "2024-01-12").select("event_id")
)
query(
    "retention_expire",
    f"""select event_id, coalesce(date_diff('second', date_trunc('second', produced_at), {TS}) > case topic when 'raw.documents.ingested' then 604800 when 'documents.preprocessed' then 604800 else 2592000 end, false) as expired from event_log""",
)(lambda t: b.retention_expire(t.event_log, NOW).select("event_id", "expired"))
query(
    "dlq_summary",
    """select original_topic, count(*) filter (status='pending') as pending, count(*) filter (status='reprocessing') as reprocessing, count(*) filter (status='dismissed') as dismissed, count(*) filter (status='resolved') as resolved,
    min(failed_at) filter (status='pending') as oldest_pending, (select error_type from dlq_events e where e.original_topic = d.original_topic group by 1 order by count(*) desc, error_type limit 1) as common_error from dlq_events d group by 1""",
)(lambda t: b.dlq_summary(t.dlq_events))
query(
    "dlq_depth_alert",
    "select original_topic as topic, count(*) as depth, case when count(*) >= 600 then 'CRITICAL' else 'WARNING' end as severity from dlq_events where status = 'pending' group by 1 having count(*) >= 100",
)(lambda t: b.dlq_depth_alert(t.dlq_events, 100, 600))
query("dlq_page", "select event_id, (select count(*) from dlq_events where error_type = 'TimeoutError' and status = 'pending') as total from dlq_events where error_type = 'TimeoutError' and status = 'pending' order by failed_at desc, event_id limit 50 offset 50")(
    lambda t: b.dlq_page(t.dlq_events, error_type="TimeoutError", status="pending", page=2).select("event_id", "total")
)
query("dlq_lookup", "select event_id, original_topic, status from dlq_events where event_id = 'e-0'")(lambda t: b.lookup_row(t.dlq_events, "event_id", "e-0").select("event_id", "original_topic", "status"))
query("submission_status", "select doc_id, status from submissions where doc_id = 'DOC-000000000042'")(lambda t: b.lookup_row(t.submissions, "doc_id", "DOC-000000000042").select("doc_id", "status"))
query("dlq_record", "select event_id, substr(repeat(event_type, 300), 1, 1000) as error_cut, length(substr(repeat(event_type, 900), 1, 3000)) as n_stack, cast(user_id as varchar) as payload_doc_id from events")(
    lambda t: b.dlq_record(
        t.events.select("event_id", F.repeat("event_type", 300).alias("error_message"), F.repeat("event_type", 900).alias("stack_trace"), F.to_json(F.struct(F.col("user_id").alias("doc_id"))).alias("payload"))
    ).select("event_id", "error_cut", F.length("stack_cut").alias("n_stack"), "payload_doc_id")
)
query(
    "dlq_reprocess_select",
    """select event_id, (row_number() over (order by failed_at, event_id) - 1) // 10 as due_second, 'reprocessing' as status from dlq_events
    where original_topic = 'reports.generated' and status = 'pending' and failed_at between timestamp '2024-01-03 00:00:00' and timestamp '2024-01-25 00:00:00'""",
)(lambda t: b.dlq_reprocess(t.dlq_events, "reports.generated", "2024-01-03", "2024-01-25"))
query(
    "dlq_dismiss",
    "select event_id, case when status = 'pending' and retry_count = 3 then 'dismissed' else status end as status, case when status = 'pending' and retry_count = 3 then 'stale' end as reason from dlq_events",
)(lambda t: b.dlq_dismiss(t.dlq_events, t.dlq_events.where("retry_count = 3"), "stale", NOW).select("event_id", "status", "reason"))
ROUTE = """with r as (select *, sum(case when processing_status = 'failed' then 0 else 1 end) over (partition by topic, doc_id order by produced_at, event_id rows unbounded preceding) as run from event_log),
    n as (select *, sum(case when processing_status = 'failed' then 1 else 0 end) over (partition by topic, doc_id, run order by produced_at, event_id rows unbounded preceding) as attempt from r)
    select event_id, attempt, case when attempt <= {limit} then concat(topic, '.retry.', cast(cast(attempt as bigint) as varchar)) else 'dlq' end as target from n where processing_status = 'failed'"""
for name, limit in (("retry_route", 3), ("retry_route_ingest", 2)):
    query(name, ROUTE.format(limit=limit))(lambda t, limit=limit: b.retry_route(t.event_log.withColumn("failed", F.col("processing_status") == "failed"), limit).select("event_id", "attempt", "target"))
#: counters that end a day after their first failure: the failures and successes of a key folded in order
COUNT = "case when not x.bad then 0 when s.n > 0 and x.us - s.first < 86400000000 then s.n + 1 else 1 end"
ROUTE_TTL = f"""select event_id, attempt, case when attempt <= 3 then concat(topic, '.retry.', cast(attempt as varchar)) else 'dlq' end as target from (
    select topic, unnest(ids) as event_id, cast(unnest(outs) as bigint) as attempt from (select topic, ids, list_reduce(list_prepend(struct_pack(us := 0::bigint, bad := false, n := 0, first := 0::bigint, outs := []::int[]), r),
        lambda s, x: struct_pack(us := x.us, bad := x.bad, n := {COUNT}, first := case when {COUNT} = 1 then x.us else s.first end, outs := list_append(s.outs, {COUNT}))).outs as outs from (
    select topic, list(event_id order by produced_at, event_id) as ids, list(struct_pack(us := epoch_us(produced_at), bad := processing_status = 'failed', n := 0, first := 0::bigint, outs := []::int[]) order by produced_at, event_id) as r
    from event_log group by topic, doc_id))) where attempt > 0"""
query("retry_route_ttl", ROUTE_TTL)(lambda t: b.retry_route_ttl(t.event_log.withColumn("failed", F.col("processing_status") == "failed"), 3).select("event_id", F.col("attempt").cast("long").alias("attempt"), "target"))
query(
    "retry_due",
    """select event_id, topic as original_topic from event_log where processing_status = 'failed' and
    epoch(timestamp '2024-01-15 00:00:00') >= floor(epoch(produced_at)) + case off % 3 when 0 then 5 when 1 then 30 else 300 end""",
)(
    lambda t: b.retry_due(
        t.event_log.where("processing_status = 'failed'").select("event_id", F.concat("topic", F.lit(".retry."), (F.col("off") % 3 + 1).cast("string")).alias("topic"), (F.col("off") % 3 + 1).alias("attempt"), F.col("produced_at").alias("retry_ts")),
        "2024-01-15",
    ).select("event_id", "original_topic")
)
LAG = "greatest(0, coalesce(end_offset, 0) - coalesce(committed_offset, 0))"
query("consumer_lag", f"select group_id, topic, part, {LAG} as lag from group_offsets")(lambda t: b.consumer_lag(t.group_offsets).select("group_id", "topic", "part", "lag"))
query("lag_alert", f"select group_id, cast(sum({LAG}) as bigint) as total_lag, case when sum({LAG}) >= 10000 then 'CRITICAL' else 'WARNING' end as severity from group_offsets group by 1 having sum({LAG}) >= 1000")(
    lambda t: b.lag_alert(t.group_offsets)
)
query("lag_by_group_topic", f"select group_id, topic, cast(sum({LAG}) as bigint) as lag from group_offsets group by 1, 2")(
    lambda t: b.consumer_lag(t.group_offsets).groupBy("group_id", "topic").agg(F.sum("lag").alias("lag"))
)
query(
    "failure_rate",
    f"""select {window_start(5)} as window_start, count(*) filter (processing_status='failed') as failed, count(*) filter (processing_status='success') as processed,
    round(count(*) filter (processing_status='failed') / count(*), 9) as rate from event_log where processing_status in ('failed','success') group by 1""",
)(lambda t: b.failure_rate(t.event_log).withColumn("rate", F.round("rate", 9)))
query("throughput_rate", f"select topic, {window_start(1)} as window_start, round(count(*) / 60, 9) as per_second from event_log group by 1, 2")(lambda t: b.throughput_rate(t.event_log).withColumn("per_second", F.round("per_second", 9)))
query(
    "latency_quantiles",
    f"select {window_start(60)} as window_start, " + ", ".join(f"round(quantile_cont(processing_duration_ms, {p}), 6) as {n}" for n, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))) + " from event_log group by 1",
)(lambda t: b.latency_quantiles(t.event_log, 60).select("window_start", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "p99")]))
BOUNDS = b.LATENCY_BOUNDS
INSIDE = [" and ".join([*([f"processing_duration_ms > {BOUNDS[i - 1]}"] if i else []), *([f"processing_duration_ms <= {BOUNDS[i]}"] if i < len(BOUNDS) else [])]) for i in range(len(BOUNDS) + 1)]
DUCK_COUNTS = "[" + ", ".join(f"count(*) filter ({c})" for c in INSIDE) + "]"
query("latency_histogram", f"select {window_start(1)} as window_start, array_to_string({DUCK_COUNTS}, ',') as counts from event_log where processing_duration_ms is not null group by 1")(
    lambda t: b.latency_histogram(t.event_log).select("window_start", F.array_join(F.transform("counts", lambda n: n.cast("string")), ",").alias("counts"))
)


def duck_quantile(p: float) -> str:
    """The bucket that the rank falls into, cut in proportion, from the list `counts`."""
    lows, highs = ", ".join(map(str, (0, *BOUNDS))), ", ".join(map(str, (*BOUNDS, BOUNDS[-1])))
    rank, at = f"({p} * list_sum(counts))", f"list_position(list_transform(counts, lambda n, i: n > 0 and list_sum(counts[1:i]) >= {p} * list_sum(counts)), true)"
    return f"([{lows}][{at}] + ([{highs}][{at}] - [{lows}][{at}]) * ({rank} - coalesce(list_sum(counts[1:{at} - 1]), 0)) / counts[{at}])"


PARTS = (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))
query(
    "latency_histogram_quantiles",
    f"select window_start, {', '.join(f'round({duck_quantile(p)}, 6) as {n}' for n, p in PARTS)} from (select {window_start(60)} as window_start, {DUCK_COUNTS} as counts from event_log where processing_duration_ms is not null group by 1)",
)(lambda t: b.merge_histograms(b.latency_histogram(t.event_log), 60).select("window_start", *[F.round(b.histogram_quantile(F.col("counts"), p), 6).alias(n) for n, p in PARTS]))
FINISHED = "count(*) filter (processing_status = 'failed') as failed, count(*) filter (processing_status = 'success') as processed"
query(
    "failure_rate_alert",
    f"""with w as (select topic, time_bucket(interval 1 minute, produced_at) - to_minutes(k) + interval 5 minute as ts, processing_status from event_log, (select unnest([0,1,2,3,4]) as k)),
    r as (select topic, ts, failed / (failed + processed) as rate from (select topic, ts, {FINISHED} from w group by 1, 2) where failed + processed > 0),
    i as (select *, rate > 0.1 as held, sum(case when rate > 0.1 and lag_ts = ts - interval 1 minute then 0 else 1 end) over (partition by topic order by ts rows unbounded preceding) as island from (select *, lag(ts) over (partition by topic order by ts) as lag_ts from r)),
    s as (select topic, min(ts) as since, max(ts) as until, count(*) as samples from i where held group by topic, island)
    select topic, since, until, samples from s where epoch(until) - epoch(since) >= 180""",
)(lambda t: b.failure_rate_alert(t.event_log))
query(
    "error_percent",
    f"select topic, window_start, round(100 * (failed / 300) / (failed / 300 + processed / 300 + 0.001), 6) as percent from (select topic, {window_start(5)} as window_start, {FINISHED} from event_log group by 1, 2)",
)(lambda t: b.error_percent(t.event_log).select("topic", "window_start", F.round("percent", 6).alias("percent")))
query(
    "rate_windows",
    "select time_bucket(interval 1 minute, produced_at) - to_minutes(k) as window_start, count(*) as n from event_log, (select unnest([0,1,2,3,4]) as k) group by 1",
)(lambda t: b.rate_windows(t.event_log))
query(
    "heartbeat_dead",
    f"select concat('u', cast(user_id as varchar)) as group_id, cast(date_diff('second', date_trunc('second', max(ts)), {TS}) as bigint) as age from events group by 1 having date_diff('second', date_trunc('second', max(ts)), {TS}) > 200000",
)(lambda t: b.heartbeat_dead(t.events.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("group_id"), "ts"), NOW, 200_000).select("group_id", "age"))
query(
    "sustained_alert",
    """with f as (select topic, produced_at as ts, processing_duration_ms > 300 as held from event_log),
    i as (select *, sum(case when held then 0 else 1 end) over (partition by topic order by ts rows unbounded preceding) as island from f),
    s as (select topic, island, min(ts) as since, max(ts) as until, count(*) as samples from i where held group by 1, 2)
    select topic, since, until, samples from s where floor(epoch(until)) - floor(epoch(since)) >= 3600""",
)(lambda t: b.sustained_alert(t.event_log, F.col("processing_duration_ms") > 300, 3600, "topic", "produced_at"))
RATED = "select *, count(*) over (partition by ip order by epoch_us(ts) range between {us} preceding and current row) as in_window from request_log"
query("sliding_rate", f"select req_id, in_window, in_window > 1 as over_limit from ({RATED.format(us=86399999999)}) where ip <> '10.0.0.1'")(
    lambda t: b.sliding_rate(t.request_log, "ip", 1, 86_400, allowed=("10.0.0.1",)).select("req_id", "in_window", "over_limit")
)
query(
    "rate_violations",
    f"""with r as ({RATED.format(us=86399999999)}), v as (select *, count(*) over (partition by ip order by epoch_us(ts) range between 863999999999 preceding and current row) as violations from r where in_window > 1)
    select req_id, violations, case when violations >= 3 then ts + interval 24 hour end as blocked_until from v""",
)(lambda t: b.rate_violations(b.sliding_rate(t.request_log, "ip", 1, 86_400), "ip", 864_000, 3).select("req_id", "violations", "blocked_until"))
query(
    "notifications_union",
    f"""select 'dlq' as origin, original_topic as subject, case when count(*) >= 600 then 'CRITICAL' else 'WARNING' end as severity from dlq_events where status = 'pending' group by 2 having count(*) >= 100
    union all select 'lag', group_id, case when sum({LAG}) >= 10000 then 'CRITICAL' else 'WARNING' end from group_offsets group by 2 having sum({LAG}) >= 1000
    union all select 'compliance', concat(doc_id, '/', source_event), case when blocked then 'CRITICAL' else 'WARNING' end from assessments where human_review_required""",
)(
    lambda t: b.dlq_depth_alert(t.dlq_events, 100, 600).select(F.lit("dlq").alias("origin"), F.col("topic").alias("subject"), "severity")
    .unionByName(b.lag_alert(t.group_offsets).select(F.lit("lag").alias("origin"), F.col("group_id").alias("subject"), "severity"), allowMissingColumns=True)
    .unionByName(t.assessments.where("human_review_required").select(F.lit("compliance").alias("origin"), F.concat_ws("/", "doc_id", "source_event").alias("subject"), F.when(F.col("blocked"), "CRITICAL").otherwise("WARNING").alias("severity")))
)
