"""Message-bus analytics: event store, retries, dead letters, lag, rates, retention."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from dossierlake.operators.dashboards import at

#: seconds that topics are kept (fixed values): 7 days, 30 days, 24 hours
DAY = 86_400
RETENTION = {
    "raw.documents.ingested": 7 * DAY,
    "documents.preprocessed": 7 * DAY,
    "documents.chunks.ready": 7 * DAY,
    "documents.anonymised": 30 * DAY,
    "documents.summarised": 30 * DAY,
    "documents.classified": 30 * DAY,
    "reports.generated": 30 * DAY,
    "dlq": 30 * DAY,
    "notifications": DAY,
    "documents.comparison.requested": DAY,
    "retry": DAY,
}
#: seconds before the nth retry is due (fixed values)
RETRY_DELAYS = {1: 5, 2: 30, 3: 300}
STATUSES = ("pending", "reprocessing", "dismissed", "resolved")
#: pending dead letters of a topic that raise an alert (fixed values)
DEPTHS = {"WARNING": 10, "CRITICAL": 50}
#: seconds that an attempt counter lives from its first failure (fixed value)
ATTEMPT_TTL = DAY


def lookup(key: Column, table: dict, default=None) -> Column:
    """A small fixed dictionary as a column."""
    out = F.lit(default)
    for k, v in reversed(table.items()):
        out = F.when(key == k, v).otherwise(out)
    return out


# --- event store ---------------------------------------------------------------------------------------------------


def event_store_record(events: DataFrame, payload: str = "payload", limit: int = 1024) -> DataFrame:
    """events plus summary: the payload if it is JSON of at most `limit` characters, else a preview."""
    c = F.col(payload)
    fits = (F.length(c) <= limit) & F.try_parse_json(c).isNotNull()
    preview = F.to_json(F.struct(F.lit(True).alias("_truncated"), F.substring(c, 1, limit).alias("_preview")))
    return events.withColumn("summary", F.when(fits, c).otherwise(preview)).withColumn("status", F.lit("received"))


def event_status_fold(updates: DataFrame, key: str = "event_id", order: str = "seq") -> DataFrame:
    """Last known status, duration and error of each event from its log of updates; nulls do not overwrite."""
    last = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c)
    done = F.col("status").isin("success", "failed", "dlq", "dismissed")
    return updates.groupBy(key).agg(last("status"), last("duration_ms"), last("error"), F.max(F.when(done, F.col(order))).alias("completed_at"))


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old plus the rows of new whose keys it lacks; of repeated new keys one row."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"))


def upsert_latest(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each key: the new one if there is one, the latest of several by `order`."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    newest = W.partitionBy(*keys).orderBy(F.desc("_new"), F.desc(order))
    return both.withColumn("_rank", F.row_number().over(newest)).where("_rank = 1").drop("_new", "_rank")


def replace_for_keys(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old without the rows of keys that new holds, plus new."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def delete_keys(table: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return table.join(gone.select(key), key, "left_anti")


def events_by_doc(events: DataFrame, doc_id: str) -> DataFrame:
    return events.where(F.col("doc_id") == doc_id).orderBy("produced_at", "event_id")


def events_by_topic(events: DataFrame, topic: str, status: str | None = None, start: str | None = None, end: str | None = None, limit: int = 100) -> DataFrame:
    """Newest events of a topic; only given filters apply."""
    out = events.where(F.col("topic") == topic)
    out = out if status is None else out.where(F.col("processing_status") == status)
    out = out if start is None else out.where(F.col("produced_at") >= at(start))
    out = out if end is None else out.where(F.col("produced_at") <= at(end))
    return out.orderBy(F.desc("produced_at"), "event_id").limit(limit)


def month_partition_scan(events: DataFrame, start: str, end: str, month: str = "produced_month", ts: str = "produced_at") -> DataFrame:
    """Rows of a time range of a table partitioned by month; the month bounds let the reader skip whole partitions."""
    months = F.col(month).between(F.date_format(F.trunc(at(start), "month"), "yyyy-MM"), F.date_format(at(end), "yyyy-MM"))
    return events.where(months & (F.col(ts) >= at(start)) & (F.col(ts) < at(end)))


def retention_expire(events: DataFrame, now: str, topic: str = "topic", ts: str = "produced_at") -> DataFrame:
    """events plus expired: older than their topic is kept; topics without a rule never expire."""
    keep = lookup(F.col(topic), RETENTION)
    return events.withColumn("expired", F.coalesce(F.unix_timestamp(at(now)) - F.unix_timestamp(ts) > keep, F.lit(False)))


# --- dead letters --------------------------------------------------------------------------------------------------


def dlq_summary(dlq: DataFrame) -> DataFrame:
    """Per topic the count of each status, the oldest pending time and the commonest error (ties: the smallest)."""
    errors = dlq.groupBy("original_topic", "error_type").agg(F.count("*").alias("n"))
    common = errors.groupBy("original_topic").agg(F.min(F.struct((-F.col("n")).alias("n"), "error_type")).alias("e"))
    counts = dlq.groupBy("original_topic").agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES], F.min(F.when(F.col("status") == "pending", F.col("failed_at"))).alias("oldest_pending"))
    return counts.join(common, "original_topic").select("original_topic", *STATUSES, "oldest_pending", F.col("e.error_type").alias("common_error"))


def dlq_depth_alert(dlq: DataFrame, warning: int = 10, critical: int = 50) -> DataFrame:
    """A notification for each topic with too many pending dead letters."""
    depth = dlq.where("status = 'pending'").groupBy(F.col("original_topic").alias("topic")).agg(F.count("*").alias("depth"))
    severity = F.when(F.col("depth") >= critical, "CRITICAL").when(F.col("depth") >= warning, "WARNING")
    return depth.withColumn("severity", severity).where("severity is not null")


def dlq_page(dlq: DataFrame, topic=None, error_type=None, status=None, start=None, end=None, page: int = 1, page_size: int = 50) -> DataFrame:
    """A page of dead letters, newest first, with the total count; only given filters apply."""
    if not 1 <= page_size <= 200 or page < 1:
        raise ValueError("page_size is from 1 to 200 and page from 1")
    out = dlq
    for column, value in (("original_topic", topic), ("error_type", error_type), ("status", status)):
        out = out if value is None else out.where(F.col(column) == value)
    out = out if start is None else out.where(F.col("failed_at") >= at(start))
    out = out if end is None else out.where(F.col("failed_at") <= at(end))
    rows = out.orderBy(F.desc("failed_at"), "event_id").offset((page - 1) * page_size).limit(page_size)
    return rows.join(F.broadcast(out.agg(F.count("*").alias("total"))), F.lit(True))  # one row


def lookup_row(rows: DataFrame, key: str, value: str) -> DataFrame:
    """A point lookup; an unknown key gives no row."""
    return rows.where(F.col(key) == value)


def dlq_record(failures: DataFrame) -> DataFrame:
    """Dead-letter rows with long fields cut, and the document read from the payload."""
    return failures.select(
        "*", F.substring("error_message", 1, 1000).alias("error_cut"), F.substring("stack_trace", 1, 3000).alias("stack_cut"), F.substring("payload", 1, 10000).alias("payload_cut"),
        F.get_json_object("payload", "$.doc_id").alias("payload_doc_id"),
    )


def dlq_reprocess(dlq: DataFrame, topic: str, start: str, end: str, per_second: int = 10) -> DataFrame:
    """Pending dead letters of a range with the second in which each is sent again, `per_second` of them a second.

    Positions come from counts of whole minutes and a rank inside each minute, so no single task orders all rows.
    """
    chosen = dlq.where((F.col("original_topic") == topic) & (F.col("status") == "pending") & F.col("failed_at").between(at(start), at(end)))
    chosen = chosen.withColumn("minute", F.date_trunc("minute", "failed_at"))
    inside = chosen.withColumn("rank", F.row_number().over(W.partitionBy("minute").orderBy("failed_at", "event_id")))
    minutes = chosen.groupBy("minute").agg(F.count("*").alias("n"))  # one row a minute: small
    before = minutes.withColumn("before", F.sum("n").over(W.orderBy("minute").rowsBetween(W.unboundedPreceding, -1))).select("minute", F.coalesce("before", F.lit(0)).alias("before"))
    return inside.join(before, "minute").select("event_id", F.floor((F.col("before") + F.col("rank") - 1) / per_second).alias("due_second"), F.lit("reprocessing").alias("status"))


def dlq_dismiss(dlq: DataFrame, event_ids: DataFrame, reason: str, now: str) -> DataFrame:
    """dlq after dismissal: pending rows that are named become dismissed with a reason and time."""
    named = dlq.join(event_ids.select("event_id").distinct().withColumn("_hit", F.lit(True)), "event_id", "left")
    hit = F.coalesce(F.col("_hit") & (F.col("status") == "pending"), F.lit(False))
    return named.select(*[c for c in dlq.columns if c != "status"], F.when(hit, "dismissed").otherwise(F.col("status")).alias("status"), F.when(hit, reason).alias("reason"), F.when(hit, at(now)).alias("resolved_at"))


def backlog_alerts(changes: DataFrame, depths: dict[str, int] | None = None, bucket: int = DAY) -> DataFrame:
    """(topic, event_id, us, depth, severity) each time the pending events of a topic reach a depth from below.

    changes: event_id, topic, status, ts.  A status that is said again changes nothing.  Depths are running sums inside
    time buckets, on top of the sums of the buckets before, so that a busy topic is no single task.
    """
    rows = changes.select("topic", "event_id", "status", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    pending = F.col("status") == "pending"
    before = F.coalesce(F.lag(pending).over(W.partitionBy("topic", "event_id").orderBy("us", "status")), F.lit(False))
    rows = rows.withColumn("delta", pending.cast("int") - before.cast("int")).where("delta <> 0").withColumn("bucket", F.floor(F.col("us") / (bucket * 1_000_000)))
    sums = rows.groupBy("topic", "bucket").agg(F.sum("delta").alias("sum"))
    base = F.coalesce(F.sum("sum").over(W.partitionBy("topic").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    within = F.sum("delta").over(W.partitionBy("topic", "bucket").orderBy("us", "event_id", "status").rowsBetween(W.unboundedPreceding, 0))
    rows = rows.join(sums.withColumn("base", base).drop("sum"), ["topic", "bucket"]).withColumn("depth", F.col("base") + within)
    severity = lookup(F.col("depth"), {n: s for s, n in (depths or DEPTHS).items()})
    return rows.where("delta > 0").select("topic", "event_id", "us", "depth", severity.alias("severity")).where("severity is not null")


# --- retries -------------------------------------------------------------------------------------------------------


def retry_route(records: DataFrame, limit: int = 3, keys: tuple[str, ...] = ("topic", "doc_id"), order: tuple[str, ...] = ("produced_at", "event_id")) -> DataFrame:
    """Where each failure goes: the nth since the last success to {topic}.retry.n, beyond the limit to the dead letters."""
    w = W.partitionBy(*keys).orderBy(*order)
    runs = records.withColumn("_run", F.sum(F.when(F.col("failed"), 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    nth = F.sum(F.when(F.col("failed"), 1).otherwise(0)).over(W.partitionBy(*keys, "_run").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    nth = runs.withColumn("attempt", nth).where("failed")
    return nth.withColumn("target", F.when(F.col("attempt") <= limit, F.concat("topic", F.lit(".retry."), F.col("attempt").cast("string"))).otherwise("dlq")).drop("_run")


def attempts(times: list[int], failed: list[bool], ttl: int | None, state: tuple[int, int] = (0, 0)) -> tuple[list[int], tuple[int, int]]:
    """Number of each failure since the last success (0 for a success), and the state (failures, time of the first) after.

    Times are microseconds in ascending order; a counter ends `ttl` seconds after its first failure.
    """
    (n, first), out = state, []
    for us, bad in zip(times, failed, strict=True):
        if n and ttl is not None and us - first >= ttl * 1_000_000:
            n = 0
        n = n + 1 if bad else 0
        if n == 1:
            first = us
        out.append(n)
    return out, (n, first if n else 0)


def retry_route_ttl(records: DataFrame, limit: int = 3, ttl: int | None = ATTEMPT_TTL, keys: tuple[str, ...] = ("topic", "doc_id"), order: tuple[str, ...] = ("produced_at", "event_id")) -> DataFrame:
    """retry_route with counters that end `ttl` seconds after their first failure.

    When a counter began depends on when the one before it ended, so a key is walked in order: in sorted partitions,
    keys side by side, with two numbers held.
    """
    names, schema = records.columns, StructType([*records.schema.fields]).add("attempt", IntegerType())
    rows = records.withColumn("_us", F.unix_micros(F.col(order[0]).cast("timestamp")))

    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, (0, 0)
        for batch in batches:
            numbers = []
            held = zip(zip(*(batch.column(k).to_pylist() for k in keys), strict=True), batch.column("_us").to_pylist(), batch.column("failed").to_pylist(), strict=True)
            for key, us, bad in held:
                if key != now:
                    now, state = key, (0, 0)
                (n,), state = attempts([us], [bool(bad)], ttl, state)
                numbers.append(n)
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(numbers, pa.int32())], names=[*names, "attempt"])

    walked = rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(walk, schema).where("failed")
    return walked.withColumn("target", F.when(F.col("attempt") <= limit, F.concat("topic", F.lit(".retry."), F.col("attempt").cast("string"))).otherwise("dlq"))


def retry_due(retries: DataFrame, now: str) -> DataFrame:
    """Retries whose delay has passed, with the topic they came from."""
    due = F.unix_timestamp("retry_ts") + lookup(F.col("attempt"), RETRY_DELAYS, 300)
    return retries.where(F.unix_timestamp(at(now)) >= due).withColumn("original_topic", F.regexp_replace("topic", r"\.retry\.\d+$", ""))


# --- lag and rates -------------------------------------------------------------------------------------------------


def consumer_lag(offsets: DataFrame) -> DataFrame:
    """Lag of each partition: end minus committed, never negative; a missing committed offset counts 0, a missing end 0."""
    return offsets.withColumn("lag", F.greatest(F.lit(0), F.coalesce("end_offset", F.lit(0)) - F.coalesce("committed_offset", F.lit(0))))


def lag_alert(offsets: DataFrame, warning: int = 1_000, critical: int = 10_000) -> DataFrame:
    total = consumer_lag(offsets).groupBy("group_id").agg(F.sum("lag").alias("total_lag"))
    return total.withColumn("severity", F.when(F.col("total_lag") >= critical, "CRITICAL").when(F.col("total_lag") >= warning, "WARNING")).where("severity is not null")


def failure_rate(events: DataFrame, minutes: int = 5) -> DataFrame:
    """Share of failures among finished events of each window."""
    bad, good = F.count_if(F.col("processing_status") == "failed"), F.count_if(F.col("processing_status") == "success")
    per = events.groupBy(F.window("produced_at", f"{minutes} minutes").alias("w")).agg(bad.alias("failed"), good.alias("processed"))
    return per.where("failed + processed > 0").select(F.col("w.start").alias("window_start"), "failed", "processed", (F.col("failed") / (F.col("failed") + F.col("processed"))).alias("rate"))


def throughput_rate(events: DataFrame) -> DataFrame:
    """Messages a second of each topic over windows of a minute."""
    per = events.groupBy("topic", F.window("produced_at", "1 minute").alias("w")).agg(F.count("*").alias("n"))
    return per.select("topic", F.col("w.start").alias("window_start"), (F.col("n") / 60).alias("per_second"))


def latency_quantiles(events: DataFrame, minutes: int = 5, exact: bool = True) -> DataFrame:
    """p50, p95 and p99 of the processing time of each window; exact, or by bounded sketches for very large windows."""
    q = F.percentile if exact else F.percentile_approx
    per = events.groupBy(F.window("produced_at", f"{minutes} minutes").alias("w")).agg(*[q("processing_duration_ms", F.lit(p)).alias(n) for n, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))])
    return per.select(F.col("w.start").alias("window_start"), "p50", "p95", "p99")


#: upper bounds of latency buckets in milliseconds, the last one open; a histogram of a user's own choice may differ
LATENCY_BOUNDS = (5, 10, 25, 50, 75, 100, 250, 500, 750, 1_000, 2_500, 5_000, 7_500, 10_000)


def latency_histogram(events: DataFrame, minutes: int = 1, bounds: tuple[float, ...] = LATENCY_BOUNDS, value: str = "processing_duration_ms", keys: tuple[str, ...] = ()) -> DataFrame:
    """Counts of a window's durations per bucket: (keys, window_start, counts), counts one longer than bounds.

    A bucket holds what is above the bound before it and at most its own.  Nulls are left out.  The counts are all that
    is kept of a window, whatever the number of its events, and add up over windows and keys (merge_histograms).
    """
    v, lows = F.col(value), [None, *bounds]
    within = lambda i: (v > lows[i] if i else F.lit(True)) & (v <= bounds[i] if i < len(bounds) else F.lit(True))
    per = events.where(v.isNotNull()).groupBy(*keys, F.window("produced_at", f"{minutes} minutes").alias("w")).agg(F.array(*[F.count_if(within(i)) for i in range(len(bounds) + 1)]).alias("counts"))
    return per.select(*keys, F.col("w.start").alias("window_start"), "counts")


def merge_histograms(histograms: DataFrame, minutes: int, slide: int | None = None, bounds: tuple[float, ...] = LATENCY_BOUNDS, keys: tuple[str, ...] = ()) -> DataFrame:
    """Histograms of longer windows, tumbling or sliding by `slide` minutes, from those of shorter ones that divide them."""
    w = F.window("window_start", f"{minutes} minutes", f"{slide or minutes} minutes").alias("w")
    per = histograms.groupBy(*keys, w).agg(F.array(*[F.sum(F.col("counts")[i]) for i in range(len(bounds) + 1)]).alias("counts"))
    return per.select(*keys, F.col("w.start").alias("window_start"), "counts")


def histogram_quantile(counts: Column, p: float, bounds: tuple[float, ...] = LATENCY_BOUNDS) -> Column:
    """The p-quantile that bucket counts tell: the bucket in which the rank p * n falls, cut in proportion.

    The first bucket begins at 0; a rank in the open last bucket gives the highest bound; no events give null.
    """
    lows = F.array(*[F.lit(float(b)) for b in (0, *bounds)])
    highs = F.array(*[F.lit(float(b)) for b in (*bounds, bounds[-1])])
    rank = p * F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    start = F.struct(F.lit(0).cast("long").alias("below"), F.lit(None).cast("double").alias("q"))
    pieces = F.arrays_zip(counts.alias("n"), lows.alias("low"), highs.alias("high"))

    def step(a: Column, x: Column) -> Column:
        here = a["q"].isNull() & (x["n"] > 0) & (a["below"] + x["n"] >= rank)
        return F.struct((a["below"] + x["n"]).alias("below"), F.when(here, x["low"] + (x["high"] - x["low"]) * (rank - a["below"]) / x["n"]).otherwise(a["q"]).alias("q"))

    return F.aggregate(pieces, start, step, lambda a: a["q"])


def failure_rate_alert(events: DataFrame, over: float = 0.1, minutes: int = 5, seconds: int = 180, key: str = "topic") -> DataFrame:
    """Stretches over which the share of failures in the last `minutes`, told each minute, stayed above `over` for `seconds`.

    A minute without finished events in its window says nothing, and ends a stretch.
    """
    bad, good = F.count_if(F.col("processing_status") == "failed"), F.count_if(F.col("processing_status") == "success")
    per = events.groupBy(key, F.window("produced_at", f"{minutes} minutes", "1 minute").alias("w")).agg(bad.alias("failed"), good.alias("processed"))
    told = per.select(key, F.col("w.end").alias("ts"), F.try_divide(F.col("failed"), F.col("failed") + F.col("processed")).alias("rate")).where("rate is not null")
    # a minute that is missing stands between its neighbours as one on which the condition does not hold; a row a minute
    gap = F.lead("ts").over(W.partitionBy(key).orderBy("ts")) > F.col("ts") + F.make_interval(mins=F.lit(1))
    marked = told.withColumn("gap", F.coalesce(gap, F.lit(False)))
    holes = marked.where("gap").select(key, (F.col("ts") + F.make_interval(mins=F.lit(1))).alias("ts"), F.lit(None).cast("double").alias("rate"))
    return sustained_alert(told.unionByName(holes), F.col("rate") > over, seconds, key, "ts")


def error_percent(events: DataFrame, minutes: int = 5, keys: tuple[str, ...] = ("topic",), floor: float = 0.001) -> DataFrame:
    """Failures per hundred finished events as a dashboard draws them: rates a second, with `floor` under the fraction."""
    bad, good = F.count_if(F.col("processing_status") == "failed"), F.count_if(F.col("processing_status") == "success")
    per = events.groupBy(*keys, F.window("produced_at", f"{minutes} minutes").alias("w")).agg((bad / (60 * minutes)).alias("bad"), (good / (60 * minutes)).alias("good"))
    return per.select(*keys, F.col("w.start").alias("window_start"), (100 * F.col("bad") / (F.col("bad") + F.col("good") + floor)).alias("percent"))


def rate_windows(events: DataFrame, width: str = "5 minutes", slide: str = "1 minute") -> DataFrame:
    per = events.groupBy(F.window("produced_at", width, slide).alias("w")).agg(F.count("*").alias("n"))
    return per.select(F.col("w.start").alias("window_start"), "n")


def heartbeat_dead(beats: DataFrame, now: str, seconds: int = 300) -> DataFrame:
    """Groups whose last sign of life is older than `seconds`."""
    last = beats.groupBy("group_id").agg(F.max("ts").alias("last"))
    return last.withColumn("age", F.unix_timestamp(at(now)) - F.unix_timestamp("last")).where(F.col("age") > seconds)


def sustained_alert(samples: DataFrame, condition: Column, seconds: int, key: str, ts: str, bucket: int = 86_400) -> DataFrame:
    """Stretches of consecutive samples of a key on which the condition held for at least `seconds`.

    Stretches are found inside time buckets of a key and joined at the buckets' edges, from two rows a bucket at most,
    so no task orders all samples of a key.
    """
    on = F.coalesce(condition, F.lit(False))
    flagged = samples.select(F.col(key).alias("key"), F.col(ts).alias("ts"), on.alias("on"), F.floor(F.unix_timestamp(ts) / bucket).alias("bucket"))
    w = W.partitionBy("key", "bucket").orderBy("ts").rowsBetween(W.unboundedPreceding, 0)
    numbered = flagged.withColumn("island", F.sum(F.when(F.col("on"), 0).otherwise(1)).over(w))
    # an island's number is how many samples before it, in the bucket, were off
    local = numbered.groupBy("key", "bucket", "island").agg(*[f(F.when(F.col("on"), F.col("ts"))).alias(n) for n, f in (("since", F.min), ("until", F.max), ("samples", F.count))])
    ends = local.groupBy("key", "bucket").agg(F.max("island").alias("last"))
    marked = local.join(ends, ["key", "bucket"]).withColumn("starts", (F.col("island") == 0) & (F.col("samples") > 0)).withColumn("stops", (F.col("island") == F.col("last")) & (F.col("samples") > 0))
    inner = marked.where("samples > 0 and not starts and not stops").select("key", "since", "until", "samples")
    edges = marked.where("island = 0 or island = last")
    order = W.partitionBy("key").orderBy("bucket", "island")
    # a stretch goes on from the edge row before it if that one stopped with its bucket and this one starts with its own
    fresh = ~(F.col("starts") & F.coalesce(F.lag("stops").over(order), F.lit(False)))
    edges = edges.withColumn("stretch", F.sum(fresh.cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0))).where("samples > 0")
    whole = edges.groupBy("key", "stretch").agg(F.min("since").alias("since"), F.max("until").alias("until"), F.sum("samples").alias("samples")).drop("stretch")
    long = inner.unionByName(whole).where(F.unix_timestamp("until") - F.unix_timestamp("since") >= seconds)
    return long.select(F.col("key").alias(key), "since", "until", "samples")


# --- requests ------------------------------------------------------------------------------------------------------


def _in_last(rows: DataFrame, key: str, seconds: int, out: str) -> DataFrame:
    """rows plus `out`: rows of the key in (t - seconds, t].

    Time is cut into buckets of that length, and each row also stands in the next one, which holds all that its rows
    look back on; so a key with very many rows is no single task.
    """
    span = seconds * 1_000_000
    placed = rows.withColumn("_us", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("_next", F.explode(F.array(F.lit(0), F.lit(1))))
    placed = placed.withColumn("_bucket", F.floor(F.col("_us") / span) + F.col("_next"))
    frame = W.partitionBy(key, "_bucket").orderBy("_us").rangeBetween(-(span - 1), 0)
    return placed.withColumn(out, F.count("*").over(frame)).where("_next = 0").drop("_us", "_next", "_bucket")


def sliding_rate(requests: DataFrame, key: str = "ip", limit: int = 60, seconds: int = 60, allowed: tuple[str, ...] = ()) -> DataFrame:
    """Requests of the key in (t - seconds, t] at each request, and whether the limit is passed; listed keys are skipped."""
    rows = requests.where(~F.col(key).isin(*allowed)) if allowed else requests
    return _in_last(rows, key, seconds, "in_window").withColumn("over_limit", F.col("in_window") > limit)


def rate_violations(rated: DataFrame, key: str = "ip", window: int = 3600, most: int = 10, block_hours: int = 24) -> DataFrame:
    """Requests over the limit with the violations of the last window, and until when the key is blocked."""
    bad = _in_last(rated.where("over_limit"), key, window, "violations")
    return bad.withColumn("blocked_until", F.when(F.col("violations") >= most, F.col("ts") + F.make_interval(hours=F.lit(block_hours))))
