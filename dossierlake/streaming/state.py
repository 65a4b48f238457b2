"""Streams that keep state of their own: retry timers, attempt counters, backlog alerts.

All are stateful processors over RocksDB.  What arrives for a key in a micro-batch comes in no order; each processor gathers
the few columns it needs, sorts them by (time, event) and walks them, so that order does not show in the result.  Between
micro-batches the order of arrival counts.  Keys are many and small, so they take rows, and counters and pending events lie in
parts that are read and written at once: a frame a key, or a call to the store for each, costs more than what it holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from dossierlake.operators.bus import DEPTHS, RETRY_DELAYS, attempts

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: parts of a topic whose pending events are kept apart
PARTS = 64
#: parts that the counters of attempts are kept in
COUNTERS = 256
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_rocksdb(spark: SparkSession) -> None:
    """The state store of the streams of this module, which a query takes from its session when it starts."""
    spark.conf.set(PROVIDER, ROCKSDB)


def gathered(rows: Iterator[Row], *columns: str) -> list[tuple]:
    """The named columns of all rows of a key, in the order of those columns, nulls last."""
    return sorted((tuple(r[c] for c in columns) for r in rows), key=lambda t: tuple((v is None, v) for v in t))


# --- retries that wait -------------------------------------------------------------------------------------------

RELEASED = "topic string, doc_id string, event_id string, attempt int, due_ms long, released_ms long"


class RetryTimers(StatefulProcessor):
    """Holds each retry of a key until its delay has passed on the stream's clock, then lets it go."""

    def __init__(self, event_time: bool):
        self.event_time = event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "due_ms long, event_id string, attempt int")

    def clock(self, timers) -> int:
        return timers.getCurrentWatermarkInMs() if self.event_time else timers.getCurrentProcessingTimeInMs()

    def rows(self, key: tuple, due: list[tuple], now: int) -> Iterator[Row]:
        for ms, event, attempt in sorted(due):
            yield Row(topic=key[0], doc_id=key[1], event_id=event, attempt=attempt, due_ms=ms, released_ms=now)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now, due, wait = self.clock(timerValues), [], []
        for ms, event, attempt in gathered(rows, "due_ms", "event_id", "attempt"):
            (due if ms <= now else wait).append((int(ms), event, int(attempt)))
        if wait:
            self.waiting.appendList(wait)
            self.handle.registerTimer(wait[0][0])
        yield from self.rows(key, due, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        # one timer a key stands for all that is due by now, and the next one for what waits longer
        now, due, wait = self.clock(timerValues), [], []
        for held in self.waiting.get():
            (due if held[0] <= now else wait).append(tuple(held))
        if due:
            if wait:
                self.waiting.put(wait)
                self.handle.registerTimer(min(wait)[0])
            else:
                self.waiting.clear()
        yield from self.rows(key, due, now)

    def close(self) -> None:
        pass


def retry_timers(retries: DataFrame, lateness: str | None = "1 hour") -> DataFrame:
    """Retries when they are due: (topic, doc_id, event_id, attempt, due_ms, released_ms), topic the one they came from.

    retries: topic ({original}.retry.{n}), doc_id, event_id, attempt, retry_ts.  The nth waits RETRY_DELAYS[n] seconds.
    With a lateness the clock is the watermark of retry_ts, so a stream that is read again lets the same rows go; retries
    later than that are dropped.  lateness=None goes by the wall clock, as a consumer that sleeps does.
    """
    delay = F.lit(300)
    for n, seconds in RETRY_DELAYS.items():
        delay = F.when(F.col("attempt") == n, seconds).otherwise(delay)
    rows = retries.withColumn("retry_ts", F.col("retry_ts").cast("timestamp"))
    if lateness:
        rows = rows.withWatermark("retry_ts", lateness)
    rows = rows.withColumn("due_ms", F.unix_millis("retry_ts") + delay * 1000).withColumn("topic", F.regexp_replace("topic", r"\.retry\.\d+$", ""))
    return rows.groupBy("topic", "doc_id").transformWithState(RetryTimers(bool(lateness)), RELEASED, "Append", "EventTime" if lateness else "ProcessingTime")


# --- attempts ----------------------------------------------------------------------------------------------------


class Attempts(StatefulProcessor):
    """Failures of the keys of a part since their last success, forgotten `ttl` seconds after the first of them."""

    def __init__(self, limit: int, ttl: int | None, expire: bool):
        self.limit, self.ttl, self.expire = limit, ttl, bool(expire and ttl)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getListState("failures", "topic string, doc_id string, n int, first_us long, seen_ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        clock = timerValues.getCurrentProcessingTimeInMs() if self.expire else 0
        # keys that have been silent for so long are forgotten, whatever the events' own times say
        counts = {(t, d): (n, first, seen) for t, d, n, first, seen in self.state.get() if not (self.expire and clock - seen >= self.ttl * 1000)}
        for (topic, doc), group in groupby(gathered(rows, "topic", "doc_id", "us", "event_id", "failed"), key=lambda r: r[:2]):
            held = list(group)
            numbers, state = attempts([h[2] for h in held], [h[4] for h in held], self.ttl, counts.pop((topic, doc), (0, 0))[:2])
            if state[0]:
                counts[topic, doc] = (*state, clock)
            for h, n in zip(held, numbers, strict=True):
                if n:
                    yield Row(topic=topic, doc_id=doc, event_id=h[3], attempt=n, target=f"{topic}.retry.{n}" if n <= self.limit else "dlq")
        if counts:
            self.state.put([(*k, *v) for k, v in counts.items()])
        else:
            self.state.clear()

    def close(self) -> None:
        pass


def retry_route_stream(records: DataFrame, limit: int = 3, ttl: int | None = 86_400, expire: bool = True) -> DataFrame:
    """Routes of failures: (topic, doc_id, event_id, attempt, target); records: topic, doc_id, event_id, failed, ts.

    The batch form is retry_route_ttl with the same ttl.  Counters lie in COUNTERS parts, each read and written at once.  With
    expire those of silent keys are forgotten by the wall clock, when something next arrives for their part; this clock keeps
    an availableNow trigger from ending.  Without, a counter stays until a success.
    """
    rows = records.select("topic", "doc_id", "event_id", "failed", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    clock = "ProcessingTime" if expire and ttl else "None"
    rows = rows.withColumn("part", F.pmod(F.xxhash64("topic", "doc_id"), F.lit(COUNTERS)).cast("int"))
    return rows.groupBy("part").transformWithState(Attempts(limit, ttl, expire), "topic string, doc_id string, event_id string, attempt int, target string", "Append", clock)


# --- backlog -----------------------------------------------------------------------------------------------------


class Pending(StatefulProcessor):
    """Pending events of a part of a topic, and what each change does to the topic's depth."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pending = handle.getListState("pending", "event_id string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known = {r[0] for r in self.pending.get()}
        before = set(known)
        for us, event, status in gathered(rows, "us", "event_id", "status"):
            if (status == "pending") == (event in known):
                continue  # said again, or resolved before it was pending
            (known.add if status == "pending" else known.remove)(event)
            yield Row(topic=key[0], event_id=event, status=status, us=us, delta=1 if status == "pending" else -1)
        if known != before:
            if known:
                self.pending.put([(event,) for event in known])
            else:
                self.pending.clear()

    def close(self) -> None:
        pass


class Backlog(StatefulProcessor):
    """Depth of a topic; an alert when it reaches a depth from below."""

    def __init__(self, depths: dict[str, int]):
        self.depths = depths

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.depth = handle.getValueState("depth", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        depth = (self.depth.get() or (0,))[0]
        for us, event, _, delta in gathered(rows, "us", "event_id", "status", "delta"):
            depth += delta
            if delta > 0:
                for severity, at in self.depths.items():
                    if depth == at:
                        yield Row(topic=key[0], event_id=event, us=us, depth=depth, severity=severity)
        self.depth.update((depth,))

    def close(self) -> None:
        pass


def backlog_alerts_stream(changes: DataFrame, depths: dict[str, int] | None = None) -> DataFrame:
    """Alerts of a stream of status changes (event_id, topic, status, ts): (topic, event_id, us, depth, severity).

    A topic's depth goes up when an event becomes pending and down when it stops being so; an alert is raised each time a
    depth is reached from below.  Which events are pending is kept in PARTS parts of a topic; only the changes of the depth meet
    in its one counter.  The batch form is operators.bus.backlog_alerts.
    """
    part = F.pmod(F.xxhash64("event_id"), F.lit(PARTS)).cast("int")
    rows = changes.select("topic", part.alias("part"), "event_id", "status", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    changed = rows.groupBy("topic", "part").transformWithState(Pending(), "topic string, event_id string, status string, us long, delta int", "Append", "None")
    return changed.groupBy("topic").transformWithState(Backlog(depths or DEPTHS), "topic string, event_id string, us long, depth long, severity string", "Append", "None")
