"""Audit of a request log by two coupled rate limits: per ip, and per user among the requests that their ip let pass.

Rules, at each request in order of (time, id): an ip under a block refuses it, uncounted.  Otherwise the ip's window counts
it, refused or not, and refuses it beyond its limit.  What passes is counted by its user's window in the same way.  Any
refusal of either kind is a violation of the ip; the `most`-th within `window` blocks the ip for `block` seconds.

Neither key can be walked alone: a user's window depends on which ips let requests pass, an ip's block on the users'
refusals.  But only blocks feed back.  So:

1. Counts that ignore blocks are upper bounds of the true ones.  Ips that can't reach `most` violations by them are never
   blocked; their requests are settled by counts over time buckets, in which no key is one task's work.
2. The others, the suspects, are walked in time order, given a guess of which requests their users refused; then the users'
   windows are counted over what passed, which is the next guess.  The rules only look back, so each turn settles
   at least what comes before the next wrong block, and a guess that comes back unchanged is the one consistent answer.

A suspect's walk is a stream through one sorted partition: it holds that ip's last counted requests and violations, and
leaps over the spans of blocks.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dossierlake.functions.scratch import written

PASSED, LIMITED, BLOCKED = 0, 1, 2
#: requests a minute of a role, where they differ from those of other users (fixed value)
ROLE_LIMITS = {"api_client": 30}


def counted(rows: DataFrame, key: str, seconds: int, out: str) -> DataFrame:
    """rows plus `out`: rows of the key in (t - seconds, t] up to and with this one, in the order of us, req_id.

    Time is cut into buckets of that length, and each row also stands in the next one, which holds all that its rows look
    back on.  Equal times count in the order of their ids.
    """
    span = seconds * 1_000_000
    placed = rows.withColumn("_next", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("_bucket", F.floor(F.col("us") / span) + F.col("_next"))
    at = W.partitionBy(key, "_bucket")
    before = F.row_number().over(at.orderBy("us", "req_id"))
    gone = F.count("*").over(at.orderBy("us").rangeBetween(W.unboundedPreceding, -span))
    return placed.withColumn(out, (before - gone).cast("long")).where("_next = 0").drop("_next", "_bucket")


WALKED = "req_id long, ip string, user string, us long, cap int, refused boolean, code int, blocked_until long"


def _walker(limit: int, seconds: int, most: int, window: int, block: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Walks requests sorted by ip, time and id; of each: its code, and until when its ip is blocked by it."""
    second = 1_000_000

    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen, bad, until = None, deque(), deque(), None
        for batch in batches:
            if not batch.num_rows:
                continue
            ips, refused = batch.column("ip").to_pylist(), batch.column("refused").to_pylist()
            times = batch.column("us").to_numpy()
            codes, ends = np.zeros(len(times), dtype=np.int32), [None] * len(times)
            at = 0
            while at < len(times):
                ip, t = ips[at], int(times[at])
                if ip != now:
                    now, seen, bad, until = ip, deque(), deque(), None
                if until is not None and t < until:
                    # leap to the first request that the block does not cover, or that is another ip's
                    to = at
                    while to < len(times) and ips[to] == ip and times[to] < until:
                        to += 1
                    codes[at:to], at = BLOCKED, to
                    continue
                while seen and seen[0] <= t - seconds * second:
                    seen.popleft()
                seen.append(t)
                over = len(seen) > limit
                if len(seen) > limit + 1:
                    seen.popleft()  # the count need not go on beyond the limit
                codes[at] = LIMITED if over else PASSED
                if over or refused[at]:
                    while bad and bad[0] <= t - window * second:
                        bad.popleft()
                    bad.append(t)
                    if len(bad) >= most:
                        until = ends[at] = t + block * second
                        bad.popleft()
                at += 1
            columns = [batch.column(n) for n in ("req_id", "ip", "user", "us", "cap", "refused")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(codes), pa.array(ends, pa.int64())], names=["req_id", "ip", "user", "us", "cap", "refused", "code", "blocked_until"])

    return walk


def rate_block_state(requests: DataFrame, limit: int = 60, user_limit: int = 20, role_limits: dict[str, int] | None = None, seconds: int = 60, most: int = 10, window: int = 3600, block: int = 86_400, allowed: tuple[str, ...] = ()) -> DataFrame:
    """(req_id, outcome, blocked_until) of each request: ok, limited_ip, limited_user or blocked.

    requests: req_id (unique), ip, ts, and, where they are there, user_id and role.  Requests of allowed ips and those
    without a time are ok and not counted; a null ip is one ip, `unknown`; a null or empty user has no limit.
    blocked_until is set on the request that blocks its ip.
    """
    caps = F.lit(user_limit)
    for role, cap in (ROLE_LIMITS if role_limits is None else role_limits).items() if "role" in requests.columns else ():
        caps = F.when(F.col("role") == role, cap).otherwise(caps)
    user = F.nullif(F.col("user_id").cast("string"), F.lit("")) if "user_id" in requests.columns else F.lit(None).cast("string")
    rows = requests.select("req_id", F.coalesce("ip", F.lit("unknown")).alias("ip"), user.alias("user"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), caps.cast("int").alias("cap"))
    free = F.col("us").isNull() | F.col("ip").isin(*allowed) if allowed else F.col("us").isNull()
    skipped = rows.where(free).select("req_id", F.lit("ok").alias("outcome"), F.lit(None).cast("timestamp").alias("blocked_until"))

    # 1: upper bounds; a row without a user keeps its place, since its user's count is not asked for
    bounded = written(counted(rows.where(~free), "ip", seconds, "of_ip"), "limiter-ips")
    named = bounded.where("user is not null")
    over_user = counted(named, "user", seconds, "of_user").where("of_user > cap and of_ip <= " + str(limit))
    maybe = bounded.where(F.col("of_ip") > limit).select("ip", "us", "req_id").unionByName(over_user.select("ip", "us", "req_id"))
    suspects = written(counted(maybe, "ip", window, "n").where(F.col("n") >= most).select("ip").distinct(), "limiter-suspects")

    calm = bounded.join(suspects, "ip", "left_anti").withColumn("code", F.when(F.col("of_ip") > limit, LIMITED).otherwise(PASSED)).drop("of_ip")
    now = written(bounded.join(suspects, "ip", "left_semi").drop("of_ip").withColumn("refused", F.lit(False)), "limiter-walk")

    # 2: the users that suspects' requests name, with their requests elsewhere, and the suspects, to a fixed point
    users = now.where("user is not null").select("user").distinct()
    elsewhere = written(calm.where(F.col("code") == PASSED).join(users, "user", "left_semi").drop("code").withColumn("suspect", F.lit(False)), "limiter-users")
    walk, state = _walker(limit, seconds, most, window, block), None
    while True:
        walked = written(now.repartition("ip").sortWithinPartitions("ip", "us", "req_id").mapInArrow(walk, WALKED), "limiter-walked")
        passed = walked.where((F.col("code") == PASSED) & F.col("user").isNotNull())
        told = counted(passed.withColumn("suspect", F.lit(True)).unionByName(elsewhere, allowMissingColumns=True), "user", seconds, "of_user").where("suspect").withColumn("refused", F.col("of_user") > F.col("cap"))
        rest = walked.where((F.col("code") != PASSED) | F.col("user").isNull()).withColumn("refused", F.lit(False))
        now = written(told.select(walked.columns).unionByName(rest).drop("code", "blocked_until"), "limiter-walk")
        found = now.agg(F.count_if("refused").alias("n"), F.sum(F.when(F.col("refused"), F.xxhash64("req_id").cast("decimal(38,0)"))).alias("h")).first()
        if state == (found["n"], found["h"]) or not found["n"] and state is None:
            break
        state = (found["n"], found["h"])

    settled = walked.select("req_id", "ip", "user", "us", "cap", "code", "blocked_until").unionByName(calm, allowMissingColumns=True)
    passed = (F.col("code") == PASSED) & F.col("user").isNotNull()
    judged = counted(settled.where(passed), "user", seconds, "of_user").unionByName(settled.where(~passed), allowMissingColumns=True)
    return judged.select("req_id", outcome_name(F.col("code"), F.col("of_user") > F.col("cap")).alias("outcome"), F.timestamp_micros("blocked_until").alias("blocked_until")).unionByName(skipped)


def outcome_name(code: Column, refused: Column) -> Column:
    return F.when(code == BLOCKED, "blocked").when(code == LIMITED, "limited_ip").when(refused, "limited_user").otherwise("ok")
