"""Reviewer dashboard: metrics, queue, detail, status columns.  `now` is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PROCESSED, PENDING = ("processed", "rejected"), ("ingested", "queued", "preprocessing")


def at(now: str) -> Column:
    return F.lit(now).cast("timestamp")


def metric_total_processed(subs: DataFrame) -> DataFrame:
    return subs.agg(F.count_if(F.col("status").isin(*PROCESSED)).alias("total_processed"))


def metric_pending(subs: DataFrame) -> DataFrame:
    return subs.agg(F.count_if(F.col("status").isin(*PENDING)).alias("pending"))


def critical_saes(subs: DataFrame, assessments: DataFrame, now: str, literal: bool = False) -> DataFrame:
    """Documents with an open review of the last 30 days.

    literal filters the source event by the letters 'sae', which no event name holds; otherwise the submission's type is meant.
    """
    recent = assessments.where(F.col("human_review_required") & (F.col("assessed_at") > at(now) - F.expr("interval 30 days")))
    if literal:
        recent = recent.where(F.col("source_event").contains("sae"))
    else:
        recent = recent.join(subs.where("submission_type = 'sae'").select("doc_id"), "doc_id", "left_semi")
    return recent.agg(F.countDistinct("doc_id").alias("critical_saes"))


def throughput_by_day(subs: DataFrame, now: str, zone: str = "Asia/Kolkata", days: int = 7) -> DataFrame:
    """Submissions of the last days by local calendar date, with the name of the day."""
    local = F.from_utc_timestamp("created_at", zone)
    recent = subs.where(F.col("created_at") > at(now) - F.make_interval(days=F.lit(days)))
    return recent.groupBy(F.to_date(local).alias("day")).agg(F.count("*").alias("n")).select("day", F.date_format("day", "E").alias("day_name"), "n")


def auto_approved(subs: DataFrame, assessments: DataFrame) -> DataFrame:
    """Processed submissions without an assessment that needs a person."""
    return subs.where("status = 'processed'").join(assessments.where("human_review_required").select("doc_id"), "doc_id", "left_anti")


def priority_breakdown(subs: DataFrame, assessments: DataFrame) -> DataFrame:
    """Counts by priority over submissions joined to all their assessments, a row each."""
    joined = subs.select("doc_id").join(assessments.select("doc_id", "decision"), "doc_id", "left")
    return joined.groupBy(display_priority(F.col("decision")).alias("priority")).agg(F.count("*").alias("n"))


def dashboard_metrics(subs: DataFrame, assessments: DataFrame, now: str) -> DataFrame:
    """All scalar metrics in one row, each input scanned once."""
    open_review = assessments.groupBy("doc_id").agg(
        F.bool_or("human_review_required").alias("review"),
        F.bool_or(F.col("human_review_required") & (F.col("assessed_at") > at(now) - F.expr("interval 30 days"))).alias("recent_review"),
    )
    joined = subs.select("doc_id", "status", "submission_type").join(open_review, "doc_id", "left")
    return joined.agg(
        F.count_if(F.col("status").isin(*PROCESSED)).alias("total_processed"),
        F.count_if(F.col("status").isin(*PENDING)).alias("pending"),
        F.count_if((F.col("submission_type") == "sae") & F.coalesce("recent_review", F.lit(False))).alias("critical_saes"),
        F.count_if((F.col("status") == "processed") & ~F.coalesce("review", F.lit(False))).alias("auto_approved"),
    )


def latest_per_doc(rows: DataFrame, ts: str, n: int = 1, key: str = "doc_id", tie: str = "source_event") -> DataFrame:
    """The n newest rows of each key; equal times by `tie` descending."""
    newest = W.partitionBy(key).orderBy(F.desc(ts), F.desc(tie))
    return rows.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= n)


def latest_artefact(rows: DataFrame, ts: str = "assessed_at", key: str = "doc_id", columns: tuple[str, ...] = ("source_event", "decision")) -> DataFrame:
    """Newest row of each key by an aggregate (no sort): the columns of the row with the greatest (ts, columns)."""
    best = rows.groupBy(key).agg(F.max(F.struct(ts, *columns)).alias("b"))
    return best.select(key, f"b.{ts}", *[f"b.{c}" for c in columns])


def display_priority(decision: Column) -> Column:
    return F.when(decision == "blocked", "critical").when(decision == "review_required", "high").when(decision == "pass", "low").otherwise("medium")


def display_status(status: Column, decision: Column) -> Column:
    return F.when(decision == "blocked", "blocked").when(decision == "review_required", "review").otherwise(status)


def status_badge(status: Column, priority: Column) -> Column:
    return F.when((status == "processed") & priority.isin("low", "informational"), "auto-approved").otherwise(status)


def human_age(ts: Column, now: str) -> Column:
    """Age as whole seconds, minutes, hours or days; null: Unknown."""
    s = F.unix_timestamp(at(now)) - F.unix_timestamp(ts)
    part = lambda by, unit: F.concat(F.floor(s / by).cast("string"), F.lit(f" {unit} ago"))
    return F.when(ts.isNull(), "Unknown").when(s < 60, part(1, "secs")).when(s < 3600, part(60, "mins")).when(s < 86400, part(3600, "hrs")).otherwise(part(86400, "days"))


def applicant_label(filename: Column) -> Column:
    """File stem before the first dot, underscores as spaces, each run of letters capitalised, 40 characters."""
    stem = F.replace(F.element_at(F.split(filename, r"\."), 1), F.lit("_"), F.lit(" "))
    words = F.regexp_extract_all(stem, F.lit(r"([A-Za-z]+|[^A-Za-z]+)"), F.lit(1))
    return F.substring(F.array_join(F.transform(words, F.initcap), ""), 1, 40)


def score_band(score: Column) -> Column:
    return F.when(score >= 0.85, "green").when(score >= 0.6, "orange").otherwise("red")


def queue_latest_join(subs: DataFrame, assessments: DataFrame, now: str) -> DataFrame:
    """Submissions with their latest assessment and the columns of the reviewer queue."""
    latest = latest_artefact(assessments)
    joined = subs.select("doc_id", "status", "original_filename", "created_at").join(latest, "doc_id", "left")
    return joined.select(
        "doc_id", "decision", display_status(F.col("status"), F.col("decision")).alias("display_status"), display_priority(F.col("decision")).alias("priority"),
        human_age(F.col("created_at"), now).alias("age"), applicant_label(F.col("original_filename")).alias("applicant"),
    )


def queue_page(subs: DataFrame, page: int = 1, size: int = 20, status: str | None = None) -> DataFrame:
    """One page, newest first with the id as tie-break, and the total count on each row; size from 1 to 100."""
    if not 1 <= size <= 100 or page < 1:
        raise ValueError("size is from 1 to 100 and page from 1")
    chosen = subs if status is None else subs.where(F.col("status") == status)
    total = chosen.agg(F.count("*").alias("total"))
    rows = chosen.orderBy(F.desc("created_at"), "doc_id").offset((page - 1) * size).limit(size)
    return rows.join(F.broadcast(total), F.lit(True))  # one row


def queue_search(rows: DataFrame, term: str, columns: tuple[str, ...] = ("doc_id", "applicant")) -> DataFrame:
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.lower(c).contains(term.lower())
    return rows.where(hit)


def submission_detail(subs: DataFrame, assessments: DataFrame, events: DataFrame) -> DataFrame:
    """Per document the latest decision, its last five assessments and its number of failed events, over the corpus."""
    five = latest_per_doc(assessments, "assessed_at", 5)
    nested = five.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("rank", "source_event", "decision"))).alias("last"))
    failed = events.groupBy("doc_id").agg(F.count_if(F.col("processing_status").isin("failed", "dlq")).alias("n_failed"))
    joined = subs.select("doc_id", "status").join(nested, "doc_id", "left").join(failed, "doc_id", "left")
    return joined.select(
        "doc_id", "status", F.get("last", F.lit(0))["decision"].alias("latest_decision"), F.array_join(F.transform("last", lambda a: F.concat_ws("=", a["source_event"], a["decision"])), ",").alias("history"),
        F.coalesce("n_failed", F.lit(0)).alias("n_failed"),
    )


def compliance_counters(assessments: DataFrame, top: int = 100) -> DataFrame:
    """Counts over the newest `top` assessments."""
    newest = assessments.orderBy(F.desc("assessed_at"), "doc_id", "source_event").limit(top)
    return newest.agg(F.count_if(F.col("blocked")).alias("n_blocked"), F.count_if(F.col("decision") == "review_required").alias("n_review"), F.count_if(F.col("blocked") | F.col("human_review_required")).alias("n_alerts"))


def visible_submissions(subs: DataFrame, user: int, role: str, owner: str = "owner") -> DataFrame:
    """admin sees all, others their own; rows without an owner show to api_client and portal_operator only."""
    if role == "admin":
        return subs
    mine = F.col(owner) == user
    return subs.where(mine | F.col(owner).isNull() if role in ("api_client", "portal_operator") else mine)


def reviewer_action(subs: DataFrame, actions: DataFrame) -> DataFrame:
    """Submissions after the reviewers' actions: approve -> reviewed, reject -> rejected.

    Of several actions on a document the latest by `acted_at` counts; without times the greatest by name.
    """
    order = F.struct("acted_at", "action") if "acted_at" in actions.columns else F.struct("action")
    latest = actions.groupBy("doc_id").agg(F.max(order).alias("a")).select("doc_id", "a.action")
    joined = subs.join(latest, "doc_id", "left")
    return joined.withColumn("status", F.when(F.col("action") == "approve", "reviewed").when(F.col("action") == "reject", "rejected").otherwise(F.col("status"))).drop("action")


def soft_delete(subs: DataFrame, doc_ids: DataFrame, reason: str) -> DataFrame:
    """Named submissions become rejected with a reason; no row goes."""
    named = doc_ids.select("doc_id").distinct().withColumn("_gone", F.lit(True))
    joined = subs.join(named, "doc_id", "left")
    return joined.withColumn("status", F.when(F.col("_gone"), "rejected").otherwise(F.col("status"))).withColumn("reason", F.when(F.col("_gone"), reason)).drop("_gone")
