"""Queries over the dashboard operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossierlake.operators import dashboards as d
from dossierlake.plans.fixtures import NOW
from dossierlake.plans.registry import query

TS = f"timestamp '{NOW}'"
PRIORITY = "case decision when 'blocked' then 'critical' when 'review_required' then 'high' when 'pass' then 'low' else 'medium' end"
LATEST = "select doc_id, source_event, decision, assessed_at from assessments qualify row_number() over (partition by doc_id order by assessed_at desc, source_event desc, decision desc) = 1"

query("metric_total_processed", "select count(*) filter (status in ('processed','rejected')) as total_processed from submissions")(lambda t: d.metric_total_processed(t.submissions))
query("metric_pending", "select count(*) filter (status in ('ingested','queued','preprocessing')) as pending from submissions")(lambda t: d.metric_pending(t.submissions))
CRITICAL = f"select count(distinct doc_id) as critical_saes from assessments where human_review_required and assessed_at > {TS} - interval 30 day"
query("metric_critical_saes_literal", CRITICAL + " and source_event like '%sae%'")(lambda t: d.critical_saes(t.submissions, t.assessments, NOW, literal=True))
query("metric_critical_saes_intended", CRITICAL + " and doc_id in (select doc_id from submissions where submission_type = 'sae')")(lambda t: d.critical_saes(t.submissions, t.assessments, NOW))
query(
    "throughput_by_day",
    f"""select cast(created_at + interval 330 minute as date) as day, strftime(cast(created_at + interval 330 minute as date), '%a') as day_name, count(*) as n
    from submissions where created_at > {TS} - interval 7 day group by 1, 2""",
)(lambda t: d.throughput_by_day(t.submissions, NOW))
query("auto_approved", "select doc_id, submission_type from submissions s where status = 'processed' and not exists (select 1 from assessments a where a.doc_id = s.doc_id and a.human_review_required)")(
    lambda t: d.auto_approved(t.submissions, t.assessments).select("doc_id", "submission_type")
)
query("priority_breakdown", f"select {PRIORITY} as priority, count(*) as n from submissions s left join assessments a using (doc_id) group by 1")(lambda t: d.priority_breakdown(t.submissions, t.assessments))
query(
    "dashboard_metrics",
    f"""select (select count(*) from submissions where status in ('processed','rejected')) as total_processed,
    (select count(*) from submissions where status in ('ingested','queued','preprocessing')) as pending,
    (select count(distinct doc_id) from assessments where human_review_required and assessed_at > {TS} - interval 30 day and doc_id in (select doc_id from submissions where submission_type = 'sae')) as critical_saes,
    (select count(*) from submissions s where status = 'processed' and not exists (select 1 from assessments a where a.doc_id = s.doc_id and a.human_review_required)) as auto_approved""",
)(lambda t: d.dashboard_metrics(t.submissions, t.assessments, NOW))
query("latest_per_doc", "select doc_id, source_event, decision, row_number() over (partition by doc_id order by assessed_at desc, source_event desc) as rank from assessments qualify rank <= 2")(
    lambda t: d.latest_per_doc(t.assessments, "assessed_at", 2).select("doc_id", "source_event", "decision", "rank")
)
query("latest_artefact", f"select doc_id, source_event, decision from ({LATEST})")(lambda t: d.latest_artefact(t.assessments).select("doc_id", "source_event", "decision"))
AGE = f"""case when s < 60 then concat(cast(s as varchar), ' secs ago') when s < 3600 then concat(cast(s // 60 as varchar), ' mins ago')
    when s < 86400 then concat(cast(s // 3600 as varchar), ' hrs ago') else concat(cast(s // 86400 as varchar), ' days ago') end"""
SECONDS = f"cast(date_diff('second', created_at, {TS}) as bigint)"
query(
    "queue_latest_join",
    f"""select doc_id, decision, case decision when 'blocked' then 'blocked' when 'review_required' then 'review' else status end as display_status, {PRIORITY} as priority, {AGE} as age,
    concat('File ', cast(doc_num as varchar)) as applicant from (select *, {SECONDS} as s from submissions) left join ({LATEST}) using (doc_id)""",
)(lambda t: d.queue_latest_join(t.submissions, t.assessments, NOW))
query("human_age", f"select doc_id, {AGE} as age from (select *, {SECONDS} as s from submissions)")(lambda t: t.submissions.select("doc_id", d.human_age(F.col("created_at"), NOW).alias("age")))
query("applicant_label", "select doc_id, concat('File ', cast(doc_num as varchar)) as applicant from submissions")(lambda t: t.submissions.select("doc_id", d.applicant_label(F.col("original_filename")).alias("applicant")))
query(
    "display_status_priority",
    f"""select doc_id, source_event, case decision when 'blocked' then 'blocked' when 'review_required' then 'review' else status end as display_status, {PRIORITY} as priority,
    case when status = 'processed' and {PRIORITY} in ('low','informational') then 'auto-approved' else status end as badge from submissions join assessments using (doc_id)""",
)(
    lambda t: t.submissions.select("doc_id", "status")
    .join(t.assessments, "doc_id")
    .select("doc_id", "source_event", d.display_status(F.col("status"), F.col("decision")).alias("display_status"), d.display_priority(F.col("decision")).alias("priority"), d.status_badge(F.col("status"), d.display_priority(F.col("decision"))).alias("badge"))
)
query("score_band", "select event_id, case when value / 100 >= 0.85 then 'green' when value / 100 >= 0.6 then 'orange' else 'red' end as band from events")(
    lambda t: t.events.select("event_id", d.score_band(F.col("value") / 100).alias("band"))
)
query("queue_page", "select doc_id, status, (select count(*) from submissions where status = 'processed') as total from submissions where status = 'processed' order by created_at desc, doc_id limit 20 offset 20")(
    lambda t: d.queue_page(t.submissions, 2, 20, "processed").select("doc_id", "status", "total")
)
query("queue_search", "select doc_id from submissions where contains(lower(doc_id), '07') or contains(lower(concat('File ', cast(doc_num as varchar))), '07')")(
    lambda t: d.queue_search(t.submissions.withColumn("applicant", d.applicant_label(F.col("original_filename"))), "07").select("doc_id")
)
DETAIL = f"""select s.doc_id, s.status, l.decision as latest_decision, h.history, coalesce(f.n, 0) as n_failed from submissions s left join ({LATEST}) l using (doc_id)
    left join (select doc_id, string_agg(concat(source_event, '=', decision), ',' order by assessed_at desc, source_event desc) as history from assessments group by 1) h using (doc_id)
    left join (select doc_id, count(*) filter (processing_status in ('failed','dlq')) as n from event_log group by 1) f using (doc_id)"""
query("submission_detail", DETAIL)(lambda t: d.submission_detail(t.submissions, t.assessments, t.event_log))
query(
    "compliance_counters",
    """select count(*) filter (blocked) as n_blocked, count(*) filter (decision = 'review_required') as n_review, count(*) filter (blocked or human_review_required) as n_alerts
    from (select * from assessments order by assessed_at desc, doc_id, source_event limit 100)""",
)(lambda t: d.compliance_counters(t.assessments))
OWNED = "case when doc_num % 5 = 0 then null else doc_num % 7 end"
query("visible_submissions", f"select doc_id from submissions where {OWNED} = 3 or {OWNED} is null")(
    lambda t: d.visible_submissions(t.submissions.withColumn("owner", F.expr(OWNED)), 3, "api_client").select("doc_id")
)
query(
    "reviewer_action",
    "select doc_id, case when doc_num % 10 = 0 then 'reviewed' when doc_num % 10 = 1 then 'rejected' else status end as status from submissions",
)(
    lambda t: d.reviewer_action(
        t.submissions,
        # an earlier opposite action on each document does not count
        t.submissions.where("doc_num % 10 < 2").select("doc_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("acted_at"), "doc_num")
        .select("doc_id", "acted_at", F.when(F.col("doc_num") % 10 == F.col("acted_at"), "reject").otherwise("approve").alias("action")),
    ).select("doc_id", "status")
)
query("soft_delete", "select doc_id, case when doc_num % 13 = 0 then 'rejected' else status end as status, case when doc_num % 13 = 0 then 'withdrawn' end as reason from submissions")(
    lambda t: d.soft_delete(t.submissions, t.submissions.where("doc_num % 13 = 0"), "withdrawn").select("doc_id", "status", "reason")
)
