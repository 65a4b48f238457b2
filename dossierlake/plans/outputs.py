"""Queries over event payloads, prompts, replies, exact diffs and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossierlake.operators import chunks as c
from dossierlake.operators import dashboards as d
from dossierlake.operators import outputs as o
from dossierlake.operators import summary as s
from dossierlake.operators import anonymise as a
from dossierlake.plans.dashboards import DETAIL
from dossierlake.plans.governance import MATCHES, PRIORITY, SCORED, WITH_S, pairs
from dossierlake.plans.registry import query

query("prompt_rows", "select doc_id, sha256(concat('Summarise this ', submission_type, ' submission.', chr(10), chr(10), substr(text, 1, 40000))) as prompt_hash from submissions")(
    lambda t: o.prompt_rows(t.submissions).select("doc_id", F.sha2("prompt", 256).alias("prompt_hash"))
)


def replies(t):
    n = F.col("doc_num")
    body = F.to_json(F.struct(F.concat(F.lit("S"), n.cast("string")).alias("executive_summary"), F.when(n % 3 == 0, F.array(F.lit("k1"), F.lit(""), F.lit("k2"))).alias("key_findings")))
    return t.submissions.select("doc_id", F.when(n % 5 == 0, "no json").when(n % 2 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body).alias("reply"))


query("parse_model_reply", "select doc_id, concat('S', cast(doc_num as varchar)) as executive_summary, case when doc_num % 3 = 0 then 'k1,k2' else 'No key findings could be extracted.' end as key_findings from submissions where doc_num % 5 <> 0")(
    lambda t: o.parse_model_reply(replies(t))[0].select("doc_id", "executive_summary", F.array_join("key_findings", ",").alias("key_findings"))
)
query("parse_model_reply_errors", "select doc_id from submissions where doc_num % 5 = 0")(lambda t: o.parse_model_reply(replies(t))[1].select("doc_id"))
query("line_diff_exact")(lambda t: o.line_diff_exact(pairs(t)))
query("preprocess_done_events", "select topic, cast(doc_id as varchar) as key from documents, (select unnest(['documents.preprocessed','documents.chunks.ready']) as topic) where trim(text) <> ''")(
    lambda t: o.preprocess_done_events(c.processing_log_rows(t.documents, c.chunk_text(t.documents))).select("topic", "key")
)


def parts(event, *fields: str):
    """An event's payload as columns, so that SQL need not spell JSON."""
    return event.select("topic", "key", *[F.get_json_object("value", f"$.{f}").alias(f) for f in fields])


query(
    "classified_event",
    f"select 'documents.classified' as topic, doc_id as key, doc_id, submission_type, severity, {PRIORITY} as priority, cast(({PRIORITY} in ('critical','high') or coalesce(severity in ('death','life_threatening'), false)) as varchar) as requires_review from ({SCORED})",
)(lambda t: parts(o.classified_event(s.scorecard(t.reg_text)), "doc_id", "submission_type", "severity", "priority", "requires_review"))
query("summarised_event", f"select 'documents.summarised' as topic, doc_id as key, doc_id, submission_type, case when len(s) = 0 then 'No readable document content was available.' else array_to_string(s[1:5], ' ') end as executive_summary from ({WITH_S})")(
    lambda t: parts(o.summarised_event(s.summarise(t.reg_text)), "doc_id", "submission_type", "executive_summary")
)
query("anonymised_event", "select 'documents.anonymised' as topic, doc_id as key, doc_id, submission_type, concat('anonymised/', doc_id, '.txt') as anonymised_path, cast(" + " + ".join(f"len({m})" for m in MATCHES.values()) + " as varchar) as entities_found from reg_text")(
    lambda t: parts(o.anonymised_event(a.anonymise(t.reg_text), F.concat(F.lit("anonymised/"), "doc_id", F.lit(".txt"))), "doc_id", "submission_type", "anonymised_path", "entities_found")
)
query("report_event", "select 'reports.generated' as topic, doc_id as key, doc_id, concat('RPT-', doc_id) as report_id, submission_type as report_type, concat('reports/RPT-', doc_id, '.txt') as report_path from submissions")(
    lambda t: parts(o.report_event(t.submissions, F.col("submission_type"), F.lit("reports")), "doc_id", "report_id", "report_type", "report_path")
)
query("table_json_rows", """select n_regionkey as region, string_agg(concat('{"k":"', cast(n_nationkey as varchar), '","n":"', n_name, '"}'), '|' order by n_nationkey) as rows from nation group by 1""")(
    lambda t: t.nation.groupBy(F.col("n_regionkey").alias("region"))
    .agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("r"))
    .select("region", F.array_join(o.table_json_rows(F.array(F.lit("k"), F.lit("n")), F.transform("r", lambda y: F.array(y["n_nationkey"].cast("string"), y["n_name"]))), "|").alias("rows"))
)
query(
    "report_lines",
    f"""select doc_id, array_to_string(['SUBMISSION REPORT', 'Document: ' || doc_id, 'Status: ' || coalesce(status, '-'), 'Decision: ' || coalesce(latest_decision, '-'), 'History: ' || coalesce(history, '-'), 'Failures: ' || coalesce(n_failed::varchar, '-')], chr(10)) as report
    from ({DETAIL})""",
)(lambda t: o.report_lines(d.submission_detail(t.submissions, t.assessments, t.event_log)).select("doc_id", F.array_join("lines", "\n").alias("report")))
