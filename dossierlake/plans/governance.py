"""Queries over anonymisation, rules, summaries, classification and comparison; the flagship chain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossierlake.operators import anonymise as a
from dossierlake.operators import rules as r
from dossierlake.operators import summary as s
from dossierlake.plans.fixtures import Tables
from dossierlake.plans.registry import query


def q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def duck_list(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]::varchar[]"


def duck_by_type(table: dict) -> str:
    return "case submission_type " + " ".join(f"when {q(k)} then {duck_list(v)}" for k, v in table.items()) + " end"


def joined(c: str) -> F.Column:
    return F.array_join(c, " | ")


def duck_pattern(kind: str) -> str:
    return q(next(p for k, p, _ in a.PATTERNS if k == kind))


MATCHES = {k: f"regexp_extract_all(text, {duck_pattern(k)})" for k, _, _ in a.PATTERNS}
query("pii_detect", "select * from (" + " union all ".join(f"select doc_id, '{k}' as kind, len({m}) as n, array_to_string({m}, '|') as originals from reg_text" for k, m in MATCHES.items()) + ") where n > 0")(
    lambda t: t.reg_text.select("doc_id", a.pii_detect(F.col("text")).alias("e"))
    .select("doc_id", F.explode_outer("e").alias("e"))
    .where("e is not null")
    .groupBy("doc_id", "e.kind")
    .agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("e.start", "e.original"))), lambda x: x["original"]), "|").alias("originals"))
)


def duck_spans(kind: str, confidence: float) -> str:
    """Matches of one pattern and where they start: gaps and matches before them."""
    p = duck_pattern(kind)
    length = "coalesce(list_sum(list_transform({}, lambda z: length(z))), 0)"
    return f"""select doc_id, '{kind}' as kind, {confidence} as confidence, m[i] as original, {length.format("g[1:i]")} + {length.format("m[1:i-1]")} as s
        from (select doc_id, m, g, unnest(range(1, len(m) + 1)) as i from (select doc_id, regexp_extract_all(text, {p}) as m, string_split_regex(text, {p}) as g from reg_text))"""


FOUND = f"""select doc_id, list(struct_pack(kind := kind, confidence := confidence, original := original, s := cast(s as int), e := cast(s + length(original) as int))
    order by s, -length(original), -confidence, kind) as found from ({" union all ".join(duck_spans(k, c) for k, _, c in a.PATTERNS)}) group by 1"""
KEPT = f"""select r.doc_id, text, submission_type, lang, coalesce(list_transform(list_reduce(list_transform(found, lambda x, i: struct_pack(until := x.e, s := x.s, kept := [i])),
    lambda a, x: case when x.s >= a.until then struct_pack(until := x.until, s := a.s, kept := list_concat(a.kept, x.kept)) else a end).kept, lambda k: found[k]), []) as e
    from reg_text r left join ({FOUND}) f on f.doc_id = r.doc_id"""
KEYED = f"select *, list_transform(e, lambda x: concat(x.kind, ':', lower(x.original))) as keys from ({KEPT})"
NAMED = f"""select *, list_transform(e, lambda x, i: concat('<', x.kind, '_', len(list_filter(range(1, list_position(keys, keys[i]) + 1), lambda j: list_position(keys, keys[j]) = j)), '_',
    upper(substr(sha256(concat(doc_id, ':', keys[i])), 1, 6)), '>')) as p from ({KEYED})"""
ANONYMISED = f"""select *, cast(len(e) as int) as n_entities, case when len(e) = 0 then 0.99 else round(list_avg(list_transform(e, lambda x: x.confidence)), 3) end as confidence,
    case when len(e) = 0 then text else concat(array_to_string(list_transform(e, lambda x, i: concat(substr(text, coalesce(e[i-1].e, 0) + 1, x.s - coalesce(e[i-1].e, 0)), p[i])), ''), substr(text, e[-1].e + 1)) end as anonymised_text from ({NAMED})"""
SPAN_ROWS = f'select doc_id, x.kind as kind, x.s as "start", x.e as "end", x.original as original from (select doc_id, unnest(e) as x from ({KEPT}))'
query("pii_spans", SPAN_ROWS)(lambda t: a.entity_rows(a.anonymise(t.reg_text)))
query("pii_overlap", f"select doc_id, cast(len(e) as int) as kept, cast(len(found) as int) as found from ({KEPT}) join ({FOUND}) using (doc_id)")(
    lambda t: t.reg_text.select("doc_id", a.pii_detect(F.col("text")).alias("e")).select("doc_id", F.size(a.pii_overlap(F.col("e"))).alias("kept"), F.size("e").alias("found")).where("found > 0")
)
query("anonymise_text", f"select doc_id, anonymised_text, n_entities, confidence from ({ANONYMISED})")(lambda t: a.anonymise(t.reg_text).select("doc_id", "anonymised_text", "n_entities", "confidence"))
query("anonymise_summary", f"select doc_id, n_entities, confidence, cast(len(list_distinct(keys)) as int) as n_values from ({ANONYMISED})")(
    lambda t: a.anonymise(t.reg_text).select("doc_id", "n_entities", "confidence", F.size(F.array_distinct("pseudonyms")).alias("n_values"))
)
query("pseudonymise", f"select doc_id, array_to_string(p, ',') as pseudonyms from ({NAMED})")(lambda t: a.anonymise(t.reg_text).select("doc_id", F.array_join("pseudonyms", ",").alias("pseudonyms")))
query(
    "entity_stats",
    "select kind, cast(sum(n) as bigint) as n from (" + " union all ".join(f"select '{k}' as kind, len({m}) as n from reg_text" for k, m in MATCHES.items()) + ") group by 1 having sum(n) > 0",
)(lambda t: a.entity_stats(a.anonymise(t.reg_text)))
query("pii_leak_scan", "select doc_id, " + " + ".join(f"len({m})" for m in MATCHES.values()) + " as n_leaks from reg_text")(lambda t: t.reg_text.select("doc_id", F.size(a.pii_leak_scan(F.col("text"))).alias("n_leaks")))

SENTENCES = r"list_filter(list_transform(string_split(regexp_replace(trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g')), '([.!?]) ', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: length(x) > 20)"
WITH_S = f"select *, {SENTENCES} as s from reg_text"
query("sentences", f"select doc_id, len(s) as n, array_to_string(s, ' | ') as sentences from ({WITH_S})")(
    lambda t: t.reg_text.select("doc_id", s.sentences(F.col("text")).alias("s")).select("doc_id", F.size("s").alias("n"), joined("s").alias("sentences"))
)
query("exec_summary", f"select doc_id, case when len(s) = 0 then 'No readable document content was available.' else array_to_string(s[1:5], ' ') end as executive_summary from ({WITH_S})")(
    lambda t: s.summarise(t.reg_text).select("doc_id", "executive_summary")
)
query(
    "key_findings",
    f"""select doc_id, array_to_string(case when len(h) > 0 then h[1:5] when len(s) > 0 then s[1:3] else ['No key findings could be extracted.'] end, ' | ') as key_findings
    from (select *, list_filter(s, lambda x: len(list_filter(k, lambda w: contains(lower(x), w))) > 0) as h from (select *, {duck_by_type(s.KEYWORDS)} as k from ({WITH_S})))""",
)(lambda t: s.summarise(t.reg_text).select("doc_id", joined("key_findings").alias("key_findings")))
RISKS = f"""case when len(list_filter({duck_list(s.RISK_TERMS)}, lambda w: contains(lower(text), w))) > 0
    then list_transform(list_filter({duck_list(s.RISK_TERMS)}, lambda w: contains(lower(text), w)), lambda w: concat('Potential regulatory risk detected: ', w))
    when submission_type = 'sae' then ['SAE submission requires reviewer validation even when no critical keyword is present.'] else ['No explicit high-risk signal detected in the extracted text.'] end"""


def absent(table: dict) -> str:
    return f"list_filter({duck_by_type(table)}, lambda f: not contains(lower(text), replace(f, '_', ' ')))"


query("risk_terms", f"select doc_id, array_to_string({RISKS}, ' | ') as risks from reg_text")(lambda t: t.reg_text.select("doc_id", joined(s.risk_terms(F.col("text"), F.col("submission_type"))).alias("risks")))
query("missing_info", f"select doc_id, array_to_string({absent(s.SUMMARY_FIELDS)}, ',') as missing from reg_text")(
    lambda t: t.reg_text.select("doc_id", F.array_join(s.missing_fields(F.col("text"), F.col("submission_type"), s.SUMMARY_FIELDS), ",").alias("missing"))
)
query(
    "next_steps",
    f"""select doc_id, case when len(x) = 0 then 'Proceed to standard reviewer queue.' else array_to_string(x, ' | ') end as next_steps from (select doc_id, list_filter([
    case when len({absent(s.SUMMARY_FIELDS)}) > 0 then 'Request applicant clarification for missing mandatory fields.' end, case when not contains(({RISKS})[1], 'No explicit') then 'Route to CDSCO reviewer for priority assessment.' end,
    case when submission_type = 'sae' then 'Verify SAE seriousness, causality, and mandatory reporting timeline.' end], lambda y: y is not null) as x from reg_text)""",
)(lambda t: s.summarise(t.reg_text).select("doc_id", joined("next_steps").alias("next_steps")))
query(
    "summary_confidence",
    f"""select doc_id, case when trim(text) = '' then 0.2 else round(greatest(0.3, least(0.95, 0.72 + least(len(case when len(h) > 0 then h[1:5] when len(s) > 0 then s[1:3] else ['none'] end), 5) * 0.04 - len({absent(s.SUMMARY_FIELDS)}) * 0.03)), 3) end as summary_confidence,
    cast(len(list_filter(string_split_regex(case when len(s) = 0 then 'No readable document content was available.' else array_to_string(s[1:5], ' ') end, '\\s+'), lambda x: x <> '')) as int) as word_count
    from (select *, list_filter(s, lambda x: len(list_filter(k, lambda w: contains(lower(x), w))) > 0) as h from (select *, {duck_by_type(s.KEYWORDS)} as k from ({WITH_S})))""",
)(lambda t: s.summarise(t.reg_text).select("doc_id", "summary_confidence", "word_count"))
query("completeness", f"select doc_id, array_to_string({absent(s.REQUIRED_FIELDS)}, ',') as missing, (4 - len({absent(s.REQUIRED_FIELDS)})) / 4 as completeness from reg_text")(
    lambda t: s.scorecard(t.reg_text).select("doc_id", F.array_join("missing", ",").alias("missing"), "completeness")
)


def severity_sql(value: int) -> str:
    cases = " ".join("when " + " or ".join(f"contains(lower(text), {q(w)})" for w in x[2]) + f" then {q(x[0]) if value == 0 else x[1]}" for x in s.SEVERITIES)
    return f"case {cases} else {q('other') if value == 0 else 0.45} end"


query("sae_severity", f"select doc_id, {severity_sql(0)} as severity, cast({severity_sql(1)} as double) as score from reg_text")(lambda t: t.reg_text.select("doc_id", s.sae_severity(F.col("text")).alias("x")).select("doc_id", "x.severity", "x.score"))
SCORED = f"""select *, case when submission_type = 'sae' then {severity_sql(0)} end as severity, (4 - len({absent(s.REQUIRED_FIELDS)})) / 4 as completeness,
    greatest(1 - (4 - len({absent(s.REQUIRED_FIELDS)})) / 4, case when submission_type = 'sae' then cast({severity_sql(1)} as double) else 0.0 end) as risk from reg_text"""
PRIORITY = "case when risk >= 0.85 then 'critical' when risk >= 0.65 then 'high' when risk >= 0.4 then 'medium' when risk >= 0.2 then 'low' else 'informational' end"
query("risk_priority", f"select doc_id, risk as risk_score, {PRIORITY} as priority, ({PRIORITY} in ('critical','high') or coalesce(severity in ('death','life_threatening'), false)) as requires_review from ({SCORED})")(
    lambda t: s.scorecard(t.reg_text).select("doc_id", "risk_score", "priority", "requires_review")
)
query("category_label", "select doc_id, case submission_type " + " ".join(f"when {q(k)} then {q(v)}" for k, v in s.CATEGORIES.items()) + " end as category from submissions")(
    lambda t: t.submissions.select("doc_id", s.category_label(F.col("submission_type")).alias("category"))
)
query("scorecard", f"select doc_id, completeness, severity, risk as risk_score, {PRIORITY} as priority, case when completeness >= 0.75 then 0.86 else 0.72 end as class_confidence from ({SCORED})")(
    lambda t: s.scorecard(t.reg_text).select("doc_id", "completeness", "severity", "risk_score", "priority", "class_confidence")
)
query("priority_alerts", f"select doc_id, case when p = 'critical' then 'CRITICAL' else 'WARNING' end as severity, case when p = 'critical' and submission_type = 'sae' then 'sae_critical' else 'review_required' end as kind from (select *, {PRIORITY} as p from (select doc_id, submission_type, risk from ({SCORED}))) where p in ('critical','high')")(
    lambda t: s.priority_alerts(s.scorecard(t.reg_text))
)

# --- rules ---------------------------------------------------------------------------------------------------------


def rule_events(t: Tables) -> DataFrame:
    """One event of each topic for each submission, some with gaps, as the rules see them."""
    base = t.reg_text.select(F.when(F.col("doc_num") % 17 != 0, F.col("doc_id")).alias("doc_id"), F.when(F.col("doc_num") % 11 != 0, F.col("submission_type")).alias("submission_type"), "doc_num", "text")
    kinds = F.array(*[F.lit(x) for x in ("documents.anonymised", "documents.summarised", "documents.classified", "reports.generated")])
    rows = base.withColumn("topic", F.explode(kinds))
    n = F.col("doc_num")
    return rows.select(
        "*", a.pii_leak_scan(F.when((F.col("topic") == "documents.anonymised") & (n % 2 == 0), F.col("text")).otherwise("")).alias("leaks"), F.lit(0).alias("n_entities"), F.when(n % 3 != 0, F.lit("p")).alias("path"),
        F.substring("text", -60, 60).alias("summary"), F.when(n % 5 == 0, "death").otherwise("other").alias("severity"), F.when(n % 4 == 0, "high").otherwise("low").alias("priority"), (n % 10 == 0).alias("requires_review"),
        F.when(n % 2 == 0, "comparison").otherwise("summary").alias("report_type"), F.concat(F.lit("R"), n.cast("string")).alias("report_id"),
    )


LEAKS = "case when doc_num % 2 = 0 then " + " + ".join(f"len({m})" for m in MATCHES.values()) + " else 0 end"
EVENTS = f"""select doc_num, case when doc_num % 17 <> 0 then doc_id end as doc_id, topic, case when doc_num % 17 = 0 then 1 else 0 end as c, case when doc_num % 11 = 0 then 1 else 0 end as w0,
    case topic when 'documents.anonymised' then {LEAKS} when 'documents.summarised' then case when contains(right(text, 60), 'Aadhaar') or contains(right(text, 60), 'PAN') or contains(right(text, 60), '@') then 1 else 0 end else 0 end as dp,
    case topic when 'documents.classified' then case when doc_num % 5 = 0 and doc_num % 10 <> 0 then 1 else 0 end when 'reports.generated' then case when doc_num % 2 = 0 and doc_num % 3 = 0 then 1 else 0 end else 0 end as oc,
    case topic when 'documents.anonymised' then case when length(text) > 500 then 1 else 0 end + case when doc_num % 3 = 0 then 1 else 0 end when 'documents.classified' then case when doc_num % 4 = 0 and doc_num % 10 <> 0 then 1 else 0 end else 0 end as w
    from reg_text, (select unnest(['documents.anonymised','documents.summarised','documents.classified','reports.generated']) as topic)"""
ASSESSED = f"select *, c + w0 + dp + oc + w as n, dp > 0 as blocked, c + w0 + dp + oc + w > 0 as review from ({EVENTS})"
query("assess", f"select doc_num, topic, n as n_findings, case when blocked then 'blocked' when review then 'review_required' else 'pass' end as decision, review as human_review_required, blocked, case when n > 0 then 0.98 else 0.93 end as confidence from ({ASSESSED})")(
    lambda t: r.assess(rule_events(t)).select("doc_num", "topic", F.size("findings").alias("n_findings"), "decision", "human_review_required", "blocked", "confidence")
)
query("decision", f"select topic, case when blocked then 'blocked' when review then 'review_required' else 'pass' end as decision, count(*) as n from ({ASSESSED}) group by 1, 2")(lambda t: r.assess(rule_events(t)).groupBy("topic", "decision").agg(F.count("*").alias("n")))
query("finding_stats", f"select doc_id, cast(sum(n) as bigint) as n_findings, bool_or(blocked) as any_blocked, bool_or(review) as any_review from ({ASSESSED}) group by 1")(lambda t: r.finding_stats(r.assess(rule_events(t))))
#: findings of an event in the order in which the rules give them
TOLD = """list_concat(case when c = 1 then ['NDHM-DOC-ID-MISSING=critical'] else [] end, case when w0 = 1 then ['NDHM-SUBMISSION-TYPE-MISSING=warning'] else [] end, case topic
    when 'documents.anonymised' then list_concat(list_transform(range(dp), lambda i: 'DPDP-PII-LEAK=critical'), case when w > (doc_num % 3 = 0)::int then ['DPDP-AUDIT-ENTITY-MAP=warning'] else [] end, case when doc_num % 3 = 0 then ['DPDP-LINEAGE-MISSING=warning'] else [] end)
    when 'documents.summarised' then case when dp = 1 then ['DPDP-SUMMARY-IDENTIFIER=critical'] else [] end
    when 'documents.classified' then list_concat(case when oc = 1 then ['ICMR-SAE-MANDATORY-REVIEW=critical'] else [] end, case when w = 1 then ['ICMR-HIGH-RISK-REVIEW=warning'] else [] end)
    else case when oc = 1 then ['GOV-REPORT-LINEAGE=critical'] else [] end end)[1:10]"""
query(
    "compliance_notifications",
    f"""select doc_id, topic, case when blocked then 'CRITICAL' else 'WARNING' end as severity, array_to_string(list_filter(told, lambda x, i: list_position(told, x) = i), ',') as rules from (select *, {TOLD} as told from ({ASSESSED})) where review""",
)(lambda t: r.compliance_notifications(r.assess(rule_events(t))))
for name, topic in (("rule_dpdp_anonymised", "documents.anonymised"), ("rule_dpdp_summary", "documents.summarised"), ("rule_icmr", "documents.classified"), ("rule_report_lineage", "reports.generated")):
    query(name, f"select doc_num, dp + oc + w as n_findings, dp + oc as n_critical from ({EVENTS}) where topic = '{topic}'")(
        lambda t, topic=topic: r.assess(rule_events(t).where(F.col("topic") == topic))
        .select("doc_num", F.filter("findings", lambda f: ~f["rule_id"].startswith("NDHM")).alias("f"))
        .select("doc_num", F.size("f").alias("n_findings"), F.size(F.filter("f", lambda x: x["severity"] == "critical")).alias("n_critical"))
    )
query("rule_ndhm", f"select doc_num, c + w0 as n_findings from ({EVENTS}) where topic = 'reports.generated'")(
    lambda t: r.assess(rule_events(t).where("topic = 'reports.generated'")).select("doc_num", F.size(F.filter("findings", lambda f: f["rule_id"].startswith("NDHM"))).alias("n_findings"))
)
query(
    "xai_records",
    """select doc_id, topic, m as module, concat(m, ' decision for ', doc_id) as summary from (select *, case when contains(topic, 'anonymised') then 'anonymisation' when contains(topic, 'summarised') then 'summarisation'
    when contains(topic, 'classified') then 'classification' else 'reporting' end as m from event_log)""",
)(lambda t: r.xai_records(t.event_log.withColumns({"model_id": F.lit(None).cast("string"), "confidence": F.lit(None).cast("double")})).select("doc_id", "topic", "module", "summary"))

# --- comparison ----------------------------------------------------------------------------------------------------


def pairs(t: Tables) -> DataFrame:
    """Each document and the one twenty further, which has the same source."""
    return s.version_pairs(t.submissions.select(F.col("doc_num").alias("doc_id"), "text"), t.submissions.select(F.col("doc_num").alias("pair_id"), F.col("doc_num").alias("doc_a"), (F.col("doc_num") + 20).alias("doc_b")))


BAG = """select pair_id, line, cast(sum(s) as bigint) as change from (
    select doc_num as pair_id, trim(unnest(string_split(text, chr(10)))) as line, -1 as s from submissions where doc_num + 20 in (select doc_num from submissions)
    union all select doc_num - 20, trim(unnest(string_split(text, chr(10)))), 1 from submissions where doc_num - 20 in (select doc_num from submissions)) where line <> '' group by 1, 2 having sum(s) <> 0"""
query("version_pairs", "select a.doc_num as pair_id, length(a.text) as n_a, length(b.text) as n_b from submissions a join submissions b on b.doc_num = a.doc_num + 20")(
    lambda t: pairs(t).select("pair_id", F.length("text_a").alias("n_a"), F.length("text_b").alias("n_b"))
)
query("line_diff_bag", BAG)(lambda t: s.line_diff_bag(pairs(t)))
query(
    "changed_sections",
    f"select doc_id, case when len(x) = 0 then 'general_content' else array_to_string(x, ',') end as sections from (select doc_id, list_filter({duck_list(('outcome', *s.ASPECTS))}, lambda w: contains(lower(text), w)) as x from reg_text)",
)(lambda t: t.reg_text.select("doc_id", F.array_join(s.changed_sections(F.col("text"), ("outcome",)), ",").alias("sections")))
NOTES = "[" + ", ".join(f"case when contains(lower(text), {q(w)}) then {q(n)} end" for w, n in s.SIGNIFICANCE) + "]"
query("significance_notes", f"select doc_id, case when len(x) = 0 then 'No specific high-impact regulatory term was detected in the diff.' else array_to_string(x, ' | ') end as notes from (select doc_id, list_filter({NOTES}, lambda y: y is not null) as x from reg_text)")(
    lambda t: t.reg_text.select("doc_id", joined(s.significance_notes(F.col("text"))).alias("notes"))
)
query(
    "comparison_report",
    f"""select pair_id, added, removed, confidence, concat('# Comparison', chr(10), 'Additions: ', cast(added as varchar), chr(10), 'Deletions: ', cast(removed as varchar), chr(10), '## Diff', chr(10), text, chr(10), '## Significance', chr(10),
    case when len(x) = 0 then 'No specific high-impact regulatory term was detected in the diff.' else array_to_string(x, chr(10)) end) as report from (select *, list_filter({NOTES}, lambda y: y is not null) as x from (
    select pair_id, cast(sum(greatest(change, 0)) as bigint) as added, cast(sum(greatest(-change, 0)) as bigint) as removed, case when sum(abs(change)) <= 3 then 0.75 else 0.9 end as confidence,
    string_agg(concat(case when change > 0 then '+ ' else '- ' end, line), chr(10) order by line) as text from ({BAG}) group by 1))""",
)(lambda t: s.comparison_report(s.line_diff_bag(pairs(t))).select("pair_id", "added", "removed", "confidence", "report"))


def governance(t: Tables) -> DataFrame:
    """Anonymise, scan the result for leaks, apply the rules, decide, and count: one narrow pass and one aggregation."""
    done = a.anonymise(t.reg_text)
    events = done.select("doc_id", "submission_type", "lang", F.lit("documents.anonymised").alias("topic"), a.pii_leak_scan(F.col("anonymised_text")).alias("leaks"), "n_entities", F.col("anonymised_text").alias("text"), F.lit("p").alias("path"))
    found = events.withColumn("findings", F.concat(r.rule_ndhm(F.col("doc_id"), F.col("submission_type")), r.rule_dpdp_anonymised(F.col("leaks"), F.col("n_entities"), F.col("text"), F.col("path"), F.col("doc_id"))))
    return found.withColumn("d", r.decision(F.col("findings"))).groupBy("submission_type", "lang", "d.decision").agg(F.count("*").alias("n"))


LEFT = " + ".join(f"len(regexp_extract_all(anonymised_text, {duck_pattern(k)}))" for k, _, _ in a.PATTERNS)
query(
    "entry_governance",
    f"""select submission_type, lang, case when leaks > 0 then 'blocked' when n_entities = 0 and length(anonymised_text) > 500 then 'review_required' else 'pass' end as decision, count(*) as n
    from (select *, {LEFT} as leaks from ({ANONYMISED})) group by 1, 2, 3""",
)(governance)
