"""Compliance rules as arrays of findings, the decision they lead to, and explanation records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossierlake.operators.anonymise import FINDING

#: rule, framework, severity, message (fixed values)
RULES = {
    "doc_id": ("NDHM-DOC-ID-MISSING", "NDHM Health Data Standards", "critical", "AI output is missing the canonical document identifier."),
    "type": ("NDHM-SUBMISSION-TYPE-MISSING", "NDHM Health Data Standards", "warning", "AI output is missing submission type metadata."),
    "map": ("DPDP-AUDIT-ENTITY-MAP", "DPDP Act 2023", "warning", "No anonymisation entity map was stored for a non-trivial document."),
    "lineage": ("DPDP-LINEAGE-MISSING", "DPDP Act 2023", "warning", "Anonymised artefact is missing source lineage to the processed document."),
    "summary": ("DPDP-SUMMARY-IDENTIFIER", "DPDP Act 2023", "critical", "Summary appears to contain direct personal identifiers."),
    "sae": ("ICMR-SAE-MANDATORY-REVIEW", "ICMR/Clinical Trial Governance", "critical", "Death/life-threatening SAE must always be routed for human review."),
    "high": ("ICMR-HIGH-RISK-REVIEW", "ICMR/Clinical Trial Governance", "warning", "High-priority AI classification should require reviewer validation."),
    "report": ("GOV-REPORT-LINEAGE", "XAI", "critical", "Generated report is missing storage lineage."),
}
MARKERS = ("Aadhaar", "PAN", "@")


def _blank(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def finding(rule: str, condition: Column, evidence: Column | None = None) -> Column:
    """The finding of a rule where its condition holds, else null."""
    names = ("rule_id", "framework", "severity", "message")
    return F.when(condition, F.struct(*[F.lit(v).alias(n) for n, v in zip(names, RULES[rule], strict=True)], (F.lit("") if evidence is None else evidence).alias("evidence")))


def findings(*parts: Column) -> Column:
    return F.array_compact(F.array(*parts)).cast(f"array<{FINDING}>")


def rule_ndhm(doc_id: Column, submission_type: Column) -> Column:
    return findings(finding("doc_id", _blank(doc_id)), finding("type", _blank(submission_type), F.coalesce(doc_id, F.lit(""))))


def rule_dpdp_anonymised(leaks: Column, n_entities: Column, text: Column, path: Column, doc_id: Column) -> Column:
    return F.concat(leaks, findings(finding("map", (F.coalesce(n_entities, F.lit(0)) == 0) & (F.length(text) > 500), doc_id), finding("lineage", _blank(path))))


def rule_dpdp_summary(text: Column) -> Column:
    hit = F.lit(False)
    for m in MARKERS:
        hit = hit | F.contains(text, F.lit(m))
    return findings(finding("summary", hit, F.substring(text, 1, 120)))


def rule_icmr(severity: Column, priority: Column, requires_review: Column) -> Column:
    open_ = ~F.coalesce(requires_review, F.lit(False))
    return findings(finding("sae", severity.isin("death", "life_threatening") & open_, severity), finding("high", priority.isin("critical", "high") & open_, priority))


def rule_report_lineage(report_type: Column, path: Column, report_id: Column) -> Column:
    return findings(finding("report", report_type.isin("comparison", "compliance_check") & _blank(path), report_id))


def decision(found: Column) -> Column:
    """struct<decision, human_review_required, blocked, confidence>: blocked by a critical data-protection finding,
    reviewed for any critical or warning one."""
    blocked = F.exists(found, lambda f: (f["severity"] == "critical") & f["rule_id"].startswith("DPDP"))
    review = F.exists(found, lambda f: f["severity"].isin("critical", "warning"))
    return F.struct(
        F.when(blocked, "blocked").when(review, "review_required").otherwise("pass").alias("decision"), (blocked | review).alias("human_review_required"), blocked.alias("blocked"),
        F.when(F.size(found) > 0, 0.98).otherwise(0.93).alias("confidence"),
    )


def assess(events: DataFrame) -> DataFrame:
    """events plus findings and the decision, the rule set chosen by topic in one pass.

    Reads topic, doc_id, submission_type, leaks, n_entities, text, path, summary, severity, priority, requires_review,
    report_type and report_id; those that a topic does not need may be null.
    """
    own = (
        F.when(F.col("topic") == "documents.anonymised", rule_dpdp_anonymised(F.col("leaks"), F.col("n_entities"), F.col("text"), F.col("path"), F.col("doc_id")))
        .when(F.col("topic") == "documents.summarised", rule_dpdp_summary(F.coalesce("summary", F.lit(""))))
        .when(F.col("topic") == "documents.classified", rule_icmr(F.col("severity"), F.col("priority"), F.col("requires_review")))
        .when(F.col("topic") == "reports.generated", rule_report_lineage(F.col("report_type"), F.col("path"), F.col("report_id")))
        .otherwise(F.array().cast(f"array<{FINDING}>"))
    )
    found = events.withColumn("findings", F.concat(rule_ndhm(F.col("doc_id"), F.col("submission_type")), own))
    return found.withColumn("d", decision(F.col("findings"))).select("*", "d.*").drop("d")


def compliance_notifications(assessed: DataFrame) -> DataFrame:
    """A notification for each blocked or reviewed decision, with the first ten findings as rule -> severity."""
    pairs = F.transform(F.slice("findings", 1, 10), lambda f: F.concat_ws("=", f["rule_id"], f["severity"]))
    told = F.struct("doc_id", "topic", F.when(F.col("blocked"), "CRITICAL").otherwise("WARNING").alias("severity"), F.array_join(F.array_distinct(pairs), ",").alias("rules"))
    # unnested, so that the filter is not put before the rules and runs them again
    return assessed.select(F.explode(F.array(F.struct("human_review_required", told.alias("told")))).alias("n")).where("n.human_review_required").select("n.told.*")


def finding_stats(assessed: DataFrame) -> DataFrame:
    """Per document: findings, and whether any decision blocked or asked for review."""
    return assessed.groupBy("doc_id").agg(F.sum(F.size("findings")).alias("n_findings"), F.bool_or("blocked").alias("any_blocked"), F.bool_or("human_review_required").alias("any_review"))


def xai_records(events: DataFrame) -> DataFrame:
    """Explanation rows: module by topic, model and confidence with defaults, a one-line summary."""
    module = F.when(F.col("topic").contains("anonymised"), "anonymisation").when(F.col("topic").contains("summarised"), "summarisation").when(F.col("topic").contains("classified"), "classification").otherwise("reporting")
    named = events.withColumn("module", module)
    return named.select("doc_id", "topic", "module", F.coalesce("model_id", F.lit("unknown")).alias("model_id"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.format_string("%s decision for %s", "module", F.coalesce("doc_id", F.lit(""))).alias("summary"))
