"""Extractive summaries, completeness, severity, risk and version comparison, as columns over a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossierlake.functions.hooks import hook
from dossierlake.functions.spans import let

#: keywords, required fields and notes (fixed values)
KEYWORDS = {
    "drug": ("indication", "dosage", "contraindication", "stability", "manufacturing", "safety"),
    "medical_device": ("device", "risk", "sterile", "performance", "clinical", "manufacturing"),
    "clinical_trial": ("phase", "endpoint", "protocol", "eligibility", "adverse", "efficacy"),
    "sae": ("death", "life-threatening", "hospital", "serious", "causality", "adverse"),
}
SUMMARY_FIELDS = {
    "drug": ("applicant_name", "drug_name", "indication"),
    "medical_device": ("device_name", "risk_class", "manufacturer"),
    "clinical_trial": ("protocol_number", "phase", "sponsor"),
    "sae": ("patient_id", "event_date", "outcome"),
}
REQUIRED_FIELDS = {
    "drug": ("applicant_name", "drug_name", "indication", "dosage_form"),
    "medical_device": ("device_name", "risk_class", "manufacturer", "intended_use"),
    "clinical_trial": ("protocol_number", "phase", "sponsor", "primary_endpoint"),
    "sae": ("patient_id", "event_date", "outcome", "causality"),
}
RISK_TERMS = ("death", "life-threatening", "contraindication", "serious adverse", "missing", "deviation")
SEVERITIES = [
    ("death", 0.98, ("death", "fatal", "expired")),
    ("life_threatening", 0.92, ("life-threatening", "life threatening", "icu", "ventilator")),
    ("hospitalisation", 0.76, ("hospitalisation", "hospitalization", "admitted")),
    ("disability", 0.72, ("disability", "congenital anomaly")),
]
CATEGORIES = {
    "drug": "Drug regulatory submission",
    "medical_device": "Medical device regulatory submission",
    "clinical_trial": "Clinical trial submission",
    "sae": "Serious adverse event report",
}
SIGNIFICANCE = [
    ("contraindication", "Contraindication section modified — reviewer must assess patient safety impact."),
    ("adverse", "Adverse event data changed — requires pharmacovigilance review."),
    ("dosage", "Dosage information changed — verify against approved Schedule Y data."),
    ("indication", "Indication modified — may require new clinical evidence assessment."),
    ("death", "Death-related content changed — immediate reviewer escalation required."),
    ("stability", "Stability data changed — manufacturing quality review required."),
    ("manufacturing", "Manufacturing information updated — GMP compliance check needed."),
    ("contraindication", "Safety labelling change detected."),
]
ASPECTS = ("safety", "efficacy", "dosage", "indication", "manufacturing")


def _strings(*parts) -> Column:
    return F.array(*[F.lit(p) for p in parts]) if parts else F.array().cast("array<string>")


def _by_type(kind: Column, table: dict) -> Column:
    out = _strings()
    for k, v in reversed(table.items()):
        out = F.when(kind == k, _strings(*v)).otherwise(out)
    return out


def _any_of(text: Column, terms: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for t in terms:
        hit = hit | F.contains(text, F.lit(t))
    return hit


def sentences(text: Column) -> Column:
    """White space collapsed, cut after . ! or ?, those of more than 20 characters."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.filter(F.transform(F.split(flat, r"(?<=[.!?])\s+", -1), lambda x: F.trim(x)), lambda s: F.length(s) > 20)


def exec_summary(found: Column) -> Column:
    return F.when(F.size(found) == 0, "No readable document content was available.").otherwise(F.array_join(F.slice(found, 1, 5), " "))


def key_findings(found: Column, kind: Column) -> Column:
    """First five sentences with a keyword of the type; else the first three; else a fixed one."""
    words = _by_type(kind, KEYWORDS)
    hits = F.slice(F.filter(found, lambda s: let(F.lower(s), lambda low: F.exists(words, lambda w: F.contains(low, w)))), 1, 5)
    return F.when(F.size(hits) > 0, hits).when(F.size(found) > 0, F.slice(found, 1, 3)).otherwise(_strings("No key findings could be extracted."))


def risk_terms(text: Column, kind: Column) -> Column:
    held = let(F.lower(text), lambda low: F.filter(_strings(*RISK_TERMS), lambda t: F.contains(low, t)))
    hits = F.transform(held, lambda t: F.concat(F.lit("Potential regulatory risk detected: "), t))
    return (
        F.when(F.size(hits) > 0, hits)
        .when(kind == "sae", _strings("SAE submission requires reviewer validation even when no critical keyword is present."))
        .otherwise(_strings("No explicit high-risk signal detected in the extracted text."))
    )


def missing_fields(text: Column, kind: Column, table: dict = REQUIRED_FIELDS, metadata: Column | None = None) -> Column:
    """Fields of the type that neither the metadata map nor the text names."""
    absent = lambda low, f: ~F.contains(low, F.replace(f, F.lit("_"), F.lit(" ")))
    fields = let(F.lower(F.coalesce(text, F.lit(""))), lambda low: F.filter(_by_type(kind, table), lambda f: absent(low, f)))
    return fields if metadata is None else F.filter(fields, lambda f: F.coalesce(F.try_element_at(metadata, f), F.lit("")) == "")


def next_steps(kind: Column, missing: Column, risks: Column) -> Column:
    steps = F.array_compact(
        F.array(
            F.when(F.size(missing) > 0, "Request applicant clarification for missing mandatory fields."),
            F.when((F.size(risks) > 0) & ~F.contains(F.get(risks, F.lit(0)), F.lit("No explicit")), "Route to CDSCO reviewer for priority assessment."),
            F.when(kind == "sae", "Verify SAE seriousness, causality, and mandatory reporting timeline."),
        )
    )
    return F.when(F.size(steps) > 0, steps).otherwise(_strings("Proceed to standard reviewer queue."))


def summary_confidence(text: Column, found: Column, missing: Column) -> Column:
    score = 0.72 + F.least(F.size(found), F.lit(5)) * 0.04 - F.size(missing) * 0.03
    return F.when(F.trim(text) == "", 0.2).otherwise(F.round(F.greatest(F.lit(0.3), F.least(F.lit(0.95), score)), 3))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def summarise(docs: DataFrame, text: str = "text", kind: str = "submission_type") -> DataFrame:
    """docs plus every part of the extractive summary."""
    t, k = F.col(text), F.col(kind)
    out = docs.withColumn("sentences", sentences(t))
    out = out.withColumns({"executive_summary": exec_summary(F.col("sentences")), "key_findings": key_findings(F.col("sentences"), k), "risks": risk_terms(t, k), "missing": missing_fields(t, k, SUMMARY_FIELDS)})
    return out.withColumns({"next_steps": next_steps(k, F.col("missing"), F.col("risks")), "summary_confidence": summary_confidence(t, F.col("key_findings"), F.col("missing")), "word_count": word_count(F.col("executive_summary"))})


def sae_severity(text: Column) -> Column:
    """struct<severity, score> by the model plugged in as `severity`, else by words."""
    return hook("severity", severity_by_words)(text)


def severity_by_words(text: Column) -> Column:
    """struct<severity, score> by the first group of words found anywhere in the lower-cased text."""
    pair = lambda s, x: F.struct(F.lit(s).alias("severity"), F.lit(x).alias("score"))

    def graded(low: Column) -> Column:
        out = pair("other", 0.45)
        for name, score, terms in reversed(SEVERITIES):
            out = F.when(_any_of(low, terms), pair(name, score)).otherwise(out)
        return out

    return let(F.lower(text), graded)


def category_label(kind: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in CATEGORIES.items():
        out = F.when(kind == k, v).otherwise(out)
    return out


def scorecard(docs: DataFrame, text: str = "text", kind: str = "submission_type", max_similarity: Column | None = None) -> DataFrame:
    """docs plus completeness, severity, risk, priority, review flag, labels and confidence."""
    k = F.col(kind)
    out = docs.withColumn("missing", missing_fields(F.col(text), k)).withColumn("sev", F.when(k == "sae", sae_severity(F.col(text))))
    out = out.withColumn("completeness", F.round((4 - F.size("missing")) / 4, 3))
    risk = F.greatest(1 - F.col("completeness"), F.coalesce("sev.score", F.lit(0.0)), *([F.coalesce(max_similarity, F.lit(0.0)) * 0.8] if max_similarity is not None else []))
    out = out.withColumn("risk", risk).withColumn("severity", F.col("sev.severity"))
    r = F.col("risk")
    out = out.withColumn("priority", F.when(r >= 0.85, "critical").when(r >= 0.65, "high").when(r >= 0.4, "medium").when(r >= 0.2, "low").otherwise("informational"))
    return out.withColumns(
        {
            "requires_review": F.col("priority").isin("critical", "high") | F.coalesce(F.col("severity").isin("death", "life_threatening"), F.lit(False)),
            "risk_score": F.round(F.least(F.lit(1.0), r), 3),
            "category": category_label(k),
            "labels": F.array_compact(F.array(k, F.format_string("completeness:%.2f", "completeness"), F.when(F.col("severity").isNotNull(), F.concat(F.lit("sae:"), "severity", F.lit("(keyword)"))))),
            "class_confidence": F.when(F.col("completeness") >= 0.75, 0.86).otherwise(0.72),
        }
    ).drop("sev", "risk")


def priority_alerts(scored: DataFrame) -> DataFrame:
    """Notifications for critical and high priorities."""
    return scored.where(F.col("priority").isin("critical", "high")).select(
        "doc_id", F.when(F.col("priority") == "critical", "CRITICAL").otherwise("WARNING").alias("severity"), F.when((F.col("priority") == "critical") & (F.col("submission_type") == "sae"), "sae_critical").otherwise("review_required").alias("kind")
    )


def significance_notes(diff: Column) -> Column:
    notes = let(F.lower(diff), lambda low: F.array_distinct(F.array_compact(F.array(*[F.when(F.contains(low, F.lit(t)), n) for t, n in SIGNIFICANCE]))))
    return F.when(F.size(notes) > 0, notes).otherwise(_strings("No specific high-impact regulatory term was detected in the diff."))


def changed_sections(diff: Column, aspects: tuple[str, ...] = ()) -> Column:
    """Asked-for aspects found in the diff, then the standing ones."""
    found = let(F.lower(diff), lambda low: F.array_distinct(F.filter(_strings(*aspects, *ASPECTS), lambda a: F.contains(low, F.lower(a)))))
    return F.when(F.size(found) > 0, found).otherwise(_strings("general_content"))


def diff_confidence(changed_lines: Column) -> Column:
    return F.when(changed_lines <= 3, 0.75).otherwise(0.90)


def line_diff_bag(pairs: DataFrame, a: str = "text_a", b: str = "text_b", key: str = "pair_id") -> DataFrame:
    """Lines added and removed between two texts as bags: (pair, line, change), change the signed surplus in b."""
    sides = F.array(*[F.struct(F.col(c).alias("text"), F.lit(sign).alias("s")) for c, sign in ((a, -1), (b, 1))])
    # whole texts move once, to the task of their pair; lines are counted there, and what follows by pair stays there
    both = pairs.select(key, a, b).repartition(key).select(key, F.explode(sides).alias("side"))
    # from an inner explode the optimizer would infer a filter that splits again
    lines = both.select(key, F.explode_outer(F.split("side.text", "\n")).alias("line"), "side.s").withColumn("line", F.trim("line")).where("line <> ''")
    return lines.groupBy(key, "line").agg(F.sum("s").alias("change")).where("change <> 0")


def version_pairs(docs: DataFrame, requests: DataFrame) -> DataFrame:
    """Texts of the two documents of each comparison request (pair_id, doc_a, doc_b)."""
    one = lambda s: docs.select(F.col("doc_id").alias(f"doc_{s}"), F.col("text").alias(f"text_{s}"))
    return requests.join(one("a"), "doc_a").join(one("b"), "doc_b")


def comparison_report(diffs: DataFrame) -> DataFrame:
    """A markdown report for each pair from its bag diff: counts, the lines themselves, and what they may mean."""
    line = F.struct("line", F.when(F.col("change") > 0, "+ ").otherwise("- ").alias("sign"))
    lines = F.transform(F.array_sort(F.collect_list(line)), lambda x: F.concat(x["sign"], x["line"]))
    body = diffs.groupBy("pair_id").agg(
        F.sum(F.greatest("change", F.lit(0))).alias("added"), F.sum(F.greatest(-F.col("change"), F.lit(0))).alias("removed"), F.array_join(lines, "\n").alias("diff")
    )
    count = lambda label, c: F.concat(F.lit(f"{label}: "), F.col(c).cast("string"))
    notes = F.array_join(significance_notes(F.col("diff")), "\n")
    report = F.concat_ws("\n", F.lit("# Comparison"), count("Additions", "added"), count("Deletions", "removed"), F.lit("## Diff"), F.col("diff"), F.lit("## Significance"), notes)
    return body.select(
        "pair_id", "added", "removed", F.array_join(changed_sections(F.col("diff")), ",").alias("sections"), diff_confidence(F.col("added") + F.col("removed")).alias("confidence"), report.alias("report")
    )
