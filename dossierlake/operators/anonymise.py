"""Personal identifiers: detection, overlap resolution, pseudonyms, anonymised text, leak scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossierlake.functions.hooks import hook
from dossierlake.functions.spans import let, regex_spans

#: type, pattern, confidence (fixed values)
PATTERNS = [
    ("AADHAAR", r"\b(?:\d{4}[\s-]?){2}\d{4}\b", 0.98),
    ("PAN", r"\b[A-Z]{5}[0-9]{4}[A-Z]\b", 0.96),
    ("CIN", r"\b[UL]\d{5}[A-Z]{2}\d{4}[A-Z]{3}\d{6}\b", 0.96),
    ("INDIAN_PHONE", r"\b(?:\+91[\s-]?)?[6-9]\d{9}\b", 0.94),
    ("EMAIL", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", 0.98),
    ("TRIAL_SUBJECT", r"(?i)\b(?:patient|subject)\s*(?:id|no\.?|number)?\s*[:#-]?\s*[A-Z0-9-]{3,}\b", 0.88),
    ("DATE_OF_BIRTH", r"(?i)\b(?:dob|date of birth)\s*[:#-]?\s*\d{1,2}[-/]\d{1,2}[-/]\d{2,4}\b", 0.90),
]
#: what a text with a match of a pattern holds; found in a fraction of the pattern's time
NEEDS = {
    "AADHAAR": lambda t: t.rlike(r"\d{4}[\s-]?\d{4}[\s-]?\d{4}"),
    "PAN": lambda t: t.rlike("[0-9]{4}[A-Z]"),
    "CIN": lambda t: t.rlike(r"[UL]\d{5}"),
    "INDIAN_PHONE": lambda t: t.rlike(r"[6-9]\d{9}"),
    "EMAIL": lambda t: t.contains("@"),
    "TRIAL_SUBJECT": lambda t: t.rlike("[PpSs](?i:atient|ubject)"),
    "DATE_OF_BIRTH": lambda t: t.rlike("[Dd](?i:ob|ate of birth)"),
}
NO_ENTITY_CONFIDENCE = 0.99
METHOD, VERSION = "regex", "1.0.0"
ENTITY = "struct<start:int,neg_length:int,neg_confidence:double,kind:string,end:int,original:string>"


def pii_detect(text: Column) -> Column:
    """All matches of all patterns, and what the model plugged in as `ner` finds, sorted by start, longer first, surer first:
    array<struct<start, neg_length, neg_confidence, kind, end, original>>."""

    def found(kind: str, pattern: str, confidence: float) -> Column:
        return F.transform(
            regex_spans(text, pattern, needs=NEEDS[kind](text)),
            lambda s: F.struct(
                s["start"], (s["start"] - s["end"]).alias("neg_length"), F.lit(-confidence).alias("neg_confidence"), F.lit(kind).alias("kind"), s["end"], s["match"].alias("original")
            ),
        )

    more = hook("ner", lambda t: F.array())(text).cast(f"array<{ENTITY}>")
    return F.array_sort(F.concat(*[found(*p) for p in PATTERNS], more))


def pii_overlap(entities: Column) -> Column:
    """Of sorted entities those that begin at or after the end of the last one kept."""
    state = F.struct(F.lit(0).alias("until"), F.array().cast(f"array<{ENTITY}>").alias("kept"))
    step = lambda a, e: F.when(e["start"] >= a["until"], F.struct(e["end"].alias("until"), F.concat(a["kept"], F.array(e)).alias("kept"))).otherwise(a)
    return F.aggregate(entities, state, step, lambda a: a["kept"])


def pseudonyms(doc_id: Column, entities: Column) -> Column:
    """<TYPE_index_HEX6> of each entity: the same type and value, whatever its case, get the same one."""
    key = lambda e: F.concat_ws(":", e["kind"], F.lower(e["original"]))
    named = lambda keys: F.transform(
        entities,
        lambda e: F.concat(
            F.lit("<"), e["kind"], F.lit("_"), F.array_position(keys, key(e)).cast("string"), F.lit("_"),
            F.upper(F.substring(F.sha2(F.concat_ws(":", doc_id, e["kind"], F.lower(e["original"])), 256), 1, 6)), F.lit(">"),
        ),
    )
    return let(F.array_distinct(F.transform(entities, key)), named)


def anonymise_text(text: Column, entities: Column, names: Column) -> Column:
    """The text with each entity replaced."""
    pieces = F.arrays_zip(entities.alias("e"), names.alias("p"))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda a, x: F.struct(x["e"]["end"].alias("at"), F.concat(a["out"], F.substring(text, a["at"] + 1, x["e"]["start"] - a["at"]), x["p"]).alias("out"))
    return F.aggregate(pieces, start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))


def anonymise(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs plus entities, pseudonyms, anonymised_text, n_entities and confidence; one narrow pass."""
    found = docs.withColumn("entities", pii_detect(F.col(text)))
    found = found.withColumn("entities", pii_overlap(F.col("entities")))
    found = found.withColumn("pseudonyms", pseudonyms(F.col(id_col), F.col("entities")))
    mean = F.aggregate("entities", F.lit(0.0), lambda a, e: a - e["neg_confidence"]) / F.size("entities")
    return found.select(
        "*",
        F.when(F.size("entities") == 0, F.col(text)).otherwise(anonymise_text(F.col(text), F.col("entities"), F.col("pseudonyms"))).alias("anonymised_text"),
        F.size("entities").alias("n_entities"),
        F.when(F.size("entities") == 0, NO_ENTITY_CONFIDENCE).otherwise(F.round(mean, 3)).alias("confidence"),
    )


def entity_rows(anonymised: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """A row an entity.  From an inner explode the optimizer would infer a filter that detects everything again."""
    rows = anonymised.select(id_col, F.explode_outer("entities").alias("e")).where("e is not null")
    return rows.select(id_col, "e.kind", "e.start", "e.end", "e.original")


def entity_stats(anonymised: DataFrame) -> DataFrame:
    """Entities of each type over the corpus."""
    return anonymised.select(F.explode_outer("entities.kind").alias("kind")).where("kind is not null").groupBy("kind").agg(F.count("*").alias("n"))


FINDING = "struct<rule_id:string,framework:string,severity:string,message:string,evidence:string>"


def pii_leak_scan(text: Column) -> Column:
    """A critical finding for each identifier that is left in a text; values cut to 80 characters."""
    return F.transform(
        pii_overlap(pii_detect(text)),
        lambda e: F.struct(
            F.lit("DPDP-PII-LEAK").alias("rule_id"), F.lit("DPDP Act 2023").alias("framework"), F.lit("critical").alias("severity"),
            F.concat(F.lit("Potential direct identifier remained after anonymisation: "), e["kind"]).alias("message"), F.substring(e["original"], 1, 80).alias("evidence"),
        ),
    )
