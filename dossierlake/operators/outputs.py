"""Event payloads, prompts, model replies, exact diffs and text reports."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROMPT_LIMIT = 40_000
REPLY = "struct<executive_summary:string,key_findings:array<string>,risks:array<string>,recommended_next_steps:array<string>>"


def prompt_rows(docs: DataFrame, template: str = "Summarise this %s submission.\n\n%s", text: str = "text", kind: str = "submission_type") -> DataFrame:
    """docs plus a prompt for an outside model; the text is cut to the model's limit of characters."""
    return docs.withColumn("prompt", F.format_string(template, F.col(kind), F.substring(F.col(text), 1, PROMPT_LIMIT)))


def parse_model_reply(replies: DataFrame, reply: str = "reply") -> tuple[DataFrame, DataFrame]:
    """(parsed, errors): JSON replies without code fences, lists cut to five non-empty entries, empty ones defaulted."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(F.col(reply)), r"^```[a-z]*\s*", ""), r"\s*```$", "")
    read = replies.withColumn("data", F.from_json(bare, f"struct<{REPLY[7:-1]},_corrupt:string>", {"columnNameOfCorruptRecord": "_corrupt"}))
    bad = F.col("data").isNull() | F.col("data._corrupt").isNotNull()

    def entries(field: str, default: str) -> Column:
        kept = F.slice(F.filter(F.coalesce(F.col(f"data.{field}"), F.array().cast("array<string>")), lambda x: F.trim(F.coalesce(x, F.lit(""))) != ""), 1, 5)
        return F.when(F.size(kept) > 0, kept).otherwise(F.array(F.lit(default))).alias(field)

    good = replies.columns
    parsed = read.where(~bad).select(
        *[c for c in good if c != reply], F.coalesce("data.executive_summary", F.lit("")).alias("executive_summary"), entries("key_findings", "No key findings could be extracted."),
        entries("risks", "No explicit high-risk signal detected in the extracted text."), entries("recommended_next_steps", "Proceed to standard reviewer queue."),
    )
    return parsed, read.where(bad).select(*good)


def line_diff_exact(pairs: DataFrame, key: str = "pair_id") -> DataFrame:
    """(pair, diff, added, removed): unified diff with three lines of context of the stripped non-blank lines of text_a and
    text_b, headed by doc_a and doc_b."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, a, b, name_a, name_b in zip(pdf[key], pdf["text_a"], pdf["text_b"], pdf["doc_a"], pdf["doc_b"], strict=True):
                clean = [[x.strip() for x in (t or "").splitlines() if x.strip()] for t in (a, b)]
                diff = list(difflib.unified_diff(*clean, str(name_a), str(name_b), lineterm="", n=3))
                body = diff[2:]  # the two lines of the heading come first
                rows.append((k, "\n".join(diff), sum(d.startswith("+") for d in body), sum(d.startswith("-") for d in body)))
            yield pd.DataFrame(rows, columns=[key, "diff", "added", "removed"])

    return pairs.select(key, "doc_a", "doc_b", "text_a", "text_b").mapInPandas(run, f"{key} {pairs.schema[key].dataType.simpleString()}, diff string, added int, removed int")


def output_event(rows: DataFrame, topic: str, fields: tuple[str, ...], key: str = "doc_id") -> DataFrame:
    """Event rows (topic, key, value) whose value is the JSON of the given columns."""
    return rows.select(F.lit(topic).alias("topic"), F.col(key).cast("string").alias("key"), F.to_json(F.struct(*fields)).alias("value"))


def anonymised_event(done: DataFrame, path: Column) -> DataFrame:
    """The event of an anonymised document: where its text lies, how many identifiers were replaced, by what, how surely."""
    rows = done.select("*", path.alias("anonymised_path"), F.col("n_entities").alias("entities_found"), F.lit("regex").alias("method"), F.lit("1.0.0").alias("model_version"))
    return output_event(rows, "documents.anonymised", ("doc_id", "submission_type", "anonymised_path", "entities_found", "confidence", "method", "model_version"))


def summarised_event(done: DataFrame) -> DataFrame:
    """The event of a summarised document with the summary itself."""
    fields = ("doc_id", "submission_type", "executive_summary", "key_findings", "next_steps", "summary_confidence", "word_count")
    return output_event(done, "documents.summarised", fields)


def classified_event(done: DataFrame) -> DataFrame:
    """The event of a classified document: priority, risk, completeness and whether a reviewer must look."""
    fields = ("doc_id", "submission_type", "severity", "priority", "risk_score", "completeness", "missing", "requires_review", "class_confidence")
    return output_event(done, "documents.classified", fields)


def report_event(docs: DataFrame, kind: Column, folder: Column) -> DataFrame:
    """The event of a generated report: its id, type and place."""
    named = docs.withColumn("report_id", F.concat(F.lit("RPT-"), "doc_id")).withColumn("report_type", kind)
    named = named.withColumn("report_path", F.concat(folder, F.lit("/"), "report_id", F.lit(".txt")))
    return output_event(named, "reports.generated", ("doc_id", "report_id", "report_type", "report_path"))


def preprocess_done_events(runs: DataFrame) -> DataFrame:
    """Two events for each processed document: the record of the run, and the call to embed its chunks."""
    done = runs.where("status = 'processed'")
    return output_event(done, "documents.preprocessed", ("doc_id", "chunk_count", "chars")).unionByName(output_event(done, "documents.chunks.ready", ("doc_id", "chunk_count")))


def table_json_rows(headers: Column, rows: Column) -> Column:
    """Rows as JSON objects by header; a row without headers uses col_1, col_2 ..."""
    names = lambda r: F.when(F.size(headers) > 0, headers).otherwise(F.transform(r, lambda _, i: F.concat(F.lit("col_"), (i + 1).cast("string"))))
    return F.transform(rows, lambda r: F.to_json(F.map_from_arrays(names(r), r)))


def report_lines(detail: DataFrame) -> DataFrame:
    """A text report of each submission, a line a row of the array."""
    line = lambda label, c: F.concat(F.lit(f"{label}: "), F.coalesce(F.col(c).cast("string"), F.lit("-")))
    return detail.select("doc_id", F.array(F.lit("SUBMISSION REPORT"), line("Document", "doc_id"), line("Status", "status"), line("Decision", "latest_decision"), line("History", "history"), line("Failures", "n_failed")).alias("lines"))
