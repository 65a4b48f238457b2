"""The governance chain as a stream of topics: preprocess, anonymise, summarise and classify, assess.

Each stage is a query of its own.  It reads the topic tables of its predecessors as streams, with its own checkpoint, and
appends to its own topic table through the file sink, whose log makes each row land once, whatever is killed and started
again between or inside the stages.  Rows that a stage can't use are rows of its topic with an error; the next stages
pass over them, and the dead-letter stage gathers those of all topics.  The same functions applied to tables are the
batch form.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from dossierlake.functions.scratch import written
from dossierlake.operators import anonymise as a
from dossierlake.operators import rules as r
from dossierlake.operators import summary as s
from dossierlake.operators.text import normalise_text

#: what a stage needs of the event that starts the chain
RAW = StructType().add("doc_id", "string").add("submission_type", "string").add("text", "string")
KINDS = ("drug", "medical_device", "clinical_trial", "sae")
DEAD_LETTERS = "dlq"


@dataclass(frozen=True)
class Stage:
    """A topic, the topics that it is made from, and how: a function of their usable rows, in that order."""

    topic: str
    sources: tuple[str, ...]
    make: Callable[..., DataFrame]


def _first(*checks: tuple[Column, str]) -> Column:
    out = F.lit(None).cast("string")
    for bad, name in reversed(checks):
        out = F.when(bad, F.lit(name)).otherwise(out)
    return out


def _blank(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit(""))) == ""


def preprocess(raw: DataFrame) -> DataFrame:
    error = _first((_blank("doc_id"), "MissingDocId"), (~F.coalesce(F.col("submission_type").isin(*KINDS), F.lit(False)), "UnknownType"), (_blank("text"), "EmptyDocument"))
    rows = raw.withColumn("error", error)
    return rows.select("doc_id", "submission_type", F.when(F.col("error").isNull(), normalise_text(F.col("text"))).otherwise(F.col("text")).alias("text"), "error")


def anonymised(preprocessed: DataFrame) -> DataFrame:
    done = a.anonymise(preprocessed.drop("error"))
    # a text that is gone once identifiers and marks are taken out has nothing for the stages behind
    error = _first((_blank("anonymised_text"), "EmptyAfterAnonymisation"))
    return done.select("doc_id", "submission_type", F.col("anonymised_text").alias("text"), "n_entities", "confidence", F.concat(F.lit("ai/"), "submission_type", F.lit("/"), "doc_id", F.lit("/anonymised.json")).alias("path"), error.alias("error"))


def classified(anonymised_rows: DataFrame) -> DataFrame:
    done = s.scorecard(s.summarise(anonymised_rows.select("doc_id", "submission_type", "text")))
    return done.select("doc_id", "submission_type", "executive_summary", "key_findings", "summary_confidence", "severity", "priority", "risk_score", "requires_review", F.lit(None).cast("string").alias("error"))


def assessed(anonymised_rows: DataFrame, classified_rows: DataFrame) -> DataFrame:
    """A decision for the anonymised document, for its summary and for its classification."""
    none = lambda kind: F.lit(None).cast(kind)
    blank = {"leaks": none(f"array<{a.FINDING}>"), "n_entities": none("int"), "text": none("string"), "path": none("string"), "summary": none("string"), "severity": none("string"), "priority": none("string"), "requires_review": none("boolean"), "report_type": none("string"), "report_id": none("string")}

    def events(topic: str, rows: DataFrame, **known: Column) -> DataFrame:
        return rows.select("doc_id", "submission_type", F.lit(topic).alias("topic"), *[known.get(n, c).alias(n) for n, c in blank.items()])

    told = events("documents.anonymised", anonymised_rows, leaks=a.pii_leak_scan(F.col("text")), n_entities=F.col("n_entities"), text=F.col("text"), path=F.col("path"))
    told = told.unionByName(events("documents.summarised", classified_rows, summary=F.concat_ws(" ", "executive_summary", F.array_join("key_findings", " "))))
    told = told.unionByName(events("documents.classified", classified_rows, severity=F.col("severity"), priority=F.col("priority"), requires_review=F.col("requires_review")))
    return r.assess(told).select("doc_id", "topic", "decision", "human_review_required", "blocked", "confidence", F.transform("findings", lambda f: f["rule_id"]).alias("rules"), F.lit(None).cast("string").alias("error"))


STAGES = (
    Stage("documents.preprocessed", ("raw.documents.ingested",), preprocess),
    Stage("documents.anonymised", ("documents.preprocessed",), anonymised),
    Stage("documents.classified", ("documents.anonymised",), classified),
    Stage("compliance.decisions", ("documents.anonymised", "documents.classified"), assessed),
)


def batch_chain(raw: DataFrame) -> dict[str, DataFrame]:
    """Topic tables of a table of raw documents, each written, and the dead letters.

    As one plan the stages would not do: the optimizer puts a stage's columns into each place where the next uses them.
    """
    out = {"raw.documents.ingested": raw.select(RAW.names)}
    for stage in STAGES:
        out[stage.topic] = written(stage.make(*[_usable(out[t]) for t in stage.sources]), stage.topic)
    del out["raw.documents.ingested"]
    return out | {DEAD_LETTERS: _union([_dead(t, rows) for t, rows in out.items()])}


def _usable(rows: DataFrame) -> DataFrame:
    return rows.where("error is null") if "error" in rows.columns else rows


def _dead(topic: str, rows: DataFrame) -> DataFrame:
    """Rows with an error as dead letters."""
    return rows.where("error is not null").select(F.lit(topic).alias("original_topic"), "doc_id", F.col("error").alias("error_type"), F.to_json(F.struct(*rows.drop("error").columns)).alias("payload"))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


class Chain:
    """The stages over a folder of the shared store: root/{topic} are the tables, root/_state/{topic} the checkpoints."""

    def __init__(self, spark: SparkSession, root: str, files: int = 1_000):
        self.spark, self.root, self.files = spark, root, files
        # each stage is made once; its query may start from there as often as it likes
        self.schemas, self.made = {"raw.documents.ingested": RAW}, {}
        for stage in STAGES:
            self.made[stage.topic] = stage.make(*[_usable(self.stream(t)) for t in stage.sources])
            self.schemas[stage.topic] = self.made[stage.topic].schema

    def stream(self, topic: str) -> DataFrame:
        path = f"{self.root}/{topic}"
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).mkdirs(hadoop)
        return self.spark.readStream.schema(self.schemas[topic]).option("maxFilesPerTrigger", self.files).parquet(path)

    def _start(self, topic: str, rows: DataFrame, trigger: dict):
        writer = rows.writeStream.outputMode("append").format("parquet").option("path", f"{self.root}/{topic}")
        return writer.option("checkpointLocation", f"{self.root}/_state/{topic}").queryName(f"{topic}-{abs(hash(self.root))}").trigger(**(trigger or {"availableNow": True})).start()

    def start(self, stage: Stage, **trigger):
        """The query of one stage; by default it takes what is there and ends."""
        return self._start(stage.topic, self.made[stage.topic], trigger)

    def start_dead_letters(self, **trigger):
        return self._start(DEAD_LETTERS, _union([_dead(s.topic, self.stream(s.topic)) for s in STAGES]), trigger)

    def start_all(self, **trigger) -> list:
        """All queries at once, as a service runs them."""
        return [*[self.start(s, **trigger) for s in STAGES], self.start_dead_letters(**trigger)]

    def run(self) -> None:
        """Stage after stage over what is there."""
        for stage in STAGES:
            self.start(stage).awaitTermination()
        self.start_dead_letters().awaitTermination()

    def read(self, topic: str) -> DataFrame:
        """Rows of a topic table that its sink has committed."""
        if topic == DEAD_LETTERS:
            return self.spark.read.schema("original_topic string, doc_id string, error_type string, payload string").parquet(f"{self.root}/{topic}")
        return self.spark.read.schema(self.schemas[topic]).parquet(f"{self.root}/{topic}")
