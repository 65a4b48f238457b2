"""Hash-chained audit log: building, verifying, append-only checks."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

GENESIS = "0" * 64


def _sorted_keys(value: Column, kind: DataType) -> Column:
    """value with the fields of every struct inside it in order of their names."""
    if isinstance(kind, StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        return F.when(value.isNotNull(), F.struct(*[_sorted_keys(value[f.name], f.dataType).alias(f.name) for f in fields]))
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, (StructType, ArrayType)):
        return F.transform(value, lambda x: _sorted_keys(x, kind.elementType))
    return value


def canonical(rows: DataFrame, *fields: str) -> Column:
    """Compact JSON of the given columns of rows, keys sorted at every level."""
    return F.to_json(F.struct(*[_sorted_keys(F.col(f), rows.schema[f].dataType).alias(f) for f in sorted(fields)]))


def audit_chain_build(rows: DataFrame, key: str, order: str, payload: str) -> DataFrame:
    """(key, id, prev_hash, entry_hash) of every row: one chain a key, entry_hash = sha256(prev_hash + payload) from the genesis hash.

    A chain is sequential by nature, so the log is cut by key (document or day) and chains run side by side: rows are
    sorted inside partitions and walked once, holding nothing but the last hash.
    """
    names = rows.select(F.col(key).alias("key"), F.col(order).alias("id"), F.col(payload).alias("payload"))
    ordered = names.repartition("key").sortWithinPartitions("key", "id")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = object(), GENESIS
        for batch in batches:
            prev, entry = [], []
            for k, body in zip(batch.column("key").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                if k != now:
                    now, last = k, GENESIS
                prev.append(last)
                last = sha256((last + (body or "")).encode()).hexdigest()
                entry.append(last)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("id"), pa.array(prev, pa.string()), pa.array(entry, pa.string())], names=["key", "id", "prev_hash", "entry_hash"])

    kinds = [names.schema[c].dataType.simpleString() for c in ("key", "id")]
    return ordered.mapInArrow(walk, f"key {kinds[0]}, id {kinds[1]}, prev_hash string, entry_hash string").withColumnRenamed("key", key)


def audit_rows(decisions: DataFrame, actor: str = "system") -> DataFrame:
    """Audit rows of decisions (doc_id, source_event, decision): an event of each, its actor and payload; the hash chain is the logger's."""
    body = canonical(decisions, "decision", "doc_id", "source_event")
    return decisions.select("doc_id", F.lit("ai_decision").alias("event_type"), F.lit(actor).alias("actor"), F.col("decision").alias("outcome"), body.alias("payload"), F.lit("managed-by-audit-logger").alias("prev_hash"))


def audit_chain_verify(log: DataFrame, bucket: int = 1_000_000) -> DataFrame:
    """Rows whose link or hash is wrong: (id, reason).

    log: id, prev_hash, entry_hash in id order.  Rows are checked inside id ranges; the first row of a range is checked
    against the last one of the range before it, found in a table of one row a range, so no task sorts the whole log.
    """
    ranged = log.withColumn("range", F.floor(F.col("id") / bucket))
    inside = ranged.withColumn("before", F.lag("entry_hash").over(W.partitionBy("range").orderBy("id")))
    ends = ranged.groupBy("range").agg(F.max_by("entry_hash", "id").alias("last"))
    ends = ends.withColumn("edge", F.lag("last").over(W.orderBy("range"))).select("range", "edge")
    joined = inside.join(ends, "range")
    first = F.row_number().over(W.partitionBy("range").orderBy("id")) == 1
    expected = F.when(first, F.coalesce("edge", F.lit(GENESIS))).otherwise(F.col("before"))
    reason = F.when(~F.col("prev_hash").eqNullSafe(expected), "prev_hash_mismatch").when(F.col("entry_hash").isNull() | (F.length("entry_hash") != 64), "invalid_entry_hash_format")
    return joined.select("id", reason.alias("reason")).where("reason is not null")


def append_only_check(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of an older snapshot that changed or vanished: (id, violation)."""
    joined = old.select("id", F.col("entry_hash").alias("was")).join(new.select("id", F.col("entry_hash").alias("now")), "id", "left")
    return joined.select("id", F.when(F.col("now").isNull(), "deleted").when(F.col("now") != F.col("was"), "changed").alias("violation")).where("violation is not null")
