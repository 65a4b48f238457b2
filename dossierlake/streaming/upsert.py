"""A table with one row a key that a stream updates: buckets, versions and a manifest.

Keys are dealt by hash to a fixed number of buckets.  A micro-batch rewrites the buckets that it touches, as new files
beside the old ones, and then puts one manifest in place that names the files of every bucket and the batch.  Readers and
later batches go by the newest manifest only, so a batch that dies halfway leaves no trace, and one that is run again
after its manifest was written changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: (rows held, rows that came, both with the table's columns) -> rows held from now on
Merge = Callable[[DataFrame, DataFrame], DataFrame]


@dataclass(frozen=True)
class KeyedTable:
    """A table in a folder of the shared store; buckets is the number that it was made with."""

    spark: SparkSession
    path: str
    schema: StructType
    keys: tuple[str, ...]
    buckets: int = 16

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def manifest(self) -> dict:
        """{batch, buckets: {number: folder}} of the newest manifest; before the first, no batch and no buckets."""
        fs, folder = self._fs(f"{self.path}/manifests")
        if not fs.exists(folder):
            return {"batch": -1, "buckets": {}}
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        done = sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_")))
        if not done:
            return {"batch": -1, "buckets": {}}
        text = self.spark.read.text(f"{self.path}/manifests/{done[-1]}.json", wholetext=True).first()[0]
        return json.loads(text)

    def _commit(self, manifest: dict) -> None:
        """Written beside its place and renamed into it, which fails if a manifest of that batch is there."""
        fs, draft = self._fs(f"{self.path}/manifests/.{uuid.uuid4().hex}")
        out = fs.create(draft)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        place = self._fs(f"{self.path}/manifests/{manifest['batch']}.json")[1]
        if fs.exists(place) or not fs.rename(draft, place):
            fs.delete(draft, False)
            raise RuntimeError(f"batch {manifest['batch']} was committed by another writer")

    def bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("_bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def read(self, only: list[int] | None = None) -> DataFrame:
        """Rows of the newest version, of some buckets or of all."""
        folders = [f for b, f in self.manifest()["buckets"].items() if only is None or int(b) in only]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def apply(self, batch: DataFrame, number: int, merge: Merge) -> bool:
        """Merge a micro-batch; False if it is in the table already."""
        now = self.manifest()
        if number <= now["batch"]:
            return False
        came = self.bucketed(batch).persist()
        try:
            # no more than there are buckets
            touched = sorted(r[0] for r in came.select("_bucket").distinct().collect())
            if touched:
                merged = merge(self.read(touched), came.drop("_bucket"))
                folder = f"{self.path}/data/{number}-{uuid.uuid4().hex}"
                self.bucketed(merged.select(self.schema.names)).repartition(len(touched), "_bucket").write.partitionBy("_bucket").parquet(folder)
                now["buckets"] |= {str(b): f"{folder}/_bucket={b}" for b in touched}
            self._commit({"batch": number, "buckets": now["buckets"]})
        finally:
            came.unpersist()
        return True

    def vacuum(self) -> int:
        """Delete folders that the newest manifest does not name, and the manifests before it; how many buckets went."""
        now, gone = self.manifest(), 0
        kept = set(now["buckets"].values())
        fs, folder = self._fs(f"{self.path}/data")
        for version in fs.listStatus(folder) if fs.exists(folder) else ():
            for bucket in fs.listStatus(version.getPath()):
                where = f"{self.path}/data/{version.getPath().getName()}/{bucket.getPath().getName()}"
                if bucket.isDirectory() and where not in kept:
                    fs.delete(bucket.getPath(), True)
                    gone += 1
        fs, folder = self._fs(f"{self.path}/manifests")
        for f in fs.listStatus(folder) if fs.exists(folder) else ():
            if f.getPath().getName() != f"{now['batch']}.json":
                fs.delete(f.getPath(), False)
        return gone


def upsert_stream(updates: DataFrame, table: KeyedTable, merge: Merge, checkpoint: str, **trigger):
    """Merge each micro-batch of a stream into a keyed table."""
    writer = updates.writeStream.foreachBatch(lambda batch, number: table.apply(batch, number, merge) and None)
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


# --- the event store's status ------------------------------------------------------------------------------------

STATUS = "event_id long, status string, status_seq long, duration_ms int, duration_seq long, error string, error_seq long, completed_at long"


def status_rows(updates: DataFrame) -> DataFrame:
    """Updates (event_id, seq, status, duration_ms, error) as rows of the status table, which keep when each value was set."""
    at = lambda c: F.when(F.col(c).isNotNull(), F.col("seq"))
    done = F.col("status").isin("success", "failed", "dlq", "dismissed")
    return updates.select(
        "event_id", "status", at("status").alias("status_seq"), F.col("duration_ms").cast("int").alias("duration_ms"), at("duration_ms").alias("duration_seq"),
        "error", at("error").alias("error_seq"), F.when(done, F.col("seq")).alias("completed_at"),
    )


def merge_status(held: DataFrame, came: DataFrame) -> DataFrame:
    """Latest known status, duration and error of each event: null overwrites nothing, and neither does an older update."""
    both = held.unionByName(came)
    last = lambda c, seq: [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c), F.max(F.when(F.col(c).isNotNull(), F.col(seq))).alias(seq)]
    return both.groupBy("event_id").agg(*last("status", "status_seq"), *last("duration_ms", "duration_seq"), *last("error", "error_seq"), F.max("completed_at").alias("completed_at"))


def merge_latest(key: str, order: str) -> Merge:
    """The row of the highest `order` of each key; of equal ones the one that came."""

    def merge(held: DataFrame, came: DataFrame) -> DataFrame:
        both = held.withColumn("_new", F.lit(0)).unionByName(came.withColumn("_new", F.lit(1)))
        rows = F.struct(*[F.col(c) for c in held.columns])
        return both.groupBy(key).agg(F.max_by(rows, F.struct(order, "_new")).alias("_row")).select("_row.*")

    return merge
