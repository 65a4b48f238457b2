"""What several operators of this subpackage share: the shared folder, written intermediate tables, components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossierlake.functions.batches import BATCH_BYTES, small_batches  # noqa: F401
from dossierlake.functions.scratch import scratch_path

def written(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Ids up to which a written list of them is broadcast (a long each: tens of MB in memory at most)
BROADCAST_IDS = 1_000_000


def id_side(ids: DataFrame, tag: str) -> DataFrame:
    """A list of ids for a semi or anti join against wide rows: written, counted, and broadcast if the count is small.

    The wide rows then stay where they are; longer lists are joined by a shuffle.
    """
    ids = written(ids, tag)
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def drop_written(df: DataFrame) -> None:
    """Delete the files of a table made by written(), through Hadoop's file system so that any store works."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph: edges (u, v) -> (node, component), component the smallest node reachable.

    Alternating large-star and small-star rounds; each keeps the number of edges linear and is written to the
    shared folder.  Only nodes that have an edge come back.  Self loops and repeated edges are allowed; rows with a
    null end are ignored; no edges give no rows.  The minima are written before they are joined, so both join
    inputs are plain shuffles that adaptive execution can split when one node holds most edges.
    """

    def minima(e: DataFrame) -> DataFrame:
        return e.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))

    now = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(minima(both), "minima")
        large = written(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = written(minima(large), "minima")
        joined = large.join(least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        after = written(small.where("u <> v").distinct(), "small")
        old, now = now, after
        for t in (old, low, large, least):
            drop_written(t)
        sign = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == (sign["n"], sign["h"]):
            break
        state = (sign["n"], sign["h"])
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
