"""Streams that Spark's own operators express: events once, windowed counts; and how streams are fed and run in parts.

Each takes a streaming DataFrame and gives one; the batch forms of the same operators give the same rows.  Streams with
state of their own are in `state`, tables that a stream updates in `upsert`, the governance chain in `chain`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def stream_dedup(events: DataFrame, key: str = "event_id", ts: str = "ts", lateness: str = "1 day") -> DataFrame:
    """The same event once, however often it arrives within `lateness`."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness).dropDuplicatesWithinWatermark([key])


def rate_windows_stream(events: DataFrame, ts: str = "ts", width: str = "5 minutes", slide: str = "1 minute", lateness: str = "10 minutes") -> DataFrame:
    """Counts of sliding windows; rows later than `lateness` are left out once their window is closed."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)
    return timed.groupBy(F.window(ts, width, slide).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "n")


def run_once(stream: DataFrame, spark: SparkSession, path: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and read what it wrote."""
    if mode == "complete":
        query = stream.writeStream.outputMode("complete").foreachBatch(lambda b, _: b.write.mode("overwrite").parquet(f"{path}/out")).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    else:
        query = stream.writeStream.outputMode("append").format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{path}/out")


def run_in_parts(rows: DataFrame, ts: str, path: str, stream: Callable[[DataFrame], DataFrame], parts: int = 6) -> DataFrame:
    """Feed a table to a stream in `parts` slices of time, a micro-batch each, stopping and starting again between them.

    Each slice is written by as many tasks as the table has; the query ends with it and a new one goes on from its checkpoint.
    Rows without a time come first.
    """
    spark = rows.sparkSession
    # a row a day
    edges = F.ntile(parts).over(W.orderBy("day"))
    days = rows.select(F.to_date(ts).alias("day")).groupBy("day").count().withColumn("part", edges)
    sliced = rows.withColumn("_day", F.to_date(ts)).join(F.broadcast(days.select(F.col("day").alias("_d"), "part")), F.col("_day").eqNullSafe(F.col("_d"))).drop("_day", "_d")

    for n in range(1, parts + 1):
        sliced.where(F.col("part") == n).drop("part").write.mode("append").parquet(f"{path}/in")
        run_once(stream(spark.readStream.schema(rows.schema).parquet(f"{path}/in")), spark, path)
    return spark.read.parquet(f"{path}/out")
