"""Bounds of the Arrow batches that go to Python."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Bytes of an Arrow batch of whole texts
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes of the Arrow batches that the session hands to Python, unless they are bounded tighter already.

    Rows of whole texts differ in length by orders of magnitude, so a bound on rows alone lets one batch take hundreds
    of MB, on either side of the socket, in each task.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).rstrip("bB")
    if not (now.isdigit() and 0 < int(now) <= BATCH_BYTES):
        spark.conf.set(key, BATCH_BYTES)
