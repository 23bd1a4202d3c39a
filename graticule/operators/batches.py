"""Arrow batches of a bounded size for the functions on texts."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Bytes of an Arrow batch, about (a longer row is a batch by itself).
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Hold Arrow batches to `BATCH_BYTES` in this session, so that a batch of long texts stays small; a lower bound stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(key)
    if not held.isdigit() or not 0 < int(held) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
