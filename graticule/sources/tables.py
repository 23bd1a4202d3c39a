"""Readers for the driver's Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graticule.operators.batches import bound_batches


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One named table of a scale-factor directory; the path may be in any store that Spark can read. Functions on
    its rows get Arrow batches of a bounded size."""
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
