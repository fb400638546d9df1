"""Loaders for the driver's tables."""

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read ``{sf_dir}/{name}.parquet`` through Spark's own reader, so any Hadoop path works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
