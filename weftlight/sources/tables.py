"""Where tables are and how they are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a data folder; a file or a folder of parts."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
