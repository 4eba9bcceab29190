"""How much room tables take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """(table, bytes, mb): size of each table's files; only their lengths are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(folder).select("path", "length")
    name = F.regexp_extract("path", r"/([A-Za-z_]+)\.parquet", 1)
    return files.groupBy(name.alias("table")).agg(F.sum("length").alias("bytes")).withColumn("mb", F.bround(F.col("bytes") / 1048576, 2))
