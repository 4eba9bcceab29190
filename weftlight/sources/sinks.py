"""Writing snapshots and append-only logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def write_snapshot(df: DataFrame, path: str) -> None:
    """Replaces a table by a new snapshot."""
    df.write.mode("overwrite").parquet(path)


def append(df: DataFrame, path: str) -> None:
    """Adds rows to an append-only table, such as the query log."""
    df.write.mode("append").parquet(path)


def write_postings(index: DataFrame, path: str, buckets: int = 64) -> None:
    """Postings partitioned by a hash of the word and sorted, so that a query reads few row groups."""
    placed = index.withColumn("bucket", F.pmod(F.xxhash64("word"), F.lit(buckets)).cast("int"))
    placed.repartition(buckets, "bucket").sortWithinPartitions("bucket", "word", "page_id").write.mode("overwrite").partitionBy("bucket").parquet(path)


def write_postings_table(index: DataFrame, table: str, buckets: int = 64) -> None:
    """Postings as a bucketed table: joins on the word need no shuffle of this side."""
    index.write.mode("overwrite").bucketBy(buckets, "word").sortBy("word").saveAsTable(table)
