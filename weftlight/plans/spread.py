"""Spreading few splits over all cores."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(scan: DataFrame) -> DataFrame:
    """``scan`` in at least as many partitions as there are cores.

    A small file is one split, whatever work follows. Where a scan (a read with
    projections and filters) has fewer splits than the cluster has cores, its rows
    are dealt out evenly; a larger table has more splits and is left alone, without a shuffle.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
