"""Shared small pieces of the operators for training text."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def unique_by(df: DataFrame, key: str) -> DataFrame:
    """``df`` with rows of a null ``key`` left out and each key once.

    Of rows with the same key the one counts whose other columns, in order, are
    largest (nulls are smallest). Only the keys are counted first; the wide rows
    are shuffled solely if a key does occur more than once.
    """
    df = df.filter(F.col(key).isNotNull())
    repeated = df.groupBy(key).count().filter("count > 1").limit(1).count()
    if not repeated:
        return df
    others = [c for c in df.columns if c != key]
    if not others:
        return df.distinct()
    best = df.groupBy(key).agg(F.max(F.struct(*others)).alias("_best"))
    return best.select(*[key if c == key else F.col("_best")[c].alias(c) for c in df.columns])
