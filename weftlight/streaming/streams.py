"""Streams over append-only folders: visited addresses, heartbeats, query log, politeness."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def folder_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 16) -> DataFrame:
    """New parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def new_addresses(tasks: DataFrame, time: str = "ts", within: str = "1 day") -> DataFrame:
    """Each address once: those seen within the watermark are dropped, state is bounded by it."""
    return tasks.withWatermark(time, within).dropDuplicatesWithinWatermark(["url"])


def heartbeats(pings: DataFrame, ttl: str = "15 seconds", late: str = "30 seconds") -> DataFrame:
    """(start, active_workers) of each window of the heartbeat's life; each worker counts once.

    Two stateful steps: the workers of a window, then their number.
    """
    each = pings.withWatermark("ts", late).groupBy(F.window("ts", ttl).alias("w"), "worker").agg(F.lit(1).alias("one"))
    return each.groupBy("w").agg(F.count("worker").alias("active_workers")).select(F.col("w.start").alias("start"), "active_workers")


def query_counts(log: DataFrame, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """(start, query, searches): the query log by day."""
    return (
        log.withWatermark("searched_at", late).groupBy(F.window("searched_at", window).alias("w"), "query")
        .agg(F.count("*").alias("searches")).select(F.col("w.start").alias("start"), "query", "searches")
    )


def polite(tasks: DataFrame, default_delay: float = 0.2, late: str = "1 hour", idle_s: float = 3600.0) -> DataFrame:
    """(domain, url, fetch_at): a domain's fetches keep its delay, in the order of their times, across batches.

    ``tasks``: (domain, url, ts, delay). The state of a domain is one time stamp; it
    is dropped once the watermark is ``idle_s`` past it. The tasks of a domain in
    one batch are ordered as a whole; a batch is bounded by its files. Null domains
    and times take no part.
    """
    def space(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        ready = state.get[0] if state.exists else float("-inf")
        frame = pd.concat([f for f in frames if len(f)]).sort_values(["ts", "url"])
        times = []
        for ts, delay in zip(frame["ts"], frame["delay"], strict=True):
            at = max(ts.timestamp(), ready)
            ready = at + (float(delay) if delay and delay > 0 else default_delay)
            times.append(at)
        state.update((ready,))
        state.setTimeoutTimestamp(max(int((ready + idle_s) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"domain": key[0], "url": frame["url"].to_numpy(), "fetch_at": pd.to_datetime(times, unit="s").round("us")})

    timed = tasks.filter("domain is not null and ts is not null").withWatermark("ts", late)
    return timed.groupBy("domain").applyInPandasWithState(
        space, "domain string, url string, fetch_at timestamp", "ready double", "append", GroupStateTimeout.EventTimeTimeout
    )


def drained(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over what is there now into a parquet folder, and ends."""
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
