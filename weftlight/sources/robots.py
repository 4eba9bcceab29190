"""robots.txt rules of many sites."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from weftlight.functions import url as U
from weftlight.plans.joins import sized_join

AGENT, DEFAULT_DELAY = "*", 0.2


def rules(text: str | None) -> RobotFileParser:
    """The rules of a robots.txt; none (all allowed) where it is missing."""
    parser = RobotFileParser()
    parser.parse((text or "").splitlines())
    return parser


def permissions(urls: DataFrame, robots: DataFrame, agent: str = AGENT, default: float = DEFAULT_DELAY) -> DataFrame:
    """(url, allowed, delay) of (url) by (domain, robots_txt).

    A site without a robots.txt allows all. A delay that is missing, 0 or no whole number is the default.
    """
    keyed = urls.select("url", U.authority(F.col("url")).alias("domain"))
    files = robots.groupBy("domain").agg(F.first("robots_txt", ignorenulls=True).alias("robots_txt"))
    joined = sized_join(keyed, files, ["domain"], "left")

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, RobotFileParser] = {}
        for frame in batches:
            allowed, delay = [], []
            for url, text in zip(frame["url"], frame["robots_txt"], strict=True):
                key = text or ""
                if key not in known:
                    if len(known) > 10_000:
                        known.clear()
                    known[key] = rules(text)
                found = known[key]
                allowed.append(found.can_fetch(agent, url or ""))
                delay.append(float(found.crawl_delay(agent) or 0) or default)
            yield pd.DataFrame({"url": frame["url"], "allowed": allowed, "delay": delay})

    return joined.mapInPandas(judge, "url string, allowed boolean, delay double")


def addresses(urls: DataFrame) -> DataFrame:
    """(url, etag, last_modified): the robots.txt of each site in ``urls``, as the page source reads them."""
    sites = urls.select(U.robots_of(F.col("url")).alias("url")).filter(U.authority(F.col("url")) != "").distinct()
    return sites.withColumn("etag", F.lit(None).cast("string")).withColumn("last_modified", F.lit(None).cast("string"))


def from_fetches(fetched: DataFrame) -> DataFrame:
    """(domain, robots_txt) of fetched robots.txt files; anything but a 200 means no rules."""
    return fetched.select(U.authority(F.col("url")).alias("domain"), F.when(F.col("status_code") == 200, F.col("html")).alias("robots_txt"))
