"""Figures about the corpus, the crawl and the query log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


#: Ranges of values in which ranks are counted.
RANGES = 64


def corpus_counts(pages: DataFrame, websites: DataFrame, words: DataFrame, links: DataFrame, history: DataFrame) -> DataFrame:
    """One row of counts, and links per page rounded to two digits."""
    parts = {"pages": pages, "websites": websites, "words": words, "links": links, "searches": history}
    out = None
    for name, df in parts.items():
        one = df.agg(F.count("id").alias(name))
        out = one if out is None else out.crossJoin(one)  # rows of one aggregate each
    return out.withColumn("links_per_page", F.bround(F.col("links") / F.greatest("pages", F.lit(1)), 2))


def queue_counts(queue: DataFrame) -> DataFrame:
    """One row: tasks by status, all tasks, and progress in percent."""
    c = lambda s: F.count_if(F.col("status") == s).alias(s)
    done = F.col("completed") + F.col("failed")
    return queue.agg(c("pending"), c("crawling"), c("completed"), c("failed"), F.count("*").alias("total")).withColumn(
        "progress", F.when(F.col("total") > 0, F.bround(done / F.col("total") * 100, 1)).otherwise(0.0)
    )


def top_domains(pages: DataFrame, websites: DataFrame, k: int = 5) -> DataFrame:
    """(domain, pages) of the k sites with most pages; pages are counted before the join."""
    sizes = pages.groupBy(F.col("website_id").alias("id")).agg(F.count("*").alias("pages"))
    return websites.join(sizes, "id").groupBy("domain").agg(F.sum("pages").alias("pages")).orderBy(F.desc("pages"), F.asc("domain")).limit(k)


def pages_per_site(pages: DataFrame, websites: DataFrame) -> DataFrame:
    """(id, domain, pages) of every site, newest first."""
    sizes = pages.groupBy(F.col("website_id").alias("id")).agg(F.count("*").alias("pages"))
    return websites.join(sizes, "id", "left").select("id", "domain", F.coalesce("pages", F.lit(0)).alias("pages")).orderBy(F.desc("id"))


def top_queries(history: DataFrame, k: int = 5) -> DataFrame:
    """(query, searches) of the k most frequent queries."""
    return history.filter("query is not null").groupBy("query").agg(F.count("*").alias("searches")).orderBy(F.desc("searches"), F.asc("query")).limit(k)


def status_histogram(pages: DataFrame) -> DataFrame:
    """(status, fetches): 200, 304, redirect, 404, server error, and everything else."""
    s = F.col("status_code")
    kind = F.when(s == 200, "200").when(s == 304, "304").when(s.isin(301, 302), "redirect").when(s == 404, "404").when(s >= 500, "5xx").otherwise("other")
    return pages.groupBy(kind.alias("status")).agg(F.count("*").alias("fetches"))


def latency(events: DataFrame, value: str) -> DataFrame:
    """One row: mean, least, most, median, 95th and 99th of a column, rounded to two digits.

    Percentiles are the element int(n p) of the sorted values. Their ranks are
    found without one global sort: values are counted, and the counts of equal
    values are summed over ranges of about as many different values.
    """
    values = events.select(F.col(value).cast("double").alias("v")).filter("v is not null and not isnan(v)")
    counts = values.groupBy("v").agg(F.count("*").alias("n"))
    bounds = counts.agg(F.percentile_approx("v", [i / RANGES for i in range(1, RANGES)])).first()[0] or []
    ranged = counts.withColumn("_b", F.size(F.filter(F.array(*[F.lit(x) for x in bounds]).cast("array<double>"), lambda x: x <= F.col("v"))))
    blocks = ranged.groupBy("_b").agg(F.sum("n").alias("bn"))  # a bounded number of ranges
    before = blocks.select("_b", F.coalesce(F.sum("bn").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    upto = ranged.join(F.broadcast(before), "_b").withColumn("_c", F.col("_before") + F.sum("n").over(Window.partitionBy("_b").orderBy("v")))
    total = counts.agg(F.sum("n").alias("_n"), F.min("v").alias("least"), F.max("v").alias("most"), (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean"))
    def at(rank):
        # the value whose running count first passes the rank
        return F.min(F.when(F.col("_c") > rank, F.col("v")))
    placed = upto.crossJoin(F.broadcast(total))  # one row
    n = F.col("_n")
    middle = (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2
    return placed.agg(
        F.bround(F.first("mean"), 2).alias("mean"), F.bround(F.first("least"), 2).alias("least"), F.bround(F.first("most"), 2).alias("most"), F.bround(middle, 2).alias("median"),
        F.bround(at(F.least(F.floor(n * 0.95), n - 1)), 2).alias("p95"), F.bround(at(F.least(F.floor(n * 0.99), n - 1)), 2).alias("p99"), F.first("_n").alias("n"),
    )


def averages(log: DataFrame, value: str, scale: float, digits: int) -> DataFrame:
    """One row: count, sum and mean of a column times ``scale``; 0 for an empty log."""
    return log.agg(F.count(value).alias("n"), F.coalesce(F.sum(value), F.lit(0.0)).alias("s")).select(
        "n", F.bround(F.col("s") / F.greatest("n", F.lit(1)) * scale, digits).alias("mean")
    )


def success_rate(log: DataFrame, ok: str) -> DataFrame:
    """One row: successes in percent and the mean value of a success."""
    good = F.expr(ok)
    return log.agg(F.count("*").alias("n"), F.count_if(good).alias("ok"), F.avg(F.when(good, F.col("value"))).alias("m")).select(
        "n", "ok", F.bround(F.col("ok") / F.greatest("n", F.lit(1)) * 100, 2).alias("success_percent"), F.bround("m", 2).alias("mean_of_successes")
    )


def cache_efficiency(log: DataFrame) -> DataFrame:
    """One row: crawled, skipped, visited; share of skipped fetches in percent; addresses that deduplication kept away."""
    sums = log.agg(F.count_if(F.col("status_code") == 200).alias("crawled"), F.count_if(F.col("status_code") == 304).alias("skipped"), F.countDistinct("url").alias("visited"))
    seen = F.col("crawled") + F.col("skipped")
    return sums.withColumns({
        "hit_percent": F.when(seen > 0, F.bround(F.col("skipped") / seen * 100, 2)).otherwise(0.0),
        "dedup_skips": F.greatest(F.lit(0), F.col("visited") - seen),
    })


def throughput(log: DataFrame, time: str, window: str = "1 day") -> DataFrame:
    """(start, pages, pages_per_min) of fixed windows of crawl time."""
    minutes = (F.unix_timestamp("w.end") - F.unix_timestamp("w.start")) / 60
    return log.filter(F.col(time).isNotNull()).groupBy(F.window(time, window).alias("w")).agg(F.count("*").alias("pages")).select(
        F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "pages", F.bround(F.col("pages") / minutes, 4).alias("pages_per_min")
    )


def cardinalities(visited: DataFrame, queue: DataFrame, workers: DataFrame) -> DataFrame:
    """One row: distinct visited addresses, waiting tasks, distinct workers; exact."""
    return (
        visited.agg(F.countDistinct("url").alias("visited"))
        .crossJoin(queue.agg(F.count_if(F.col("status") == "pending").alias("waiting")))  # one row each
        .crossJoin(workers.agg(F.countDistinct("worker").alias("workers")))
    )


def suggestions(words: DataFrame, history: DataFrame, prefix: str, each: int = 5, k: int = 8) -> DataFrame:
    """(suggestion): words and past queries that begin with a prefix.

    The prefix is trimmed and lower-cased; % and _ in it are wildcards; past
    queries are compared as they were typed. In text order where the limit cuts.
    """
    pattern = prefix.strip().lower() + "%"
    from_words = words.filter(F.col("word").like(pattern)).select(F.col("word").alias("suggestion")).orderBy("suggestion").limit(each)
    from_log = history.filter(F.col("query").like(pattern)).select(F.col("query").alias("suggestion")).distinct().orderBy("suggestion").limit(each)
    return from_words.union(from_log).distinct().orderBy("suggestion").limit(k)
