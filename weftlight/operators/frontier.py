"""The crawl frontier as functions from snapshot to snapshot.

A queue is (id, url, status, depth, priority); statuses are pending, crawling,
completed and failed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from weftlight.functions import url as U

MAX_DEPTH, SEED_PRIORITY, RECRAWL_PRIORITY = 3, 10, 5
DEFAULT_DELAY, HEARTBEAT_TTL = 0.2, 15


def normalised_seeds(seeds: DataFrame, visited: DataFrame) -> DataFrame:
    """(raw, url, domain, accepted, reason) of entered seeds; reasons are added, invalid and visited."""
    full = seeds.select(F.col("url").alias("raw"), U.seed(F.col("url")).alias("url"))
    seen = visited.select("url").distinct().withColumn("_seen", F.lit(True))
    reason = F.when(F.col("url").isNull(), "invalid").when(F.col("_seen"), "visited").otherwise("added")
    return full.join(seen, "url", "left").select("raw", "url", U.authority(F.col("url")).alias("domain"), (reason == "added").alias("accepted"), reason.alias("reason"))


def popped(queue: DataFrame, k: int) -> DataFrame:
    """The k pending tasks that come next: higher priority first, then the smaller id."""
    return queue.filter("status = 'pending'").orderBy(F.desc("priority"), F.asc("id")).limit(k)


def flushed(queue: DataFrame) -> DataFrame:
    """The queue after a start from nothing: its columns, and no task."""
    return queue.limit(0)


def with_status(queue: DataFrame, ids: DataFrame, status: str) -> DataFrame:
    """The queue with the tasks of ``ids`` set to a status."""
    hit = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    return queue.join(hit, "id", "left").withColumn("status", F.when(F.col("_hit"), F.lit(status)).otherwise(F.col("status"))).drop("_hit")


def unvisited(tasks: DataFrame, visited: DataFrame) -> DataFrame:
    """The tasks whose address was not visited, each address once (the task of highest priority, then smallest depth)."""
    fresh = tasks.filter("url is not null").join(visited.select("url"), "url", "left_anti")
    best = fresh.groupBy("url").agg(F.max(F.struct("priority", (-F.col("depth")).alias("_d"))).alias("b"))
    return best.select("url", (-F.col("b._d")).alias("depth"), F.col("b.priority").alias("priority"))


def child_tasks(links: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(url, depth, priority, domain) of the links found on fetched pages: one deeper, one less urgent, never below 0.

    ``links``: (target, depth, priority) with the depth and priority of the page.
    """
    deeper = links.filter(F.col("depth") + 1 <= max_depth)
    return deeper.select(
        F.col("target").alias("url"), (F.col("depth") + 1).alias("depth"), F.greatest(F.col("priority") - 1, F.lit(0)).alias("priority"),
        U.authority(F.col("target")).alias("domain"),
    )


def crawl_round(tasks: DataFrame, pages: DataFrame, visited: DataFrame, max_depth: int = MAX_DEPTH) -> tuple[DataFrame, DataFrame]:
    """(fetched pages, next tasks): one breadth-first round over stored pages instead of the network."""
    from weftlight.operators.graph import extracted_links

    due = tasks.filter(F.col("depth") <= max_depth)
    fetched = pages.join(due, "url")
    links = extracted_links(fetched).join(fetched.select(F.col("id").alias("src"), "depth", "priority"), "src").select("target", "depth", "priority")
    return fetched, unvisited(child_tasks(links, max_depth), visited.select("url").unionByName(due.select("url")))


def outcome(status: Column, known: Column, same_hash: Column) -> Column:
    """What a fetch means: skipped, updated, duplicate, new, redirect, missing, error or none."""
    return (
        F.when(status == 304, F.when(known, "skipped").otherwise("none"))
        .when(status.isin(301, 302), "redirect")
        .when(status == 200, F.when(same_hash, "duplicate").when(known, "updated").otherwise("new"))
        .when(status == 404, "missing").otherwise("error")
    )


def classified(fetches: DataFrame, stored: DataFrame) -> DataFrame:
    """(url, status_code, page_hash, outcome) of fetched pages against the stored snapshot.

    A page whose hash another address already has is a duplicate; among new pages
    with the same hash the smallest id is the first. ``fetches``: (id, url, status_code, page_hash).
    """
    known = stored.select("url", F.lit(True).alias("_known")).distinct()
    hashes = stored.filter("page_hash is not null").groupBy("page_hash").agg(F.min("url").alias("_low"), F.max("url").alias("_high"))
    first = fetches.filter("status_code = 200 and page_hash is not null").groupBy("page_hash").agg(F.min("id").alias("_first"))
    joined = fetches.join(known, "url", "left").join(hashes, "page_hash", "left").join(first, "page_hash", "left")
    elsewhere = F.col("_low").isNotNull() & ((F.col("_low") != F.col("url")) | (F.col("_high") != F.col("url")))
    later = F.col("_known").isNull() & F.col("page_hash").isNotNull() & (F.col("id") > F.col("_first"))
    is_known = F.coalesce("_known", F.lit(False))
    result = outcome(F.col("status_code"), is_known, F.coalesce(elsewhere | later, F.lit(False)))
    return joined.select("id", "url", "status_code", "page_hash", F.coalesce(result, F.lit("error")).alias("outcome"))


def merged_pages(stored: DataFrame, fetched: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The page snapshot after a round: updated pages replaced, new pages appended, last_checked set on all that were seen.

    ``fetched`` has the columns of ``stored``.
    """
    told = outcomes.select("url", "outcome")
    seen = told.filter("outcome in ('skipped', 'updated')").select("url", "outcome").distinct()
    news = fetched.join(told.filter("outcome in ('updated', 'new')"), "url").drop("outcome")
    now = fetched.groupBy("url").agg(F.max("crawl_time").alias("_now"))
    kept = stored.join(seen.filter("outcome = 'updated'").select("url"), "url", "left_anti").join(seen.join(now, "url").select("url", "_now"), "url", "left")
    kept = kept.withColumn("last_checked", F.coalesce("_now", "last_checked")).drop("_now")
    return kept.select(*stored.columns).unionByName(news.select(*stored.columns))


def redirected(fetches: DataFrame) -> DataFrame:
    """(url, depth, priority): absolute targets of redirects, at the same depth and priority."""
    moved = fetches.filter(F.col("status_code").isin(301, 302) & F.col("location").isNotNull())
    return moved.select(U.resolve(F.col("url"), F.col("location")).alias("url"), "depth", "priority")


def schedule(tasks: DataFrame, delays: DataFrame, default: float = DEFAULT_DELAY) -> DataFrame:
    """``tasks`` with wait_s, the seconds after the start at which politeness allows the fetch.

    The n-th task of a domain waits n times its delay; a delay of 0 or null is the
    default. The order of a domain is found in two levels, blocks of consecutive
    priorities and ids first, so a domain with a third of all tasks is no single task.
    """
    block = F.floor(F.col("id") / 4096)
    keyed = tasks.withColumn("_b", block)
    sizes = keyed.groupBy("domain", "priority", "_b").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("domain").orderBy(F.desc("priority"), F.asc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("domain", "priority", "_b", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("domain", "priority", "_b").orderBy("id")
    told = delays.groupBy("domain").agg(F.max("crawl_delay").alias("_delay"))
    delay = F.when(F.coalesce("_delay", F.lit(0)) > 0, F.col("_delay").cast("double")).otherwise(default)
    return (
        keyed.withColumn("_i", F.row_number().over(inside)).join(before, ["domain", "priority", "_b"]).join(told, "domain", "left")
        .withColumn("wait_s", F.round((F.col("_before") + F.col("_i") - 1) * delay, 3)).drop("_b", "_i", "_before", "_delay")
    )


def recrawl(pages: DataFrame) -> DataFrame:
    """(url, depth, priority): every stored page again."""
    return pages.filter("url is not null").select("url", F.lit(0).alias("depth"), F.lit(RECRAWL_PRIORITY).alias("priority"))


def uncrawled_sites(websites: DataFrame, pages: DataFrame) -> DataFrame:
    """(id, domain, url): sites without a page, with the root address to start from."""
    return websites.join(pages.select(F.col("website_id").alias("id")), "id", "left_anti").select("id", "domain", U.root_of(F.col("domain")).alias("url"))


def recovered(queue: DataFrame, websites: DataFrame, pages: DataFrame, visited: DataFrame) -> DataFrame:
    """(url, depth, priority) to push after a restart: unvisited pending and interrupted tasks, and roots of sites without pages."""
    open_ = queue.filter("status in ('pending', 'crawling')").select("url", "depth", "priority")
    roots = uncrawled_sites(websites, pages).select("url", F.lit(0).alias("depth"), F.lit(SEED_PRIORITY).alias("priority"))
    return unvisited(open_.unionByName(roots), visited)


def seed_prefixes(domain: str) -> list[str]:
    return [f"{s}{w}{domain}" for s in ("http://", "https://") for w in ("", "www.")]


def without_seed(domain: str, *, queue: DataFrame, websites: DataFrame, pages: DataFrame, links: DataFrame, index: DataFrame, embeddings: DataFrame) -> dict[str, DataFrame]:
    """All tables after a seed is deleted: its queue rows (by address prefix), site, pages, links, postings and vectors."""
    under = F.lit(False)
    for prefix in seed_prefixes(domain):
        under = under | F.col("url").like(prefix + "%")
    sites = websites.filter(F.col("domain") == domain).select(F.col("id").alias("website_id"))
    gone = pages.join(sites, "website_id", "left_semi").select(F.col("id").alias("page_id"))
    return {
        "queue": queue.filter(~F.coalesce(under, F.lit(False))),
        "websites": websites.filter(F.coalesce(F.col("domain") != domain, F.lit(True))),
        "pages": pages.join(gone.withColumnRenamed("page_id", "id"), "id", "left_anti"),
        "links": links.join(gone.withColumnRenamed("page_id", "source_page"), "source_page", "left_anti").join(gone.withColumnRenamed("page_id", "destination_page"), "destination_page", "left_anti").select(*links.columns),
        "inverted_index": index.join(gone, "page_id", "left_anti").select(*index.columns),
        "page_embeddings": embeddings.join(gone, "page_id", "left_anti").select(*embeddings.columns),
    }


def first_of_content(pages: DataFrame) -> DataFrame:
    """(page_hash, id, copies): the first page of each content; pages without a hash are left out."""
    return pages.filter("page_hash is not null").groupBy("page_hash").agg(F.min("id").alias("id"), F.count("*").alias("copies"))


def active_workers(pings: DataFrame, now: Column, ttl: int = HEARTBEAT_TTL) -> DataFrame:
    """(active_workers): workers with a ping in the last ``ttl`` seconds."""
    last = pings.filter("worker is not null").groupBy("worker").agg(F.max("ts").alias("last"))
    return last.agg(F.count_if(F.col("last") >= now - F.expr(f"INTERVAL {ttl} SECONDS")).alias("active_workers"))


def task_json(tasks: DataFrame) -> DataFrame:
    """(id, task): tasks as the JSON texts that a queue carries."""
    return tasks.select("id", F.to_json(F.struct("url", "depth", "priority")).alias("task"))


def from_task_json(texts: DataFrame) -> DataFrame:
    """(id, url, depth, priority) from JSON texts; malformed ones give nulls."""
    return texts.select("id", F.from_json("task", "url string, depth int, priority int").alias("t")).select("id", "t.*")
