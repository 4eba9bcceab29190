"""The link graph and PageRank."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, functions as F

from weftlight.functions import html, url as U
from weftlight.plans.joins import sized_join
from weftlight.plans.lineage import written
from weftlight.plans.spread import spread

DAMPING, MAX_ITERATIONS, TOLERANCE = 0.85, 50, 1e-6


def known_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges whose two ends are nodes; a node with a large part of all edges is met by many tasks."""
    ids = nodes.select("id").filter("id is not null")
    count = ids.count()
    for end in ("src", "dst"):
        edges = sized_join(edges, ids.withColumnRenamed("id", end), [end], "left_semi", right_rows=count)
    return edges.select("src", "dst")


def link_edges(links: DataFrame, pages: DataFrame) -> DataFrame:
    """(src, dst): each stored link once, without self-links and unknown pages."""
    plain = links.select(F.col("source_page").alias("src"), F.col("destination_page").alias("dst")).filter("src <> dst")
    return known_edges(plain.dropDuplicates(["src", "dst"]), pages)


def extracted_links(pages: DataFrame) -> DataFrame:
    """(src, target): the distinct addresses each page links to."""
    return spread(pages.filter("html is not null").select("id", "url", "html")).select(F.col("id").alias("src"), F.explode(html.links(F.col("html"), F.col("url"))).alias("target"))


def resolved_edges(pages: DataFrame, as_of_crawl: bool = False) -> DataFrame:
    """(src, dst) from the html: links to stored pages by address without fragment.

    Addresses that several pages share lead to the smallest id. ``as_of_crawl``
    keeps only links to pages that were stored before.
    """
    known = pages.groupBy(U.without_fragment(F.col("url")).alias("target")).agg(F.min("id").alias("dst"))
    found = sized_join(extracted_links(pages), known, ["target"]).filter("src <> dst").select("src", "dst").distinct()
    return found.filter("dst < src") if as_of_crawl else found


def out_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.count("*").alias("out_degree"))


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The nodes without an outgoing edge."""
    return nodes.select("id").join(edges.select(F.col("src").alias("id")), "id", "left_anti")


@dataclass(frozen=True)
class Ranking:
    """Raw ranks, and how they came about."""

    ranks: DataFrame
    pages: int
    edges: int
    iterations: int
    converged: bool
    largest: float

    def normalised(self, digits: int = 8) -> DataFrame:
        """(id, pagerank): divided by the largest rank."""
        return self.ranks.select("id", F.bround(F.col("rank") / F.lit(self.largest or 1.0), digits).alias("pagerank"))

    def stats(self) -> dict:
        """The run in figures; an empty graph has no count of edges."""
        if not self.pages:
            return {"pages_computed": 0, "iterations": 0, "converged": False}
        return {"pages_computed": self.pages, "link_edges": self.edges, "iterations": self.iterations, "converged": self.converged, "max_raw_score": self.largest}


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = DAMPING, max_iterations: int = MAX_ITERATIONS, tolerance: float = TOLERANCE) -> Ranking:
    """PageRank with the mass of dangling nodes spread evenly.

    Repeated edges and self-loops count; edges to unknown nodes do not. Edges
    stay partitioned by their source, so a round shuffles only the ranks and the
    map-side combined sums (a page with a seventh of all links is one key of
    those). Each round's ranks are a small written table, so plans stay flat and a
    lost executor costs one round; the change and the dangling mass are observed
    while it is written.
    """
    nodes = nodes.select("id").filter("id is not null").distinct()
    inside = known_edges(edges.select("src", "dst"), nodes)
    table = written(inside.join(out_degree(inside), "src").select("src", "dst", (F.lit(1.0) / F.col("out_degree")).alias("share")), "rank-edges")
    count, links = nodes.count(), table.count()
    if not count:
        return Ranking(nodes.withColumn("rank", F.lit(0.0)), 0, 0, 0, False, 0.0)
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    weighted = table.repartition(parts, "src").persist(StorageLevel.MEMORY_AND_DISK)
    leaves = dangling(nodes, table).withColumn("leaf", F.lit(True))
    start = nodes.join(leaves, "id", "left").select("id", F.lit(1.0 / count).alias("rank"), F.coalesce("leaf", F.lit(False)).alias("leaf"), F.lit(0.0).alias("old"))
    state = written(start, "ranks")
    lost = state.filter("leaf").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
    turn, converged, largest = 0, False, 1.0 / count
    while turn < max_iterations and not converged:
        turn += 1
        inflow = weighted.join(state.select(F.col("id").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("share")).alias("inflow"))
        base = (1.0 - damping) / count + damping * lost / count
        seen = Observation()  # taken while the round is written; no job of its own
        fresh = (
            state.select("id", F.col("rank").alias("old"), "leaf").join(inflow, "id", "left")
            .select("id", (F.lit(base) + F.lit(damping) * F.coalesce("inflow", F.lit(0.0))).alias("rank"), "leaf", "old")
            .observe(seen, F.sum(F.abs(F.col("rank") - F.col("old"))).alias("change"), F.sum(F.when(F.col("leaf"), F.col("rank"))).alias("lost"), F.max("rank").alias("largest"))
        )
        state = written(fresh, "ranks")
        change, lost, largest = seen.get["change"], seen.get["lost"] or 0.0, seen.get["largest"]
        converged = change < tolerance
    weighted.unpersist()
    return Ranking(state.select("id", "rank"), count, links, turn, converged, largest)


def ranked_pages(pages: DataFrame, normalised: DataFrame) -> DataFrame:
    """``pages`` with their new pagerank; pages that were not ranked keep theirs."""
    fresh = normalised.select("id", F.col("pagerank").alias("_new"))
    return pages.join(fresh, "id", "left").withColumn("pagerank", F.coalesce("_new", "pagerank")).drop("_new")
