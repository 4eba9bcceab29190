"""Problem 4: lines repeated across the documents of one site.

The lines of a site form a weighted graph: a node is a line (its letters and
combining marks, lower-cased), an edge joins two lines that follow each other;
weights count distinct pages. Nodes and edges of high support stay, connected
components are boilerplate blocks, and every occurrence of a block's line is
deleted.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from weftlight.llm.common import unique_by
from weftlight.plans.joins import sized_join
from weftlight.plans.lineage import checkpointed, written
from weftlight.plans.spread import spread

#: Pages of a site that a line or a pair of lines must stand on.
MIN_PAGES = 8
#: Edges of a site up to which its components are found in one task.
SITE_EDGES = 200_000


def line_key(line: Column) -> Column:
    """Hash of a line's letters and marks, lower-cased; 0 for a line without letters."""
    letters = F.regexp_replace(F.lower(line), r"[^\p{L}\p{M}]+", "")
    return F.when(letters == "", F.lit(0).cast("long")).otherwise(F.xxhash64(letters))


def page_lines(pages: DataFrame) -> DataFrame:
    """(page_id, website_id, keys): the line keys of each page's content, in order.

    Rows with a null id, website_id or content take no part; a page delivered twice counts once.
    """
    plain = unique_by(spread(pages.select(F.col("id").alias("page_id"), "website_id", "content")), "page_id")
    plain = plain.filter("website_id is not null and content is not null")
    return plain.select("page_id", "website_id", F.transform(F.split("content", "\n", -1), line_key).alias("keys"))


def supported_lines(lines: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(website_id, line, pages): lines on at least ``min_pages`` pages of their site."""
    each = lines.select("website_id", F.explode(F.array_distinct("keys")).alias("line")).filter("line <> 0")
    return each.groupBy("website_id", "line").agg(F.count("*").alias("pages")).filter(F.col("pages") >= min_pages)


def supported_edges(lines: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(website_id, a, b, pages): lines that follow each other on at least ``min_pages`` pages."""
    real = F.filter("keys", lambda k: k != 0)
    pairs = F.zip_with(F.slice("real", 1, F.greatest(F.size("real") - 1, F.lit(0))), F.slice("real", 2, F.greatest(F.size("real") - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    each = (
        lines.select("website_id", real.alias("real")).filter(F.size("real") > 1)
        .select("website_id", F.explode(F.array_distinct(pairs)).alias("e"))
        .select("website_id", F.col("e.a").alias("a"), F.col("e.b").alias("b")).filter("a <> b")
    )
    return each.groupBy("website_id", "a", "b").agg(F.count("*").alias("pages")).filter(F.col("pages") >= min_pages)


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for the edges a-b."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        fresh = label.copy()
        np.minimum.at(fresh, left, low)
        np.minimum.at(fresh, right, low)
        np.minimum.at(fresh, label[left], low)
        np.minimum.at(fresh, label[right], low)
        fresh = fresh[fresh]
        if (fresh == label).all():
            return nodes, nodes[label]
        label = fresh


def components(edges: DataFrame, site_edges: int = SITE_EDGES) -> DataFrame:
    """(website_id, line, block): the connected component of each line that has an edge.

    Components never cross sites. The edges of a site meet in one task while they
    are at most ``site_edges``; larger sites are spread over several tasks, each of
    which leaves a forest, and the forests are joined by rounds of least labels.
    """
    edges = edges.select("website_id", "a", "b")
    sizes = edges.groupBy("website_id").agg(F.count("*").alias("n")).filter(F.col("n") > site_edges)
    large = sizes.count()

    def local(frame: pd.DataFrame) -> pd.DataFrame:
        node, block = _forest(frame["a"].to_numpy(), frame["b"].to_numpy())
        return pd.DataFrame({"website_id": frame["website_id"].iloc[0], "line": node, "block": block})

    schema = "website_id long, line long, block long"
    typed = edges.withColumn("website_id", F.col("website_id").cast("long")).filter("website_id is not null")
    if not large:
        return typed.groupBy("website_id").applyInPandas(local, schema)
    # fewer than one site for each site_edges edges
    marked = sized_join(typed, sizes.select(F.col("website_id").cast("long").alias("website_id"), F.lit(True).alias("big")), ["website_id"], "left", right_rows=large)
    spread = marked.withColumn("_s", F.when(F.col("big"), F.pmod(F.xxhash64("a", "b"), F.lit(64))).otherwise(0)).drop("big")
    forest = written(spread.groupBy("website_id", "_s").applyInPandas(local, schema), "line-forests")
    label = checkpointed(forest.groupBy("website_id", "line").agg(F.min("block").alias("block")))
    links = checkpointed(forest.select("website_id", F.col("line").alias("a"), F.col("block").alias("b")).filter("a <> b").distinct())
    both = links.union(links.select("website_id", F.col("b").alias("a"), F.col("a").alias("b")))
    while True:
        near = both.join(label.withColumnRenamed("line", "b"), ["website_id", "b"]).select("website_id", F.col("a").alias("line"), "block")
        least = near.union(label).groupBy("website_id", "line").agg(F.min("block").alias("block"))
        jump = least.select("website_id", F.col("line").alias("block"), F.col("block").alias("next"))
        fresh = checkpointed(least.join(jump, ["website_id", "block"], "left").select("website_id", "line", F.coalesce(F.least("block", "next"), "block").alias("block")))
        moved = fresh.join(label.withColumnRenamed("block", "old"), ["website_id", "line"]).filter("block <> old").limit(1).count()
        label = fresh
        if not moved:
            return label


def boilerplate_blocks(lines: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(website_id, line, pages, block): supported lines with their block; a line without a supported edge is its own block."""
    nodes = supported_lines(lines, min_pages)
    inside = components(written(supported_edges(lines, min_pages), "line-edges"))
    # both sides hold supported lines only, a small part of all lines
    return (
        nodes.withColumn("website_id", F.col("website_id").cast("long")).join(inside, ["website_id", "line"], "left")
        .withColumn("block", F.coalesce("block", "line"))
    )


def repeated_occurrences(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """(page_id, line_no, website_id, block): where the lines of the blocks stand; line_no counts from 0."""
    each = lines.select("page_id", F.col("website_id").cast("long").alias("website_id"), F.posexplode("keys").alias("line_no", "line")).filter("line <> 0")
    return sized_join(each, blocks.select("website_id", "line", "block"), ["website_id", "line"]).select("page_id", "line_no", "website_id", "block")


def without_repeated_lines(pages: DataFrame, occurrences: DataFrame) -> DataFrame:
    """(page_id, content, lines_removed): each page's content without its repeated lines.

    Null contents stay null; a page whose lines are all repeated gets an empty text.
    """
    # at most the lines of one page
    gone = occurrences.groupBy("page_id").agg(F.collect_set("line_no").alias("gone"))
    plain = unique_by(pages.select(F.col("id").alias("page_id"), "content"), "page_id")
    kept = F.filter(F.transform(F.split("content", "\n", -1), lambda line, i: F.struct(line.alias("line"), i.alias("i"))), lambda s: ~F.array_contains(F.col("gone"), s["i"]))
    joined = plain.join(gone, "page_id", "left")
    return joined.select(
        "page_id",
        F.when(F.col("gone").isNull(), F.col("content")).otherwise(F.array_join(F.transform(kept, lambda s: s["line"]), "\n")).alias("content"),
        F.coalesce(F.size("gone"), F.lit(0)).alias("lines_removed"),
    )


def stored_lines_and_blocks(pages: DataFrame, min_pages: int = MIN_PAGES) -> tuple[DataFrame, DataFrame]:
    """The lines of all pages and their blocks; the blocks are kept as a table."""
    lines = page_lines(pages)
    return lines, written(boilerplate_blocks(lines, min_pages), "line-blocks")
