"""Problem 5: how distinctive a word is of its page (residual inverse document frequency).

For each word the observed inverse document frequency ln(N / df) is compared
with what a Poisson process of the same collection frequency would give,
ln(N / (N (1 - e^(-cf/N)))) = -ln(1 - e^(-cf/N)). The difference, the residual,
is high for words that are concentrated in few pages. A page's word scores the
residual times its frequency on the page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from weftlight.plans.joins import sized_join
from weftlight.plans.lineage import written


def clean_postings(inverted_index: DataFrame) -> DataFrame:
    """(page_id, word_id, tf) once per page and word; null keys and unusable tf (null, NaN, <= 0) are left out.

    If a (page, word) comes with different tf, the largest counts.
    """
    return (
        inverted_index.filter("word_id is not null and page_id is not null and tf > 0 and not isnan(tf)")
        .groupBy("page_id", "word_id").agg(F.max("tf").alias("tf"))
    )


def word_statistics(postings: DataFrame) -> DataFrame:
    """(word_id, pages, df, cf, observed, expected, residual) over all postings.

    tf is a count divided by the page's length and the length is not stored. One
    occurrence is the least of a page's tf and of the gaps between them, so tf
    divided by that is the count; where all counts of a page have a common
    divisor and no gap is smaller, the counts come out divided by it.
    """
    # the different tf of a page are few
    levels = postings.groupBy("page_id").agg(F.sort_array(F.collect_set(F.round("tf", 12))).alias("l"))
    gaps = F.zip_with("l", F.concat(F.array(F.lit(0.0)), F.col("l")), lambda a, b: a - b)
    least = levels.select("page_id", F.array_min(F.filter(gaps, lambda g: g > 1e-9)).alias("_one"))
    counted = postings.join(least, "page_id")
    pages = postings.agg(F.countDistinct("page_id").alias("pages"))
    stats = counted.groupBy("word_id").agg(F.count("*").alias("df"), F.sum(F.round(F.col("tf") / F.col("_one"))).alias("cf"))
    observed = F.log(F.col("pages") / F.col("df"))
    expected = -F.log(-F.expm1(-F.col("cf") / F.col("pages")))
    return (
        stats.crossJoin(F.broadcast(pages))  # one row
        .withColumn("observed", observed).withColumn("expected", expected)
        .withColumn("residual", F.col("observed") - F.col("expected"))
    )


def scored_words(inverted_index: DataFrame) -> DataFrame:
    """(page_id, word_id, tf, df, cf, observed, expected, residual, score) for each posting.

    ``score`` is tf times the residual. ``tf * (residual + expected)`` is the
    plain tf-idf. An empty index gives no row.
    """
    postings = written(clean_postings(inverted_index), "postings")
    statistics = written(word_statistics(postings).drop("pages"), "word-statistics")
    # frequent words stand on a third of all pages: beyond the broadcast bound the join is salted
    joined = sized_join(postings, statistics, ["word_id"])
    return joined.withColumn("score", F.col("tf") * F.col("residual"))


def top_words(scored: DataFrame, k: int = 3) -> DataFrame:
    """(page_id, word_id): the k words of a page with the highest tf * (residual + Poisson expectation).

    Only words on at least two pages; rounded to nine decimals, ties to the smaller word_id.
    A page's words are bounded by its length, so a window per page is bounded.
    """
    value = F.round(F.col("tf") * (F.col("residual") + F.col("expected")), 9)
    order = Window.partitionBy("page_id").orderBy(F.desc("_v"), F.asc("word_id"))
    return (
        scored.filter("df >= 2").select("page_id", "word_id", value.alias("_v"))
        .withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k)
        .select("page_id", "word_id")
    )
