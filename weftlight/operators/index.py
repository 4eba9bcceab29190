"""The inverted index: postings, dictionary, frequencies, and their snapshot updates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from weftlight.functions.text import tokens
from weftlight.plans.lineage import written
from weftlight.plans.spread import spread


def page_tokens(pages: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(page_id, tokens) of the rows that have a token."""
    texts = spread(pages.select(F.col(id_col).alias("page_id"), F.col(text_col).alias("text")))
    return texts.select("page_id", tokens(F.col("text")).alias("tokens")).filter(F.size("tokens") > 0)


def postings(pages: DataFrame, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """(page_id, word, n, tf): occurrences, and occurrences over all tokens of the page.

    The rows of a page are counted before they are shuffled.
    """
    each = page_tokens(pages, id_col, text_col).select("page_id", F.size("tokens").alias("total"), F.explode("tokens").alias("word"))
    counted = each.groupBy("page_id", "word", "total").agg(F.count("*").alias("n"))
    return counted.select("page_id", "word", "n", (F.col("n") / F.col("total")).alias("tf"))


def by_word(index: DataFrame) -> DataFrame:
    """The postings in ranges of words, sorted; a word with a large part of all postings is spread over several."""
    return index.repartitionByRange("word", "page_id").sortWithinPartitions("word", "page_id")


def document_frequency(index: DataFrame) -> DataFrame:
    """(word, df)."""
    return index.groupBy("word").agg(F.count("*").alias("df"))


def with_idf(frequencies: DataFrame, pages: int) -> DataFrame:
    """``frequencies`` with idf = ln(1 + N / (1 + df)); N counts all pages, indexed or not."""
    return frequencies.withColumn("idf", F.log(1.0 + F.lit(float(pages)) / (1.0 + F.col("df"))))


def reindexed(old: DataFrame, changed_pages: DataFrame, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """The index after pages changed: their postings are replaced; a page that has no token now keeps its old ones."""
    fresh = postings(changed_pages, id_col, text_col).select("page_id", "word", "tf")
    return old.select("page_id", "word", "tf").join(fresh.select("page_id").distinct(), "page_id", "left_anti").unionByName(fresh)


def numbered(rows: DataFrame, order: list[str], start: int, name: str = "id") -> DataFrame:
    """``rows`` with consecutive numbers after ``start`` in the given order.

    A range sort and one count per partition; no task sees all rows.
    """
    placed = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()), "numbered")
    counts = placed.groupBy("_p").agg(F.count("*").alias("_n"))  # one row per partition
    before = counts.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_p").orderBy(*order)
    return (
        placed.join(F.broadcast(before), "_p")
        .withColumn(name, F.lit(start) + F.col("_before") + F.row_number().over(inside)).drop("_p", "_before")
    )


def dictionary_after(words: DataFrame, index: DataFrame) -> DataFrame:
    """(id, word): the dictionary with the index's new words appended in alphabetical order."""
    last = words.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()["m"]
    new = index.select("word").distinct().join(words.select("word"), "word", "left_anti")
    return words.select("id", "word").unionByName(numbered(new, ["word"], last).select("id", "word"))


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The rows of ``old`` whose key is not in ``new``, and all rows of ``new``."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)
