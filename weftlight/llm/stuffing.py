"""Problem 6: pages of repeated keywords, tags or lists of links.

The terms of a page's lines, furniture and headings aside, are one sequence
(words that are no function words; pairs of letters in scripts without spaces).
Recurrence gaps and the positional autocorrelation over lag windows decide which
lines are keyword text: terms that come back within a short window, or at the
same lags through the page. Lists of distinct nouns without function words count
too, and short lines are the entries of lists. A page is found if such text
outweighs its sentences.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from weftlight.llm.common import unique_by
from weftlight.llm.linekinds import judged_lines
from weftlight.llm.template import with_flags
from weftlight.plans.spread import spread

#: Short lines that make a list; fewer are a title, a date or a caption. A page of two links and nothing else is not found.
LIST_LINES = 3


def weighed(content: str, furniture: list[int] | None = None, headings: list[int] | None = None) -> tuple[int, int, int]:
    """(characters of keyword text, of lists, of sentences) in a page's content."""
    keywords = lists = prose = entries = 0
    for _, line, kind in judged_lines(content, furniture, headings):
        if kind == "keywords":
            keywords += len(line)
        elif kind == "prose":
            prose += len(line)
        elif kind == "short":
            entries += 1
            lists += len(line.strip())
    return keywords, lists if entries >= LIST_LINES else 0, prose


def page_weights(pages: DataFrame) -> DataFrame:
    """(page_id, keyword_chars, list_chars, prose_chars) of each page with content.

    Null and empty contents and null ids give no row; of pages with one id the one
    with the largest fields counts.
    """
    plain = with_flags(unique_by(spread(pages.select("id", "content", "html", "website_id").filter("content <> ''")), "id"))
    plain = plain.select(F.col("id").alias("page_id"), "content", "furniture", "headings")

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows = [weighed(*row) for row in zip(frame["content"], frame["furniture"], frame["headings"], strict=True)]
            out = pd.DataFrame(rows, columns=["keyword_chars", "list_chars", "prose_chars"], dtype="int64")
            out.insert(0, "page_id", frame["page_id"].to_numpy())
            yield out

    return plain.mapInPandas(weigh, "page_id long, keyword_chars long, list_chars long, prose_chars long")


def stuffed_pages(weights: DataFrame) -> DataFrame:
    """The rows of ``weights`` whose keyword text and lists outweigh their sentences."""
    return weights.filter(F.col("keyword_chars") + F.col("list_chars") > F.col("prose_chars"))
