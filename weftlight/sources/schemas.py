"""Explicit schemas of the stored tables."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {"bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType()}


def _struct(text: str) -> T.StructType:
    """A schema from "name type, name type"; needs no session."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (part.split() for part in text.split(","))])


WEBSITES = _struct("id bigint, domain string, robots_checked boolean, crawl_delay int")
PAGES = _struct(
    "id bigint, url string, title string, content string, html string, status_code int, crawl_time timestamp, language string, page_hash string,"
    " website_id bigint, etag string, last_modified string, last_checked timestamp, pagerank double"
)
LINKS = _struct("id bigint, source_page bigint, destination_page bigint")
PAGE_EMBEDDINGS = _struct("page_id bigint, embedding string, model_name string, created_at timestamp")
QUEUE = _struct("id bigint, url string, status string, depth int, priority int")
SEARCH_HISTORY = _struct("id bigint, query string, searched_at timestamp")
WORDS = _struct("id bigint, word string")
INVERTED_INDEX = _struct("word_id bigint, page_id bigint, tf double")

TABLES = {
    "websites": WEBSITES, "pages": PAGES, "links": LINKS, "page_embeddings": PAGE_EMBEDDINGS, "queue": QUEUE,
    "search_history": SEARCH_HISTORY, "words": WORDS, "inverted_index": INVERTED_INDEX,
}
