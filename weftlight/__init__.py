"""weftlight: a Spark-first engine for crawl analytics and full-text search."""

__version__ = "0.1.0"
