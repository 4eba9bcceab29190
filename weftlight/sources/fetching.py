"""Pages from the network as a data source, and their replay from a table.

``spark.read.format("web_pages").option("urls_path", table).load()`` fetches the
addresses of a parquet table (url, etag, last_modified). A partition is a bucket
of hosts (option ``buckets``), so one task has all addresses of a host and keeps
the pause between two fetches of it (``delay``, or the delay of its robots.txt);
with ``robots`` set, a host's robots.txt is read first and what it forbids is a
row with an error. Redirects are not followed, known pages are asked for
conditionally. The table may lie on any file system that pyarrow reads (a local
path, hdfs:, s3: ...); a path without parquet files is an error.
"""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit
from zlib import crc32

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "url string, status_code int, location string, etag string, last_modified string, html string, error string"
USER_AGENT, TIMEOUT_S, BUCKETS, DELAY_S = "weftlight", 10, 64, 0.2


class _NoRedirect(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *args, **kwargs):
        return None


def fetch(url: str, etag: str | None = None, last_modified: str | None = None, timeout: float = TIMEOUT_S) -> tuple:
    """One row of the source; failures of the network are rows with an error."""
    headers = {"User-Agent": USER_AGENT}
    if etag:
        headers["If-None-Match"] = etag
    if last_modified:
        headers["If-Modified-Since"] = last_modified
    try:
        with urllib.request.build_opener(_NoRedirect).open(urllib.request.Request(url, headers=headers), timeout=timeout) as answer:
            body = answer.read().decode(answer.headers.get_content_charset() or "utf-8", "replace")
            return url, answer.status, None, answer.headers.get("ETag"), answer.headers.get("Last-Modified"), body, None
    except urllib.error.HTTPError as e:
        return url, e.code, e.headers.get("Location"), e.headers.get("ETag"), e.headers.get("Last-Modified"), None, None
    except (OSError, ValueError) as e:
        return url, None, None, None, None, None, str(e)[:200]


def host_of(url: str) -> str:
    """The authority of an address, lower case; "" where it cannot be read."""
    try:
        return urlsplit(url).netloc.lower()
    except ValueError:
        return ""


class Polite:
    """Fetches one after the other, with a pause between two fetches of a host, and by its robots.txt."""

    def __init__(self, delay: float, robots: bool, timeout: float = TIMEOUT_S, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.delay, self.robots, self.timeout, self.clock, self.sleep = delay, robots, timeout, clock, sleep
        self.ready: dict[str, float] = {}
        self.rules: dict[str, object] = {}

    def _rules(self, url: str, host: str):
        if host not in self.rules:
            from weftlight.sources.robots import rules

            got = fetch(f"{urlsplit(url).scheme}://{host}/robots.txt", timeout=self.timeout)
            self.rules[host] = rules(got[5] if got[1] == 200 else None)
        return self.rules[host]

    def get(self, url: str, etag: str | None, last_modified: str | None) -> tuple:
        host, pause = host_of(url), self.delay
        if self.robots and host:
            rules = self._rules(url, host)
            if not rules.can_fetch("*", url):
                return url, None, None, None, None, None, "forbidden by robots.txt"
            pause = float(rules.crawl_delay("*") or 0) or pause
        wait = self.ready.get(host, 0.0) - self.clock()
        if wait > 0:
            self.sleep(wait)
        row = fetch(url, etag, last_modified, self.timeout)
        self.ready[host] = self.clock() + pause
        return row


class _Part(InputPartition):
    def __init__(self, bucket: int):
        super().__init__(bucket)
        self.bucket = bucket


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["urls_path"]
        self.timeout = float(options.get("timeout", TIMEOUT_S))
        self.buckets = int(options.get("buckets", BUCKETS))
        self.delay = float(options.get("delay", DELAY_S))
        self.robots = str(options.get("robots", "false")).lower() == "true"

    def _files(self):
        """(file system, parquet files) of the table of addresses."""
        from pathlib import Path

        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.path) if ":" in self.path.split("/")[0] else (fs.LocalFileSystem(), str(Path(self.path).resolve()))
        info = system.get_file_info(root)
        if info.type == fs.FileType.Directory:
            found = [f.path for f in system.get_file_info(fs.FileSelector(root, recursive=True)) if f.type == fs.FileType.File and f.path.endswith(".parquet")]
        else:
            found = [root] if info.type == fs.FileType.File else []
        if not found:
            raise FileNotFoundError(f"no parquet file of addresses under {self.path}")
        return system, sorted(found)

    def partitions(self) -> list[_Part]:
        self._files()  # a missing table fails here and not as no rows
        return [_Part(b) for b in range(self.buckets)]

    def read(self, partition: _Part) -> Iterator[tuple]:
        import pyarrow.parquet as pq

        polite = Polite(self.delay, self.robots, self.timeout)
        system, files = self._files()
        for path in files:
            with system.open_input_file(path) as file:
                table = pq.ParquetFile(file)
                columns = [c for c in ("url", "etag", "last_modified") if c in table.schema_arrow.names]
                for batch in table.iter_batches(columns=columns):
                    for row in batch.to_pylist():
                        if row.get("url") and crc32(host_of(row["url"]).encode()) % self.buckets == partition.bucket:
                            yield polite.get(row["url"], row.get("etag"), row.get("last_modified"))


class WebPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "web_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WebPages)


def replay(pages: DataFrame) -> DataFrame:
    """The rows of the source as stored pages would give them; no network."""
    return pages.select(
        "url", "status_code", F.lit(None).cast("string").alias("location"), "etag", "last_modified",
        F.when(F.col("status_code") == 200, F.col("html")).alias("html"), F.lit(None).cast("string").alias("error"),
    )
