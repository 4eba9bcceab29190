from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from weftlight.operators import frontier as Fr, index, stats
from weftlight.plans.joins import sized_join
from weftlight.plans.lineage import written
from weftlight.sources import corpus, fetching, robots, sinks, storage
from weftlight.sources.schemas import PAGES, TABLES
from weftlight.sources.tables import table
from weftlight.streaming import streams

QUEUE = "id long, url string, status string, depth int, priority int"


def test_pop_order(spark):
    rows = [(1, "a", "pending", 0, 0), (2, "b", "pending", 0, 5), (3, "c", "completed", 0, 9), (4, "d", "pending", 0, 5)]
    assert [r["id"] for r in Fr.popped(spark.createDataFrame(rows, QUEUE), 2).collect()] == [2, 4]


def test_child_tasks_depth_and_priority(spark):
    rows = spark.createDataFrame([("https://a.b/x", 2, 0), ("https://a.b/y", 3, 5), ("https://C.d/z", 0, 10)], "target string, depth int, priority int")
    assert sorted(map(tuple, Fr.child_tasks(rows).collect())) == [("https://C.d/z", 1, 9, "c.d"), ("https://a.b/x", 3, 0, "a.b")]


FETCHES = [
    (1, "new", 200, "h1"), (2, "known", 200, "h2"), (3, "copy", 200, "h9"), (4, "known", 304, None), (5, "strange", 304, None), (6, "m1", 301, None), (7, "m2", 302, None),
    (8, "m3", 307, None), (9, "gone", 404, None), (10, "bad", 500, None), (11, "net", None, None), (12, "new2", 200, "h1"), (13, "nohash", 200, None),
]


def test_outcomes(spark):
    stored = spark.createDataFrame([("known", "h0"), ("other", "h9")], "url string, page_hash string")
    found = Fr.classified(spark.createDataFrame(FETCHES, "id long, url string, status_code int, page_hash string"), stored)
    got = {r["id"]: r["outcome"] for r in found.collect()}
    assert got == {1: "new", 2: "updated", 3: "duplicate", 4: "skipped", 5: "none", 6: "redirect", 7: "redirect", 8: "error", 9: "missing", 10: "error", 11: "error", 12: "duplicate", 13: "new"}


def test_merge(spark):
    blank = {f.name: None for f in PAGES}
    def page(**k):
        return tuple({**blank, **k}.values())
    t = datetime(2025, 1, 2)
    stored = spark.createDataFrame([page(id=1, url="a", page_hash="x"), page(id=2, url="b", page_hash="y"), page(id=3, url="c", page_hash="z")], PAGES)
    fetched = spark.createDataFrame([page(id=1, url="a", page_hash="x2", crawl_time=t), page(id=2, url="b", crawl_time=t), page(id=9, url="n", page_hash="q", crawl_time=t)], PAGES)
    told = spark.createDataFrame([("a", "updated"), ("b", "skipped"), ("n", "new")], "url string, outcome string")
    got = {r["url"]: (r["page_hash"], r["last_checked"]) for r in Fr.merged_pages(stored, fetched, told).collect()}
    assert got["a"][0] == "x2" and got["b"] == ("y", t) and got["c"] == ("z", None) and got["n"][0] == "q" and len(got) == 4


def test_politeness_against_plain_order(spark):
    rows = [(i * 1500, "d" if i % 3 else "e", i % 4) for i in range(60)]
    tasks = spark.createDataFrame(rows, "id long, domain string, priority int")
    delays = spark.createDataFrame([("d", 2), ("e", 0)], "domain string, crawl_delay int")
    got = {r["id"]: r["wait_s"] for r in Fr.schedule(tasks, delays).collect()}
    for domain, delay in (("d", 2.0), ("e", 0.2)):
        own = sorted((x for x in rows if x[1] == domain), key=lambda x: (-x[2], x[0]))
        for n, x in enumerate(own):
            assert got[x[0]] == round(n * delay, 3)


def test_unvisited_recover_and_redirect(spark):
    queue = spark.createDataFrame([(1, "a", "pending", 2, 1), (2, "a", "crawling", 1, 1), (3, "b", "pending", 0, 0), (4, "c", "failed", 0, 0)], QUEUE)
    visited = spark.createDataFrame([("b",)], "url string")
    sites = spark.createDataFrame([(1, "x.y"), (2, "z.w")], "id long, domain string")
    pages = spark.createDataFrame([(1, 1)], "id long, website_id long")
    assert sorted(map(tuple, Fr.recovered(queue, sites, pages, visited).select("url", "depth", "priority").collect())) == [("a", 1, 1), ("https://z.w/", 0, 10)]
    moved = spark.createDataFrame([("https://a.b/c", 302, "../d", 1, 4), ("https://a.b/c", 307, "/e", 1, 4)], "url string, status_code int, location string, depth int, priority int")
    assert [tuple(r) for r in Fr.redirected(moved).collect()] == [("https://a.b/d", 1, 4)]


def test_crawl_round(spark):
    pages = spark.createDataFrame([(1, "https://a.b/", '<a href="/x">x</a><a href="/y.pdf">y</a><a href="/">self</a>'), (2, "https://a.b/x", "")], "id long, url string, html string")
    tasks = spark.createDataFrame([("https://a.b/", 0, 10), ("https://a.b/deep", 4, 0)], "url string, depth int, priority int")
    fetched, following = Fr.crawl_round(tasks, pages, spark.createDataFrame([], "url string"))
    assert [r["id"] for r in fetched.collect()] == [1]
    assert [tuple(r) for r in following.select("url", "depth", "priority").collect()] == [("https://a.b/x", 1, 9)]


def test_task_json(spark):
    tasks = spark.createDataFrame([(7, "u", 1, 2)], "id long, url string, depth int, priority int")
    assert [tuple(r) for r in Fr.from_task_json(Fr.task_json(tasks)).collect()] == [(7, "u", 1, 2)]
    assert tuple(Fr.from_task_json(spark.createDataFrame([(8, "{broken")], "id long, task string")).first()) == (8, None, None, None)


def test_robots(spark):
    files = spark.createDataFrame([
        ("no.x", "User-agent: *\nDisallow: /"), ("one.x", "User-agent: weftlight\nDisallow: /a\n\nUser-agent: *\nDisallow: /b\nCrawl-delay: 3"), ("zero.x", "User-agent: *\nCrawl-delay: 0"), ("half.x", "User-agent: *\nCrawl-delay: 1.5"),
    ], "domain string, robots_txt string")
    urls = spark.createDataFrame([(u,) for u in ("https://no.x/", "https://one.x/a", "https://one.x/b", "https://zero.x/", "https://half.x/", "https://free.x/")], "url string")
    got = {r["url"]: (r["allowed"], r["delay"]) for r in robots.permissions(urls, files).collect()}
    assert got == {"https://no.x/": (False, 0.2), "https://one.x/a": (True, 3.0), "https://one.x/b": (False, 3.0), "https://zero.x/": (True, 0.2), "https://half.x/": (True, 0.2), "https://free.x/": (True, 0.2)}
    named = {r["url"]: r["allowed"] for r in robots.permissions(urls, files, agent="weftlight").collect()}
    assert not named["https://one.x/a"] and named["https://one.x/b"]


def plain_percentile(values, p):
    values = sorted(values)
    return round(values[min(int(len(values) * p), len(values) - 1)], 2)


@pytest.mark.parametrize("n", [1, 2, 7, 100, 257])
def test_latency(spark, n):
    values = [((i * 37) % 101) / 7 - 3 for i in range(n)]
    got = stats.latency(spark.createDataFrame([(v,) for v in values], "v double"), "v").first()
    import statistics

    assert got["n"] == n and abs(got["median"] - round(statistics.median(values), 2)) < 1e-9
    assert got["p95"] == plain_percentile(values, 0.95) and got["p99"] == plain_percentile(values, 0.99)


def test_empty_logs(spark):
    empty = spark.createDataFrame([], "id long, url string, status_code int, value double, status string")
    assert stats.averages(empty, "value", 1.0, 2).first()["mean"] == 0
    assert stats.queue_counts(empty).first()["progress"] == 0.0
    assert stats.cache_efficiency(empty).first()["hit_percent"] == 0.0
    assert stats.latency(empty, "value").first()["n"] is None


def test_suggestions(spark):
    words = spark.createDataFrame([(i, w) for i, w in enumerate(["crawl", "crawler", "cream", "zoo", "c%x"])], "id long, word string")
    log = spark.createDataFrame([(1, "crawl web"), (2, "Crawl"), (3, "crawl web"), (4, None)], "id long, query string")
    assert [r["suggestion"] for r in stats.suggestions(words, log, " CRA").collect()] == ["crawl", "crawl web", "crawler"]
    assert [r["suggestion"] for r in stats.suggestions(words, log, "c_e").collect()] == ["cream"]


def test_heartbeats(spark):
    now = datetime(2025, 1, 1, 0, 1)
    pings = spark.createDataFrame([("a", now - timedelta(seconds=15)), ("a", now - timedelta(seconds=90)), ("b", now - timedelta(seconds=16)), (None, now)], "worker string, ts timestamp")
    assert Fr.active_workers(pings, F.lit(now)).first()["active_workers"] == 1


def test_index_updates(spark):
    pages = spark.createDataFrame([(1, "crawling crawls web"), (2, ""), (3, None), (4, "the of")], "id long, content string")
    got = sorted(map(tuple, index.postings(pages).collect()))
    assert got == [(1, "crawl", 2, 2 / 3), (1, "web", 1, 1 / 3)]
    old = spark.createDataFrame([(1, "old", 1.0), (2, "kept", 1.0), (4, "kept", 1.0)], "page_id long, word string, tf double")
    assert sorted((r["page_id"], r["word"]) for r in index.reindexed(old, pages).collect()) == [(1, "crawl"), (1, "web"), (2, "kept"), (4, "kept")]
    words = spark.createDataFrame([(7, "web")], "id long, word string")
    fresh = spark.createDataFrame([("web",), ("b",), ("a",), ("a",)], "word string")
    assert sorted(map(tuple, index.dictionary_after(words, fresh).collect())) == [(7, "web"), (8, "a"), (9, "b")]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_sized_join_is_the_same_both_ways(spark, how):
    left = spark.createDataFrame([(i % 5, i) for i in range(50)] + [(None, 1)], "k long, v long")
    right = spark.createDataFrame([(0, "a"), (1, "b"), (7, "c")], "k long, w string")
    a = sized_join(left, right, ["k"], how)
    b = sized_join(left, right, ["k"], how, broadcast_rows=0, salts=3)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.select(a.columns).collect()))


def test_mock_corpus(spark):
    one, two = (corpus.mock_pages(spark, 50).orderBy("page_no").collect() for _ in range(2))
    assert one == two and len({r["html"] for r in one}) == 50
    for r in one:
        assert 3 <= r["html"].count("<p>") <= 8 and 1 <= r["html"].count("<li>") <= 20 and f'page_{r["page_no"]}.html' not in r["html"] and "%s" not in r["html"] and "\u0001" not in r["html"]


def test_sources_and_sinks(spark, small, tmp_path):
    for name in ("pages", "websites", "links", "page_embeddings", "search_history", "words", "inverted_index"):
        assert [(f.name, f.dataType) for f in table(spark, small, name).schema] == [(f.name, f.dataType) for f in TABLES[name]]
    post = index.postings(table(spark, small, "pages"))
    sinks.write_postings(post, str(tmp_path / "p"), 4)
    assert spark.read.parquet(str(tmp_path / "p")).count() == post.count()
    log = spark.createDataFrame([(1, "q")], "id long, query string")
    sinks.append(log, str(tmp_path / "l"))
    sinks.append(log, str(tmp_path / "l"))
    assert spark.read.parquet(str(tmp_path / "l")).count() == 2
    sizes = {r["table"]: r["bytes"] for r in storage.table_sizes(spark, small).collect()}
    import os

    assert sizes["pages"] == os.path.getsize(f"{small}/pages.parquet")


def test_web_source_fetches_from_a_local_server(spark, tmp_path):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Site(BaseHTTPRequestHandler):
        def do_GET(self):
            if self.headers.get("If-None-Match") == "e1":
                self.send_response(304)
            elif self.path == "/moved":
                self.send_response(301)
                self.send_header("Location", "/new")
            elif self.path == "/gone":
                self.send_response(404)
            else:
                self.send_response(200)
                self.send_header("ETag", "e1")
            self.end_headers()
            if self.path == "/":
                self.wfile.write(b"<p>hi</p>")

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    root = f"http://127.0.0.1:{server.server_port}"
    rows = [(root + "/", None, None), (root + "/moved", None, None), (root + "/gone", None, None), (root + "/known", "e1", None), ("http://127.0.0.1:1/", None, None), (None, None, None)]
    spark.createDataFrame(rows, "url string, etag string, last_modified string").write.parquet(str(tmp_path / "u"))
    fetching.register(spark)
    got = {r["url"]: r for r in spark.read.format("web_pages").option("urls_path", str(tmp_path / "u")).load().collect()}
    server.shutdown()
    assert len(got) == 5 and got[root + "/"]["html"] == "<p>hi</p>" and got[root + "/"]["etag"] == "e1"
    assert got[root + "/moved"]["status_code"] == 301 and got[root + "/moved"]["location"] == "/new" and got[root + "/gone"]["status_code"] == 404
    assert got[root + "/known"]["status_code"] == 304 and got["http://127.0.0.1:1/"]["error"]


def test_web_source_says_when_there_are_no_addresses(spark, tmp_path):
    fetching.register(spark)
    with pytest.raises(Exception, match="no parquet file of addresses"):
        spark.read.format("web_pages").option("urls_path", str(tmp_path / "none")).load().count()


def test_politeness_and_robots_of_the_source(monkeypatch):
    now, asked = [0.0], []

    def fetch(url, etag=None, last_modified=None, timeout=0):
        asked.append((now[0], url))
        body = "User-agent: *\nDisallow: /no\nCrawl-delay: 3" if url == "http://a/robots.txt" else "<p>"
        return url, 404 if url == "http://b/robots.txt" else 200, None, None, None, body, None

    monkeypatch.setattr(fetching, "fetch", fetch)
    polite = fetching.Polite(0.5, True, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s))
    rows = [polite.get(u, None, None) for u in ("http://a/1", "http://a/no/x", "http://a/2", "http://b/1", "http://b/2", "http://[x")]
    assert [r[6] for r in rows] == [None, "forbidden by robots.txt", None, None, None, None]
    assert [(t, u) for t, u in asked if "robots" not in u] == [(0.0, "http://a/1"), (3.0, "http://a/2"), (3.0, "http://b/1"), (3.5, "http://b/2"), (3.5, "http://[x")]


def test_polite_stream_orders_a_batch_and_drops_idle_domains(spark, tmp_path):
    """Rows of a batch in several files and out of order; a batch far later finds no state."""
    start = datetime(2025, 1, 1)
    first = [("d", f"u{i}", start.replace(second=(7 * i) % 10), 2.0) for i in range(10)] + [(None, "x", start, 1.0)]
    schema = "domain string, url string, ts timestamp, delay double"
    spark.createDataFrame(first, schema).repartition(5).write.parquet(str(tmp_path / "in"))
    stream = streams.polite(streams.folder_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema), late="1 second", idle_s=60.0)
    streams.drained(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    got = sorted((r["fetch_at"], r["url"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert [u for _, u in got] == [u for _, u, _, _ in sorted(first[:10], key=lambda r: r[2])]
    assert [(b[0] - a[0]).total_seconds() for a, b in zip(got, got[1:], strict=False)] == [2.0] * 9
    for day in (2, 3):
        spark.createDataFrame([("e", f"v{day}", datetime(2025, 1, day), 2.0)], schema).write.mode("append").parquet(str(tmp_path / "in"))
        streams.drained(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    state = spark.read.format("statestore").load(str(tmp_path / "cp")).selectExpr("key.domain as d").collect()
    assert [r["d"] for r in state] == ["e"]


def test_polite_stream_keeps_distance(spark, tmp_path):
    t = datetime(2025, 1, 1)
    rows = [("d", f"u{i}", t, 2.0) for i in range(4)] + [("e", "v", t, 0.0)]
    spark.createDataFrame(rows, "domain string, url string, ts timestamp, delay double").write.parquet(str(tmp_path / "in"))
    stream = streams.folder_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    streams.drained(streams.polite(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    at = sorted(r["fetch_at"] for r in spark.read.parquet(str(tmp_path / "out")).filter("domain = 'd'").collect())
    assert [(b - a).total_seconds() for a, b in zip(at, at[1:], strict=False)] == [2.0, 2.0, 2.0]


def test_robots_from_fetches(spark):
    fetched = spark.createDataFrame([("https://a.b/robots.txt", 200, "User-agent: *"), ("https://c.d/robots.txt", 404, "x"), ("https://e.f/robots.txt", None, None)], "url string, status_code int, html string")
    assert {r["domain"]: r["robots_txt"] for r in robots.from_fetches(fetched).collect()} == {"a.b": "User-agent: *", "c.d": None, "e.f": None}


def test_written_tables_can_be_dropped(spark):
    import os

    from weftlight.plans import lineage

    made = lineage.written(spark.range(5), "probe")
    assert made.count() == 5
    folder = lineage._tables_of(spark).removeprefix("file:")
    assert os.path.isdir(folder)
    lineage.drop_written(spark)
    assert not os.path.isdir(folder)


def test_a_repeated_side_is_not_broadcast(spark):
    left = spark.range(2000).selectExpr("id % 50 AS k", "id AS v")
    right = written(spark.range(50).withColumnRenamed("id", "k"), "small-side")  # a few kB of files, far below Spark's own limit
    joined = sized_join(left, right, ["k"], "left", broadcast_rows=10)
    assert joined.count() == 2000
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
