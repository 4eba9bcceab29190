import math

import pytest

from weftlight.operators import graph, rank

GRAPHS = {
    "single": ([1], []), "pair": ([1, 2], [(1, 2)]), "ring": (list(range(5)), [(i, (i + 1) % 5) for i in range(5)]), "fan": ([1, 2, 3], [(1, 2), (1, 3)]),
    "hub": ([1, 2, 3, 4, 5], [(i, 5) for i in range(1, 5)]), "loops": ([1, 2], [(1, 1), (2, 2), (1, 2)]), "double": ([1, 2, 3], [(1, 2), (1, 2), (1, 3)]),
    "unknown": ([1, 2], [(1, 2), (2, 99), (98, 1)]), "no edges": ([1, 2, 3], []),
}


def plain(nodes, edges, rounds):
    known = set(nodes)
    edges = [(a, b) for a, b in edges if a in known and b in known]
    out = {n: sum(a == n for a, _ in edges) for n in nodes}
    r = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(rounds):
        lost = sum(r[n] for n in nodes if not out[n])
        r = {n: 0.15 / len(nodes) + 0.85 * lost / len(nodes) + 0.85 * sum(r[a] / out[a] for a, b in edges if b == n) for n in nodes}
    return r


def frames(spark, nodes, edges):
    return spark.createDataFrame([(n,) for n in nodes], "id long"), spark.createDataFrame(edges, "src long, dst long")


@pytest.mark.parametrize("name", list(GRAPHS))
def test_ranks_equal_plain_python(spark, name):
    nodes, edges = GRAPHS[name]
    found = graph.pagerank(*frames(spark, nodes, edges), max_iterations=6, tolerance=0.0)
    got = {r["id"]: r["rank"] for r in found.ranks.collect()}
    want = plain(nodes, edges, 6)
    assert got.keys() == want.keys() and all(abs(got[n] - want[n]) < 1e-12 for n in nodes)
    assert abs(sum(got.values()) - 1) < 1e-9
    assert max(r["pagerank"] for r in found.normalised().collect()) == 1.0


def test_empty_graph_and_convergence(spark):
    empty = graph.pagerank(*frames(spark, [], []))
    assert empty.stats() == {"pages_computed": 0, "iterations": 0, "converged": False} and empty.normalised().count() == 0
    done = graph.pagerank(*frames(spark, *GRAPHS["ring"])).stats()
    assert done["converged"] and done["iterations"] == 1 and done["link_edges"] == 5 and done["pages_computed"] == 5


def test_a_chain_of_fifty_does_not_converge_in_fifty_rounds(spark):
    nodes, edges = list(range(50)), [(i, i + 1) for i in range(49)]
    found = graph.pagerank(*frames(spark, nodes, edges))
    assert found.iterations == graph.MAX_ITERATIONS == 50 and not found.converged
    want = plain(nodes, edges, 50)
    got = {r["id"]: r["pagerank"] for r in found.normalised().collect()}
    assert all(abs(got[n] - want[n] / max(want.values())) < 1e-8 for n in nodes) and got[49] == 1.0
    before = plain(nodes, edges, 49)
    assert 1e-6 < sum(abs(want[n] - before[n]) for n in nodes) < 1e-4


def test_iso_times(spark):
    from pyspark.sql import functions as F

    times = [(None,), ("2024-03-01 05:06:07",), ("2024-03-01 05:06:07.000120",)]
    got = [r["t"] for r in spark.createDataFrame(times, "s string").select(rank.iso(F.col("s").cast("timestamp")).alias("t")).collect()]
    assert got == [None, "2024-03-01T05:06:07", "2024-03-01T05:06:07.000120"]


def test_many_query_words_take_the_other_way(spark, monkeypatch):
    whole = searched(spark, [(1, "crawling crawls web"), (2, "other")], INDEX, PAGES)
    monkeypatch.setattr(rank, "PUSHED_WORDS", 1)
    assert searched(spark, [(1, "crawling crawls web"), (2, "other")], INDEX, PAGES) == whole


def test_edges(spark):
    links = spark.createDataFrame([(1, 1, 2), (2, 1, 2), (3, 2, 2), (4, 1, 9), (5, None, 1), (6, 2, 1)], "id long, source_page long, destination_page long")
    pages = spark.createDataFrame([(1,), (2,)], "id long")
    assert sorted(map(tuple, graph.link_edges(links, pages).collect())) == [(1, 2), (2, 1)]
    assert graph.dangling(pages, graph.link_edges(links.limit(1), pages).limit(1)).count() == 1


def searched(spark, queries, index, pages, **more):
    q = spark.createDataFrame(queries, "query_id long, query string")
    i = spark.createDataFrame(index, "page_id long, word string, tf double")
    p = spark.createDataFrame(pages, "id long, url string, title string, content string, language string, crawl_time timestamp, pagerank double")
    return rank.search(q, i, p, **more).orderBy("query_id", "position").collect()


PAGES = [(n, f"u{n}", None if n == 1 else f"t{n}", "crawling the web " * n, None, None, p) for n, p in ((1, 0.0), (2, 1.0), (3, None), (4, 0.5))]
INDEX = [(1, "crawl", 0.5), (2, "crawl", 0.1), (3, "web", 0.4), (2, "web", 0.1), (4, "other", 1.0)]


def test_search_scores(spark):
    rows = searched(spark, [(1, "crawling crawls web"), (2, "nothing"), (3, "the"), (4, "")], INDEX, PAGES)
    assert {r["query_id"] for r in rows} == {1}
    idf = math.log(1 + 4 / 3)
    raw = {1: 0.5 * idf, 2: 0.2 * idf, 3: 0.4 * idf}
    pr = {1: 0.0, 2: 1.0, 3: 0.15}
    want = sorted(((round(0.7 * raw[p] / raw[1] + 0.3 * pr[p], 5), -p) for p in raw), reverse=True)
    assert [(r["score"], -r["page_id"]) for r in rows] == want
    assert {r["page_id"]: r["title"] for r in rows}[1] == "Untitled" and rows[0]["language"] == "en" and rows[0]["snippet"].startswith("crawling")


def test_search_with_vectors(spark):
    qv = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<double>")
    pv = spark.createDataFrame([(1, [0.5, 0.1]), (2, [-1.0, 0.0]), (3, [1.0])], "page_id long, vector array<double>")
    rows = {r["page_id"]: r for r in searched(spark, [(1, "crawl web")], INDEX, PAGES, query_vectors=qv, page_vectors=pv, with_snippets=False)}
    assert rows[1]["semantic"] == 1.0 and rows[2]["semantic"] == 0.0 and rows[3]["semantic"] == 0.0
    assert abs(rows[1]["score"] - (0.5 * 1.0 + 0.2)) < 1e-9


def test_search_limits_and_ties(spark):
    index = [(n, "word", 0.5) for n in range(1, 71)]
    pages = [(n, "u", "t", "word", "en", None, 0.0) for n in range(1, 71)]
    rows = searched(spark, [(1, "word")], index, pages)
    assert [r["page_id"] for r in rows] == list(range(1, 21))
    assert all(r["pagerank"] == 0.0 for r in rows)


def test_vectors(spark):
    from pyspark.sql import functions as F

    from weftlight.functions import vector

    rows = spark.createDataFrame([(1, [3.0, 4.0], [3.0, 4.0], "[3, 4]"), (2, [1.0], [1.0, 2.0], "[1"), (3, [0.0, 0.0], [1.0, 1.0], None), (4, [1.0, 0.0], [0.0, 2.0], "[]")], "id int, a array<double>, b array<double>, j string")
    got = {r["id"]: tuple(r)[1:] for r in rows.select("id", vector.dot(F.col("a"), F.col("b")), vector.cosine(F.col("a"), F.col("b")), vector.from_json(F.col("j"))).collect()}
    assert got == {1: (25.0, 1.0, [3.0, 4.0]), 2: (0.0, 0.0, None), 3: (0.0, 0.0, None), 4: (0.0, 0.0, [])}
    usable = rows.select("id", vector.usable(vector.from_json(F.col("j")), 2).alias("u")).collect()
    assert {r["id"]: r["u"] for r in usable} == {1: True, 2: False, 3: False, 4: False}
    assert rows.select(vector.from_json(vector.to_json(F.col("b"))).alias("r"), "b").filter("r <> b").count() == 0


def test_encoder(spark):
    from pyspark.sql import functions as F

    from weftlight.functions import vector

    def load():
        def model(texts):
            if "fail" in texts:
                raise RuntimeError
            return [[float(len(t))] for t in texts]

        return model

    rows = spark.createDataFrame([(1, "abc"), (2, " "), (3, None), (4, "x" * 900)], "id int, t string").coalesce(1)
    got = {r["id"]: r["v"] for r in rows.select("id", vector.encoder(load)(F.col("t")).alias("v")).collect()}
    assert got == {1: [3.0], 2: None, 3: None, 4: [800.0]}
    assert spark.createDataFrame([("fail",)], "t string").select(vector.encoder(load)("t").alias("v")).first()["v"] is None
