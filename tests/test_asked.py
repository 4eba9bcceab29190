"""Searches in which every row whose id is divisible by 20 asks."""

import datetime
import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from comparing import compared, connection

from weftlight.operators import rank
from weftlight.plans.catalogue import ORACLES, QUERIES

def test_blended_search_of_every_asking_page(spark, small):
    found = QUERIES["search_blended_asked"](spark, small).toPandas()
    titled = connection(small).execute("SELECT id FROM pages WHERE id % 20 = 0 AND regexp_matches(title, '[a-z]{3}')").df()["id"]
    assert len(titled) and set(titled) <= set(found["query_id"])
    # a page's own vector is its query's: it is the most similar of its candidates
    own = found[(found["query_id"] == found["page_id"]) & (found["semantic"] > 0)]
    assert len(own) and (own["semantic"] > 0.9).all()


def test_blocks_change_nothing(spark):
    draw = np.random.default_rng(3).integers(-3, 4, (60, 4)).astype(float)
    draw[7] = 0
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(draw)] + [(None, [1.0] * 4), (99, None)], "id long, vector array<double>")
    asked = rows.filter("id % 5 = 0").withColumnRenamed("id", "query_id")
    for cosine in (False, True):
        one, many = (sorted(map(tuple, rank.nearest_by_vectors(rows, asked, 6, cosine=cosine, block=b).collect())) for b in (4096, 7))
        assert one == many and len(one) == 12 * 6 and not (cosine and any(r[1] == 7 for r in one))


def test_no_pair_of_text_and_document_is_shuffled(spark, small):
    plan = QUERIES["tfidf_topk_asked"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Aggregate\(keys=\[query_id#\d+L?, page_id#", plan)


def test_documents_of_one_id_are_one_and_null_ids_are_none(spark, tmp_path):
    rows = [(i, f"harbour market w{i % 3}x lantern q{i % 7}y {'bridge ' * (i % 4)}") for i in range(200)]
    rows += [(20, "bridge lantern copper copper"), (40, "market"), (40, None), (60, ""), (41, "copper copper kiln"), (None, "harbour copper"), (None, "kiln"), (300, None)]
    whole = {"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": [r[1] for r in rows], "fetched_at": [datetime.datetime(2024, 1, 1)] * len(rows)}
    pq.write_table(pa.table(whole), tmp_path / "documents.parquet")
    ours, theirs = compared(spark, str(tmp_path), QUERIES["tfidf_topk_asked"], ORACLES["tfidf_topk_asked"])
    assert len(ours) == 10 * 50 and ours == theirs


def test_blocks_of_a_text_search_change_nothing(spark):
    draw = np.random.default_rng(5)
    rows = [(int(i), [f"w{w}" for w in draw.zipf(1.4, 8) % 40]) for i in draw.permutation(300)]
    pages = spark.createDataFrame(rows, "page_id long, tokens array<string>")
    asked = pages.filter("page_id % 20 = 0").withColumnRenamed("page_id", "query_id")
    one, many = (sorted(map(tuple, rank.candidates_of_many(asked, pages, 300, 9, block=b, query_block=q).collect())) for b, q in ((10**6, 10**6), (300, 40)))
    assert one == many and len(one) == 15 * 9
    # every sum, without blocks and bounds
    df = {w: sum(w in t for _, t in rows) for _, t in rows for w in t}
    for i, tokens in rows:
        if i % 20 == 0:
            sums = {p: round(sum(t.count(w) / len(t) * np.log(1 + 300 / (1 + df[w])) for w in sorted(set(tokens))), 12) for p, t in rows if set(t) & set(tokens)}
            assert [p for q, p, _ in sorted((r for r in one if r[0] == i), key=lambda r: (-r[2], r[1]))] == [p for p, _ in sorted(sums.items(), key=lambda x: (-x[1], x[0]))[:9]]


def test_text_search_without_documents(spark):
    pages = spark.createDataFrame([(1, ["a"])], "page_id long, tokens array<string>")
    none = pages.filter("page_id > 5")
    assert rank.candidates_of_many(none.withColumnRenamed("page_id", "query_id"), pages, 1).count() == 0
    assert rank.candidates_of_many(none.withColumnRenamed("page_id", "query_id"), none, 0).count() == 0
