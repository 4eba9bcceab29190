import json

import numpy as np
import pytest

from weftlight.llm import neighbours as N
from weftlight.sources.tables import table

SCHEMA = "page_id long, embedding string, model_name string, created_at timestamp"


def brute_force(vectors, k):
    ids = np.array(sorted(vectors))
    x = np.array([vectors[i] for i in ids], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    cosine = np.round(x @ x.T, 6)
    out = {}
    for r, i in enumerate(ids):
        order = sorted((c for c in range(len(ids)) if c != r), key=lambda c: (-cosine[r, c], ids[c]))
        out[int(i)] = [int(ids[c]) for c in order[:k]]
    return out


def rows_of(vectors):
    return [(i, json.dumps(list(map(float, v))), "m", None) for i, v in vectors.items()]


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((12, 16))
    vectors = {i + 1: np.round(centres[rng.integers(12)] + 0.35 * rng.standard_normal(16), 4) for i in range(400)}
    for i in range(401, 461):  # one region with many, and exact copies
        vectors[i] = np.round(centres[0] + 0.1 * rng.standard_normal(16), 4)
    for i in range(461, 475):
        vectors[i] = vectors[1]
    return vectors


@pytest.mark.parametrize(("block", "cell_size", "fit_vectors"), [(4096, 512, 16384), (24, 512, 16384), (4096, 20, 16384), (24, 12, 96)])
def test_recall_and_blocks(spark, clustered, block, cell_size, fit_vectors):
    """Whole, in blocks, in many cells, and in cells that are cut again from small samples."""
    found = N.nearest_neighbours(spark.createDataFrame(rows_of(clustered), SCHEMA), 5, dimensions=16, block=block, cell_size=cell_size, fit_vectors=fit_vectors).collect()
    expected = brute_force(clustered, 5)
    hits = {(r["page_id"], r["neighbour"]) for r in found}
    truth = {(i, j) for i, js in expected.items() for j in js}
    assert len(hits & truth) / len(truth) > 0.97
    assert all(r["page_id"] != r["neighbour"] for r in found)


def test_recall_where_the_index_is_fitted_on_a_small_sample(spark, small):
    frame = table(spark, small.replace("0.001", "0.01"), "page_embeddings")
    whole = {(r["page_id"], r["neighbour"]) for r in N.nearest_neighbours(frame, 5, cell_size=1 << 20).collect()}
    found = {(r["page_id"], r["neighbour"]) for r in N.nearest_neighbours(frame, 5, fit_vectors=160, cell_size=64).collect()}
    assert len(whole) > 2000 and len(found & whole) / len(whole) >= 0.9


def test_ties_go_to_the_smaller_id(spark, clustered):
    found = N.nearest_neighbours(spark.createDataFrame(rows_of(clustered), SCHEMA), 5, dimensions=16).filter("page_id = 470").orderBy("rank").collect()
    assert [r["neighbour"] for r in found] == [1, 461, 462, 463, 464]


def test_dirty_vectors(spark):
    good = [1.0, 2.0, 3.0, 4.0]
    rows = [
        (1, json.dumps(good), "m", None), (1, json.dumps(good), "m", None), (2, json.dumps([2.0, 4.0, 6.0, 8.1]), "m", None), (3, "[1, 2, 3", "m", None),
        (4, "[]", "m", None), (5, None, "m", None), (6, "[0, 0, 0, 0]", "m", None), (7, "[NaN, 1, 2, 3]", "m", None), (8, "[1, 2, 3]", "m", None),
        (None, json.dumps(good), "m", None), (9, "[null, 1, 2, 3]", "m", None), (10, "[1e999, 1, 2, 3]", "m", None), (11, '["a", 1, 2, 3]', "m", None),
        (12, "[[1], 2, 3, 4]", "m", None), (13, "[true, 1, 2, 3]", "m", None),
    ]
    found = N.neighbour_pairs(N.nearest_neighbours(spark.createDataFrame(rows, SCHEMA), 5, dimensions=4)).collect()
    assert [tuple(r) for r in found] == [(1, 2)]


def test_empty_table(spark):
    assert N.nearest_neighbours(spark.createDataFrame([], SCHEMA), 5).count() == 0


def test_newest_vector_counts(spark):
    from datetime import datetime

    rows = [(1, "[1, 0]", "m", datetime(2024, 1, 1)), (1, "[0, 1]", "m", datetime(2025, 1, 1)), (2, "[0, 2]", "m", None)]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as payload", "'x' as cell")
    found = N.nearest_neighbours(frame, 1, dimensions=2).filter("page_id = 2").first()
    assert (found["neighbour"], found["cosine"]) == (1, 1.0)


def test_a_group_of_copies_of_any_size(spark, clustered):
    """Half of all rows are one vector: copies are neighbours of each other, and the smallest of them of others."""
    vectors = dict(clustered)
    vectors |= {1000 + i: vectors[3] for i in range(len(clustered))}
    found = N.nearest_neighbours(spark.createDataFrame(rows_of(vectors), SCHEMA), 5, dimensions=16).collect()
    expected = brute_force(vectors, 5)
    by_page = {}
    for r in sorted(found, key=lambda r: (r["page_id"], r["rank"])):
        by_page.setdefault(r["page_id"], []).append(r["neighbour"])
    assert by_page == expected
    assert [r["cosine"] for r in found if r["page_id"] == 1200] == [1.0] * 5


def test_a_tree_of_several_levels():
    rng = np.random.default_rng(3)
    tree = N.Tree()
    centres = rng.standard_normal((40, 8)).astype(np.float32)
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    tree.add(centres[:4], np.array([0, 1, 1, 2]))
    tree.add(centres[4:10], np.arange(6), 1)
    tree.add(centres[10:14], np.arange(4), 5)
    tree.add(centres[14:15], np.array([0]), 0)  # it cannot be cut: a dense region
    assert tree.dense == {0} and tree.cells == 13
    row, cell = tree.nearest(centres, 2)
    assert set(cell) <= {0, 2, *range(3, 13)} - {5} and (np.diff(row) >= 0).all() and np.bincount(row).max() == 2
    alone = [tree.nearest(centres[i : i + 1], 2)[1].tolist() for i in range(40)]
    assert alone == [cell[row == i].tolist() for i in range(40)]


def test_packing_is_exact():
    rng = np.random.default_rng(1)
    vectors = [np.round(rng.standard_normal(8), 4), rng.standard_normal(8), rng.standard_normal(8) * 1e6]
    together = N.Vectors([N.packed(v) for v in vectors], 8)
    every = np.arange(3)
    assert np.allclose(together.cosines(every, together, every[::-1]), [a @ b / np.linalg.norm(a) / np.linalg.norm(b) for a, b in zip(vectors, vectors[::-1], strict=True)], atol=1e-15)
    for i, v in enumerate(vectors):
        alone = N.Vectors([N.packed(v)], 8)
        assert np.allclose(alone.unit[0], v / np.linalg.norm(v), atol=1e-6) and np.allclose(alone.unit[0], together.unit[i], atol=1e-6)


def test_codes_bound_the_inner_product():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((200, 64)) + rng.standard_normal((200, 1)) * np.ones(64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    turn = N.rotation(64)
    assert np.allclose(turn @ turn.T, np.eye(64), atol=1e-9)
    centre = x.mean(axis=0)
    codes = N.Codes(x, centre, turn)
    differ = N.differing_bits(codes.words, codes.words)
    signs = (x - centre) @ turn >= 0
    assert (differ == (signs[:, None] != signs[None]).sum(axis=2)).all()
    estimate, upper = N.cosine_bounds(64, 2.5)
    lengths = codes.length[:, None] * codes.length
    rest = codes.centre_dot + (x @ centre)[:, None]
    other = ~np.eye(200, dtype=bool)
    assert (upper[differ] * lengths + rest >= x @ x.T)[other].mean() > 0.97
    assert abs((estimate[differ] * lengths + rest - x @ x.T)[other].mean()) < 0.02
