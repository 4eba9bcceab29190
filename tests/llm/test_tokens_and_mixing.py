import random

import pytest

from weftlight.llm import bpe, distinctive, mixing

PATH = f"{bpe.VOCABULARY_DIR}/byte_bpe_50k.json"


@pytest.fixture(scope="module")
def machine():
    return bpe.MatrixEncoder(PATH)


def random_texts(n, seed=1):
    rng = random.Random(seed)
    pools = [range(32, 127), range(160, 0x700), range(0x900, 0xE80), range(0x3000, 0x9FFF), [0x1F600, 0x1F468, 0x200D, 9, 10, 13, 32, 0xA0]]
    return ["".join(chr(rng.choice(rng.choice(pools))) for _ in range(rng.randrange(200))) for _ in range(n)]


def test_ids_equal_the_library(machine):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH)
    library.encode_special_tokens = True
    texts = random_texts(200) + ["", None, "<|endoftext|> it's we'll I'D", "a" * 3000, "日本" * 900, " " * 200, "\r\n\r\n \n"]
    ids, offsets = machine.encode(texts)
    expected = library.encode_batch([t or "" for t in texts], add_special_tokens=False)
    for k, e in enumerate(expected):
        assert list(ids[offsets[k] : offsets[k + 1]]) == e.ids


def test_ids_equal_the_rank_file(machine):
    import base64

    import tiktoken

    with open(f"{bpe.VOCABULARY_DIR}/byte_bpe_50k.tiktoken", "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    other = tiktoken.Encoding("own", pat_str=bpe.WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = random_texts(100, seed=2)
    ids, offsets = machine.encode(texts)
    assert [list(ids[offsets[k] : offsets[k + 1]]) for k in range(len(texts))] == [other.encode_ordinary(t) for t in texts]


def test_cache_limit_changes_nothing(machine, monkeypatch):
    texts = random_texts(50, seed=3)
    before = machine.encode(texts)
    monkeypatch.setattr(bpe, "CACHED_WORDS", 10)
    after = machine.encode(texts)
    assert (before[0] == after[0]).all() and (before[1] == after[1]).all()


def test_token_ids_frame(spark):
    rows = [(1, "Hello world"), (2, ""), (3, None), (1, "Hello world"), (None, "x")]
    found = bpe.token_ids(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "2 as ids")).collect()
    assert sorted((str(r["doc_id"]), r["ids"]) for r in found) == [("1", [15496, 995]), ("1", [15496, 995]), ("2", []), ("3", []), ("None", [87])]
    assert bpe.token_ids(spark.createDataFrame([], "doc_id long, text string")).count() == 0


DOCS = "doc_id long, text string, source string"
TARGETS = "mix_name string, source string, target_share double, max_repeats int"


def test_mix_reaches_its_shares(spark):
    docs = [(i, "word " * 20, "a") for i in range(200)] + [(1000 + i, "word " * 20, "b") for i in range(40)] + [(2000 + i, "x " * 30, "c") for i in range(100)]
    targets = [("m", "a", 2.0, 1), ("m", "b", 2.0, 4), ("m", "gone", 4.0, 2), ("n", "c", 0.5, 2), ("n", "a", 0.5, 1)]
    sequence, plan = mixing.mixed_sequence(spark.createDataFrame(docs, DOCS), spark.createDataFrame(targets, TARGETS))
    rows = sequence.collect()
    shares = {(r["mix_name"], r["source"]): r for r in mixing.shares_reached(sequence, plan).collect()}
    assert abs(shares["m", "a"]["actual_share"] - 0.5) < 0.02 and abs(shares["m", "b"]["actual_share"] - 0.5) < 0.02
    assert shares["m", "gone"]["actual_share"] == 0 and shares["m", "gone"]["gap"] == -0.5
    assert all(r["repeats_used"] <= r["max_repeats"] for r in shares.values())
    uses = {}
    for r in rows:
        uses.setdefault((r["mix_name"], r["source"], r["doc_id"]), set()).add(r["pass_no"])
    assert all(sorted(p) == list(range(1, len(p) + 1)) for p in uses.values())
    positions = [(r["mix_name"], r["position"]) for r in rows]
    assert positions == sorted(positions) and all(0 <= p <= 1 for _, p in positions)


def test_running_tokens_against_plain_sum(spark):
    docs = spark.createDataFrame([(i, f"s{i % 3}", i % 7 + 1) for i in range(500)], "doc_id long, source string, n_tokens long")
    found = mixing.running_tokens(docs, buckets=16).collect()
    for s in ("s0", "s1", "s2"):
        own = sorted((r["tokens_before"], r["n_tokens"]) for r in found if r["source"] == s)
        total = 0
        for before, n in own:
            assert before == total
            total += n


def test_schedules_add_up_and_meet_their_shares():
    import numpy as np

    rng = np.random.default_rng(1)
    times = np.array([0.0, 0.2, 0.5, 1.0])
    for shares in ([0.5, 0.3, 0.2], [0.9, 0.1, 0.0], [1.0, 0.0, 0.0]):
        w = mixing.fitted_schedules(rng.random((3, 4)) + 0.2, times, np.array(shares))
        assert np.allclose(w.sum(axis=0), 1) and np.allclose(np.trapezoid(w, times, axis=1), shares, atol=1e-6) and (w >= 0).all()


def test_inverse_demand_inverts(spark):
    import numpy as np
    from pyspark.sql import functions as F

    times = [0.0, 0.3, 0.6, 1.0]
    for weights in ([0.2, 0.8, 0.8, 0.0], [0.0, 0.0, 1.0, 3.0], [1.0, 1.0, 1.0, 1.0], [2.0, 0.0, 0.0, 2.0]):
        fine = np.linspace(0, 1, 20_001)
        total = np.r_[0, np.cumsum((np.interp(fine[1:], times, weights) + np.interp(fine[:-1], times, weights)) / 2 * np.diff(fine))]
        demand = [float(total[np.searchsorted(fine, t - 1e-9)]) for t in times]
        lists = [F.array(*[F.lit(x) for x in part]) for part in (times, weights, demand)]
        rows = spark.range(1, 100).select((F.col("id") / 100).alias("f")).select("f", mixing.inverse_demand(F.col("f"), *lists).alias("t")).collect()
        assert all(abs(np.interp(r["t"], fine, total) - r["f"] * total[-1]) < 1e-6 for r in rows)


def test_a_stated_schedule_orders_the_run(spark):
    docs = [(i, "word " * 20, "a") for i in range(300)] + [(1000 + i, "word " * 20, "b") for i in range(300)]
    targets = spark.createDataFrame([("m", "a", 1.0, 1), ("m", "b", 1.0, 1)], TARGETS)
    stated = spark.createDataFrame([("m", "a", 0.0, 1.0), ("m", "a", 1.0, 0.0), ("m", "b", 0.0, 0.0), ("m", "b", 1.0, 1.0), ("m", None, 0.5, 1.0), ("m", "a", None, 1.0)], "mix_name string, source string, t double, weight double")
    rows = mixing.mixed_sequence(spark.createDataFrame(docs, DOCS), targets, schedules=stated)[0].collect()
    assert len(rows) == 600
    for low, high, share in ((0.0, 0.1, 0.95), (0.45, 0.55, 0.5), (0.9, 1.0, 0.05)):
        part = [r["source"] == "a" for r in rows if low <= r["position"] < high]
        assert abs(len(part) / 600 - 0.1) < 0.01  # the position is the share of the run that is done
        assert abs(sum(part) / len(part) - share) < 0.03


def test_a_stated_size(spark):
    import numpy as np

    docs = [(i, "word " * 20, "a") for i in range(100)] + [(1000 + i, "word " * 20, "b") for i in range(100)]
    targets = spark.createDataFrame([("m", "a", 3.0, 1), ("m", "b", 1.0, 2), ("n", "a", 1.0, 1)], TARGETS)
    frame = spark.createDataFrame(docs, DOCS)
    half = mixing.mixed_sequence(frame, targets, total_tokens=400)
    used = {(r["mix_name"], r["source"]): r["tokens_used"] for r in mixing.shares_reached(*half).collect()}
    assert abs(used["m", "a"] - 300) <= 21 and abs(used["m", "b"] - 100) <= 21 and abs(used["n", "a"] - 400) <= 21
    more = mixing.mixed_sequence(frame, targets, total_tokens={"m": 10**9})
    used = {(r["mix_name"], r["source"]): (r["repeats_used"], r["tokens_used"] == r["tokens_there"] * r["max_repeats"]) for r in mixing.shares_reached(*more).collect()}
    assert used == {("m", "a"): (1, True), ("m", "b"): (2, True), ("n", "a"): (1, True)}
    assert mixing.wanted_tokens(np.array([0.5, 0.5]), np.array([10.0, 100.0]), 60).tolist() == [10.0, 50.0]


def test_mix_dirty(spark):
    docs = [(1, "a b c", "a"), (1, "a b c", "a"), (2, None, "a"), (3, "", "a"), (None, "x", "a"), (4, "x", None)]
    targets = [("m", "a", None, 2), ("m", "a", 1.0, None), ("m", None, 1.0, 1), (None, "a", 1.0, 1), ("z", "a", -1.0, 1), ("z", "b", float("nan"), 1)]
    sequence, plan = mixing.mixed_sequence(spark.createDataFrame(docs, DOCS), spark.createDataFrame(targets, TARGETS))
    assert [(r["mix_name"], r["doc_id"], r["pass_no"]) for r in sequence.collect()] == [("m", 1, 1), ("m", 1, 2)]
    assert mixing.shares_reached(sequence, plan).count() == 3
    empty, _ = mixing.mixed_sequence(spark.createDataFrame([], DOCS), spark.createDataFrame(targets, TARGETS))
    assert empty.count() == 0


def test_distinctive_words(spark):
    import math

    rows = [(w, p, tf) for p in range(1, 9) for w, tf in ((1, 0.5), (2 + p % 2, 0.25), (10 + p, 0.25))] + [(1, 1, 0.5), (None, 1, 0.5), (1, None, 0.1), (5, 1, None), (6, 1, float("nan")), (7, 1, 0.0)]
    frame = spark.createDataFrame(rows, "word_id long, page_id long, tf double")
    scored = distinctive.scored_words(frame)
    one = scored.filter("word_id = 2").first()
    assert one["df"] == 4 and one["cf"] == 4
    assert abs(one["observed"] - math.log(2)) < 1e-12 and abs(one["expected"] + math.log(1 - math.exp(-0.5))) < 1e-12
    top = distinctive.top_words(scored).collect()
    # the word of all pages scores 0 and still fills the second place; words of one page never count
    assert sorted((r["page_id"], r["word_id"]) for r in top) == sorted([(p, 2 + p % 2) for p in range(1, 9)] + [(p, 1) for p in range(1, 9)])
    assert distinctive.scored_words(frame.limit(0)).count() == 0
