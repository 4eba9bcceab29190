import re

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from weftlight.functions import text as X
from weftlight.plans.oracles import stemmed


def column(spark, values, build, kind="string"):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["r"] for r in frame.select("i", build(F.col("v")).alias("r")).orderBy("i").collect()]


STEMS = {
    "running": "run", "agreed": "agree", "agreement": "agree", "pythonic": "pythonic", "cats": "cat", "indexes": "index", "crawls": "crawl", "crawling": "crawl",
    "crawled": "crawl", "pages": "pag", "page": "page", "databases": "databas", "king": "k", "string": "str", "need": "nee", "others": "oth", "created": "create",
    "ings": "", "faster": "fast", "is": "is", "classes": "class", "flies": "fli", "status": "status", "basis": "basis", "Kindly ": "kind", "falling": "fall",
}


def test_stems(spark):
    assert column(spark, list(STEMS), X.stem) == list(STEMS.values())


def test_tokens(spark):
    cases = {
        "We are building a distributed web crawler!": ["build", "distribut", "web", "crawl"], "test-case": ["test-case"], "": [], None: [], "Error 313": ["error", "313"],
        "Running faster than expected": ["run", "fast", "expect"], "café foo-": ["foo"], "_x-y a_b": ["-y"], "don't can't": ["don", "can"], "x²y 日本abc": [],
        "a" * 51 + " ok then": ["ok"], "éa bc": ["bc"], "ings": [], "the THE The": [], "\U0001D518nit two": ["two"],
    }
    found = column(spark, list(cases), X.tokens)
    expected = list(cases.values())
    for k, f, e in zip(cases, found, expected, strict=True):
        assert f == e, k


def plain_tokens(text):
    """A restatement in plain Python."""
    stop = set(X.STOP_WORDS)
    words = [w for w in re.findall(r"\b[a-zA-Z0-9\-]+\b", text.lower()) if w not in stop and 2 <= len(w) <= 50]
    return len(words)


def test_stop_words_and_length_match_plain_python(spark, small):
    texts = [r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").filter("text is not null").limit(150).collect()]
    words = column(spark, texts, lambda c: F.size(F.filter(X.raw_words(c), lambda w: ~X.is_stop_word(w) & F.length(w).between(2, 50))), "string")
    assert words == [plain_tokens(t) for t in texts]


def test_clean_text_and_hash(spark):
    import hashlib

    assert column(spark, [" a  b\x0b\x85c\n"], X.clean_text) == ["a b c"]
    assert column(spark, ["é"], X.content_hash) == [hashlib.sha256("é".encode()).hexdigest()]


def plain_snippet(content, tokens, most=200):
    if not content:
        return ""
    hits = [m.start() for t in tokens for m in [re.search(r"\b" + re.escape(t), content.lower())] if m]
    if not hits:
        return content[:most] + ("..." if len(content) > most else "")
    start, end = max(0, min(hits) - 60), min(len(content), min(hits) + most - 60)
    piece = content[start:end]
    if start > 0:
        piece = "..." + piece.partition(" ")[2] if " " in piece else "..." + piece
    if end < len(content):
        piece = piece.rpartition(" ")[0] + "..." if " " in piece else piece + "..."
    return piece


SNIPPETS = [
    ("", ["a"]), ("no hit here", ["zzz"]), ("crawl at once", ["crawl"]), ("x" * 30 + " crawling the web " + "y " * 200, ["crawl"]), ("word " * 100 + "crawling " + "tail " * 100, ["crawl"]),
    ("word " * 100 + "crawl", ["crawl"]), ("z" * 500 + "crawl" + "z" * 500, ["crawl"]), ("q" * 200, ["crawl"]), ("a" * 199 + " crawl", ["crawl"]), ("é " * 90 + "page " * 60, ["pag"]), ("text", []),
    ("𝔘 " * 50 + "crawl " * 60, ["crawl", "zzz"]),
]


def test_snippets(spark):
    rows = spark.createDataFrame([(i, c, t) for i, (c, t) in enumerate(SNIPPETS)], "i int, c string, t array<string>")
    found = [r["s"] for r in rows.select("i", X.snippet(F.col("c"), F.col("t")).alias("s")).orderBy("i").collect()]
    for f, (c, t) in zip(found, SNIPPETS, strict=True):
        assert f == plain_snippet(c, t)


def test_stem_equals_its_sql_on_the_vocabulary(spark, small):
    import duckdb

    words = [r["word"] for r in spark.read.parquet(f"{small}/words.parquet").collect()]
    ours = column(spark, words, X.stem)
    con = duckdb.connect()
    con.execute("CREATE TABLE v AS SELECT unnest($1) AS w, unnest(range(len($1))) AS i", [words])
    assert ours == [r[0] for r in con.execute(f"SELECT stem FROM {stemmed('v')} ORDER BY i").fetchall()]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="abcdefgilmnrstuyz", min_size=1, max_size=12), min_size=1, max_size=40))
def test_stems_never_grow_by_more_than_a_letter(spark, words):
    for w, s in zip(words, column(spark, words, X.stem), strict=True):
        assert len(s) <= len(w) + 1


@pytest.mark.parametrize("n, df, low, high", [(1000, 1, 5.0, 9.0), (1000, 1000, 0.0, 1.0)])
def test_idf_points(spark, n, df, low, high):
    from weftlight.operators.index import with_idf

    assert low < with_idf(spark.createDataFrame([("w", df)], "word string, df long"), n).first()["idf"] < high
