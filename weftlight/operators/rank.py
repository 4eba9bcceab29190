"""Blended ranking of many queries in one plan: TF-IDF, PageRank and vector similarity."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from weftlight.functions import vector
from weftlight.functions.text import snippet, tokens
from weftlight.operators.index import page_tokens, with_idf
from weftlight.plans.joins import sized_join
from weftlight.plans.lineage import written

CANDIDATES, RESULTS, UNRANKED = 50, 20, 0.15
#: Weights with and without a query vector: TF-IDF, PageRank, similarity.
WITH_VECTOR, WITHOUT_VECTOR = (0.5, 0.3, 0.2), (0.7, 0.3, 0.0)
#: Distinct words of queries up to which they are looked up in the index by name.
PUSHED_WORDS = 1000
#: Vectors of one side of a matrix product, and the queries of one step of it.
BLOCK, STEP = 4096, 512
#: Tokens of the pages, and words of the queries, of one block of a text search. Every how manieth page is looked at for a first bound.
BLOCK_TOKENS, BLOCK_WORDS, SPARSE = 2_000_000, 1_000_000, 16


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, word): the distinct tokens of each query."""
    return queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("query")))).alias("word"))


def candidates(terms: DataFrame, index: DataFrame, page_count: int, k: int = CANDIDATES) -> DataFrame:
    """(query_id, page_id, raw): the k pages of each query with the highest sum of tf * idf.

    Only postings of query words go on; a word's frequency is counted after that.
    Sums are rounded to twelve decimals before ranking, ties go to the smaller id.
    """
    words = terms.select("word").distinct().limit(PUSHED_WORDS + 1).collect()
    size = terms.count()  # what is joined below is at most as large
    if len(words) <= PUSHED_WORDS:  # few words reach the scan: an index sorted by word is read in part
        hits = index.select("page_id", "word", "tf").filter(F.col("word").isin([r["word"] for r in words]))
    else:
        hits = sized_join(index.select("page_id", "word", "tf"), terms.select("word").distinct(), ["word"], "left_semi", right_rows=size)
    weights = with_idf(hits.groupBy("word").agg(F.count("*").alias("df")), page_count).select("word", "idf")
    asked = terms.join(weights, "word")
    # a page's postings in one place: its sums for all queries, and the k best there, need no further shuffle
    hits = hits.repartition(4 * int(hits.sparkSession.conf.get("spark.sql.shuffle.partitions")), "page_id")
    scored = sized_join(hits, asked, ["word"], right_rows=size).groupBy("query_id", "page_id").agg(F.round(F.sum(F.col("tf") * F.col("idf")), 12).alias("raw"))
    best = Window.partitionBy("query_id").orderBy(F.desc("raw"), F.asc("page_id"))
    return scored.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= k).drop("_r")


def page_terms(pages: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(page_id, tokens) of each id that has a token; rows with one id are one page, null ids are left out."""
    each = page_tokens(pages.filter(F.col(id_col).isNotNull()), id_col, text_col)
    # tokens have no spaces: one text is shuffled with less than an array of them
    return each.groupBy("page_id").agg(F.split(F.array_join(F.collect_list(F.array_join("tokens", " ")), " "), " ").alias("tokens"))


def candidates_of_many(queries: DataFrame, pages: DataFrame, page_count: int, k: int = CANDIDATES, *, block: int = BLOCK_TOKENS, query_block: int = BLOCK_WORDS) -> DataFrame:
    """(query_id, page_id, raw): what ``candidates`` finds, for so many queries that most pages are met by most of them.

    ``queries``: (query_id, tokens), ``pages``: (page_id, tokens), both unique and kept as tables. Both are
    cut into blocks of about ``block`` tokens and ``query_block`` words. The sums of a
    query over a block's pages are an array in memory, of which only the k best go on: no
    pair of a query and a page is shuffled, sorted or spilled.
    """
    terms = queries.select("query_id", F.explode(F.array_distinct("tokens")).alias("word"))
    weights = pages.select(F.explode(F.array_distinct("tokens")).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    weights = sized_join(weights, written(terms.select("word").distinct(), "query-words"), ["word"], "left_semi")
    weights = written(with_idf(weights, page_count).select("word", "idf"), "word-weights")
    asked = sized_join(terms, weights, ["word"]).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("word", "idf"))).alias("w"))
    asked = asked.select("query_id", F.array_join("w.word", " ").alias("words"), F.col("w.idf").alias("idf"))
    # the fewest blocks that fit a worker, as each gives k rows a query; then enough pairs of blocks for all cores
    total, words = (df.agg(F.sum(F.size("tokens")).alias("n")).first()["n"] or 0 for df in (pages, queries))
    page_blocks = max(1, math.ceil(total / block))
    query_blocks = max(math.ceil(words / query_block), math.ceil(2 * pages.sparkSession.sparkContext.defaultParallelism / page_blocks))

    def dealt(df: DataFrame, key: str, own: str, blocks: int, other: str, others: int) -> DataFrame:
        placed = df.withColumn(own, F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"))
        return placed.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    kinds = pa.schema([("query_id", pa.int64()), ("page_id", pa.int64()), ("raw", pa.float64())])

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return kinds.empty_table()
        ids = left["page_id"].to_numpy()
        order = np.argsort(ids)  # ids ascend: ties go to the smaller one
        ids, texts = ids[order], pc.split_pattern(left["tokens"].combine_chunks().take(pa.array(order)), " ")
        query_ids, query_words = right["query_id"].to_numpy(), pc.split_pattern(right["words"].combine_chunks(), " ")
        # postings of the queries' words, by word and page
        coded = pc.dictionary_encode(query_words.flatten())
        codes, vocabulary = coded.indices.to_numpy(), coded.dictionary
        idf = np.empty(len(vocabulary))
        idf[codes] = right["idf"].combine_chunks().flatten().to_numpy()
        lengths = pc.list_value_length(texts).to_numpy()
        met = pc.index_in(texts.flatten(), value_set=vocabulary).fill_null(-1).to_numpy()
        known = met >= 0
        keys, n = np.unique(met[known].astype(np.int64) * len(ids) + np.repeat(np.arange(len(ids)), lengths)[known], return_counts=True)
        word, page = np.divmod(keys, len(ids))
        value = n / lengths[page] * idf[word]
        starts = np.searchsorted(word, np.arange(len(vocabulary) + 1)).tolist()
        ends = np.append(0, np.cumsum(pc.list_value_length(query_words).to_numpy())).tolist()
        sums, codes, out = np.empty(len(ids)), codes.tolist(), []
        for i in range(len(query_ids)):
            sums.fill(0)
            for c in codes[ends[i] : ends[i + 1]]:
                a, b = starts[c], starts[c + 1]
                sums[page[a:b]] += value[a:b]  # a page is met once by a word
            at = np.flatnonzero(sums >= _bound(sums[::SPARSE], k))
            at = at[sums[at] > 0]
            at = at[sums[at] >= _bound(sums[at], k)]
            raw = np.round(sums[at], 12)
            first = np.argsort(-raw, kind="stable")[:k]
            out.append((np.full(len(first), query_ids[i]), ids[at[first]], raw[first]))
        return pa.table([np.concatenate(column) for column in zip(*out, strict=True)], schema=kinds)

    left = dealt(pages.select("page_id", F.array_join("tokens", " ").alias("tokens")), "page_id", "_r", page_blocks, "_q", query_blocks)
    right = dealt(asked, "query_id", "_q", query_blocks, "_r", page_blocks)
    found = left.groupBy("_r", "_q").cogroup(right.groupBy("_r", "_q")).applyInArrow(best, "query_id long, page_id long, raw double")
    # at most k rows of each block
    window = Window.partitionBy("query_id").orderBy(F.desc("raw"), F.asc("page_id"))
    return found.withColumn("_n", F.row_number().over(window)).filter(F.col("_n") <= k).drop("_n")


def _bound(sums: np.ndarray, k: int) -> float:
    """What the k best of these sums, and so of any that hold them, reach before they are rounded to twelve decimals."""
    return np.partition(sums, len(sums) - k)[len(sums) - k] - 2e-12 if len(sums) > k else 0.0


def iso(time: Column) -> Column:
    """A time as ISO 8601 text, with microseconds where there are any."""
    rest = F.pmod(F.unix_micros(time), F.lit(1_000_000))
    return F.concat(F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss"), F.when(rest != 0, F.concat(F.lit("."), F.lpad(rest.cast("string"), 6, "0"))).otherwise(""))


def search(
    queries: DataFrame, index: DataFrame, pages: DataFrame, *, page_count: int | None = None, query_vectors: DataFrame | None = None,
    page_vectors: DataFrame | None = None, limit: int = RESULTS, with_snippets: bool = True,
) -> DataFrame:
    """Results of all queries: score, its three parts, position and snippet.

    ``queries``: (query_id, query). ``query_vectors``: (query_id, vector);
    ``page_vectors``: (page_id, vector). A query without tokens or hits has no
    row. A query with a vector takes the weights for vectors even if no candidate
    has one; a missing or unusable page vector counts as 0.
    """
    count = pages.count() if page_count is None else page_count
    terms = written(query_terms(queries), "query-terms")
    found = written(candidates(terms, index, count), "candidates")  # at most 50 rows a query, used three times
    size = found.count()
    # the candidates are few: they find their pages, not the other way round; what is shown is fetched for the results alone
    ranked = pages.select(F.col("id").alias("page_id"), F.coalesce("pagerank", F.lit(UNRANKED)).alias("pagerank"))
    rows = sized_join(ranked, found, ["page_id"], right_rows=size)
    if query_vectors is not None and page_vectors is not None:
        own = sized_join(page_vectors, found.select("page_id").distinct(), ["page_id"], "left_semi", right_rows=size).withColumnRenamed("vector", "_page")
        asked = query_vectors.select("query_id", F.col("vector").alias("_query"))
        rows = sized_join(rows.join(own, "page_id", "left"), asked, ["query_id"], "left")
        similarity = F.coalesce(vector.dot(F.col("_page"), F.col("_query")), F.lit(0.0))
        rows = rows.withColumn("similarity", similarity).withColumn("has_vector", F.coalesce(F.size("_query") > 0, F.lit(False))).drop("_page", "_query")
    else:
        rows = rows.withColumn("similarity", F.lit(0.0)).withColumn("has_vector", F.lit(False))
    query = Window.partitionBy("query_id")

    def share(column: str) -> Column:
        top = F.max(column).over(query)
        return F.greatest(F.col(column) / F.when(top > 0, top).otherwise(1.0), F.lit(0.0))

    rows = rows.withColumns({"tfidf": share("raw"), "rank": share("pagerank"), "semantic": share("similarity")})
    blend = [F.when(F.col("has_vector"), a).otherwise(b) for a, b in zip(WITH_VECTOR, WITHOUT_VECTOR, strict=True)]
    rows = rows.withColumn("score", F.bround(blend[0] * F.col("tfidf") + blend[1] * F.col("rank") + blend[2] * F.col("semantic"), 5))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("page_id"))
    top = rows.withColumn("position", F.row_number().over(order).cast("long")).filter(F.col("position") <= limit)
    top = top.select("query_id", "position", "page_id", "score", *[F.bround(c, 4).alias(name) for c, name in (("tfidf", "tfidf"), ("rank", "pagerank"), ("semantic", "semantic"))])
    text = F.when(F.coalesce("title", F.lit("")) == "", "Untitled").otherwise(F.col("title")).alias("title")
    language = F.when(F.coalesce("language", F.lit("")) == "", "en").otherwise(F.col("language")).alias("language")
    shown = pages.select(F.col("id").alias("page_id"), "url", text, language, iso(F.col("crawl_time")).alias("crawl_time"), *(["content"] if with_snippets else []))
    out = sized_join(shown, top, ["page_id"], right_rows=size)
    if with_snippets:
        words = terms.groupBy("query_id").agg(F.sort_array(F.collect_set("word")).alias("_words"))  # bounded by the length of a query
        out = sized_join(out, words, ["query_id"]).withColumn("snippet", snippet(F.col("content"), F.col("_words")))
    names = ["query_id", "position", "page_id", "url", "title", "score", "language", "crawl_time", "tfidf", "pagerank", "semantic"]
    return out.select(*names, *(["snippet"] if with_snippets else []))


def nearest_by_vector(vectors: DataFrame, query_vector: list[float], k: int) -> DataFrame:
    """(id, similarity): the k rows of (id, vector) most similar to one vector."""
    asked = F.array(*[F.lit(float(x)) for x in query_vector])
    return vectors.select("id", F.round(vector.dot(F.col("vector"), asked), 6).alias("similarity")).orderBy(F.desc("similarity"), F.asc("id")).limit(k)


def nearest_by_vectors(vectors: DataFrame, asked: DataFrame, k: int, *, digits: int = 6, cosine: bool = False, block: int = BLOCK) -> DataFrame:
    """(query_id, id, similarity): the k rows of (id, vector) most similar to each vector of (query_id, vector).

    Both sides are cut into blocks of about ``block`` vectors, whose pairs are one
    matrix product each; only its k best rows a query go on. Null ids and vectors
    are left out; with ``cosine`` vectors of length 0 are too. Ties go to the smaller id.
    """
    rows, queries = (df.filter(F.col(key).isNotNull() & F.col("vector").isNotNull()).select(key, "vector") for df, key in ((vectors, "id"), (asked, "query_id")))
    row_blocks, query_blocks = (max(1, math.ceil(df.count() / block)) for df in (rows, queries))

    def dealt(df: DataFrame, key: str, own: str, blocks: int, other: str, others: int) -> DataFrame:
        placed = df.withColumn(own, F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"))
        return placed.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    def matrix(frame: pd.DataFrame) -> np.ndarray:
        return np.array(frame["vector"].tolist(), np.float64)

    def product(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            left = left.sort_values("id")
            m, q = matrix(left), matrix(right)
            kept, wanted = np.ones(len(m), bool), np.ones(len(q), bool)
            if cosine:
                lengths, asked_lengths = np.linalg.norm(m, axis=1), np.linalg.norm(q, axis=1)
                kept, wanted = lengths > 0, asked_lengths > 0
                m, q = m[kept] / lengths[kept, None], q[wanted] / asked_lengths[wanted, None]
            ids, query_ids = left["id"].to_numpy()[kept], right["query_id"].to_numpy()[wanted]
            for at in range(0, len(q), STEP):
                found = np.round(q[at : at + STEP] @ m.T, digits)
                best = np.argsort(-found, axis=1, kind="stable")[:, :k]  # ids ascend: ties go to the smaller one
                out.append(pd.DataFrame({
                    "query_id": np.repeat(query_ids[at : at + STEP], best.shape[1]), "id": ids[best].ravel(), "similarity": np.take_along_axis(found, best, 1).ravel(),
                }))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "id": [], "similarity": []})

    left, right = dealt(rows, "id", "_r", row_blocks, "_q", query_blocks), dealt(queries, "query_id", "_q", query_blocks, "_r", row_blocks)
    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {rows.schema['id'].dataType.simpleString()}, similarity double"
    found = left.groupBy("_r", "_q").cogroup(right.groupBy("_r", "_q")).applyInPandas(product, kinds)
    # at most k rows of each block
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), F.asc("id"))
    return found.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k).drop("_n")
