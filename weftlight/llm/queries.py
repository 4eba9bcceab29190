"""Queries of the training-text operators, by the names of the problems."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from weftlight.llm import bpe, distinctive, language, mixing, neighbours, repeated_lines, residue, sentences, stuffing, template
from weftlight.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    found = language.page_paragraphs(table(spark, d, "pages"), table(spark, d, "language_codes"))
    return language.mislabelled(language.page_languages(found)).select("page_id", "lang")


def p1_languages(spark: SparkSession, d: str) -> DataFrame:
    found = language.page_paragraphs(table(spark, d, "pages"), table(spark, d, "language_codes"))
    return language.page_languages(found).select("page_id", "lang", "paragraphs", "chars", "confidence", "chief")


def p1_segments(spark: SparkSession, d: str) -> DataFrame:
    return language.segments(language.page_paragraphs(table(spark, d, "pages"), table(spark, d, "language_codes")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue_pages(residue.page_residue(table(spark, d, "pages"))).select("page_id")


def p2_reasons(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue_pages(residue.page_residue(table(spark, d, "pages")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.neighbour_pairs(neighbours.nearest_neighbours(table(spark, d, "page_embeddings")))


def p3_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.nearest_neighbours(table(spark, d, "page_embeddings"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    lines, blocks = repeated_lines.stored_lines_and_blocks(table(spark, d, "pages"))
    return repeated_lines.repeated_occurrences(lines, blocks).select("page_id", "line_no")


def p4_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The blocks of each site: their lines, the pages of the most frequent one, and where the block stands first."""
    lines, blocks = repeated_lines.stored_lines_and_blocks(table(spark, d, "pages"))
    first = repeated_lines.repeated_occurrences(lines, blocks).groupBy("website_id", "block").agg(F.min(F.struct("page_id", "line_no")).alias("f"))
    sizes = blocks.groupBy("website_id", "block").agg(F.count("*").cast("int").alias("lines"), F.max("pages").alias("pages"))
    return sizes.join(first, ["website_id", "block"]).select("website_id", "lines", "pages", F.col("f.page_id").alias("first_page"), F.col("f.line_no").alias("first_line"))


def p4_cleaned(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages")
    lines, blocks = repeated_lines.stored_lines_and_blocks(pages)
    return repeated_lines.without_repeated_lines(pages, repeated_lines.repeated_occurrences(lines, blocks))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return distinctive.top_words(distinctive.scored_words(table(spark, d, "inverted_index")))


def p5_scores(spark: SparkSession, d: str) -> DataFrame:
    scored = distinctive.scored_words(table(spark, d, "inverted_index"))
    return scored.select("page_id", "word_id", "df", *[F.round(c, 9).alias(c) for c in ("tf", "observed", "expected", "residual", "score")])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return stuffing.stuffed_pages(stuffing.page_weights(table(spark, d, "pages"))).select("page_id")


def p6_weights(spark: SparkSession, d: str) -> DataFrame:
    """The found pages with their outgoing links, once each."""
    links = table(spark, d, "links").filter("source_page is not null").select("source_page", "destination_page").distinct()
    out = links.groupBy(F.col("source_page").alias("page_id")).agg(F.count("*").alias("links_out"))
    found = stuffing.stuffed_pages(stuffing.page_weights(table(spark, d, "pages")))
    return found.join(out, "page_id", "left").fillna(0, ["links_out"])


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return template.Templates(table(spark, d, "pages")).lines().filter("furniture").select("page_id", "line_no")


def p7_bodies(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages")
    return template.main_bodies(pages, template.Templates(pages).lines())


def p7_classes(spark: SparkSession, d: str) -> DataFrame:
    return template.Templates(table(spark, d, "pages")).equivalence_classes()


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.token_ids(table(spark, d, "documents"))


def p9_sequence(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixed_sequence(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    sequence, plan = mixing.mixed_sequence(table(spark, d, "documents"), table(spark, d, "mix_targets"))
    return mixing.shares_reached(sequence, plan)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentence_spans(table(spark, d, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        p1_found, p1_languages, p1_segments, p2_found, p2_reasons, p3_found, p3_neighbours, p4_found, p4_blocks, p4_cleaned,
        p5_found, p5_scores, p6_found, p6_weights, p7_found, p7_bodies, p7_classes, p8_ids, p9_sequence, p9_shares, p10_found,
    )
}

_LINES = """
lines AS (
  SELECT page_id, website_id, (i - 1)::INT AS line_no, regexp_replace(lower(l[i]), '[^\\p{L}\\p{M}]+', '', 'g') AS k
  FROM (SELECT id AS page_id, website_id, string_split(content, chr(10)) AS l FROM pages WHERE content IS NOT NULL AND website_id IS NOT NULL),
       unnest(range(1, len(l) + 1)) t(i)
)"""

#: SQL for what SQL can express on whole tables.
ORACLES: dict[str, str] = {
    "p4_found": f"""
WITH {_LINES},
often AS (SELECT website_id, k FROM lines WHERE k <> '' GROUP BY 1, 2 HAVING count(DISTINCT page_id) >= 8)
SELECT page_id, line_no FROM lines JOIN often USING (website_id, k)""",
    "p4_blocks": f"""
WITH RECURSIVE {_LINES},
often AS (SELECT website_id, k, count(DISTINCT page_id) AS pages FROM lines WHERE k <> '' GROUP BY 1, 2 HAVING count(DISTINCT page_id) >= 8),
seq AS (SELECT website_id, page_id, k AS a, lead(k) OVER (PARTITION BY page_id ORDER BY line_no) AS b FROM lines WHERE k <> ''),
edge AS (SELECT website_id, a, b FROM seq WHERE a <> b GROUP BY 1, 2, 3 HAVING count(DISTINCT page_id) >= 8),
both_ AS (SELECT website_id, a, b FROM edge UNION SELECT website_id, b, a FROM edge),
reach AS (SELECT website_id, k, k AS root FROM often UNION SELECT r.website_id, e.b, r.root FROM reach r JOIN both_ e ON e.website_id = r.website_id AND e.a = r.k),
comp AS (SELECT website_id, k, min(root) AS root FROM reach GROUP BY 1, 2),
size AS (SELECT website_id, root, count(*)::INT AS lines, max(pages) AS pages FROM comp JOIN often USING (website_id, k) GROUP BY 1, 2),
first_ AS (SELECT website_id, root, min({{'p': page_id, 'l': line_no}}) AS f FROM lines JOIN comp USING (website_id, k) GROUP BY 1, 2)
SELECT website_id, lines, pages, f.p AS first_page, f.l AS first_line FROM size JOIN first_ USING (website_id, root)""",
    "p4_cleaned": f"""
WITH {_LINES},
often AS (SELECT website_id, k FROM lines WHERE k <> '' GROUP BY 1, 2 HAVING count(DISTINCT page_id) >= 8),
marked AS (SELECT id AS page_id, (i - 1)::INT AS line_no, l[i] AS line FROM (SELECT id, string_split(content, chr(10)) AS l FROM pages WHERE content IS NOT NULL), unnest(range(1, len(l) + 1)) t(i)),
gone AS (SELECT page_id, line_no FROM lines JOIN often USING (website_id, k)),
kept AS (SELECT page_id, string_agg(line, chr(10) ORDER BY line_no) FILTER (g.page_id IS NULL) AS c, count(g.page_id)::INT AS n
  FROM marked LEFT JOIN gone g USING (page_id, line_no) GROUP BY 1)
SELECT id AS page_id, CASE WHEN content IS NOT NULL THEN coalesce(c, '') END AS content, coalesce(n, 0) AS lines_removed FROM pages LEFT JOIN kept ON page_id = id""",
    "p5_scores": """
WITH p AS (SELECT page_id, word_id, max(tf) AS tf FROM inverted_index WHERE tf > 0 GROUP BY 1, 2),
levels AS (SELECT DISTINCT page_id, round(tf, 12) AS t FROM p), gaps AS (SELECT page_id, t - lag(t, 1, 0.0) OVER (PARTITION BY page_id ORDER BY t) AS g FROM levels),
one AS (SELECT page_id, min(g) AS one FROM gaps WHERE g > 1e-9 GROUP BY 1), n AS (SELECT count(DISTINCT page_id)::DOUBLE AS n FROM p),
w AS (SELECT word_id, count(*) AS df, sum(round(tf / one)) AS cf FROM p JOIN one USING (page_id) GROUP BY 1),
s AS (SELECT word_id, df, ln(n / df) AS observed, -ln(1 - exp(-cf / n)) AS expected FROM w, n)
SELECT page_id, word_id, df, round(tf, 9) AS tf, round(observed, 9) AS observed, round(expected, 9) AS expected, round(observed - expected, 9) AS residual,
  round(tf * (observed - expected), 9) AS score FROM p JOIN s USING (word_id)""",
    "p5_found": """
WITH p AS (SELECT page_id, word_id, max(tf) AS tf FROM inverted_index WHERE tf > 0 GROUP BY 1, 2),
n AS (SELECT count(DISTINCT page_id) AS n FROM p),
d AS (SELECT word_id, count(*) AS df FROM p GROUP BY 1 HAVING count(*) >= 2),
r AS (SELECT page_id, word_id, row_number() OVER (PARTITION BY page_id ORDER BY round(tf * ln(n / df), 9) DESC, word_id) AS r FROM p JOIN d USING (word_id), n)
SELECT page_id, word_id FROM r WHERE r <= 3""",
}
