"""A reproducible mock corpus of html pages, made in parallel from a seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Nouns, and sentence forms with two places for them.
WORDS = """
anchor basin beacon bellows bridge canal candle canvas carriage cellar chimney cistern clock compass copper cradle crane ditch dock
engine fence flint forge furnace gallery gate granary hammer harvest hinge kiln ladder lantern lock loom meadow mill mortar oven
paddle pasture pier plough pulley quarry raft rudder saddle sluice stable
""".split()
SENTENCES = (
    "Nobody repairs a %s before the %s has dried.",
    "In the third year the %s was traded for a smaller %s.",
    "A good %s lasts longer than any %s in the valley.",
    "We keep one %s in the shed and lend the %s to neighbours.",
    "The oldest record mentions a %s, a rope and half a %s.",
    "Rain fills the %s first and reaches the %s by noon.",
    "Every child there learns to draw a %s and to count a %s.",
    "What the %s cannot hold is left beside the %s.",
)
ROBOTS = "User-agent: *\nDisallow:\nCrawl-delay: 0\n"


def _draw(seed: int, below: int, *keys: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(below)).cast("int")


def mock_pages(spark: SparkSession, pages: int = 2000, seed: int = 7) -> DataFrame:
    """(page_no, url, html): 5-20 links less a self-link, 3-8 paragraphs of 4-10 sentences."""
    vocabulary = F.array(*[F.lit(w) for w in WORDS])
    forms = F.array(*[F.lit(s) for s in SENTENCES])

    def word(*keys: Column) -> Column:
        return vocabulary[_draw(seed, len(WORDS), *keys)]

    def sentence(p: Column, j: Column) -> Column:
        first = _draw(seed + 1, len(WORDS), F.col("page_no"), p, j)
        second = F.pmod(first + 1 + _draw(seed + 2, len(WORDS) - 1, F.col("page_no"), p, j), F.lit(len(WORDS)))
        parts = F.split(forms[_draw(seed + 3, len(SENTENCES), F.col("page_no"), p, j)], "%s")
        return F.concat(parts[0], vocabulary[first], parts[1], vocabulary[second], parts[2])

    def paragraph(p: Column) -> Column:
        count = 4 + _draw(seed + 4, 7, F.col("page_no"), p)
        return F.concat(F.lit("<p>"), F.array_join(F.transform(F.sequence(F.lit(1), count), lambda j: sentence(p, j)), " "), F.lit("</p>"))

    body = F.array_join(F.transform(F.sequence(F.lit(1), 3 + _draw(seed + 5, 6, F.col("page_no"))), paragraph), "")
    drawn = F.transform(F.sequence(F.lit(1), 5 + _draw(seed + 6, 16, F.col("page_no"))), lambda j: _draw(seed + 7, pages, F.col("page_no"), j))
    targets = F.filter(F.array_distinct(drawn), lambda t: t != F.col("page_no"))
    items = F.array_join(F.transform(targets, lambda t: F.format_string('<li><a href="page_%s.html">Leaf %s</a></li>', t, t)), "")
    html = F.concat(
        F.lit("<!DOCTYPE html>\n<html>\n<head>\n<title>Almanac leaf "), F.col("page_no"), F.lit('</title>\n<meta name="description" content="Notes on the '),
        word(F.col("page_no"), F.lit(1)), F.lit(" and the "), word(F.col("page_no"), F.lit(2)), F.lit('.">\n<meta name="keywords" content="'), word(F.col("page_no"), F.lit(3)),
        F.lit(", "), word(F.col("page_no"), F.lit(4)), F.lit(', leaf, almanac">\n</head>\n<body>\n<h1>Leaf '), F.col("page_no"), F.lit("</h1>\n<div>"),
        body, F.lit("</div>\n<h3>Other leaves</h3>\n<ul>"), items, F.lit("</ul>\n</body>\n</html>\n"),
    )
    numbers = spark.range(pages).select(F.col("id").cast("int").alias("page_no"))
    return numbers.select("page_no", F.format_string("http://mock.test/page_%s.html", F.col("page_no")).alias("url"), html.alias("html"))
