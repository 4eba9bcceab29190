from collections import Counter, defaultdict

import regex

from weftlight.llm import repeated_lines as R, template as T


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "id long, website_id long, content string, html string")


def key(line):
    return regex.sub(r"[^\p{L}\p{M}]+", "", line.lower())


def brute_force(rows, least):
    count = defaultdict(set)
    for i, site, content in rows:
        for line in content.split("\n"):
            if key(line):
                count[site, key(line)].add(i)
    return {(i, n) for i, site, content in rows for n, line in enumerate(content.split("\n")) if key(line) and len(count[site, key(line)]) >= least}


def test_repeated_lines_against_brute_force(spark):
    rows = [(i, i % 3, f"Header {i}\nShare this!\n\nText of page {chr(97 + i % 26)}{chr(97 + i // 26)}\nLegal -- notice {i % 2}\n2024\nShare this") for i in range(60)]
    lines, blocks = R.stored_lines_and_blocks(pages_of(spark, [(a, b, c, None) for a, b, c in rows]))
    found = {(r["page_id"], r["line_no"]) for r in R.repeated_occurrences(lines, blocks).collect()}
    assert found == brute_force(rows, 8)


def test_repeated_lines_dirty(spark):
    rows = [(i, 1, "a\nb", None) for i in range(8)] + [(0, 1, "a\nb", None)] * 3 + [(90, None, "a\nb", None), (None, 1, "a\nb", None), (91, 1, None, None), (92, 1, "", None), (93, 2, "a", None)]
    frame = pages_of(spark, rows).selectExpr("*", "1 as line", "2 as page_id", "3 as block")
    lines, blocks = R.stored_lines_and_blocks(frame)
    found = {(r["page_id"], r["line_no"]) for r in R.repeated_occurrences(lines, blocks).collect()}
    assert found == {(i, n) for i in range(8) for n in (0, 1)}
    cleaned = {r["page_id"]: r["content"] for r in R.without_repeated_lines(frame, R.repeated_occurrences(lines, blocks)).collect()}
    assert cleaned[3] == "" and cleaned[90] == "a\nb" and cleaned[91] is None and cleaned[92] == ""


def test_repeated_lines_empty(spark):
    lines, blocks = R.stored_lines_and_blocks(pages_of(spark, []))
    assert R.repeated_occurrences(lines, blocks).count() == 0


def test_components_large_site_equals_small(spark):
    edges = [(1, a, a + 1, 9) for a in range(0, 40) if a % 10 != 9] + [(2, 7, 8, 9)]
    frame = spark.createDataFrame(edges, "website_id long, a long, b long, pages long")
    small = sorted(map(tuple, R.components(frame).collect()))
    large = sorted(map(tuple, R.components(frame, site_edges=3).collect()))
    assert small == large
    assert Counter(b for s, _, b in small if s == 1) == {0: 10, 10: 10, 20: 10, 30: 10}


ARTICLE = "The market near Karruth was repaired after the bridge failed twice. Nobody had asked why the cache of page {i} kept losing its mill number {i}."


def site_rows(n=12, site=1):
    rows = []
    for i in range(n):
        text = ARTICLE.format(i=chr(97 + i) * 3)
        html = (f"<!DOCTYPE html><html><head><title>T</title></head><body><div class='c1'>We use cookies.</div>\n<nav>Home</nav>\n<h1>Title {chr(97 + i)}</h1>\n<p>{text}</p>\n"
                f"<aside class='c1'>{text} Again, and in other words, so that it is long enough.</aside>\n<h2>Background</h2>\n<ul><li>entry {chr(97 + i)}</li></ul>\n<div class='c5'>Read next</div>\n<div class='c5'><a href='/x'>Other page {chr(98 + i)}</a></div></body></html>")
        content = "\n".join(["We use cookies.", f"Title {chr(97 + i)}", text, f"{text} Again, and in other words, so that it is long enough.", "Background", f"entry {chr(97 + i)}", "Read next", f"Other page {chr(98 + i)}"])
        rows.append((site * 1000 + i, site, content, html))
    return rows


def test_template_deduction(spark):
    found = T.Templates(pages_of(spark, site_rows())).lines().filter("furniture").collect()
    assert {r["line_no"] for r in found} == {0, 6, 7}
    assert len(found) == 36


def test_template_dirty(spark):
    rows = site_rows() + [(1, 1, "", ""), (2, 1, None, None), (None, 1, "We use cookies.", None), (3, 1, "We use cookies.\nSome text", None), (1000, *site_rows()[0][1:]), (4, None, "alone", "<p>alone</p>"), (5, 1, "We use cookies.\nA cut", "<div class='c1'>We use cookies.</div>\n<p>A cu")]
    frame = pages_of(spark, rows).selectExpr("*", "1 as page_id", "'r' as role", "2 as text")
    found = {(r["page_id"], r["line_no"]) for r in T.Templates(frame).lines().filter("furniture").collect()}
    assert {(3, 0), (5, 0)} <= found and not {(3, 1), (4, 0), (5, 1)} & found
    bodies = {r["page_id"]: r["body"] for r in T.main_bodies(frame, T.Templates(frame).lines()).collect()}
    assert bodies[3] == "Some text" and bodies[2] is None and bodies[1] == ""


def test_tail_of_a_page_without_html(spark):
    text = ARTICLE.format(i="zzz")
    rows = site_rows() + [(7, 1, f"We use cookies.\nA title\n{text}\nlast entry\nRead next\nUnseen page\nAnother one", None)]
    found = {r["line_no"] for r in T.Templates(pages_of(spark, rows)).lines().filter("furniture and page_id = 7").collect()}
    assert found == {0, 4, 5, 6}


def test_template_empty(spark):
    assert T.Templates(pages_of(spark, [])).lines().count() == 0


def test_equivalence_classes(spark):
    made = T.Templates(pages_of(spark, site_rows()))
    classes = made.equivalence_classes().collect()
    # both texts and the roles that occur once stand once on each of the same twelve pages; one role occurs twice
    once = T.site_tokens(made.blocks).filter("n = 1").groupBy("text").count().filter("count = 12").count()
    assert sorted((r["tokens"], r["pages"]) for r in classes) == [(1, 12), (once, 12)] and once >= 3


def test_an_article_fetched_again_is_no_template(spark):
    article = "A mill without html\nIt was repaired\nThe ferry came later"
    rows = site_rows() + [(100 + i, 1, article, None) for i in range(4)]
    found = T.Templates(pages_of(spark, rows)).lines().filter("furniture and page_id between 100 and 103")
    assert found.count() == 0


def test_support_is_relative_to_the_site(spark):
    names = [a + b for a in "abcdefghij" for b in "klmnopqrst"]
    rows = [(i, 1, f"We use cookies\nStory {n} of the mill\n" + ("Chapter of the ferry\n" if i < 4 else "") + f"End {n}", None) for i, n in enumerate(names)]
    made = T.Templates(pages_of(spark, rows))
    found = {(r["page_id"], r["line_no"]) for r in made.lines().filter("furniture").collect()}
    assert found == {(i, 0) for i in range(100)}
    # a class that nests in a small valid one is measured by that one
    rows = [(i, c, text + (f"\nSeccion\nA {n}" if i < 20 else "") + ("\nPie" if i < 12 else ""), h) for (i, c, text, h), n in zip(rows, names, strict=True)]
    classes = {r["pages"]: r["parent"] for r in T.Templates(pages_of(spark, rows)).equivalence_classes().collect()}
    assert set(classes) == {100, 20, 12} and classes[100] is None and classes[20] is None and classes[12] is not None


def test_blocks_line_up_with_content():
    for _, _, content, html in site_rows(3):
        assert [b[0] for b in T.blocks_of(html)] == content.split("\n")
    assert T.blocks_of("<p>a<br>b</p>\n<table><tr><td class=x>c</td></tr>")[1] == ("c", "td.x", False)


def test_occurrence_vectors_decide(spark, monkeypatch):
    """Two lines that always come together are template text where one by itself, as frequent, is not; with one vector for all it is."""
    rows = []
    for i in range(100):
        n = chr(97 + i % 26) + chr(97 + i // 26)
        pair = "Send this on\nAll rights remain\n" if i % 10 == 0 else ""
        alone = "Chapter of the ferry\n" if i % 10 == 3 else ""
        rows.append((i, 1, f"Story {n} of the mill\n{pair}{alone}End {n}", None))

    def found():
        return {(r["page_id"], r["line_no"]) for r in T.Templates(pages_of(spark, rows)).lines().filter("furniture").collect()}

    assert found() == {(i, k) for i in range(0, 100, 10) for k in (1, 2)}
    vectors = T.text_vectors
    monkeypatch.setattr(T, "text_vectors", lambda tokens: vectors(tokens).withColumn("vector", T.F.lit(0).cast("long")))
    assert found() == {(i, k) for i in range(0, 100, 10) for k in (1, 2)} | {(i, 1) for i in range(3, 100, 10)}
