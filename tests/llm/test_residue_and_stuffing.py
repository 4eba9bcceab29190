import numpy as np
import pytest

from weftlight.llm import linekinds, residue, stuffing

EN = "The market near Karruth was repaired after the bridge failed twice. Nobody had asked why the cache kept losing its mill."
THINGS = "boat mill ferry index cache trail pump orchard lantern kettle signal garden ledger museum tunnel harbor".split()


def en(i):
    """A paragraph that no other page has."""
    a, b, c, d = (THINGS[(i // 16**k + i * k) % 16] for k in range(4))
    return f"The {a} near Karruth was repaired after the {b} failed twice. Nobody had asked why the {c} kept losing its {d}."


def frame(spark, rows):
    """Each page on a site of its own, without html."""
    return spark.createDataFrame([(*row, None, row[0]) for row in rows], "id long, title string, content string, html string, website_id long")


def test_residue_cases(spark):
    notice = "Please enable JavaScript to continue using this site."
    rows = [
        (1, "{{ title }}", en(1)), (2, "A title", "Dear ${first_name}, your boat is waiting. " + en(2)), (3, "t", en(3) + " Hello undefined, your boat is ready."),
        (4, "t", "Template engines replace a mark such as {{ title }} with the value taken from the boat. " + en(4)),
        (5, "t", "The value NaN appears when the mill divides by an empty boat, and undefined means it was never set."),
        (6, "t", notice), (7, "t", notice + "\n" + en(7) + "\n" + en(70)), (8, None, "Internal server error. Please try again in a few minutes."),
        (9, "t", "A 404 answer tells the boat that the page is gone, yet the mill keeps asking. " + en(9)),
        (10, "t", "Hier steht Ihr Text. Ersetzen Sie diesen Absatz."), (11, "{{ title }}", None), (12, "{{ title }}", ""), (None, "{{ title }}", en(12)),
        (1, "{{ title }}", en(1)), (13, "t", en(13)), (14, "t", "%(city)s dufu &lt;price&gt;"), (15, "50% of 20% is", en(15)), (16, "t", en(16) * 3000),
        (17, "t", "An error 404 tells the boat that the page does not exist. It was moved to the old mill, and nobody had asked the keeper of the ledger why. " + en(17)),
    ]
    found = residue.residue_pages(residue.page_residue(frame(spark, rows)))
    assert sorted(r["page_id"] for r in found.collect()) == [1, 2, 3, 6, 8, 10, 14]


def test_furniture_counts_neither_as_notice_nor_as_content(spark):
    """Lines that stand on the pages of a site are known as furniture; without them the message is the page."""
    menu = "This site stores small files on your device, as all of its readers know by now.\nHome and search\nReaders who like it tell their friends about us."
    rows = [(i, "t", f"{menu}\n{en(i)}") for i in range(1, 30)] + [(30, "t", f"{menu}\nInternal server error. Please try again.")]
    one_site = frame(spark, rows).withColumn("website_id", residue.F.lit(7).cast("long"))
    assert [r["page_id"] for r in residue.residue_pages(residue.page_residue(one_site)).collect()] == [30]
    assert residue.residue_pages(residue.page_residue(frame(spark, rows[-1:]))).count() == 0


def test_filler_in_a_title(spark):
    titles = ["Lorem ipsum dolor sit amet", "Your text goes here", "Lorem ipsum dolor | Velmora Courier", "A short history of Boats", None, "Why lorem ipsum is still used by every printer"]
    found = residue.residue_pages(residue.page_residue(frame(spark, [(i, t, en(i)) for i, t in enumerate(titles)])))
    assert sorted(r["page_id"] for r in found.collect()) == [0, 1, 2]


WORDS = "cheap boat near me boat Velmora best boat deals boat cheap mill near me mill best mill deals mill boat mill " * 3
TAGS = ", ".join(f"{a} {b}" for a in ("cheap", "best", "top") for b in ("boat", "mill", "ferry", "index", "cache", "trail", "pump"))
LINKS = "\n".join(f"How the pump of Place{chr(97 + i % 26) * (1 + i // 26)} works" for i in range(40))
PHRASE = "Buy your cheap boat in Velmora."
OTHER = "The mill of Karruth was moved because the orchard needed more room, and nobody asked why."
CASES = [
    (1, WORDS, True), (2, TAGS, True), (3, LINKS, True), (4, en(4) + "\n" + en(40), False), (5, "\n".join([en(5), en(50), en(51), en(52), *LINKS.split("\n")[:6]]), False),
    (9, "作坊 卡鲁斯 水井 作坊 灯塔 仓库 作坊 花园 市场 港口 " * 6, True), (10, en(10) + "\n" + WORDS.replace("boat", "cart") * 3, True), (11, WORDS.replace("mill", "pump") * 500, True),
    (12, "便宜的船。" * 30, True), (13, "\n".join([PHRASE] * 20), True), (14, "\n".join(["Get your new ferry in Karruth."] * 20 + [OTHER]), True), (15, "ซื้อเรือราคาถูกที่สุด? " * 20, True),
    (16, "\n".join(["Rent your old mill in Brovik."] * 2 + [en(16), OTHER, en(160)]), False), (17, "去年冬天，邓米尔的花园几乎无法到达。小心仓库！是谁让港口开着的？", False),
    (18, "\n".join(en(600 + 7 * i) for i in range(6)), False), (19, "buy boat cheap boat best boat boat deals", True), (20, "Visiting Velmora\nVisiting Karruth\nVisiting Ostrin\nVisiting Brovik", True), (21, "A short history of Boats", False),
    (22, "\n".join([en(22), "So it goes, and so it went.", en(23), "So it goes, and so it went.", en(24), "So it goes, and so it went."]), False),
]


def test_stuffing_cases(spark):
    rows = [(i, "t", text) for i, text, _ in CASES] + [(7, "t", None), (8, "t", ""), (None, "t", WORDS), (1, "t", WORDS)]
    found = stuffing.stuffed_pages(stuffing.page_weights(frame(spark, rows)))
    assert sorted(r["page_id"] for r in found.collect()) == [i for i, _, wanted in CASES if wanted]


def test_recurrence_and_autocorrelation_decide(spark, small, monkeypatch):
    """Without them most pages of keyword text are lost; lists of links and of distinct nouns are what remains."""
    from weftlight.llm.template import with_flags
    from weftlight.sources.tables import table

    pages = with_flags(table(spark, small.replace("0.001", "0.01"), "pages").filter("content <> ''").select("id", "content", "html", "website_id")).collect()

    def found():
        return {r["id"] for r in pages for k, lists, prose in [stuffing.weighed(r["content"], r["furniture"], r["headings"])] if k + lists > prose and k > lists}

    whole = found()
    monkeypatch.setattr(linekinds, "recurring", lambda ids, window=0: np.zeros(len(ids), bool))
    monkeypatch.setattr(linekinds, "periodic", lambda ids, lags: np.zeros(len(ids)))
    rest = found()
    assert len(whole) > 20 and len(rest) < 0.5 * len(whole)


def test_empty_tables_and_clashing_columns(spark):
    empty = frame(spark, [])
    assert residue.page_residue(empty).count() == 0
    assert stuffing.page_weights(empty).count() == 0
    more = frame(spark, [(1, "t", EN)]).selectExpr("*", "1 as page_id", "'a' as filler", "2 as keyword_chars")
    assert residue.page_residue(more).columns == ["page_id", "unfilled", "filler", "notice_chars", "other_chars"]
    assert stuffing.page_weights(more).count() == 1


def test_recurrence_within_the_window_and_periods():
    ids = np.array([0, 1, 2, 0, 3, 4, 5, 6, 1])
    assert linekinds.recurring(ids, 3).tolist() == [True, False, False, True, *[False] * 5]
    assert linekinds.recurring(np.zeros(0, np.int64)).tolist() == []
    even = np.array([0, 1, 2] * 10)
    assert (linekinds.periodic(even, 24) == 3).all() and (linekinds.periodic(np.arange(30), 24) == 0).all()
    assert linekinds.periodic(np.arange(3), 24).tolist() == [0, 0, 0]


@pytest.mark.parametrize("line, kind", [
    ("", "empty"), ("   ", "empty"), ("去年冬天，邓米尔的花园几乎无法到达。小心仓库！", "prose"), ("背景", "short"), ("ใครเปิดท่าเรือทิ้งไว้?", "prose"),
    ("A short history of Boats", "short"), ("Home | News | Search | Archive", "short"), ("Page not found", "error"),
    ("Aliquam dolore sit consectur adipisca elitra sedu tempora labore.", "filler"),
])
def test_kinds(line, kind):
    assert linekinds.judged_lines(line)[0][2] == kind


def test_flags_decide_before_form():
    text = "Read more\nThe boat was repaired after the mill failed twice.\nPage not found"
    assert [k for _, _, k in linekinds.judged_lines(text, [1, 2], [0])] == ["heading", "furniture", "error"]
