import numpy as np
import pytest
from pyspark.sql import functions as F

from weftlight.llm import language
from weftlight.sources.schemas import PAGES

EN = "The market near Karruth was repaired after the bridge failed twice. Nobody had asked why the cache kept losing its mill."
ES = "Nadie sabía por qué el puente perdía siempre su molino. Cuando el jardín está lleno, el carro espera hasta que alguien lo vacíe."
DE = "Niemand wusste, warum der Garten nicht mehr zum Ofen passte. Wenn der Ordner voll ist, wartet der Brunnen, bis ihn jemand leert."
RU = "Никто не знал, почему порт всегда мешает тому, кто чинит сервер. Прошлой зимой рынок у станции был почти недоступен."


@pytest.fixture(scope="module")
def codes(spark):
    return spark.createDataFrame([("en", "English", "Latin"), ("es", "Spanish", "Latin"), ("de", "German", "Latin"), ("ru", "Russian", "Cyrillic")], "lang string, lang_name string, script string")


def pages_of(spark, rows):
    """Each page on a site of its own, each paragraph with a name of its own: what many pages share is furniture."""
    blank = {f.name: None for f in PAGES}
    made = []
    for r in rows:
        i = r["id"] or 0
        lines = (r["content"] or "").split("\n")
        own = [line and f"{line[:-1]} {chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + k)}." if line.endswith(".") else line for k, line in enumerate(lines)]
        made.append({**r, "website_id": i, "content": r["content"] and "\n".join(own)})
    return spark.createDataFrame([tuple({**blank, **r}.values()) for r in made], PAGES)


def corpus():
    # 24 well labelled pages a language
    rows, n = [], 0
    for code, text in (("en-GB", EN), ("ES", ES), ("de_AT", DE), ("ru", RU)):
        for _ in range(24):
            n += 1
            rows.append({"id": n, "language": code, "content": f"Menu | Home\n{text}"})
    return rows


def test_found_cases(spark, codes):
    rows = corpus() + [
        {"id": 101, "language": None, "content": EN},  # missing label
        {"id": 102, "language": "xx", "content": ES},  # names no language
        {"id": 103, "language": "de", "content": RU},  # wrong label
        {"id": 104, "language": "en", "content": f"{EN}\n{EN}\n{DE}"},  # two languages
        {"id": 105, "language": None, "content": ""},
        {"id": 106, "language": None, "content": None},
        {"id": 107, "language": None, "content": "404 - The page you were looking for could not be found."},
        {"id": None, "language": None, "content": EN},
        {"id": 101, "language": None, "content": EN},  # delivered twice
        {"id": 108, "language": "Russian", "content": RU},  # a name instead of a code
        {"id": 109, "language": " EN_gb ", "content": EN * 200},  # a very long paragraph
    ]
    found = language.mislabelled(language.page_languages(language.page_paragraphs(pages_of(spark, rows), codes)))
    assert sorted((r["page_id"], r["lang"]) for r in found.collect()) == [(101, "en"), (102, "es"), (103, "ru"), (104, "de"), (104, "en")]


def test_segments_follow_the_text(spark, codes):
    rows = [*corpus(), {"id": 200, "language": "en", "content": f"{EN}\n{EN}\n\n{RU}\n{EN}"}]
    found = language.segments(language.page_paragraphs(pages_of(spark, rows), codes)).filter("page_id = 200").orderBy("segment_no").collect()
    assert [(r["lang"], r["first_line"], r["last_line"]) for r in found] == [("en", 0, 1), ("ru", 3, 3), ("en", 4, 4)]
    assert all(0 < r["confidence"] <= 1 for r in found)


def test_empty_and_unlabelled_tables(spark, codes):
    assert language.page_paragraphs(pages_of(spark, []), codes).count() == 0
    assert language.page_paragraphs(pages_of(spark, [{"id": 1, "content": EN}]), codes).count() == 0


def test_clashing_columns(spark, codes):
    pages = pages_of(spark, corpus()).selectExpr("*", "'x' as page_id", "'y' as lang", "1 as label")
    assert language.page_paragraphs(pages, codes).count() == 96


def test_folded_weights_are_the_kernel_machine():
    rng = np.random.default_rng(3)
    lines = [language.letters_of("".join(rng.choice(list("abcdefgh "), 60))) for _ in range(30)]
    x = language.presence(lines)
    assert np.allclose((x**2).sum(axis=1), 1, atol=1e-5)
    # kernel values by hand: shared grams over the root of the product of set sizes
    grams = [{line[i : i + n] for n in range(1, 5) for i in range(len(line) - n + 1)} for line in lines]
    expected = len(grams[0] & grams[1]) / (len(grams[0]) * len(grams[1])) ** 0.5
    assert abs(float(x[0] @ x[1]) - expected) < 0.05  # hashing may join a few grams


def test_held_out_accuracy(spark, codes, small):
    from weftlight.sources.tables import table

    found = language.page_paragraphs(table(spark, small, "pages"), table(spark, small, "language_codes"))
    rows = found.filter("label is not null").collect()
    assert sum(r["label"] == r["lang"] for r in rows) / len(rows) > 0.8  # labels themselves are noisy


def test_the_model_is_fitted_by_a_task(spark, codes, monkeypatch):
    pages = pages_of(spark, corpus()).select("id", "language", "content")
    flags = spark.createDataFrame([(r["id"], [0], []) for r in corpus()], "id long, furniture array<int>, headings array<int>")
    lines, labels = [], []
    for r in pages.orderBy("id").collect():
        for _, line in language.paragraphs(r["content"], [0], [])[: language.FIT_PARAGRAPHS]:
            lines.append(language.letters_of(line))
            labels.append(["de", "en", "es", "ru"].index(r["language"].lower()[:2]))
    by_hand = language.Model(["de", "en", "es", "ru"], lines, np.array(labels))

    def refused(*_):
        raise AssertionError("on the driver")

    # the driver holds neither the pages of the sample nor their presence vectors
    monkeypatch.setattr(language, "presence_bits", refused)
    monkeypatch.setattr(type(pages), "toPandas", refused)
    model = language.fit_model(pages, flags, codes)
    assert model.languages == by_hand.languages
    assert np.allclose(model.weights, by_hand.weights, atol=1e-5)
    assert language.fit_model(pages.filter("id < 0"), flags, codes) is None
    assert language.fit_model(pages.withColumn("content", F.lit("Menu")), flags, codes) is None
