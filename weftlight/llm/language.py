"""Problem 1: the language of each page and of each stretch of a page.

A paragraph is the set of its character n-grams of one to four letters (a
blended-spectrum presence kernel). Kernel ridge regression, one language against
the rest, is fitted in the space of Nyström landmarks. Since the kernel is an
inner product of hashed presence vectors, the landmarks and weights fold into
one matrix, and paragraphs are scored by batched matrix products.

The labels of the pages themselves, noisy as they are, train the model: a bounded
sample per language, cleaned by its own predictions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window, functions as F

from weftlight.llm.common import unique_by
from weftlight.llm.linekinds import MARKED, judged_lines
from weftlight.llm.template import page_flags
from weftlight.plans.spread import spread

#: Dimensions of the hashed presence vectors (a power of two).
GRAMS = 8192
LONGEST_GRAM = 4
#: Labelled pages per language, at most about this many, that the model is fitted on.
FIT_PAGES = 160
FIT_PARAGRAPHS = 3
LANDMARKS = 24
RIDGE = 0.05
#: Paragraphs of a language below which it weighs less than others.
FEW = 200
#: A paragraph whose best two languages are closer than this takes the page's language, if that is one of them.
MARGIN = 0.12
ROWS = 256
#: Paragraphs of one matrix product while scoring.
SCORED = 64
_OTHER = regex.compile(r"[^\p{L}\p{M}]+")
#: The same for texts without combining marks.
_PLAIN_OTHER = re.compile(r"[\W\d_]+")


def letters_of(line: str) -> str:
    """Lower-case letters and marks; everything else is one space."""
    other = _OTHER if MARKED.search(line) else _PLAIN_OTHER
    return f" {other.sub(' ', line.lower()).strip()} "


def presence_bits(lines: list[str], kind: type = np.uint8) -> np.ndarray:
    """Which n-grams each line has (0 or 1, one row each)."""
    out = np.zeros((len(lines), GRAMS), kind)
    flat = out.ravel()
    codes = np.frombuffer("\n".join(lines).encode("utf-32-le"), np.uint32)
    end = codes == 10
    at = np.cumsum(end) * GRAMS
    h = np.zeros(len(codes), np.uint32)
    clear = np.ones(len(codes), bool)
    for n in range(1, LONGEST_GRAM + 1):
        size = len(codes) - n + 1
        if size <= 0:
            break
        h = (h[:size] * np.uint32(0x01000193)) ^ (codes[n - 1 :] * np.uint32(0x9E3779B1))
        clear = clear[:size] & ~end[n - 1 :]
        mixed = (h ^ np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) * np.uint32(0xC2B2AE35)
        slot = (mixed >> np.uint32(16)) & np.uint32(GRAMS - 1)
        flat[(at[:size] + slot)[clear]] = 1
    return out


def normalised(bits: np.ndarray) -> np.ndarray:
    """Presence vectors of length 1 (float32)."""
    dense = bits.astype(np.float32)
    return dense / np.sqrt(np.maximum(dense.sum(axis=1, keepdims=True), 1))


def presence(lines: list[str]) -> np.ndarray:
    """The normalised presence vectors of lines."""
    return normalised(presence_bits(lines))


class Model:
    """Languages and the folded weights."""

    def __init__(self, languages: list[str], lines: list[str], labels: np.ndarray):
        self.languages = languages
        bits = np.concatenate([presence_bits(lines[i : i + ROWS]) for i in range(0, len(lines), ROWS)])
        keep = np.ones(len(labels), bool)
        self.weights = self._fit(bits, labels, keep)
        for _ in range(3):  # a label that the others contradict is taken out
            keep = self._times(bits, self.weights).argmax(axis=1) == labels
            self.weights = self._fit(bits, labels, keep)

    @classmethod
    def of(cls, languages: list[str], weights: np.ndarray) -> Model:
        """The model that was fitted elsewhere."""
        model = cls.__new__(cls)
        model.languages, model.weights = languages, np.ascontiguousarray(weights)
        return model

    @staticmethod
    def _times(bits: np.ndarray, matrix: np.ndarray) -> np.ndarray:
        """The product of all presence vectors with a matrix; only a batch of vectors is ever dense."""
        return np.concatenate([normalised(bits[i : i + ROWS]) @ matrix for i in range(0, len(bits), ROWS)])

    def _fit(self, bits: np.ndarray, labels: np.ndarray, keep: np.ndarray) -> np.ndarray:
        marks = np.concatenate([np.flatnonzero(keep & (labels == c))[:LANDMARKS] for c in range(len(self.languages))])
        landmarks = normalised(bits[marks])
        values, vectors = np.linalg.eigh((landmarks @ landmarks.T).astype(np.float64) + 1e-3 * np.eye(len(marks)))
        half = vectors / np.sqrt(values) @ vectors.T
        features = self._times(bits, landmarks.T)[keep].astype(np.float64) @ half
        targets = np.where(labels[keep][:, None] == np.arange(len(self.languages)), 1.0, -1.0)
        # rare languages weigh as much as common ones, but a few paragraphs, whose labels may be wrong, do not
        count = np.bincount(labels[keep], minlength=len(self.languages))
        weight = (1.0 / np.maximum(count, FEW))[labels[keep]]
        weight *= len(weight) / weight.sum()
        ridge = RIDGE * len(features) / len(marks)
        solved = np.linalg.solve(features.T @ (features * weight[:, None]) + ridge * np.eye(len(marks)), features.T @ (targets * weight[:, None]))
        return landmarks.T @ (half @ solved).astype(np.float32)

    def scores(self, lines: list[str]) -> np.ndarray:
        """One row per line, one column per language."""
        parts = []
        for i in range(0, len(lines), SCORED):
            dense = presence_bits(lines[i : i + SCORED], np.float32)
            # the product is divided by the vectors' lengths, not the vectors
            parts.append(dense @ self.weights / np.sqrt(np.maximum(dense.sum(axis=1, keepdims=True), 1)))
        return np.concatenate(parts) if parts else np.zeros((0, len(self.languages)), np.float32)


def paragraphs(content: str, furniture: list[int] | None = None, headings: list[int] | None = None) -> list[tuple[int, str]]:
    """(line number, text) of the lines of a content that are ordinary sentences."""
    return [(i, line) for i, line, kind in judged_lines(content, furniture, headings) if kind == "prose"]


def label_code(label: Column, codes: DataFrame) -> Column:
    """The language code that a label names, or null: case, region and script suffixes do not matter."""
    known = {}
    for r in codes.select("lang", "lang_name").collect():  # a fixed table
        if r["lang"]:
            known[r["lang"].lower()] = r["lang"]
            if r["lang_name"]:
                known[r["lang_name"].lower()] = r["lang"]
    if not known:
        return F.lit(None).cast("string")
    named = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    text = F.lower(F.trim(label))
    return F.coalesce(F.try_element_at(named, text), F.try_element_at(named, F.regexp_extract(text, "^[^-_]*", 0)))


def fit_model(pages: DataFrame, flags: DataFrame, codes: DataFrame, fit_pages: int = FIT_PAGES) -> Model | None:
    """A model of the languages in ``codes``, from at most about ``fit_pages`` labelled pages of each; ``flags`` are those of the pages' lines.

    A task fits it: the driver gets the languages and their weights, no page and no presence vector.
    """
    labelled = pages.select("id", "content", label_code(F.col("language"), codes).alias("code")).filter("code is not null")
    counts = {r["code"]: r["count"] for r in labelled.groupBy("code").count().collect()}  # one row per language
    if not counts:
        return None
    shares = {code: int(min(1.0, fit_pages / count) * 1_000_003) for code, count in counts.items()}
    share = F.create_map(*[F.lit(x) for pair in shares.items() for x in pair])[F.col("code")]
    sample = labelled.filter("content <> ''").filter(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) < share)
    languages = sorted(counts)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows = [
                (i, nth, languages.index(code), letters_of(line))
                for i, code, *page in zip(*(frame[c] for c in ("id", "code", "content", "furniture", "headings")), strict=True)
                for nth, (_, line) in enumerate(paragraphs(*page)[:FIT_PARAGRAPHS])
            ]
            yield pd.DataFrame(rows, columns=["id", "nth", "label", "letters"])

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lines = pd.concat([pd.DataFrame({"label": [], "letters": []}), *batches])
        if len(lines):
            model = Model(languages, lines["letters"].tolist(), lines["label"].to_numpy(np.int64))
            yield pd.DataFrame({"label": range(len(languages)), "weights": [w.tobytes() for w in model.weights.T]})

    lines = sample.join(flags, "id", "left").mapInPandas(cut, "id long, nth int, label int, letters string")
    # bounded by fit_pages; in the pages' order, since the first paragraphs of a language are its landmarks
    fitted = lines.repartition(1).sortWithinPartitions("id", "nth").mapInPandas(fit, "label int, weights binary")
    weights = {r["label"]: np.frombuffer(r["weights"], np.float32) for r in fitted.collect()}  # one row per language
    return Model.of(languages, np.stack([weights[c] for c in range(len(languages))], axis=1)) if weights else None


def page_paragraphs(pages: DataFrame, codes: DataFrame, fit_pages: int = FIT_PAGES) -> DataFrame:
    """(page_id, label, line_no, chars, lang, confidence) of each paragraph of ordinary sentences.

    ``label`` is the code the page's own label names, or null. Null and empty
    contents and null ids give no row; of pages with one id the one with the largest
    fields counts; without any usable label there is no model and no row.
    """
    spark = pages.sparkSession
    plain = unique_by(spread(pages.select("id", "language", "content", "html", "website_id").filter("content <> ''")), "id")
    flags = page_flags(plain)
    plain = plain.drop("html", "website_id")
    schema = "page_id long, label string, line_no int, chars int, lang string, confidence double"
    model = fit_model(plain, flags, codes, fit_pages)
    if model is None:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(model)

    def classify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = shared.value
        names = np.array(machine.languages, object)
        for frame in batches:
            found = [paragraphs(*row) for row in zip(frame["content"], frame["furniture"], frame["headings"], strict=True)]
            count = np.fromiter((len(f) for f in found), np.int64, len(found))
            page = np.repeat(np.arange(len(found)), count)
            if not len(page):
                continue
            size = np.array([len(text) for f in found for _, text in f])
            scores = machine.scores([letters_of(text) for f in found for _, text in f])
            best = settled(scores, page, size)
            shifted = np.exp(8 * (scores - scores.max(axis=1, keepdims=True)))
            sure = shifted[np.arange(len(best)), best] / shifted.sum(axis=1)
            yield pd.DataFrame({
                "page_id": frame["page_id"].to_numpy()[page], "label": frame["label"].to_numpy()[page],
                "line_no": [i for f in found for i, _ in f], "chars": size, "lang": names[best], "confidence": np.round(sure.astype(float), 4),
            })

    plain = plain.join(flags, "id", "left").select(F.col("id").alias("page_id"), label_code(F.col("language"), codes).alias("label"), "content", "furniture", "headings")
    return plain.mapInPandas(classify, schema)


def settled(scores: np.ndarray, page: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The language of each paragraph; a close call goes to the language of most of the page."""
    order = np.argsort(-scores, axis=1)
    best, second = order[:, 0].copy(), order[:, 1]
    every = np.arange(len(best))
    starts = np.flatnonzero(np.r_[True, np.diff(page) > 0])
    whole = np.add.reduceat(scores * size[:, None], starts, axis=0).argmax(axis=1)
    chief = whole[np.cumsum(np.r_[False, np.diff(page) > 0])]
    close = (scores[every, best] - scores[every, second] < MARGIN) & (second == chief)
    best[close] = chief[close]
    return best


def page_languages(found: DataFrame) -> DataFrame:
    """(page_id, label, lang, paragraphs, chars, confidence, chief): one row per page and language in it.

    ``chief`` marks the language with the most characters, ties to the smaller code.
    """
    by_lang = found.groupBy("page_id", "label", "lang").agg(
        F.count("*").alias("paragraphs"), F.sum("chars").alias("chars"), F.round(F.avg("confidence"), 4).alias("confidence")
    )
    # at most one entry per language
    all_of = by_lang.groupBy("page_id", "label").agg(F.sort_array(F.collect_list(F.struct((-F.col("chars")).alias("c"), "lang", "paragraphs", "confidence"))).alias("l"))
    each = all_of.select("page_id", "label", F.col("l")[0]["lang"].alias("_first"), F.size("l").alias("languages"), F.explode("l").alias("e"))
    return each.select(
        "page_id", "label", F.col("e.lang").alias("lang"), F.col("e.paragraphs").alias("paragraphs"), (-F.col("e.c")).alias("chars"),
        F.col("e.confidence").alias("confidence"), (F.col("e.lang") == F.col("_first")).alias("chief"), "languages",
    )


def mislabelled(languages: DataFrame) -> DataFrame:
    """Rows of pages whose label is missing or not the chief language, or that hold a second language."""
    first = F.when(F.col("chief"), F.col("lang"))
    page = Window.partitionBy("page_id")  # at most one row per language
    marked = languages.withColumn("_chief", F.max(first).over(page))
    return marked.filter(F.col("label").isNull() | (F.col("label") != F.col("_chief")) | (F.col("languages") > 1)).drop("_chief")


def segments(found: DataFrame) -> DataFrame:
    """(page_id, segment_no, first_line, last_line, lang, confidence): stretches of one language, in order."""
    inside = Window.partitionBy("page_id").orderBy("line_no")  # bounded by a page
    turned = found.withColumn("_t", (F.coalesce(F.lag("lang").over(inside), F.lit("")) != F.col("lang")).cast("int"))
    numbered = turned.withColumn("segment_no", F.sum("_t").over(inside))
    return numbered.groupBy("page_id", "segment_no", "lang").agg(
        F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"),
        F.round(F.sum(F.col("confidence") * F.col("chars")) / F.sum("chars"), 4).alias("confidence"),
    )
