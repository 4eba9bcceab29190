"""Problem 2: template residue and error-page text.

Three kinds of residue, by title and content:

- a template field that was never filled, or filled with a program's empty
  value, unless its sentence speaks about such marks;
- filler text;
- an error message, a program failure or a notice about scripts or access, found
  by the phrase automaton, where the matched text covers at least half of what
  the page has besides furniture.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F

from weftlight.llm.common import unique_by
from weftlight.llm.linekinds import WORD, judged_lines, normal, seen
from weftlight.llm.notices import FIELD, FIELD_MARKS, covered, dummy_words
from weftlight.llm.template import with_flags
from weftlight.plans.spread import spread

# What programs print for a value that is not there.
EMPTY_VALUE = regex.compile(r"\[object \w+\]|\bnull null\b|\(null\)|(?<![\w'’])(?:undefined|NaN)(?![\w'’])")
EMPTY_MARKS = ("[object", "null", "undefined", "NaN")
# Words of sentences that speak about a mark, a field or a value instead of containing one by mistake.
ABOUT = regex.compile(
    r"\b(?:marks?|placeholders?|template engines?|templates?|variables?|syntax|tokens?|literals?|notation|shells?|scripts?|source code|expressions?|means|meant|denotes|stands for|wrote|typed|printed|values?"
    r"|marken?|platzhaltern?|variablen?|vorlagen?|schreibweise|bedeutet|schrieb|werte?|balises?|gabarits?|syntaxe|signifie|lisait|écrivait|valeurs?"
    r"|marcas?|plantillas?|marcador(?:es)?|sintaxis|significa|escribía|valor(?:es)?|sintaxe|modelos?|escrevia|tijdelijke aanduiding|variabelen?|sjablo(?:on|nen)|betekent|schreef|waarden?|merk(?:en)?)\b"
    r"|метк|переменн|шаблон|заполнител|синтаксис|означа|значени|متغير|قالب|علامة|قيمة|चर |टेम्पलेट|चिह्न|मान |変数|テンプレート|プレースホルダ|記号|変量|变量|模板|占位符|标记|ตัวแปร|แม่แบบ|เครื่องหมาย",
    regex.IGNORECASE,
)
SENTENCE = regex.compile(r"(?<=[.!?।。！？])\s+")
TITLE_PARTS = regex.compile(r"\s+[|·»–—-]\s+")
#: Share of a page's text, furniture aside, that notices must cover.
COVERAGE = 0.5
#: Share of a title that filler phrases must cover: a title may be about them.
TITLE_COVERED = 0.4


def unfilled(text: str) -> bool:
    """Whether a text holds a field that was never filled or was filled with an empty value."""
    field = any(m in text for m in FIELD_MARKS) and FIELD.search(text)
    empty = any(m in text for m in EMPTY_MARKS) and EMPTY_VALUE.search(text)
    if not field and not empty:
        return False
    for line in text.split("\n"):
        if not (FIELD.search(line) or EMPTY_VALUE.search(line)):
            continue
        for sentence in SENTENCE.split(line):
            if (FIELD.search(sentence) or EMPTY_VALUE.search(sentence)) and not ABOUT.search(sentence):
                return True
    return False


def filler_title(title: str) -> bool:
    """Whether a title is filler text; the name of the site may stand beside it. Two words of a language with spaces may be an honest title."""
    for part in [title, *TITLE_PARTS.split(title)]:
        text, tokens = normal(part), WORD.findall(part.lower())
        if (len(tokens) >= 3 or not text.isascii()) and (covered(text).get("filler", 0) >= TITLE_COVERED * len(text) or dummy_words(tokens)):
            return True
    return False


def judged(title: str | None, content: str, furniture: list[int] | None = None, headings: list[int] | None = None) -> tuple[bool, bool, int, int]:
    """(unfilled field, filler text, characters of messages and notices, characters of other content)."""
    matched = other = short = 0
    filler = bool(title) and filler_title(title)
    for _, line, kind in judged_lines(content, furniture, headings):
        if kind in ("error", "script"):
            matched += seen(line).notice_chars  # what stands beside the message in its line is neither
        elif kind == "filler":
            filler = True
        elif kind in ("prose", "keywords"):
            other += len(line)
        elif kind == "short":
            short += len(line)
    return unfilled(content) or bool(title and unfilled(title)), filler, matched, other + short


def page_residue(pages: DataFrame) -> DataFrame:
    """(page_id, unfilled, filler, notice_chars, other_chars) of each page with content.

    Pages with null or empty content give no row, whatever their title; a null
    title counts as empty; of pages with one id the one with the largest fields counts.
    """
    plain = with_flags(unique_by(spread(pages.select("id", "title", "content", "html", "website_id").filter("content <> ''")), "id"))
    plain = plain.select(F.col("id").alias("page_id"), "title", "content", "furniture", "headings")

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows = [judged(*row) for row in zip(frame["title"], frame["content"], frame["furniture"], frame["headings"], strict=True)]
            out = pd.DataFrame(rows, columns=["unfilled", "filler", "notice_chars", "other_chars"])
            out.insert(0, "page_id", frame["page_id"].to_numpy())
            yield out

    return plain.mapInPandas(judge, "page_id long, unfilled boolean, filler boolean, notice_chars long, other_chars long")


def residue_pages(residue: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The rows of ``residue`` that are residue."""
    share = F.col("notice_chars") / (F.col("notice_chars") + F.col("other_chars"))
    return residue.filter(F.col("unfilled") | F.col("filler") | ((F.col("notice_chars") > 0) & (share >= coverage)))
