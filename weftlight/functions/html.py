"""HTML to records: regular expressions in the JVM, and a parser for html beyond them.

The expressions cover what pages of the wild consist of, closed or cut short;
``parse_html`` is the general form, an Arrow-batched parser that gives all
fields at once.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache
from html.entities import html5
from html.parser import HTMLParser
from urllib.parse import urljoin, urlparse

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from weftlight.functions import url as U
from weftlight.functions.text import bound, clean_text

#: Elements whose text is not content; scripts first, since they may hold anything.
NOT_CONTENT = ("script", "style", "noscript", "header", "footer", "nav")
UNTITLED, DEFAULT_LANGUAGE, LANGUAGE_LENGTH = "Untitled", "en", 10
#: An entity after its ampersand, as HTML reads it: a number in either base or a name.
_ENTITY = r"^(#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]*)(;?)"
#: A tag's attributes may hold ">" between quotation marks.
_INSIDE = r"""(?:[^'">]++|"[^"]*+"|'[^']*+')*+"""


@cache
def _names() -> str:
    """All named entities, by their first letter, as JSON; those that need no semicolon stand without one."""
    by_letter: dict[str, dict[str, str]] = {}
    for name, text in html5.items():
        by_letter.setdefault(name[0], {})[name] = text
    return json.dumps(by_letter)


@cache
def _old_names() -> str:
    """The names that need no semicolon, as alternatives, the longest first."""
    return "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))


def _character(code: Column) -> Column:
    """The character of a number; windows-1252 where the standard says so, a replacement character for none."""
    windows = {c: bytes([c]).decode("cp1252") for c in range(128, 160) if c not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}
    remapped = F.from_json(F.lit(json.dumps({str(c): t for c, t in windows.items()})), "map<string,string>")
    plain = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    invalid = (code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
    return F.when(invalid, "\ufffd").when(code.between(128, 159), F.coalesce(F.try_element_at(remapped, code.cast("string")), plain)).otherwise(plain)


def decoded(text: Column, attribute: bool = False) -> Column:
    """``text`` with its entities, named and numeric, as characters.

    Names of old may lack their semicolon; in an ``attribute`` only where no
    letter, digit or "=" follows, so that addresses with parameters stay whole.
    """
    names = F.from_json(F.lit(_names()), "map<string,map<string,string>>")
    old = rf"^({_old_names()})" + (r"(?![A-Za-z0-9=])" if attribute else "")

    def named(name: Column) -> Column:
        return F.try_element_at(F.try_element_at(names, name.substr(1, 1)), name)

    def piece(p: Column) -> Column:
        entity, end = F.regexp_extract(p, _ENTITY, 1), F.regexp_extract(p, _ENTITY, 2)
        number = F.when(entity.rlike("^#[xX]"), F.conv(F.substring(entity, 3, 6), 16, 10)).otherwise(F.substring(entity, 2, 7)).cast("int")
        legacy = F.regexp_extract(p, old, 1)
        after = p.substr(F.length(entity) + F.length(end) + 1, F.length(p))
        whole = named(F.concat(entity, F.lit(";")))
        return (
            F.when(entity == "", F.concat(F.lit("&"), p))
            .when(entity.startswith("#"), F.concat(_character(number), after))
            .when((end == ";") & whole.isNotNull(), F.concat(whole, after))
            .when(legacy != "", F.concat(named(legacy), p.substr(F.length(legacy) + 1, F.length(p))))
            .otherwise(F.concat(F.lit("&"), p))
        )

    pieces = F.split(text, "&", -1)
    all_of = F.concat(pieces[0], F.array_join(F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), piece), ""))
    return F.when(text.contains("&"), all_of).otherwise(text)


def _all(html: Column, pattern: str) -> Column:
    return F.regexp_extract_all(html, F.lit(pattern), F.lit(1))


def tags(html: Column, name: str) -> Column:
    """The opening tags of an element."""
    return _all(bare(html), rf"(?is)(<{name}\b{_INSIDE}>)")


def attribute(tag: Column, name: str) -> Column:
    """The value of a tag's attribute in quotation marks of either kind or bare, decoded; null where it is missing."""
    between = r"""(?:[\s/]++|(?<=["']))"""
    value = r"""(?:"[^"]*+"|'[^']*+'|[^\s"'>]*+)"""
    # the attributes before the wanted one are passed over whole, whatever their values hold
    pattern = rf"""(?is)^<[a-z][a-z0-9]*+(?:{between}(?!{name}\s*=)[^\s=>/"']++(?:\s*+=\s*+{value})?+)*+{between}{name}\s*(=\s*{value})"""

    def bare_value(found: Column) -> Column:
        return F.when(found != "", decoded(F.regexp_extract(found, r"""(?s)^=\s*(["']?)(.*?)\1$""", 2), attribute=True))

    return bound(F.regexp_extract(tag, pattern, 1), bare_value)


def bare(html: Column) -> Column:
    """Without scripts, styles and comments."""
    return F.regexp_replace(html, r"(?is)<script\b[^>]*>.*?(?:</script\s*>|\z)|<style\b[^>]*>.*?(?:</style\s*>|\z)|<!--.*?(?:-->|\z)", " ")


def title(html: Column) -> Column:
    found = F.trim(decoded(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title\s*>", 1)))
    return F.when(found == "", UNTITLED).otherwise(found)


def language(html: Column) -> Column:
    found = F.regexp_extract(html, r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([^"'>\s]*)""", 1)
    return F.when(found == "", DEFAULT_LANGUAGE).otherwise(found.substr(1, LANGUAGE_LENGTH))


def meta(html: Column, name: str) -> Column:
    """The content of the first meta element of a name; "" where there is none."""
    named = F.filter(tags(html, "meta"), lambda t: F.lower(F.trim(attribute(t, "name"))) == name)
    return F.trim(F.coalesce(attribute(F.try_element_at(named, F.lit(1)), "content"), F.lit("")))


def description(html: Column) -> Column:
    return meta(html, "description")


def keywords(html: Column) -> Column:
    return F.filter(F.transform(F.split(meta(html, "keywords"), ","), lambda k: F.trim(k)), lambda k: k != "")


def headings(html: Column) -> Column:
    inner = _all(bare(html), rf"(?is)<h[1-3]\b{_INSIDE}>(.*?)</h[1-3]\s*>")
    return F.filter(F.transform(inner, lambda h: clean_text(decoded(F.regexp_replace(h, rf"<{_INSIDE}>", "")))), lambda h: h != "")


def _values(html: Column, element: str, name: str) -> Column:
    return F.filter(F.transform(tags(html, element), lambda t: attribute(t, name)), lambda v: v.isNotNull())


def hrefs(html: Column) -> Column:
    return _values(html, "a", "href")


def links(html: Column, base: Column) -> Column:
    """The distinct web pages a page links to, without fragments, sorted."""
    absolute = F.transform(hrefs(html), lambda h: U.resolve(base, h))
    wanted = F.filter(absolute, lambda u: U.is_web(u) & U.is_page(u))
    return F.array_sort(F.array_distinct(F.filter(F.transform(wanted, U.without_fragment), lambda u: u != "")))


def images(html: Column, base: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.transform(_values(html, "img", "src"), lambda s: U.resolve(base, s)), U.is_web)))


def content(html: Column) -> Column:
    """The text of a page, its title first; elements that are not content are left out."""
    text = html
    for element in NOT_CONTENT:
        text = F.regexp_replace(text, rf"(?is)<{element}\b{_INSIDE}>.*?(?:</{element}\s*>|\z)", " ")
    text = F.regexp_replace(text, r"(?s)<!--.*?(?:-->|\z)", " ")
    text = F.regexp_replace(text, rf"(?s)</?[A-Za-z!?]{_INSIDE}(?:>|\z|[\"'][^>]*(?:>|\z))", " ")
    return clean_text(decoded(text))


PARSED = T.StructType([
    T.StructField("title", T.StringType()), T.StructField("content", T.StringType()), T.StructField("page_hash", T.StringType()),
    T.StructField("description", T.StringType()), T.StructField("keywords", T.ArrayType(T.StringType())), T.StructField("language", T.StringType()),
    T.StructField("links", T.ArrayType(T.StringType())), T.StructField("headings", T.ArrayType(T.StringType())), T.StructField("images", T.ArrayType(T.StringType())),
])


class _Reader(HTMLParser):
    """Collects everything in one pass over the markup."""

    def __init__(self, base: str):
        super().__init__(convert_charrefs=True)
        self.base = base
        self.skip: list[str] = []
        self.text: list[str] = []
        self.head: list[str] | None = None
        self.title: list[str] | None = None
        self.titled = False
        self.language = self.description = self.keywords = None
        self.links: set[str] = set()
        self.images: set[str] = set()
        self.headings: list[str] = []

    def handle_starttag(self, tag, attrs):
        found = {k: v or "" for k, v in reversed(attrs)}
        if tag == "html" and self.language is None:
            self.language = found.get("lang")
        elif tag == "meta":
            name = found.get("name", "").strip().lower()
            if name in ("description", "keywords") and getattr(self, name) is None:
                setattr(self, name, found.get("content", "").strip())
        elif tag == "title" and not self.titled:
            self.title, self.titled = [], True
        elif tag in ("h1", "h2", "h3"):
            self.head = []
        elif tag == "a" and "href" in found:
            target = urljoin(self.base, found["href"])
            seen = urlparse(target)
            if seen.scheme in ("http", "https") and not seen.path.lower().endswith(tuple("." + e for e in U.NOT_PAGES)):
                self.links.add(target.split("#")[0])
        elif tag == "img" and "src" in found:
            target = urljoin(self.base, found["src"])
            if urlparse(target).scheme in ("http", "https"):
                self.images.add(target)
        if tag in NOT_CONTENT:
            self.skip.append(tag)

    def handle_endtag(self, tag):
        if tag == "title" and self.title is not None:
            self.done_title = " ".join("".join(self.title).split())
            self.title = None
        if tag in ("h1", "h2", "h3") and self.head is not None:
            text = " ".join("".join(self.head).split())
            if text:
                self.headings.append(text)
            self.head = None
        if tag in self.skip:
            while self.skip and self.skip.pop() != tag:
                pass

    def handle_data(self, data):
        if self.title is not None:
            self.title.append(data)
        if self.head is not None:
            self.head.append(data)
        if not self.skip:
            self.text.append(data)

    done_title = ""


def parsed(html: str | None, base: str | None) -> dict | None:
    """All fields of one page, or None where the base address or a link cannot be read."""
    if html is None:
        return None
    reader = _Reader(base or "")
    try:
        # a tag that is cut off at the end is no text
        reader.feed(html[: html.rfind("<")] if html.rfind("<") > html.rfind(">") else html)
        reader.close()
    except ValueError:
        return None
    from hashlib import sha256

    text = " ".join(" ".join(reader.text).split())
    return {
        "title": reader.done_title or UNTITLED, "content": text, "page_hash": sha256(text.encode()).hexdigest(),
        "description": reader.description or "", "keywords": [k.strip() for k in (reader.keywords or "").split(",") if k.strip()],
        "language": (reader.language or DEFAULT_LANGUAGE)[:LANGUAGE_LENGTH], "links": sorted(u for u in reader.links if u),
        "headings": reader.headings, "images": sorted(reader.images),
    }


@F.pandas_udf(PARSED)
def parse_html(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """All fields of a page from (html, base address)."""
    names = [f.name for f in PARSED]
    for html, base in batches:
        rows = [parsed(h, b) or dict.fromkeys(names) for h, b in zip(html, base, strict=True)]
        yield pd.DataFrame(rows, columns=names)
