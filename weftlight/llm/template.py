"""Problem 7: main body and furniture, by deducing the templates of each host.

Every non-empty line of a page's content is one text block of its html. Two
kinds of tokens describe a page: the text of a block, and the markup that holds
it (element and class, its role). Over the distinct contents of one site (pages
fetched again count once) each token has an occurrence vector, the number of times
it occurs in each content; tokens with the same vector form an equivalence class.
A class is valid if it stands in a share of the site's contents, which is larger
for a class of a single token, or if it nests in such a class, whose contents hold
all of its own, and stands in half of them. The valid classes are the site's
template, and only their texts are template text. They nest in roles: a role whose
text is template text (headings of side columns, menus, notices) is template
structure, and its slots are furniture, also those with changing text such as the
links under "read next". Running text that is not template text is main body even
inside such a role. Roles whose text changes from page to page are the slots
that hold the main body. Headings (h1-h6) mark up the article itself.

Small sites are judged with the help of the same roles and texts on all sites.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame, functions as F

from weftlight.llm.common import unique_by
from weftlight.plans.joins import sized_join
from weftlight.plans.lineage import written
from weftlight.plans.spread import spread

#: Distinct contents without which equal vectors say nothing.
MIN_CONTENTS = 3
#: Share of a site's distinct contents that a class must stand in, of several tokens and of a single one.
CLASS_SHARE, SINGLE_SHARE = 0.05, 0.2
#: Share of the contents of the class it nests in that any other class must stand in.
NESTED_SHARE = 0.5
#: Share of all sites, and their number at least, on which a text must stand to be template text everywhere.
SITES_SHARE, MIN_SITES = 0.02, 3
#: Lines that the judgement of a role on all sites weighs as much as.
PRIOR_LINES = 12.0
#: Share of template text from which a role is template structure.
TEMPLATE_SHARE = 0.27
#: Bytes up to which a table of sites' classes, texts or roles is broadcast: it grows with the sites, and passes through the driver.
SENT_BYTES = 2 << 20
#: Characters of running text, and of a text with two sentence ends; scripts without spaces need fewer.
RUNNING_CHARS, TWO_SENTENCES, DENSE_LETTERS = 90, 72, 16

_REMOVED = re.compile(r"(?is)<!doctype[^>]*>|<(script|style|noscript|header|footer|nav|head)\b[^>]*>.*?</\1\s*>|<!--.*?-->")
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)([^>]*)>?")
_CLASS = re.compile(r"""\bclass\s*=\s*["']?([^"'>]+)""")
_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")
#: Between the items of a menu or a trail of links; the first item stands for such a line.
_ITEMS = re.compile(r"\s[|/·»>]\s")
_ENDS = re.compile(r"[.!?…؟।][\"'”»“)\]]*(?=\s|$)|[。！？]")
_DENSE = regex.compile(r"[\p{Thai}\p{Han}\p{Hiragana}\p{Katakana}]")
#: Elements that mark words inside a block.
_INLINE = frozenset("a em strong b i u span small sub sup br img code q cite abbr font s mark time wbr".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def _sized(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``sized_join`` that broadcasts at most ``SENT_BYTES``."""
    return sized_join(left, right, keys, how, broadcast_bytes=SENT_BYTES)


def text_key(text: str) -> int:
    """64-bit hash of a text's letters and marks, lower-cased; 0 without letters.

    The items of a trail of links change from page to page, so its token is the first item.
    """
    items = _ITEMS.split(text)
    letters = _LETTERS.sub("", items[0].lower())
    if len(items) > 1 and letters:
        letters += ">"
    return xxhash.xxh64_intdigest(letters) - (1 << 63) if letters else 0


#: Pages that are cut at once.
CUT_PAGES = 500
#: Lines of html, and texts, that a worker remembers; a site's template recurs on all its pages.
REMEMBERED = 30_000
_blocks: dict[str, tuple[str, str, bool] | None] = {}


def blocks_of(html: str) -> list[tuple[str, str, bool]]:
    """(text, role, link) of the non-empty text blocks that content is made of, in order.

    The role is the innermost block element with its class; ``link`` tells that the
    whole text is inside links.
    """
    out = []
    for line in _REMOVED.sub("", html).split("\n"):
        if line in _blocks:
            found = _blocks[line]
        else:
            if len(_blocks) >= REMEMBERED:
                _blocks.clear()
            found = _blocks[line] = _block(line)
        if found:
            out.append(found)
    return out


def _block(line: str) -> tuple[str, str, bool] | None:
    """The block of a line of html, if it has text."""
    if "<" not in line:
        text = " ".join(unescape(line).split())
        return (text, "", False) if text else None
    role, pieces, linked, inside, last = "", [], 0, 0, 0
    for tag in _TAG.finditer(line):
        if tag.start() > last:
            piece = line[last : tag.start()]
            pieces.append(piece)
            if inside:
                linked += len(piece.strip())
        last = tag.end()
        name = tag[2].lower()
        if name == "a":
            inside = 0 if tag[1] else 1
        elif not tag[1] and name not in _INLINE and not "".join(pieces).strip():
            found = _CLASS.search(tag[3])
            role = f"{name}.{found[1]}" if found else name
    pieces.append(line[last:])
    joined = "".join(pieces)
    text = " ".join(unescape(joined).split())
    return (text, role, linked > 0 and linked >= 0.8 * len(joined.replace(" ", ""))) if text else None


def running(text: str) -> bool:
    """Whether a text is a passage rather than a label: long, or of two sentences and more."""
    if len(text) >= RUNNING_CHARS:
        return True
    if text.isascii() or max(text) < "\u0e00":
        return len(text) >= TWO_SENTENCES and len(_ENDS.findall(text)) >= 2
    dense = len(_DENSE.findall(text))
    return dense >= 45 or (dense >= DENSE_LETTERS and len(_ENDS.findall(text)) >= 2)


def page_blocks(content: str, html: str | None) -> list[tuple[int, str, str, bool]]:
    """(line number, text, role, link) of the non-empty lines of a content.

    Lines and blocks are the same sequence; where a part of the html is missing
    or differs, lines find their block by its text, and the others have no role.
    """
    lines = [(i, " ".join(line.split())) for i, line in enumerate(content.split("\n"))]
    lines = [(i, text) for i, text in lines if text]
    blocks = blocks_of(html) if html else []
    if len(blocks) >= len(lines) and all(b[0] == t for b, (_, t) in zip(blocks, lines, strict=False)):
        return [(i, text, b[1], b[2]) for (i, text), b in zip(lines, blocks, strict=False)]
    waiting: dict[str, list[tuple[str, bool]]] = {}
    for text, role, link in reversed(blocks):
        waiting.setdefault(text, []).append((role, link))
    out = []
    for i, text in lines:
        role, link = waiting[text].pop() if waiting.get(text) else ("", False)
        out.append((i, text, role, link))
    return out


def block_table(pages: DataFrame) -> DataFrame:
    """(page_id, website_id, body, line_no, text, lead, role, heading, link, passage, nth) of each non-empty line of content.

    ``text`` is a hash of the letters, ``body`` one of the whole content; ``nth``
    counts the lines of a page with that text, headings left out; ``lead`` is the text
    of the last line before that is no link, 0 for a heading. A page delivered
    twice counts once; null ids and contents give no row; pages without a website
    form a site of their own (-1).
    """
    plain = unique_by(spread(pages.select(F.col("id").alias("page_id"), F.coalesce("website_id", F.lit(-1)).cast("long").alias("website_id"), "content", "html")), "page_id")
    plain = plain.withColumn("body", F.xxhash64("content"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, tuple[int, bool]] = {}
        for frame in (whole.iloc[a : a + CUT_PAGES] for whole in batches for a in range(0, len(whole), CUT_PAGES)):
            page, line_no, text, lead, role, heading, link, passage, nth = [], [], [], [], [], [], [], [], []
            for p, content, html in zip(range(len(frame)), frame["content"], frame["html"], strict=True):
                seen: dict[int, int] = {}
                leading = 0
                for i, t, r, k in page_blocks(content, html):
                    found = known.get(t)
                    if found is None:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        found = known[t] = text_key(t), running(t)
                    key = found[0]
                    page.append(p)
                    line_no.append(i)
                    text.append(key)
                    lead.append(leading)
                    role.append(r)
                    heading.append(r.split(".")[0] in _HEADINGS)
                    link.append(k)
                    passage.append(found[1])
                    seen[key] = seen.get(key, 0) + (not heading[-1])
                    nth.append(seen[key])
                    if not k:
                        leading = 0 if heading[-1] else key
            at = np.array(page, np.int64)
            yield pd.DataFrame({
                "page_id": frame["page_id"].to_numpy()[at], "website_id": frame["website_id"].to_numpy()[at], "body": frame["body"].to_numpy()[at], "line_no": line_no,
                "text": np.array(text, np.int64), "lead": np.array(lead, np.int64), "role": role, "heading": heading, "link": link, "passage": passage, "nth": nth,
            })

    schema = "page_id long, website_id long, body long, line_no int, text long, lead long, role string, heading boolean, link boolean, passage boolean, nth int"
    return plain.filter("content <> ''").mapInPandas(cut, schema)


def site_tokens(blocks: DataFrame) -> DataFrame:
    """(website_id, text, body, n, is_text): the tokens of each distinct content and how often it holds them.

    A token is the text of a block, headings left out, or the markup that holds a
    block (its role, by a hash of its own).
    """
    texts = blocks.filter("text <> 0 and not heading").groupBy("website_id", "text", "body").agg(F.max("nth").cast("long").alias("n"))
    # a page fetched again has the same content: its roles are counted on one of them
    roles = blocks.filter("role <> '' and not heading").groupBy("website_id", F.xxhash64(F.lit("role"), "role").alias("text"), "body", "page_id").agg(F.count("*").alias("n"))
    roles = roles.groupBy("website_id", "text", "body").agg(F.max("n").alias("n"))
    return texts.withColumn("is_text", F.lit(True)).unionByName(roles.withColumn("is_text", F.lit(False)))


def text_vectors(tokens: DataFrame) -> DataFrame:
    """(website_id, text, is_text, pages, vector): the tokens of each site.

    ``vector`` is a fingerprint of the occurrence vector: the sum, over the distinct
    contents (their number is ``pages``), of the content's hash times the number of
    occurrences.
    """
    # map-side sums; a hot site is many tokens, not one group
    return tokens.groupBy("website_id", "text", "is_text").agg(F.count("*").alias("pages"), F.sum(F.shiftrightunsigned("body", 24) * F.col("n")).alias("vector"))


def nested_classes(blocks: DataFrame, tokens: DataFrame, vectors: DataFrame) -> DataFrame:
    """(website_id, vector, pages, tokens, parent, valid): the equivalence classes of each site's tokens.

    A class that reaches its share of the site's distinct contents is valid and
    hangs from the site itself (no ``parent``). Any other class nests in the
    smallest such class whose contents hold all of its own, if there is one, and is
    valid if it stands in ``NESTED_SHARE`` of these.
    """
    sizes = blocks.groupBy("website_id").agg(F.countDistinct("body").alias("contents"))
    classes = vectors.filter(F.col("pages") >= MIN_CONTENTS).groupBy("website_id", "vector", "pages").agg(F.count("*").alias("tokens"), F.min("text").alias("one"))
    asked = F.when(F.col("tokens") > 1, CLASS_SHARE).otherwise(SINGLE_SHARE) * F.col("contents")
    classes = written(_sized(classes, sizes, ["website_id"]).withColumn("top", F.col("pages") >= asked).drop("contents"), "classes")
    # all texts of a class stand in the same contents: one of them tells which
    of_text = classes.select("website_id", F.col("one").alias("text"), "vector", "pages", "top")
    stands = written(_sized(tokens.select("website_id", "text", "body"), of_text, ["website_id", "text"]).drop("text"), "class-contents")
    inner = stands.filter("not top").select("website_id", "body", "vector", "pages")
    outer = stands.filter("top").select("website_id", "body", F.col("vector").alias("parent"), F.col("pages").alias("parent_pages"))
    # a content's classes are at most its lines
    both = inner.join(outer, ["website_id", "body"]).groupBy("website_id", "vector", "pages", "parent", "parent_pages").agg(F.count("*").alias("shared"))
    nests = both.filter("shared = pages").groupBy("website_id", "vector", "pages").agg(F.min(F.struct("parent_pages", "parent")).alias("p"))
    out = classes.join(nests, ["website_id", "vector", "pages"], "left")
    valid = F.col("top") | F.coalesce(F.col("pages") >= NESTED_SHARE * F.col("p.parent_pages"), F.lit(False))
    return out.select("website_id", "vector", "pages", "tokens", F.col("p.parent").alias("parent"), valid.alias("valid"))


def template_texts(vectors: DataFrame, classes: DataFrame) -> DataFrame:
    """(website_id, text): the texts of each site's valid classes, and those that stand on ``SITES_SHARE`` of all sites."""
    valid = classes.filter("valid").select("website_id", "vector", "pages")
    own = vectors.join(valid, ["website_id", "vector", "pages"], "left_semi").select("website_id", "text")
    sites = vectors.select("website_id").distinct().count()
    everywhere = vectors.groupBy("text").agg(F.count("*").alias("sites")).filter(F.col("sites") >= max(MIN_SITES, SITES_SHARE * sites)).select("text")
    return own.unionByName(_sized(vectors.select("website_id", "text"), written(everywhere, "texts-everywhere"), ["text"]).select("website_id", "text")).distinct()


def role_judgement(marked: DataFrame) -> DataFrame:
    """(website_id, role, lines, share, furniture): how far each role of a site holds template text.

    Where a role has text outside links, that decides; else its links do: they fill
    a slot of the template where template text leads them. The
    share on all sites counts as ``PRIOR_LINES`` further lines.
    """
    counts = marked.filter("role <> '' and not heading").groupBy("website_id", "role").agg(
        F.sum(F.when(~F.col("link"), 1).otherwise(0)).alias("plain"), F.sum(F.when(~F.col("link") & F.col("is_template"), 1).otherwise(0)).alias("plain_t"),
        F.sum(F.when(F.col("link"), 1).otherwise(0)).alias("links"), F.sum(F.when(F.col("link") & (F.col("is_template") | F.col("led")), 1).otherwise(0)).alias("links_t"),
    )
    overall = counts.groupBy("role").agg(*[F.sum(c).alias(f"all_{c}") for c in ("plain", "plain_t", "links", "links_t")])
    # one row per name of a role: a bounded vocabulary, yet sized
    both = _sized(counts, overall, ["role"], "left")
    use_plain = F.col("all_plain") > 0.02 * (F.col("all_plain") + F.col("all_links"))
    prior = F.when(use_plain, F.col("all_plain_t") / F.greatest("all_plain", F.lit(1))).otherwise(F.col("all_links_t") / F.greatest("all_links", F.lit(1)))
    hits, size = F.when(use_plain, F.col("plain_t")).otherwise(F.col("links_t")), F.when(use_plain, F.col("plain")).otherwise(F.col("links"))
    share = (hits + PRIOR_LINES * prior) / (size + PRIOR_LINES)
    return both.select("website_id", "role", (F.col("plain") + F.col("links")).alias("lines"), F.round(share, 4).alias("share"), (share >= TEMPLATE_SHARE).alias("furniture"))


class Templates:
    """The block table of a collection, its equivalence classes, template texts and role judgements, kept as tables."""

    def __init__(self, pages: DataFrame):
        self.blocks = written(block_table(pages), "page-blocks")
        tokens = written(site_tokens(self.blocks), "site-tokens")
        vectors = written(text_vectors(tokens), "token-vectors")
        self.classes = written(nested_classes(self.blocks, tokens, vectors), "nested-classes")
        flag = template_texts(vectors.filter("is_text"), self.classes).withColumn("is_template", F.lit(True))
        flag = written(flag, "template-texts")
        joined = _sized(self.blocks, flag, ["website_id", "text"], "left")
        joined = _sized(joined, flag.select("website_id", F.col("text").alias("lead"), F.lit(True).alias("led")), ["website_id", "lead"], "left")
        joined = joined.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("is_template", "led")})
        self.marked = written(joined.select("page_id", "website_id", "line_no", "role", "heading", "link", "passage", "is_template", "led"), "marked-lines")
        self.roles = written(role_judgement(self.marked), "roles")

    def lines(self) -> DataFrame:
        """(page_id, website_id, line_no, heading, furniture) of each non-empty line of content.

        A line without a role (its html is missing) is furniture if its text is
        template text, or if it stands in the page's tail: after its last passage,
        from the first template text on.
        """
        judged = _sized(self.marked, self.roles.select("website_id", "role", "furniture"), ["website_id", "role"], "left")
        bare = self.marked.filter("role = ''")
        last = bare.filter("passage and not is_template").groupBy("page_id").agg(F.max("line_no").alias("_last"))
        tails = written(
            bare.filter("is_template").join(last, "page_id").filter(F.col("line_no") > F.col("_last")).groupBy("page_id").agg(F.min("line_no").alias("_tail")), "tails",
        )
        judged = _sized(judged, tails, ["page_id"], "left")
        return judged.select(
            "page_id", "website_id", "line_no", "heading",
            F.when(F.col("heading") | (F.col("passage") & ~F.col("link") & ~F.col("is_template")), False)
            .when(F.col("role") == "", F.col("is_template") | F.coalesce(F.col("line_no") >= F.col("_tail"), F.lit(False))).otherwise(F.coalesce("furniture", F.lit(False))).alias("furniture"),
        )

    def flags(self) -> DataFrame:
        """(page_id, furniture, headings): the numbers of the furniture lines and headings of each page with content."""
        marked = self.lines().filter("furniture or heading")
        # at most the lines of a page
        return marked.groupBy("page_id").agg(*[F.collect_list(F.when(F.col(c), F.col("line_no"))).alias(name) for c, name in (("furniture", "furniture"), ("heading", "headings"))])

    def equivalence_classes(self) -> DataFrame:
        """(website_id, class_id, tokens, pages, parent): the valid equivalence classes of each site's tokens."""
        return self.classes.filter("valid").select("website_id", F.col("vector").alias("class_id"), "tokens", "pages", "parent")


def page_flags(pages: DataFrame) -> DataFrame:
    """(id, furniture, headings): the numbers of each page's furniture lines and headings, kept as a table."""
    return written(Templates(pages).flags(), "page-flags").withColumnRenamed("page_id", "id")


def with_flags(pages: DataFrame) -> DataFrame:
    """``pages`` (with id, content, html and website_id) without html and website, with the flags of their lines."""
    return pages.drop("html", "website_id").join(page_flags(pages), "id", "left")


def main_bodies(pages: DataFrame, lines: DataFrame) -> DataFrame:
    """(page_id, body, lines_kept, lines_removed): each page's content without its furniture lines.

    Null contents stay null, empty ones empty.
    """
    # bounded by the lines of a page
    gone = lines.filter("furniture").groupBy("page_id").agg(F.collect_set("line_no").alias("gone"))
    plain = unique_by(pages.select(F.col("id").alias("page_id"), "content"), "page_id")
    pieces = F.transform(F.split("content", "\n", -1), lambda line, i: F.struct(line.alias("line"), i.alias("i")))
    kept = F.filter(pieces, lambda s: (F.trim(s["line"]) != "") & ~F.array_contains(F.coalesce("gone", F.array().cast("array<int>")), s["i"]))
    joined = plain.join(gone, "page_id", "left").withColumn("_kept", kept)
    return joined.select(
        "page_id", F.array_join(F.transform("_kept", lambda s: s["line"]), "\n").alias("body"),
        F.coalesce(F.size("_kept"), F.lit(0)).alias("lines_kept"), F.coalesce(F.size("gone"), F.lit(0)).alias("lines_removed"),
    )
