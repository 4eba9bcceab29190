"""URLs: authority, resolution against a base, seeds."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from weftlight.functions.text import bound

# Path endings of files that are not pages.
NOT_PAGES = tuple("""
pdf zip tar.gz tgz rar gz png jpg jpeg gif webp bmp svg ico css js json xml rss mp4 mp3 avi wmv mov xlsx docx pptx csv txt exe
""".split())
_NOT_PAGES = r"\.(?:" + "|".join(e.replace(".", r"\.") for e in NOT_PAGES) + ")$"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def authority(url: Column) -> Column:
    """Host with port and user, lower case; "" where there is none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def without_fragment(url: Column) -> Column:
    return F.substring_index(url, "#", 1)


def _plain_path(raw: Column) -> Column:
    """A path without . and .. segments."""
    parts = F.split(raw, "/", -1)
    folded = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda done, part: F.when(part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))).when(part == ".", done).otherwise(F.concat(done, F.array(part))),
    )
    tail = F.when(raw.rlike(r"(?:^|/)\.{1,2}$"), "/").otherwise("")
    return F.when(raw.rlike(r"(?:^|/)\.{1,2}(?:/|$)"), F.concat(F.array_join(folded, "/"), tail)).otherwise(raw)


def resolve(base: Column, href: Column) -> Column:
    """``href`` as seen from ``base`` (RFC 3986); stays in the JVM."""
    ref = F.trim(href)
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    split = r"^([^?#]*)(.*)$"

    def joined(folder: Column) -> Column:
        return F.concat(origin, _plain_path(F.concat(folder, F.regexp_extract(ref, split, 1))), F.regexp_extract(ref, split, 2))

    folder = F.when(path(base) == "", "/").otherwise(F.regexp_replace(path(base), r"[^/]*$", ""))
    return (
        F.when(ref == "", base)
        .when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), ref)
        .when(ref.startswith("//"), F.concat(scheme(base), F.lit(":"), ref))
        .when(ref.startswith("#"), F.concat(without_fragment(base), ref))
        .when(ref.startswith("?"), F.concat(origin, path(base), ref))
        .when(ref.startswith("/"), joined(F.lit("")))
        .otherwise(bound(folder, joined))
    )


def is_web(url: Column) -> Column:
    return scheme(url).isin("http", "https")


def is_page(url: Column) -> Column:
    """Whether the path does not end like a file that is no page."""
    return ~F.lower(path(url)).rlike(_NOT_PAGES)


def seed(url: Column) -> Column:
    """A seed as entered, with a scheme; null where no host remains."""
    text = F.trim(url)
    full = F.when(text.rlike("^https?://"), text).otherwise(F.concat(F.lit("https://"), text))
    return F.when(authority(full) != "", full)


def root_of(domain: Column) -> Column:
    return F.concat(F.lit("https://"), domain, F.lit("/"))


def robots_of(url: Column) -> Column:
    return F.concat(scheme(url), F.lit("://"), authority(url), F.lit("/robots.txt"))
