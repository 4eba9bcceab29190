"""Words, stems, snippets and hashes as column expressions; nothing leaves the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# The stop words of the index. Entries with an apostrophe can never
# match, since words are split there; they are kept so that the list is whole.
STOP_WORDS = tuple("""
a about above after again against all am an and any are aren't as at be because been before being below between both by
can't cannot could couldn't did didn't do does doesn't doing don't down during each few for from further had hadn't has
hasn't have haven't having he he'd he'll he's her here here's hers herself him himself his how how's i i'd i'll i'm i've
if in into is isn't it it's its itself let's me more most mustn't my myself no nor not of off on once only or other ought
our ours ourselves out over own same shan't she she'd she'll she's should shouldn't so some such than that that's the
their theirs them themselves then there there's these they they'd they'll they're they've this those through to too under
until up very was wasn't we we'd we'll we're we've were weren't what what's when when's where where's which while who
who's whom why why's with won't would wouldn't you you'd you'll you're you've your yours yourself yourselves
""".split())

#: Letters and numbers beyond ASCII count as word characters, and nothing else beyond ASCII does.
OTHER_WORD_CHAR, OTHER_CHAR = r"[\p{L}\p{N}&&[^\x00-\x7F]]", r"[^\x00-\x7F]"
WORD = r"(\b[a-z0-9\-]+\b)"
#: Unicode white space.
SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]+"
SHORTEST, LONGEST = 2, 50
SNIPPET, BEFORE = 200, 60


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def clean_text(text: Column) -> Column:
    """White space runs become one space, ends are trimmed."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def content_hash(content: Column) -> Column:
    """SHA-256 of the UTF-8 text, in hex."""
    return F.sha2(content, 256)


def _searched(text: Column) -> Column:
    """Lower case and pure ASCII, character by character as long as the text: word boundaries are those of any script."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), OTHER_WORD_CHAR, "_"), OTHER_CHAR, " ")


def raw_words(text: Column) -> Column:
    """The runs of ASCII letters, digits and hyphens that stand between word boundaries, lower case."""
    return F.regexp_extract_all(_searched(text), F.lit(WORD), F.lit(1))


def _cut(word: Column, n: int) -> Column:
    return word.substr(F.lit(1), F.length(word) - n)


def _undoubled(word: Column, otherwise: Column) -> Column:
    doubled = (F.length(word) > 2) & word.rlike(r"([^lsz])\1$")
    return F.when(doubled, _cut(word, 1)).otherwise(otherwise)


def _restored(word: Column) -> Column:
    return _undoubled(word, F.when(word.rlike("(at|bl|iz)$"), F.concat(word, F.lit("e"))).otherwise(word))


def _singular(w: Column) -> Column:
    return (
        F.when(w.endswith("sses"), _cut(w, 2)).when(w.endswith("ies"), F.concat(_cut(w, 3), F.lit("i")))
        .when(w.endswith("es") & ~w.endswith("ees"), _cut(w, 2)).when(w.endswith("ss"), w)
        .when(w.endswith("s") & ~w.rlike("(us|is|as)$"), _cut(w, 1)).otherwise(w)
    )


def _suffix(w: Column) -> Column:
    return (
        F.when(w.endswith("eed"), _cut(w, 1)).when(w.endswith("ing"), bound(_cut(w, 3), _restored))
        .when(w.endswith("ed"), bound(_cut(w, 2), _restored))
        .when(w.endswith("er") & (F.length(w) > 4), bound(_cut(w, 2), lambda x: _undoubled(x, x)))
        .when(w.endswith("ly"), _cut(w, 2)).when(w.endswith("ment") & (F.length(w) > 6), _cut(w, 4)).otherwise(w)
    )


def stem(word: Column) -> Column:
    """The stem of an English word: plural endings first, then one of six suffixes; up to three letters stay."""
    return bound(F.lower(F.trim(word)), lambda w: F.when(F.length(w) <= 3, w).otherwise(bound(_singular(w), _suffix)))


def is_stop_word(word: Column) -> Column:
    return word.isin(*[w for w in STOP_WORDS if "'" not in w])


def tokens(text: Column) -> Column:
    """Index tokens of a text in order, with repetitions; an empty array for null and empty texts."""
    def wanted(w: Column) -> Column:
        return ~is_stop_word(w) & F.length(w).between(SHORTEST, LONGEST)

    stems = F.transform(F.filter(raw_words(F.coalesce(text, F.lit(""))), wanted), stem)
    return F.filter(stems, lambda s: (s != "") & ~is_stop_word(s))


def snippet(content: Column, query_tokens: Column) -> Column:
    """A passage around the first query token (as a word prefix), or the beginning of the content."""
    body = F.coalesce(content, F.lit(""))
    head = F.concat(body.substr(F.lit(1), F.lit(SNIPPET)), F.when(F.length(body) > SNIPPET, F.lit("...")).otherwise(F.lit("")))
    # tokens hold letters, digits and hyphens only, so they need no escaping
    pattern = F.concat(F.lit(r"(?s)^(.*?)\b(?:"), F.array_join(query_tokens, "|"), F.lit(")"))

    def around(first: Column) -> Column:
        start = F.greatest(first - BEFORE, F.lit(0))
        end = F.least(F.length(body), first + SNIPPET - BEFORE)
        def opened(piece: Column) -> Column:
            return F.when(start > 0, F.concat(F.lit("..."), F.when(piece.contains(" "), F.regexp_replace(piece, r"(?s)^[^ ]* ", "")).otherwise(piece))).otherwise(piece)
        def closed(piece: Column) -> Column:
            cut = F.when(piece.contains(" "), F.regexp_replace(piece, r"(?s) [^ ]*$", "")).otherwise(piece)
            return F.when(end < F.length(body), F.concat(cut, F.lit("..."))).otherwise(piece)
        return bound(bound(body.substr(start + 1, end - start), opened), closed)

    # the text before the hit gives its offset in characters
    hit = F.length(F.call_function("regexp_extract", _searched(body), pattern, F.lit(1)))
    found = F.regexp_like(_searched(body), pattern)
    return F.when(body == "", "").when(F.coalesce(F.size(query_tokens), F.lit(0)) <= 0, head).when(~found, head).otherwise(bound(hit, around))
