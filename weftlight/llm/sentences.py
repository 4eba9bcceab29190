"""Problem 10: sentence boundaries across languages and scripts.

A text is cut into blocks (paragraphs, headings, list entries); a line break that
only wraps a paragraph is white space. Inside a block, semi-Markov dynamic
programming selects whole spans between candidate cuts. A span is scored jointly
by its length, its opening word, its closing word and the balance of its
quotations. Opening and closing scores are log-odds learned from all documents of
the corpus itself: words that begin and end blocks against words that stand
inside, then twice more from the cuts chosen so.

Texts are read once: their blocks and candidate cuts become arrays (``cut_table``),
kept as a table. The turns of learning and the final choice work on those alone,
many blocks at a time. The scores of the best supported keys are sent to every
task; those of all other keys are joined to the documents that have such a key.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from weftlight.llm.common import unique_by
from weftlight.plans.lineage import written
from weftlight.plans.spread import spread

#: Opening and closing keys whose scores are sent to every task, 16 bytes each; where there are more, the scores of the least supported are joined.
MAX_KEYS = 500_000
#: Words whose counts a task holds before it gives them out, and words whose keys it remembers.
TASK_KEYS = 200_000
#: The longest line of a text whose paragraphs are wrapped.
WRAP_WIDTH = 120
#: Logarithms of a usual sentence's characters, and their spread; scripts without spaces are denser.
LENGTH, DENSE_LENGTH, LENGTH_SPREAD, LENGTH_WEIGHT = 4.2, 3.2, 0.7, 0.15
#: The largest penalty of a length, before its weight.
LENGTH_CAP = 6.0
UNBALANCED = 5.0
LIMIT = 4.0
#: The least closing score of marks that mean nothing but an end (no closing quotation after them).
SURE = 3.5
#: The least opening score of a word that is not lower case: after a sure end it may still begin a sentence.
UNUSUAL = -2.0
#: Gain of a cut at white space between two letters of a script that has no spaces between words.
GAP = 4.0
#: Candidate cuts of a block up to which blocks are cut together, as matrices.
TOGETHER = 64
#: Cells of one such matrix.
CELLS = 1 << 20
#: What is known of a candidate: a gap of a script without spaces; it follows an end mark; its opening word is lower case; its closing mark means nothing but an end.
IS_GAP, MARKED, LOWERED, SURE_END = 1, 2, 4, 8

_BLOCK = re.compile(r"\r\n?|\n[^\S\n]*(?:\n[^\S\n]*)+|[  \f\v]+")
_MARKER = re.compile(r"(?:[•*‣◦▪·–—-]|\(?\d{1,3}[.)]|\(?[A-Za-z][)])\s+\S")
_END = re.compile(r"[.!?…؟।॥。！？]+")
_END_MARKS = frozenset(".!?…؟।॥。！？")
_CLOSERS = "»”’)]」』›"
_PAIRS = {"“": "”", "„": "“", "«": "»", "「": "」", "『": "』", "(": ")", "‹": "›"}
_DENSE = regex.compile(r"[\p{Thai}\p{Han}\p{Hiragana}\p{Katakana}\p{Lao}\p{Khmer}\p{Myanmar}]")
_SPACELESS_END = re.compile(r"[。！？।॥]")
#: Any letter of those scripts: a text without one needs no further look.
_ANY_DENSE = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\uffef\U0001b000-\U0003ffff]")
_ANY_THAI = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\ua9e0-\ua9ff\uaa60-\uaa7f]")
_QUOTES = re.compile("[\"“”„«»「」『』()‹›]")
_THAI_GAP = regex.compile(r"(?<=[\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\d\p{L}])\s+(?=\S)")
_THAI = regex.compile(r"[\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]")
#: Marks that a space sets off from the last word.
_SET_OFF = re.compile(r"\S+(?:[ \u00a0\u202f][»›!?])*$")
_WORD = re.compile(r"\S+")
_DIGITS = re.compile(r"\d+")
#: A word in lower case, which no block begins with.
_LOWER_WORD = regex.compile(r"\p{Ll}+(?=[\s,.;:!?'’])")


def wrapped(lines: list[str]) -> bool:
    """Whether single line breaks only wrap: lines stop inside sentences, or all but the last are about as long."""
    full = [line.rstrip() for line in lines if line.strip()]
    if len(full) < 2:
        return False
    sizes = [len(x) for x in full]
    if max(sizes) > WRAP_WIDTH:
        return False
    following = list(zip(full, full[1:], strict=False))
    if any(len(a) >= 40 and _LOWER_WORD.match(b) for a, b in following):
        return True
    if any(_MARKER.match(line) for line in full) or any(x[:1].isupper() or _ends(a) for a, x in following if len(a) < 30):
        return False
    even = min(sizes[:-1]) >= 0.6 * max(sizes[:-1]) and sizes[-1] <= 1.15 * max(sizes[:-1])
    inside = sum(_inside(a, b) for a, b in following)
    return even and sizes[0] >= 45 and inside >= 0.4 * len(following)


def _ends(line: str) -> bool:
    tail = line.rstrip().rstrip("\"'”»“」』)]’  ")
    return bool(tail) and bool(_END.match(tail[-1]))


def _inside(line: str, following: str) -> bool:
    """Whether a sentence goes on over a line break, as far as letters tell."""
    if _ends(line):
        return False
    first = following.lstrip()[:1]
    return first.islower() or (bool(first) and not first.isupper() and not first.isspace())


def blocks(text: str) -> list[tuple[int, int]]:
    """(start, end) of the blocks of a text, without white space at their ends."""
    cuts, at = [], 0
    for m in _BLOCK.finditer(text):
        cuts.append((at, m.start()))
        at = m.end()
    cuts.append((at, len(text)))
    if len(cuts) == 1 and "\n" in text and not wrapped(text.split("\n")):
        cuts, at = [], 0
        for m in regex.finditer("\n", text):
            cuts.append((at, m.start()))
            at = m.end()
        cuts.append((at, len(text)))
    out = []
    for a, b in cuts:
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def candidates(block: str) -> list[tuple[int, int]]:
    """(end, next start) of the places where a sentence of a block may end, but for the block's own end."""
    found = []
    size = len(block)
    counted = straight = 0  # straight quotation marks before ``counted``
    for m in _END.finditer(block):
        e = m.end()
        if e >= size:
            continue
        if block[e] != " ":
            if block[e - 1] == "." and block[e].isdigit():
                continue
        elif e + 1 < size and not block[e + 1].isspace() and block[e + 1] not in "»›":
            found.append((e, e + 1))
            continue
        while e < size:
            c = block[e]
            if c in _CLOSERS:
                e += 1
            elif c in " \u00a0\u202f" and e + 1 < size and block[e + 1] in "»›":
                e += 2
            elif c == '"':
                straight += block.count('"', counted, e)
                counted = e
                if straight % 2 == 0:
                    break
                e += 1
            elif c == "“" and block.rfind("„", 0, e) > block.rfind("“", 0, e):
                e += 1
            elif c == "'" and e + 1 < size and block[e + 1].isspace():
                e += 1
            else:
                break
        s = e
        while s < size and block[s].isspace():
            s += 1
        if s >= size:
            continue
        if s == e and not _SPACELESS_END.search(m[0]):
            before, after = block[m.start() - 1 : m.start()], block[s]
            if not (before.isalpha() and before.islower() or before in "0123456789)”»\"" and before) or not (after.isupper() or after in "“„«\"'¿¡("):
                if not (before.isalpha() and after.isalpha() and not before.isupper() and not after.islower() and not after.isupper()):
                    continue
        found.append((e, s))
    if not block.isascii() and _ANY_THAI.search(block):
        for m in _THAI_GAP.finditer(block):
            if _THAI.match(block[m.start() - 1]) or _THAI.match(block[m.end()]):
                found.append((m.start(), m.end()))
        found = sorted(set(found))
    return found


def opening_key(block: str, at: int) -> str:
    """What a span opens with: its first word, or the first letters in scripts without spaces."""
    m = _WORD.match(block, at)
    if not m:
        return ""
    word = m[0]
    head = 0
    while head < len(word) - 1 and word[head] in "“„«「『‹\"'(¿¡—–-":
        head += 1
    lead, rest = word[:head], word[head:]
    if _DENSE.match(rest):
        return lead + rest[: 4 if _THAI.match(rest) else 2]
    rest = rest.rstrip(",;:.!?…؟»”\"')")
    return lead + _DIGITS.sub("0", rest)


def closing_key(block: str, start: int, end: int) -> str:
    """What a span closes with: its last word with its marks, or the last letters in scripts without spaces."""
    return closing_key_of(last_word(block, start, end))


def last_word(block: str, start: int, end: int) -> str:
    """The last word before ``end`` with its marks, also those that a space sets off."""
    tail = block[max(start, end - 48) : end]
    word = tail.rsplit(None, 1)[-1] if tail and not tail.isspace() else tail
    if len(word) == 1 and word in "»›!?":
        m = _SET_OFF.search(tail)
        word = m[0] if m else word
    return word


def closing_key_of(word: str) -> str:
    """The closing key of a last word."""
    letters = word.rstrip(".!?…؟।॥。！？»”’)]」』›\"“'   ")
    marks = word[len(letters) :]
    if letters and _DENSE.match(letters[-1]):
        return letters[-3:] + marks
    return _DIGITS.sub("0", letters.lower()) + marks


def opening_prior(key: str) -> float:
    """The opening score of a word that was never seen."""
    bare = key.lstrip("“„«「『‹\"'(¿¡—–-")
    if not bare:
        return 0.0
    bonus = 0.7 if key[0] in "“„«「『¿¡\"(" else 0.0
    first = bare[0]
    if first.isupper():
        return 0.6 + bonus
    if first.islower():
        return -2.5 + bonus
    return (0.0 if first.isalpha() else -0.7) + bonus


def closing_prior(key: str) -> float:
    """The closing score of a word that was never seen."""
    letters = key.rstrip(".!?…؟।॥。！？»”’)]」』›\"“'   ")
    marks = key[len(letters) :]
    if not marks:
        return -1.0
    if any(m in marks for m in "。！？।॥"):
        return 3.0
    if any(m in marks for m in "!?؟"):
        return 2.5
    if marks.startswith(("...", "…")):
        return 0.3
    last = letters.split("-")[-1].split(".")[-1]
    if len(last) <= 1 or (len(last) <= 3 and not regex.search(r"[aeiouyáéíóúàèäöüаеиоуыэюя0]", last)):
        return -2.5
    return 1.8


def _lowered(key: str) -> bool:
    return key.lstrip("“„«「『‹\"'(¿¡—–-")[:1].islower()


class Scores:
    """Opening and closing log-odds by key, as sorted arrays of hashes."""

    def __init__(self, more: Scores | None = None):
        nothing = (np.zeros(0, np.int64), np.zeros(0))
        self.table: dict[str, tuple[np.ndarray, np.ndarray]] = {"open": nothing, "close": nothing}
        #: the scores of further keys
        self.more = more

    def learn(self, kind: str, keys: np.ndarray, values: np.ndarray) -> None:
        """Takes the scores of distinct hashed keys."""
        order = np.argsort(keys)
        self.table[kind] = (keys[order], values[order])

    def known(self, kind: str, keys: np.ndarray) -> np.ndarray:
        """Which hashed keys are in the arrays."""
        known, _ = self.table[kind]
        if not len(known):
            return np.zeros(len(keys), bool)
        return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys

    def of(self, kind: str, keys: np.ndarray, prior: np.ndarray) -> np.ndarray:
        """The scores of hashed keys; ``prior`` where a key has none."""
        if self.more is not None:
            prior = self.more.of(kind, keys, prior)
        known, values = self.table[kind]
        if not len(known):
            return prior.astype(np.float64)
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return np.where(known[at] == keys, values[at], prior)

    def beside(self, batch: pa.RecordBatch) -> Scores:
        """These scores and those of the keys in ``joined``, lists of (kind, key, score)."""
        rows = batch.column("joined").flatten() if "joined" in batch.schema.names else []
        if not len(rows):
            return self
        kinds, keys, values = (rows.field(i).to_numpy(zero_copy_only=False) for i in range(3))
        more = Scores()
        for kind in more.table:
            key, one = np.unique(keys[kinds == kind], return_index=True)
            more.learn(kind, key, values[kinds == kind][one])
        out = Scores(more)
        out.table = self.table
        return out

    def opening(self, key: str) -> float:
        return float(self.of("open", np.array([hashed(key)]), np.array([opening_prior(key)]))[0])

    def closing(self, key: str) -> float:
        return float(self.of("close", np.array([hashed(key)]), np.array([closing_prior(key)]))[0])


def hashed(key: str) -> int:
    """64 bits of a key, never 0."""
    return (xxhash.xxh64_intdigest(key) - (1 << 63)) or 1


def quote_marks(block: str, at: list[int]) -> list[int]:
    """The state of quotations before each position, ascending: twice the depth of paired marks plus the parity of straight ones."""
    marks = [m.start() for m in _QUOTES.finditer(block)]
    if not marks:
        return [0] * len(at)
    parity = 0
    stack: list[str] = []
    out, k = [], 0
    for i in marks:
        while k < len(at) and at[k] <= i:
            out.append(2 * len(stack) + parity)
            k += 1
        c = block[i]
        if c == '"':
            parity ^= 1
        elif stack and c == stack[-1]:
            stack.pop()
        elif c in _PAIRS:
            stack.append(_PAIRS[c])
    out += [2 * len(stack) + parity] * (len(at) - k)
    return out


class Reader:
    """Reads texts into arrays of blocks and candidate cuts; keys are worked out once per word."""

    BLOCK_COLUMNS = {"block_start": np.int32, "block_end": np.int32, "block_cuts": np.int32, "dense": np.int8, "first": np.int64, "first_prior": np.float32,
                     "last": np.int64, "last_prior": np.float32, "block_flags": np.int8, "state_end": np.int32}
    CUT_COLUMNS = {"e": np.int32, "s": np.int32, "opens": np.int64, "open_prior": np.float32, "closes": np.int64, "close_prior": np.float32,
                   "flags": np.int8, "before": np.int32, "after": np.int32}

    def __init__(self):
        self.opens: dict[str, tuple[int, float, int]] = {}
        self.closes: dict[str, tuple[int, float, int]] = {}
        self.words: Counter[str] = Counter()

    def opening(self, word: str) -> tuple[int, float, int]:
        """(hash, prior, flag) of an opening word."""
        found = self.opens.get(word)
        if found is None:
            if len(self.opens) >= TASK_KEYS:
                self.opens.clear()
            key = opening_key(word, 0)
            found = self.opens[word] = (hashed(key), opening_prior(key), LOWERED if _lowered(key) else 0)
        return found

    def closing(self, word: str) -> tuple[int, float, int]:
        """(hash, prior, flag) of a closing word."""
        found = self.closes.get(word)
        if found is None:
            if len(self.closes) >= TASK_KEYS:
                self.closes.clear()
            key = closing_key_of(word)
            found = self.closes[word] = (hashed(key), closing_prior(key), SURE_END if _SPACELESS_END.match(key[-1:]) else 0)
        return found

    def read(self, text: str, block_rows: list[tuple], cut_rows: list[tuple]) -> int:
        """Appends the blocks and cuts of a text; the number of its blocks. Words inside blocks that no cut stands before are counted."""
        found_blocks = blocks(text)
        for a, b in found_blocks:
            block = text[a:b]
            if _MARKER.match(block):
                block_rows.append((a, b, 0, 0, 0, 0.0, 0, 0.0, 0, 0))
                continue
            found = candidates(block)
            self.words.update(block.split())
            opener = self.opening(word := _WORD.match(block, 0)[0])
            self.words[word] -= 1
            last = self.closing(last_word(block, 0, b - a)) if _ends(block) else (0, 0.0, 0)
            dense, state, states, gaps = 0, 0, None, False
            if found:
                if not block.isascii() and _ANY_DENSE.search(block):
                    dense, gaps = int(len(_DENSE.findall(block)) > len(block) // 3), True
                if _QUOTES.search(block):
                    at = sorted({x for pair in found for x in pair} | {b - a})
                    states = dict(zip(at, quote_marks(block, at), strict=True))
                    state = states[b - a]
            block_rows.append((a, b, len(found), dense, opener[0], opener[1], last[0], last[1], opener[2] | last[2], state))
            for e, s in found:
                word = _WORD.match(block, s)[0]
                if block[s - 1].isspace():
                    self.words[word] -= 1
                o, c = self.opening(word), self.closing(last_word(block, 0, e))
                flags = o[2] | c[2]
                if block[e - 1] in _END_MARKS:
                    flags |= MARKED
                if gaps and _THAI.match(block[e - 1]) and _THAI.match(block[s]):
                    flags |= IS_GAP  # in these scripts the gap itself is the mark
                cut_rows.append((a + e, a + s, o[0], o[1], c[0], c[1], flags, states[s] if states else 0, states[e] if states else 0))
        return len(found_blocks)

    def inner(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hashes, priors, flags, counts) of the words counted since the last call."""
        sums: dict[int, list] = {}
        for word, n in self.words.items():
            if n > 0:
                key, prior, flag = self.opening(word)
                if key in sums:
                    sums[key][3] += n
                else:
                    sums[key] = [key, prior, flag, n]
        self.words = Counter()
        columns = list(zip(*sums.values(), strict=True)) or [(), (), (), ()]
        return tuple(np.array(c, t) for c, t in zip(columns, (np.int64, np.float32, np.int8, np.int64), strict=True))  # type: ignore[return-value]


def arrays(rows: list[tuple], columns: dict[str, type]) -> dict[str, np.ndarray]:
    """The columns of rows."""
    parts = list(zip(*rows, strict=True)) if rows else [()] * len(columns)
    return {name: np.array(part, kind) for (name, kind), part in zip(columns.items(), parts, strict=True)}


def cuts_of(texts: list[str], reader: Reader | None = None) -> tuple[np.ndarray, dict[str, np.ndarray], dict[str, np.ndarray]]:
    """(blocks of each text, arrays of the blocks, arrays of the cuts)."""
    reader = reader or Reader()
    block_rows: list[tuple] = []
    cut_rows: list[tuple] = []
    count = np.array([reader.read(t, block_rows, cut_rows) for t in texts], np.int64)
    return count, arrays(block_rows, Reader.BLOCK_COLUMNS), arrays(cut_rows, Reader.CUT_COLUMNS)


def chosen_cuts(blocks_: dict[str, np.ndarray], cuts: dict[str, np.ndarray], scores: Scores) -> np.ndarray:
    """Which cuts the spans with the best total score of each block make."""
    gain = scores.of("open", cuts["opens"], cuts["open_prior"]) + scores.of("close", cuts["closes"], cuts["close_prior"])
    gain[(cuts["flags"] & IS_GAP) > 0] = GAP
    chosen = np.zeros(len(gain), bool)
    count = blocks_["block_cuts"].astype(np.int64)
    first = np.cumsum(count) - count
    usual = np.where(blocks_["dense"] > 0, DENSE_LENGTH, LENGTH)
    order = np.argsort(count, kind="stable")
    at = int(np.searchsorted(count[order], 1))
    while at < len(order):
        n = int(count[order[at]])
        if n > TOGETHER:
            b = order[at]
            z = slice(first[b], first[b] + n)
            chosen[z] = cut_long(blocks_["block_start"][b], blocks_["block_end"][b], blocks_["state_end"][b], {k: cuts[k][z] for k in ("e", "s", "before", "after")}, gain[z], usual[b])
            at += 1
            continue
        # blocks of about as many cuts in one matrix
        most = min(TOGETHER, n + max(1, n // 4))
        to = min(int(np.searchsorted(count[order], most, "right")), at + max(1, CELLS // (most + 1)))
        rows = order[at:to]
        cell = np.arange(most)
        real = cell < count[rows, None]
        where = np.where(real, first[rows, None] + cell, 0)
        one = np.zeros((len(rows), 1))
        starts = np.hstack([blocks_["block_start"][rows, None], cuts["s"][where]])
        ends = np.hstack([np.where(real, cuts["e"][where], blocks_["block_end"][rows, None]), blocks_["block_end"][rows, None]])
        gains = np.hstack([one, np.where(real, gain[where], -1e15)])
        before = np.hstack([one.astype(np.int32), cuts["before"][where]])
        after = np.hstack([np.where(real, cuts["after"][where], blocks_["state_end"][rows, None]), blocks_["state_end"][rows, None]])
        chosen[where[real]] = cut_together(starts, ends, gains, before, after, usual[rows], count[rows])[real]
        at = to
    return chosen


def cut_together(starts: np.ndarray, ends: np.ndarray, gains: np.ndarray, before: np.ndarray, after: np.ndarray, usual: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The chosen cuts of blocks, one in a row, padded behind ``count`` cuts."""
    n = ends.shape[1]
    best = np.full((len(starts), n + 1), -1e18)
    best[:, 0] = 0.0
    back = np.zeros((len(starts), n + 1), np.int64)
    for j in range(1, n + 1):
        z = (np.log(np.maximum(ends[:, j - 1, None] - starts[:, :j], 1)) - usual[:, None]) / LENGTH_SPREAD
        value = best[:, :j] + gains[:, :j] - LENGTH_WEIGHT * np.minimum(z * z, LENGTH_CAP) - UNBALANCED * (before[:, :j] != after[:, j - 1, None])
        back[:, j] = value.argmax(axis=1)
        best[:, j] = np.take_along_axis(value, back[:, j, None], 1)[:, 0]
    chosen = np.zeros((len(starts), n), bool)
    rows, j = np.arange(len(starts)), count + 1
    while len(rows):
        j = back[rows, j]
        going = j > 0
        rows, j = rows[going], j[going]
        chosen[rows, j - 1] = True
    return chosen[:, : n - 1]


def cut_long(start: int, end: int, state_end: int, cuts: dict[str, np.ndarray], gain: np.ndarray, usual: float) -> np.ndarray:
    """The chosen cuts of one block.

    A span may pass over any number of candidate cuts. From some length on all
    lengths cost the same, so of the starts that far away only the best of each
    state of the quotations is kept: linear in the block, and exact.
    """
    starts, ends = np.r_[start, cuts["s"]].astype(np.int64), np.r_[cuts["e"], end].astype(np.int64)
    gains = np.r_[0.0, gain]
    before, after = np.r_[0, cuts["before"]], np.r_[cuts["after"], state_end]
    n = len(ends)
    far_chars = math.exp(usual + LENGTH_SPREAD * math.sqrt(LENGTH_CAP))
    far_cost = LENGTH_WEIGHT * LENGTH_CAP
    best, back = np.r_[0.0, np.full(n, -1e18)], np.zeros(n + 1, np.int64)
    first_near, any_far, far = 0, (-1e18, 0), {}
    for j in range(1, n + 1):
        here, state = ends[j - 1], int(after[j - 1])
        while first_near < j and here - starts[first_near] >= far_chars:
            i = first_near
            kept = (best[i] + gains[i], i)
            if kept[0] > any_far[0]:
                any_far = kept
            if kept[0] > far.get(int(before[i]), (-1e18, 0))[0]:
                far[int(before[i])] = kept
            first_near += 1
        for (value, i), cost in ((any_far, UNBALANCED), (far.get(state, any_far), 0.0 if state in far else UNBALANCED)):
            if value - cost - far_cost > best[j]:
                best[j], back[j] = value - cost - far_cost, i
        if first_near < j:
            near = slice(first_near, j)
            z = (np.log(np.maximum(here - starts[near], 1)) - usual) / LENGTH_SPREAD
            value = best[near] + gains[near] - LENGTH_WEIGHT * np.minimum(z * z, LENGTH_CAP) - UNBALANCED * (before[near] != state)
            i = int(value.argmax())
            if value[i] > best[j]:
                best[j], back[j] = value[i], first_near + i
    chosen, j = np.zeros(n, bool), int(back[n])
    while j > 0:
        chosen[j - 1] = True
        j = int(back[j])
    return chosen[: n - 1]


def spans_of(blocks_: dict[str, np.ndarray], cuts: dict[str, np.ndarray], chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(block, start, end) of the chosen spans, in order."""
    count = blocks_["block_cuts"].astype(np.int64)
    block_of = np.repeat(np.arange(len(count)), count)
    which = np.r_[np.arange(len(count)), block_of[chosen]]
    start = np.r_[blocks_["block_start"], cuts["s"][chosen]].astype(np.int64)
    end = np.r_[blocks_["block_end"], cuts["e"][chosen]].astype(np.int64)
    return np.sort(which, kind="stable"), start[np.lexsort((start, which))], end[np.lexsort((end, which))]


def sentence_units(text: str | None, scores: Scores) -> list[tuple[int, int]]:
    """(start, end) of the sentence units of a text."""
    if not text or not text.strip():
        return []
    _, blocks_, cuts = cuts_of([text])
    _, start, end = spans_of(blocks_, cuts, chosen_cuts(blocks_, cuts, scores))
    return list(zip(start.tolist(), end.tolist(), strict=True))


_WORD_COLUMNS = {"word": np.int64, "word_prior": np.float32, "word_flags": np.int8, "word_count": np.int64}


def cut_table(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, blocks, cuts, words): the blocks and candidate cuts of each document with text, as records of fixed width one behind the other.

    Written once and used by every turn. Rows with a null id carry the counts of
    the words inside blocks instead.
    """
    plain = unique_by(spread(documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))), "id").filter("text is not null")
    schema = f"id {plain.schema['id'].dataType.simpleString()}, blocks binary, cuts binary, words binary"
    names = ["id", "blocks", "cuts", "words"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()

        def words() -> pa.RecordBatch:
            found = dict(zip(_WORD_COLUMNS, reader.inner(), strict=True))
            nothing = pa.array([b""], pa.binary())
            return pa.RecordBatch.from_arrays([pa.nulls(1, id_type), nothing, nothing, packed(found, _WORD_COLUMNS, np.array([0, len(found["word"])]))], names=names)

        id_type = None
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            id_type = ids.type
            count, blocks_, cuts = cuts_of(texts, reader)
            to_block = np.r_[0, np.cumsum(count)]
            to_cut = np.r_[0, np.cumsum(blocks_["block_cuts"].astype(np.int64))][to_block]
            yield pa.RecordBatch.from_arrays(
                [ids, packed(blocks_, Reader.BLOCK_COLUMNS, to_block), packed(cuts, Reader.CUT_COLUMNS, to_cut), pa.array([b""] * len(texts), pa.binary())], names=names,
            )
            if len(reader.words) > TASK_KEYS:
                yield words()
        if id_type is not None:
            yield words()

    return written(plain.mapInArrow(read, schema), "sentence-cuts")


def packed(columns: dict[str, np.ndarray], kinds: dict[str, type], offsets: np.ndarray) -> pa.Array:
    """One binary value per pair of neighbouring offsets: the records between them."""
    records = np.empty(int(offsets[-1]), list(kinds.items()))
    for name in kinds:
        records[name] = columns[name]
    ends = (offsets * records.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(records.tobytes())])


def unpacked(values: pa.Array, kinds: dict[str, type]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """(records of each value, the columns of all records)."""
    width = np.dtype(list(kinds.items())).itemsize
    ends = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1]
    data = values.buffers()[2]
    records = np.frombuffer(data or b"", list(kinds.items()), (int(ends[-1]) - int(ends[0])) // width, int(ends[0]) if data else 0)
    return np.diff(ends) // width, {name: np.ascontiguousarray(records[name]) for name in kinds}


_JOINED = "array<struct<kind: string, key: bigint, score: double>>"


def scored_table(table: DataFrame, scores: Broadcast[Scores] | None, rest: DataFrame | None) -> DataFrame:
    """``table`` with ``joined``, the scores that its documents need besides the sent ones: (kind, key, score) of their keys in ``rest``.

    Only documents that have a key that was not sent are shuffled.
    """
    if scores is None or rest is None:
        return table

    def unsent(batch: pa.RecordBatch) -> tuple[np.ndarray, dict[str, tuple[np.ndarray, np.ndarray]]]:
        """Which documents have keys that were not sent, and by kind the (document, key) of those."""
        count, cuts = unpacked(batch.column(2), Reader.CUT_COLUMNS)
        document, scored = np.repeat(np.arange(len(count)), count), (cuts["flags"] & IS_GAP) == 0
        has, found = np.zeros(len(count), bool), {}
        for kind, column in (("open", "opens"), ("close", "closes")):
            other = scored & ~scores.value.known(kind, cuts[column])
            found[kind] = document[other], cuts[column][other]
            has[document[other]] = True
        return has, found

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(~unsent(batch)[0]))

    def further(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            has, found = unsent(batch)
            some = batch.filter(pa.array(has))
            asked = []
            for document, keys in found.values():
                pairs = np.unique(np.stack([document, keys]), axis=1)
                ends = np.r_[0, np.cumsum(np.bincount(pairs[0], minlength=len(has))[has])]
                asked.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(pairs[1])))
            yield pa.RecordBatch.from_arrays([*some.columns, *asked], names=[*some.schema.names, "opens", "closes"])

    schema = table.schema.simpleString()[7:-1]
    some = written(table.mapInArrow(further, f"{schema},opens:array<bigint>,closes:array<bigint>"), "sentence-further")
    asked = some.select("id", F.lit("open").alias("kind"), F.explode("opens").alias("key")).unionByName(some.select("id", F.lit("close").alias("kind"), F.explode("closes").alias("key")))
    # at most the keys of a document
    joined = asked.join(rest, ["kind", "key"]).groupBy("id").agg(F.collect_list(F.struct("kind", "key", "score")).cast(_JOINED).alias("joined"))
    return table.mapInArrow(whole, schema).withColumn("joined", F.lit(None).cast(_JOINED)).unionByName(some.drop("opens", "closes").join(joined, "id", "left"))


def key_counts(table: DataFrame, scores: Scores | None, rest: DataFrame | None = None) -> DataFrame:
    """(kind, key, yes, no, prior, floor): the hashed keys of all documents, summed in each task and then over all.

    Without scores only the ends of blocks are cuts. "open" has the words inside
    blocks among its ``no``. ``rest`` has the scores of the keys that are not in ``scores``.
    """
    sent = None if scores is None else table.sparkSession.sparkContext.broadcast(scores)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks_, cuts, words = (unpacked(batch.column(i), kinds)[1] for i, kinds in ((1, Reader.BLOCK_COLUMNS), (2, Reader.CUT_COLUMNS), (3, _WORD_COLUMNS)))
            machine = None if sent is None else sent.value.beside(batch)
            chosen = np.zeros(len(cuts["e"]), bool) if machine is None else chosen_cuts(blocks_, cuts, machine)
            asked = chosen | (machine is not None) | ((cuts["flags"] & MARKED) == 0)
            begun, ended = blocks_["first"] != 0, blocks_["last"] != 0
            parts = [
                ("open", LOWERED, [(blocks_["first"][begun], blocks_["first_prior"][begun], blocks_["block_flags"][begun], np.ones(begun.sum(), np.int64), 0),
                          (cuts["opens"][asked], cuts["open_prior"][asked], cuts["flags"][asked], chosen[asked].astype(np.int64), (~chosen[asked]).astype(np.int64)),
                          (words["word"], words["word_prior"], words["word_flags"], 0, words["word_count"])]),
                ("close", SURE_END, [(blocks_["last"][ended], blocks_["last_prior"][ended], blocks_["block_flags"][ended], np.ones(ended.sum(), np.int64), 0),
                           (cuts["closes"], cuts["close_prior"], cuts["flags"], chosen.astype(np.int64), (~chosen).astype(np.int64))]),
            ]
            for kind, flag, rows in parts:
                keys = np.concatenate([r[0] for r in rows])
                if not len(keys):
                    continue
                prior, flags = (np.concatenate([r[i] for r in rows]) for i in (1, 2))
                yes, no = (np.concatenate([np.broadcast_to(r[i], len(r[0])) for r in rows]) for i in (3, 4))
                key, one, group = np.unique(keys, return_index=True, return_inverse=True)
                lower, upper = (-LIMIT, UNUSUAL) if kind == "open" else (SURE, -LIMIT)
                yield pa.RecordBatch.from_pydict({
                    "kind": pa.array([kind] * len(key)), "key": key, "yes": np.bincount(group, yes).astype(np.int64), "no": np.bincount(group, no).astype(np.int64),
                    "prior": prior[one].astype(np.float32), "floor": np.where((flags[one] & flag) > 0, lower, upper).astype(np.float32),
                })

    found = scored_table(table, sent, rest).mapInArrow(count, "kind string, key long, yes long, no long, prior float, floor float")
    return found.groupBy("kind", "key").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"), F.max("prior").alias("prior"), F.max("floor").alias("floor"))


def least_support(counts: DataFrame, max_keys: int) -> int:
    """The least sum of ``yes`` and ``no`` that at most ``max_keys`` rows have or exceed; 0 if these are all rows."""
    size = counts.count()
    if size <= max_keys:
        return 0
    # the keys of one support are fewer the larger it is: its distinct values are few
    support = 1
    for row in counts.groupBy((F.col("yes") + F.col("no")).alias("support")).agg(F.count("*").alias("keys")).orderBy("support").toLocalIterator():
        if size <= max_keys:
            break
        size -= row["keys"]
        support = row["support"] + 1
    return support


def supported(counts: DataFrame, max_keys: int) -> DataFrame:
    """The rows of ``counts`` whose sum reaches the least support that at most ``max_keys`` rows have."""
    return counts.filter(F.col("yes") + F.col("no") >= least_support(counts, max_keys))


def key_scores(counts: DataFrame, share: float) -> DataFrame:
    """(kind, key, score) of counted keys; ``share`` is the part of the counted insides that are no cuts."""
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yes, no, prior, floor = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in ("yes", "no", "prior", "floor"))
            weight = 2.0
            p = weight / (1 + np.exp(-prior))
            inside = np.where(batch.column("kind").to_numpy(zero_copy_only=False) == "close", share, 1.0)
            odds = np.log((yes + p) / (no * inside + weight - p))
            values = np.maximum(np.clip(odds, -LIMIT, LIMIT), floor)
            yield pa.RecordBatch.from_arrays([batch.column("kind"), batch.column("key"), pa.array(values)], names=["kind", "key", "score"])

    return counts.mapInArrow(score, "kind string, key long, score double")


def learned(table: DataFrame, max_keys: int = MAX_KEYS) -> tuple[Scores, DataFrame | None]:
    """Scores learned from all documents of ``cut_table``: from the ends of blocks, then twice from the cuts chosen so.

    At most ``max_keys`` of them, the best supported, come to the driver; the others are the table of (kind, key, score).
    """
    scores, rest = None, None
    for turn in range(3):
        counts = written(key_counts(table, scores, rest), "sentence-keys")
        support, share = least_support(counts, max_keys), 0.3 if turn == 0 else 1.0
        scores = Scores()
        best = key_scores(counts.filter(F.col("yes") + F.col("no") >= support), share).select((F.col("kind") == "open").alias("opens"), "key", "score").toArrow()  # at most max_keys rows of numbers, never as objects
        of_open, keys, values = (best.column(c).to_numpy() for c in ("opens", "key", "score"))
        for kind, which in (("open", of_open), ("close", ~of_open)):
            scores.learn(kind, keys[which], values[which])
        rest = key_scores(counts.filter(F.col("yes") + F.col("no") < support), share) if support else None
    return scores, rest


def fit_scores(table: DataFrame, max_keys: int = MAX_KEYS) -> Scores:
    """The scores of ``learned`` without those of its table."""
    return learned(table, max_keys)[0]


def sentence_spans(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_keys: int = MAX_KEYS) -> DataFrame:
    """(id_col, start_char, end_char): one row per sentence unit, in code points, end exclusive.

    Null and blank texts give no row; rows with a null id are left out; of rows
    with the same id the one with the largest text counts; other columns are
    ignored. Texts of any length are cut whole, block by block.
    """
    table = cut_table(documents, id_col, text_col)
    fitted, rest = learned(table, max_keys)
    scores = table.sparkSession.sparkContext.broadcast(fitted)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            machine = scores.value.beside(batch)
            count, blocks_ = unpacked(batch.column(1), Reader.BLOCK_COLUMNS)
            _, cuts = unpacked(batch.column(2), Reader.CUT_COLUMNS)
            block, start, end = spans_of(blocks_, cuts, chosen_cuts(blocks_, cuts, machine))
            row = np.repeat(np.arange(batch.num_rows), count)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[block])), pa.array(start), pa.array(end)], names=["id", "start_char", "end_char"])

    kept = scored_table(table.filter("id is not null"), scores, rest).drop("words")
    out = kept.mapInArrow(cut, f"id {table.schema['id'].dataType.simpleString()}, start_char long, end_char long")
    return out.withColumnRenamed("id", id_col)
