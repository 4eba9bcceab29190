"""What the lines of a page are: notices, furniture, headings, keyword text, prose, or short lines.

Shared by the operators for languages, residue and stuffing. Furniture and
headings are known from the page's template (``template.page_flags``); notices
by their phrases; keyword text by how the terms of the whole page recur.
"""

from __future__ import annotations

import re
from itertools import chain, compress
from operator import not_

import numpy as np
import regex

from weftlight.llm.notices import FIELD, FIELD_MARKS, dummy_words, notice_of

# The most frequent function words of the languages that put spaces between words.
FUNCTION_WORDS = frozenset("""
the a an of to in is was that for with it on as at by and or but not be are this from has have had who when no may its his her which
el la los las un una de en que por con su es lo no se más al como para cuando sin nadie fue hemos todavía cómo dos está todo
le les des et du que qui est dans pour ne pas plus sur avec nous au ont été aux son sa leur encore près après quand sans nos
der die das und ist den dem des ein eine nicht mit von zu im auf für wir noch als wie bei war um hat oder nachdem wenn ohne ihn ihren jeden
de het een en van is dat niet met op voor wij zijn nog als te aan bij was tot wie zonder hem elke hun uit nadat keer onze
o os as um uma do da dos das em que não por com seu ao é mais como para ainda duas até quando sem foi
no na nos nas aos à às pelo pela seus suas quem ou já muito também durante depois cada ele ela isso este esta
и в не на что с по как но никто почему всегда тому кто почти наш рядом это все так из за для после того был если то его до их наши мы под же когда чем
уже ещё еще чтобы при о об у я он она они вы себя пока только есть быть сих пор около больше или бы нет раз кто-нибудь рядом том этот эта после
من في على إلى أن ما لا هل كان عن مع لم التي هو قال أي كل بعد
أو هذا هذه ذلك الذي قد لقد ثم حتى إذا لكن بين عند منذ كيف هي هم نحن أكثر دائما دون أحد لمدة إن عندما قرب
का के की में को है से पर और तक ने जब तब कि नहीं हैं किसी एक भी यह था कुछ गया हर साथ क्योंकि हमारे हमने
""".split())

WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+(?:['’\-][\p{L}\p{M}\p{N}]+)*")
#: The same for texts without combining marks.
_PLAIN_WORD = re.compile(r"[^\W_]+(?:['’\-][^\W_]+)*")
MARKED = re.compile("[\u0300-\u036f\u0483-\u0489\u0591-\u1dff\u20d0-\u20ff\u2c00-\uffff\U00010000-\U0010ffff]")
_MARK = re.compile("|".join(map(re.escape, FIELD_MARKS)))
CJK = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}ー]")
THAI = regex.compile(r"\p{Thai}")
END_MARK = regex.compile(r"[.!?…؟।][\"'”»“)\]]*(?=\s|$)|[。！？]")
SENTENCE_END = regex.compile(r"[.!?…؟।。！？][\"'”»“」』)\]]*\s*$")
TAIL = regex.compile(r"\s*(?:\(\d+\)|\(/[^)]*\))\s*$|^[»\s]+|[»\s]+$")

#: Terms behind a term within which it recurs: a keyword text's few terms come back at once, those of sentences do not.
WINDOW = 24
#: Share of a line's terms that recur within the window, from which it is keyword text; pairs of letters recur in sentences, too.
RECURRING, DENSE_RECURRING = 0.5, 0.95
#: Terms from which a line that is no sentence is keyword text by itself; shorter ones are entries of a list.
TERMS = 8
#: Lags of the autocorrelation, those of scripts without spaces, and the mean share of the three best lags from which a line is periodic.
LAGS, DENSE_LAGS, PERIODIC = 24, 36, 0.6
#: Share of function words below which recurrence is no refrain: of a line without and with the form of sentences.
FEW_FUNCTION, FEW_IN_SENTENCES = 0.25, 0.15
#: Share of function words below which a line of distinct terms is a list of nouns.
NO_FUNCTION = 0.08
#: Share of distinct terms of such a list; repeated keywords are known by their recurrence alone.
DISTINCT = 0.4
#: Terms for each end mark, from which a line of distinct nouns is no sentence.
NOUNS = 12
#: Judgements kept per worker; the lines of a site recur on its pages.
REMEMBERED = 20_000

EMPTY, FURNITURE, HEADING = "empty", "furniture", "heading"
NOTICES = frozenset(("error", "script", "filler"))


def normal(line: str) -> str:
    """Lower case, single spaces, without a trailing number or path in brackets."""
    text = " ".join(line.lower().split())
    return TAIL.sub("", text) if text[-1:] in (")", "»") or text[:1] == "»" else text


def words_of(line: str, marked: bool = True) -> list[str]:
    """The words of a line (``marked``: it may hold combining marks): letters, marks and digits, joined by apostrophes and hyphens."""
    return WORD.findall(line) if marked else _PLAIN_WORD.findall(line)


def scripts_of(line: str, letters: int) -> str:
    """"east" or "thai" where most letters belong to a script without spaces, else ""."""
    if len(CJK.findall(line)) > 0.3 * letters:
        return "east"
    return "thai" if len(THAI.findall(line)) > 0.3 * letters else ""


def is_prose(line: str, tokens: list[str], script: str, function: float) -> bool:
    """Whether a line reads as sentences."""
    if script == "east":
        return len(CJK.findall(line)) >= 8 and any(m in line for m in "。！？")
    if script == "thai":
        thai = len(THAI.findall(line))
        parts = [p for p in line.split() if len(THAI.findall(p)) >= 14]
        return thai >= 45 or len(parts) >= 2 or (thai >= 14 and line.rstrip().endswith(("?", "!")))
    if len(tokens) < 4:
        return False
    if SENTENCE_END.search(line):
        lower = 1 - sum(map(str.isupper, [t[0] for t in tokens])) / len(tokens)
        return len(tokens) >= 5 and lower >= 0.4 or lower >= 0.7
    return len(tokens) >= 14 and function >= 0.2  # cut short


class Line:
    """What one line shows by itself."""

    __slots__ = ("notice", "notice_chars", "terms", "dense", "function", "nouns", "prose")

    def __init__(self, line: str):
        text = normal(line)
        plain = FIELD.sub(" ", line) if _MARK.search(line) else line  # a field is no term
        marked = not line.isascii() and MARKED.search(line) is not None
        tokens = words_of(plain, marked)
        n = len(tokens)
        lower = " ".join(tokens).lower().split(" ") if tokens else []
        script = scripts_of(line, sum(map(len, tokens))) if marked else ""
        named = list(map(FUNCTION_WORDS.__contains__, lower))
        self.function = 0.0 if script or not n else sum(named) / n
        self.notice, self.notice_chars = notice_of(text) if text else ("", 0)
        if not self.notice and n >= 6 and not script and self.function < FEW_FUNCTION and dummy_words(lower):
            self.notice = "filler"
        self.dense = bool(script)
        self.prose = is_prose(line, tokens, script, self.function)
        #: what recurs: words that are no function words, or pairs of letters
        if script:
            self.terms = [pair for w in lower for pair in ([w[i : i + 2] for i in range(len(w) - 1)] or [w])]
            pieces = line.split() if script == "thai" else tokens
            size = sum(map(len, pieces)) / max(len(pieces), 1)
            self.nouns = n >= 4 and (size <= 13 if script == "thai" else size <= 6 and sum(line.count(m) for m in "。！？") * NOUNS < n)
        else:
            self.terms = list(compress(lower, map(not_, named)))
            self.nouns = n >= 4 and self.function < NO_FUNCTION and len(END_MARK.findall(line)) * NOUNS < n
        self.nouns = self.nouns and len(set(self.terms)) >= DISTINCT * len(self.terms)


_lines: dict[str, Line] = {}


def seen(line: str) -> Line:
    """The ``Line`` of a text, kept."""
    found = _lines.get(line)
    if found is None:
        if len(_lines) >= REMEMBERED:
            _lines.clear()
        found = _lines[line] = Line(line)
    return found


def recurring(ids: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Which positions hold a term that stands within ``window`` positions before or behind, too."""
    order = np.argsort(ids, kind="stable")
    near = (np.diff(ids[order]) == 0) & (np.diff(order) <= window)
    out = np.zeros(len(ids), bool)
    out[order[1:][near]] = True
    out[order[:-1][near]] = True
    return out


def periodic(ids: np.ndarray, lags: int) -> np.ndarray:
    """For each position the number of the three best lags of the autocorrelation at which its term recurs."""
    n = len(ids)
    held = np.zeros(n)
    if n < 6:
        return held
    same = [ids[lag:] == ids[:-lag] for lag in range(1, min(lags, n - 2) + 1)]
    for k in sorted(range(len(same)), key=lambda k: (-np.count_nonzero(same[k]) / len(same[k]), k))[:3]:
        either = np.zeros(n, bool)
        either[k + 1 :] = same[k]
        either[: n - k - 1] |= same[k]
        held += either
    return held


def keyword_lines(lines: list[Line]) -> list[bool]:
    """Which of a page's lines are repeated keywords or lists of nouns rather than sentences, judged over all of them.

    A line is if its terms recur within the window, unless its function words show
    sentences; if the terms of its positions are those of the sequence's three best
    lags; or if it is a list of nouns without function words.
    """
    size = np.array([len(line.terms) for line in lines], np.int64)
    full = np.flatnonzero(size)
    out = [False] * len(lines)
    if not len(full):
        return out
    ids = np.fromiter(map(hash, chain.from_iterable(line.terms for line in lines)), np.int64, int(size.sum()))
    starts = np.cumsum(size[full]) - size[full]
    again = np.add.reduceat(recurring(ids), starts, dtype=np.int64) / size[full]
    # a periodic line recurs within the widest lag: where none does that could be keyword text, lags need not be looked at
    held = np.zeros(len(full))
    lags = DENSE_LAGS if 2 * sum(len(line.terms) for line in lines if line.dense) > len(ids) else LAGS
    if any(again[k] >= PERIODIC * WINDOW / lags for k, i in enumerate(full.tolist()) if lines[i].prose or size[i] >= TERMS):
        held = np.add.reduceat(periodic(ids, lags), starts) / size[full]
    for i, recurs, period in zip(full.tolist(), again.tolist(), held.tolist(), strict=True):
        line = lines[i]
        enough = DENSE_RECURRING if line.dense and line.prose else RECURRING
        if line.function < (FEW_IN_SENTENCES if line.prose else FEW_FUNCTION) and recurs >= enough:
            out[i] = True
        else:
            out[i] = period >= 3 * PERIODIC or line.nouns and not line.prose
    return out


def judged_lines(content: str, furniture: np.ndarray | list[int] | None = None, headings: np.ndarray | list[int] | None = None) -> list[tuple[int, str, str]]:
    """(line number, line, kind) of the lines of a content.

    Kinds: empty, error, script, filler, furniture, heading, keywords, prose,
    short. A notice is one wherever it stands.
    """
    aside, above = (set() if x is None else set(np.asarray(x).tolist()) for x in (furniture, headings))
    out, open_lines, open_at = [], [], []
    for i, line in enumerate(content.split("\n")):
        if not line or line.isspace():
            out.append((i, line, EMPTY))
            continue
        found = seen(line)
        if found.notice:
            out.append((i, line, found.notice))
        elif i in aside:
            out.append((i, line, FURNITURE))
        elif i in above:
            out.append((i, line, HEADING))
        else:
            open_at.append(len(out))
            open_lines.append(found)
            out.append((i, line, "prose" if found.prose else "short"))
    for at, found, keywords in zip(open_at, open_lines, keyword_lines(open_lines), strict=True):
        # a short line by itself shows nothing: it is an entry of a list or none
        if keywords and (found.prose or len(found.terms) >= TERMS):
            out[at] = (*out[at][:2], "keywords")
    return out
