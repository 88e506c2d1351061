"""Noise in text from scanned pages: finding and repairing it.

Lines that a page carries are taken out, and what is left is decoded as one stream of characters.
The lattice has an edge for every way to read a stretch of the stream as a word of the corpus: as it
stands, through the confusions of a recogniser, joined with what follows over a blank, a line end or
a hyphen at one, or divided where a blank is missing. An edge costs the negative logarithm of the
word's rate and of the rates of the noise it undoes; the cheapest path gives the words and the noise.
Line ends become blanks or paragraph ends by dynamic programming over the lines, in which what a
break costs depends on the kind and the length of the paragraph it closes.

All decisions compare rates (sections that hold a word, as a share), so they are the same however
large the corpus is.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.plans.stage import stage
from lexmill.sources.tables import live_rows

# What a recogniser writes for what stands on the page.
CONFUSIONS = """
1=l 1=i 0=o 5=s 9=g 6=b 8=b 2=z 3=e 4=a 7=t (=c [=c |=l |=i !=l !=i /=l $=s
rn=m ri=n rr=n i'=r r'=r ii=u li=u il=u ll=u u=ii cl=d c1=d vv=w lc=k l<=k in=m m=rn m=in d=cl n=ri nn=m h=li li=h ti=h fi=h w=vv
ﬁ=fi ﬂ=fl ﬀ=ff ﬃ=ffi ﬄ=ffl
f=t t=f e=c c=e y=v v=y h=b b=h n=u u=n o=c c=o o=e e=o a=o o=a l=i i=l l=t t=l i=j j=i q=g g=q s=5 k=lc x=z z=x r=t
"""
#: Sections a word must be in, as a share of all, to be in the lexicon; a rarer word has this rate. A
#: section of d distinct words holds at most d of them, so the lexicon has at most d / LEXICON_SHARE
#: words for the mean d, however large the corpus: some 70 * 50,000, in practice a few thousand.
LEXICON_SHARE = 1 / 50_000
#: How many times likelier a reading must be than the token for one confusion and for two; how many
#: times less likely a token of letters and figures is a word, and how many times likelier a short one.
ONE, TWO, FIGURES, SHORT = 20.0, 80.0, 20 / 3, 5.0
LIKELIER = ONE
BLANK, DIVIDED = math.log(400.0), math.log(400.0)  # costs of a blank too many or a line end in a word, and of a missing blank
_MARKS = "-‐‑–—¬\xad"
_TIGHT = "-‐‑"
_TOKEN = re.compile(r"[^\W\d_]+(?:[-‐‑][^\W\d_]+)*")
_NUMBER = re.compile(r"\s*(?:[-–—\[(]\s*)?(?:page|p\.|seite|pg\.?)?\s*(?:\d{1,4}|[ivxl]{1,7})(?:\s*(?:/|of|von)\s*\d{1,4})?(?:\s*[-–—\])])?\s*", re.I)
_SHORT_LABEL = re.compile(r"\s*(?:[A-Z][a-z]+\s+[A-Z]?\d+(?:\s+[\d.,%]+)?|Table\s.*)\s*")
_LABEL = re.compile(r"\(?[a-z0-9]{1,4}[).]\s|[-•*]\s", re.I)
_CAPITAL = re.compile(r"[A-Z][\w'&(]*")


@lru_cache(1)
def _confusions() -> dict[str, tuple[str, ...]]:
    table: dict[str, list[str]] = {}
    for pair in CONFUSIONS.split():
        seen, true = pair.split("=")
        table.setdefault(seen, []).append(true)
    return {k: tuple(v) for k, v in table.items()}


class Lexicon:
    """In how many of ``sections`` each word is, and the readings these rates allow."""

    def __init__(self, counts: dict[str, int], sections: int = 0):
        self.counts = counts
        self.least = max(1.0, sections * LEXICON_SHARE)
        self.total = max(1.0, float(sum(counts.values())))
        self.top = max(counts.values(), default=0)
        self.words = sorted(counts)
        self.sound: set[str] = set()
        self._read: dict[str, tuple[str, int] | None] = {}

    def count(self, word: str) -> int:
        return self.counts.get(word, 0)

    def begins(self, start: str) -> bool:
        """Whether a word begins so."""
        k = bisect_left(self.words, start)
        return k < len(self.words) and self.words[k].startswith(start)

    def edges(self, token: str, start: int, most: int) -> Iterator[tuple[int, str, int]]:
        """(end, word, confusions undone) of all words that the characters from ``start`` can be read as."""
        table, todo = _confusions(), [(start, "", 0)]
        while todo:
            i, word, n = todo.pop()
            if word in self.counts:
                yield i, word, n
            if i < len(token):
                if self.begins(word + token[i]):
                    todo.append((i + 1, word + token[i], n))
                if n < most:
                    for size in (1, 2):
                        for true in table.get(token[i : i + size], ()) if i + size <= len(token) else ():
                            if self.begins(word + true):
                                todo.append((i + size, word + true, n + 1))

    def literal(self, token: str) -> float:
        """Cost of a token as it stands."""
        cost = math.log(self.total / max(self.least, self.count(token)))
        if any(not c.isalpha() and c not in "-'" for c in token):
            return cost + math.log(FIGURES)
        return cost - (math.log(SHORT) if len(token) < 5 else 0.0)

    def cost(self, word: str, confusions: int = 0) -> float:
        return math.log(self.total / max(self.least, self.count(word))) + (0.0, math.log(ONE), math.log(TWO))[confusions]

    def reading(self, token: str) -> tuple[str, int] | None:
        """The word a token was misread from and the confusions undone, or None if it stands."""
        if token in self._read:
            return self._read[token]
        best, least = None, self.literal(token) + 1e-9
        if self.literal(token) + 1e-9 >= math.log(self.total / max(1, self.top)) + math.log(ONE):  # else nothing is likelier
            # Long words bear two confusions; in short ones everything resembles something.
            for end, word, n in self.edges(token, 0, 2 if len(token) >= 6 else 1):
                if end == len(token) and n and self.cost(word, n) <= least:
                    best, least = (word, n), self.cost(word, n)
        if len(self._read) > 200_000:
            self._read.clear()
        self._read[token] = best
        return best

    def division(self, token: str) -> tuple[float, list[str]] | None:
        """(cost, words) of the cheapest division of a run of letters at missing blanks."""
        best: list[tuple[float, list[str]] | None] = [(0.0, [])] + [None] * len(token)
        for i in range(len(token)):
            if best[i] is not None:
                for end, word, n in self.edges(token, i, 0):
                    cost = best[i][0] + self.cost(word) + (DIVIDED if i else 0.0)
                    if end - i >= 2 and end - i < len(token) and (best[end] is None or cost < best[end][0]):
                        best[end] = (cost, [*best[i][1], word])
        return best[-1]

    def keep(self, word: str) -> None:
        """Remember a word that stands, so that it is judged once."""
        if len(self.sound) > 200_000:
            self.sound.clear()
        self.sound.add(word)

    def cut_off(self, word: str) -> bool:
        """Whether a word may be the start of a longer one in which it breaks off."""
        i = bisect_right(self.words, word)
        while i < len(self.words) and self.words[i].startswith(word):
            if self.counts[self.words[i]] >= LIKELIER * self.count(word):
                return True
            i += 1
        return False


def furniture(lines: list[str]) -> tuple[set[int], dict[int, str]]:
    """Numbers of lines that are page numbers, and the lines that may be running headers."""
    numbers: set[int] = set()
    headers: dict[int, str] = {}
    filled = [i for i, line in enumerate(lines) if line.strip()]
    place = {i: k for k, i in enumerate(filled)}
    for i in filled:
        line, k = lines[i].strip(), place[i]
        if k == 0 or k == len(filled) - 1:
            continue
        if len(line) <= 24 and any(c.isdigit() for c in line) | (line.lower().strip("-–—[]() ") in _ROMAN) and _NUMBER.fullmatch(line):
            before = lines[filled[k - 1]].strip()
            if not _SHORT_LABEL.fullmatch(before):
                numbers.add(i)
        elif len(line) <= 160 and line[-1] not in ".;:," and not _LABEL.match(line) and not re.match(r"(?i)(?:table|band|class|annex|schedule|form)\b", line):
            words = [w for w in re.split(r"[\s|–—/\-]+", re.sub(r"(?:\s{2,}|\s[-–]\s|\|).{0,24}$", "", line) or line) if re.search(r"[^\W\d_]{2}", w)]
            capital = sum(bool(_CAPITAL.match(w)) or w.lower() in _SMALL for w in words)
            if words and capital >= 0.75 * len(words) and _CAPITAL.match(words[0]):
                headers[i] = line
    return numbers, headers


_SMALL = {"and", "of", "the", "for", "to", "on", "in", "a", "an", "or", "by"}
_ROMAN = {"".join(p) for p in (("x" * t) + u for t in range(4) for u in ("", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix")) if p}


def header_matches(line: str, names: list[str | None]) -> bool:
    """Whether a line is made of the names a page is headed by, a page number and misreadings aside."""
    plain = lambda t: [w for w in re.findall(r"[\w'’(!|]+", t.lower()) if re.search(r"[^\W\d_]", w) and len(w) > 1]
    words = plain(line)
    known = {w for n in names if n for w in plain(n)} | {"page", "of"} | {n.lower().strip() for n in names if n}
    known |= {w[:-1] for w in known if w.endswith("s")}
    lexicon = Lexicon(dict.fromkeys(known, 1))
    hit = sum(w in known or _near(w, lexicon) for w in words)
    return bool(words) and hit >= 0.7 * len(words)


def _near(a: str, names: Lexicon) -> bool:
    """Whether a word differs from a name by two letters or by up to three confusions."""
    if any(end == len(a) for end, _, _ in names.edges(a, 0, 3)):
        return True
    return any(len(b) > 4 and sum(x != y for x, y in zip(a, b)) + abs(len(a) - len(b)) <= 2 for b in names.words)


def _core(token: str) -> str:
    return token.strip(".,;:()\"'[]“”‘’?!*").lower()


def _suspect(core: str) -> bool:
    """Whether a token out of the lexicon can be a misread word: not a reference, number or label."""
    letters = sum(c.isalpha() for c in core)
    return letters >= 2 and not re.fullmatch(r"[a-z]\d+|\d+(?:st|nd|rd|th)|\d+\([a-z]+\)?|[a-z]|\d+[a-z]|[a-z]\d+[a-z]?", core)


def divided(head: str, mark: str, tail: str, lexicon: Lexicon) -> str | None:
    """The whole word if a line end divides one at ``mark``; None for a compound at its own hyphen."""
    whole, compound = (head + tail).lower(), f"{head}-{tail}".lower()
    n, joined = lexicon.count(whole), lexicon.count(compound)
    if joined > n:
        return None
    read = lexicon.reading(whole)
    if read:
        return read[0]
    if n:
        return whole
    if mark in _TIGHT and (joined or lexicon.reading(compound) or (lexicon.count(head.lower()) and lexicon.count(tail.lower()) >= 5 * lexicon.least)):
        return None
    return whole


def _breaks_off(token: str, following: str, core: str, lexicon: Lexicon) -> bool:
    """Whether a known word ends a sentence and is rather the start of a longer one cut short than misread."""
    ends = token[-1] in ".!?" or not following or following.lstrip("(\"'[“‘")[:1].isupper()
    return ends and lexicon.count(core) > 0 and lexicon.cut_off(core)


def _reading(core: str, lexicon: Lexicon, raw: str) -> str | None:
    """What a token was misread from, its parts, an ending 's and an opening bracket for a letter included."""
    n = lexicon.count(core)
    if "-" in core:
        parts = core.split("-")
        read = [lexicon.reading(p) if p and _suspect(p) else None for p in parts]
        if any(read):
            return "-".join(r[0] if r else p for r, p in zip(read, parts))
        whole = lexicon.reading(core) if not all(lexicon.count(p) for p in parts if p) else None
        return whole[0] if whole else None
    read = lexicon.reading(core)
    if read:
        return read[0]
    if core.endswith(("'s", "’s")):
        read = lexicon.reading(core[:-2])
        return read[0] + core[-2:] if read else None
    if raw.startswith("(") and raw[1:2].isalpha() and ")" not in raw:
        read = lexicon.reading("(" + core)
        return read[0] if read and lexicon.count(read[0]) >= LIKELIER * n else None
    return None


HYPHEN, MISREAD = 1, 2


def pieces_of(lines: list[str]) -> list[tuple[str, str]]:
    """The stream of a paragraph's lines: (piece, what follows it: a blank, a line end or a hyphen at one)."""
    out: list[tuple[str, str]] = []
    rows = [tokens for tokens in (line.split() for line in lines) if tokens]
    for j, tokens in enumerate(rows):
        out += [(t, " ") for t in tokens[:-1]]
        t = tokens[-1]
        if j + 1 < len(rows) and len(t) > 1 and t[-1] in _MARKS and t[-2].isalpha():
            tail = rows[j + 1][0]
            goes_on = not tail[0].isalpha() or tail[0].islower() or (t[:-1].isupper() and len(t) > 2 and _core(tail).upper() == tail.strip(".,;:)]"))
            out.append((t[:-1], t[-1]) if goes_on else (t, "\n"))
        else:
            out.append((t, "\n"))
    return out


def decode(pieces: list[tuple[str, str]], lexicon: Lexicon) -> tuple[list[str], int]:
    """(words, noise found) on the cheapest path through the lattice of a stream.

    Edges: one piece as it stands, read through confusions or divided at a missing blank; two pieces as
    one word over a blank, a line end or a hyphen. A piece that stands and joins nothing is a node all
    paths meet in, so costs are compared between such nodes only."""
    n = len(pieces)
    cores = [_core(p) for p, _ in pieces]
    stands = [c in lexicon.sound and p[0] != "(" for c, (p, _) in zip(cores, pieces)]
    words: list[str] = []
    noise = 0
    i = 0
    while i < n:
        piece, after = pieces[i]
        if stands[i] and after in " \n" and (i + 1 == n or cores[i + 1] in lexicon.counts or not cores[i + 1].isalpha()):
            words.append(piece)
            i += 1
            continue
        # The stretch up to the next node that all paths meet in.
        best: dict[int, tuple[float, int, list[str], int]] = {i: (0.0, i, [], 0)}
        at = i
        while True:
            here = best[at][0]
            for end, cost, out, found in _edges_of(pieces, at, lexicon):
                if end not in best or here + cost < best[end][0]:
                    best[end] = (here + cost, at, out, found)
            at = min(k for k in best if k > at)
            if at == n or max(best) == at:
                break
        steps = []
        while at != i:
            _, before, out, found = best[at]
            steps.append((out, found))
            at = before
        i = max(best)
        for out, found in reversed(steps):
            words += out
            noise |= found
    return words, noise


def _edges_of(pieces: list[tuple[str, str]], i: int, lexicon: Lexicon) -> Iterator[tuple[int, float, list[str], int]]:
    """(end, cost, words, noise undone) of the edges of the lattice that begin at a piece."""
    piece, after = pieces[i]
    core = _core(piece)
    following = pieces[i + 1][0] if i + 1 < len(pieces) else ""
    tail = _core(following)
    if following and after not in " \n":
        whole = divided(core, after, tail, lexicon)
        if whole is None:
            parts = [_reading(p, lexicon, "") if p and _suspect(p) else None for p in (core, tail)]
            text = f"{_recased(piece, parts[0]) if parts[0] else piece}-{_recased(following, parts[1]) if parts[1] else following}"
            yield i + 2, 0.0, [text], MISREAD if any(parts) else 0
        else:
            read = _reading((core + tail).lower(), lexicon, "") or whole
            text = piece + following
            wrong = read != (core + tail).lower()
            yield i + 2, 0.0, [_recased(text, read) if wrong else text], HYPHEN | (MISREAD if wrong else 0)
        return
    if not core or not _suspect(core):
        yield i + 1, 0.0, [piece], 0
        return
    read = _reading(core, lexicon, piece)
    if read and not _breaks_off(piece, following, core, lexicon):
        yield i + 1, lexicon.literal(core) - 1e-6, [_recased(piece, read)], MISREAD
    else:
        if not read and lexicon.count(core) and piece[0] != "(":
            lexicon.keep(core)
        yield i + 1, lexicon.literal(core), [piece], 0
        if not read and not lexicon.count(core) and piece.isalpha() and piece.islower() and len(core) >= 6:
            parts = lexicon.division(core)
            if parts:
                yield i + 1, parts[0], parts[1], 0
    if tail and piece.isalpha() and (following[0].islower() or piece.isupper()) and not (lexicon.count(core) and lexicon.count(tail)):
        whole = core + tail
        if _suspect(tail) and lexicon.count(whole):
            yield i + 2, lexicon.cost(whole) + BLANK, [piece + following], 0


def _recased(piece: str, word: str) -> str:
    core = _core(piece)
    at = piece.lower().find(core)
    if at < 0:
        return word
    fresh = word.upper() if len(core) > 2 and piece[at : at + len(core)].isupper() else (word[:1].upper() + word[1:] if piece[at].isupper() else word)
    return piece[:at] + fresh + piece[at + len(core) :]


State = tuple[str, bool, int]
NARROW, OVERFULL = 1.0, 6.0  # costs of a paragraph set narrower than the page, and of a line too long for it


def paragraphs(lines: list[str]) -> list[list[str]]:
    """Lines grouped into paragraphs: the cheapest breaking and joining of all line ends.

    The state before a line end is the kind of the paragraph it would close (a labelled item or running
    text), whether that has one line or more, and how wide it is set: as the page or, at a cost paid
    where it opens, as the median line. A line that goes on is expected to be full for its paragraph's
    width, so what pays at one line end may only show at a later one."""
    filled = sorted(len(line) for line in lines if line.strip())
    widths = sorted({filled[-1], filled[len(filled) // 2]}, reverse=True) if filled else [0]
    kinds = ["item" if _LABEL.match(line) else "text" for line in lines]
    costs = {state: cost for state, cost in _opened(lines[0], kinds[0], widths)} if lines else {}
    back: list[dict[State, tuple[State, bool]]] = []
    for k, (a, b) in enumerate(zip(lines, lines[1:])):
        fresh: dict[State, float] = {}
        came: dict[State, tuple[State, bool]] = {}
        opening = _opened(b, kinds[k + 1], widths)
        for state, cost in costs.items():
            cut, join = _end_costs(a, b, state)
            steps = [(after, cut + more, True) for after, more in opening]
            steps.append(((state[0], True, state[2]), join + (OVERFULL if len(b) > state[2] else 0.0), False))
            for after, step, opens in steps:
                if after not in fresh or cost + step < fresh[after]:
                    fresh[after], came[after] = cost + step, (state, opens)
        costs = fresh
        back.append(came)
    state = min(costs, key=costs.get) if costs else None
    opens = [True] * len(lines)
    for k in range(len(lines) - 1, 0, -1):
        state, opens[k] = back[k - 1][state]
    out: list[list[str]] = []
    for line, first in zip(lines, opens):
        if first:
            out.append([])
        out[-1].append(line)
    return [p for p in ([x for x in q if x.strip()] for q in out) if p]


def _opened(line: str, kind: str, widths: list[int]) -> list[tuple[State, float]]:
    """The states of a paragraph that a line opens, and their costs."""
    return [((kind, False, w), (NARROW if i else 0.0) + (OVERFULL if len(line) > w else 0.0)) for i, w in enumerate(widths)]


def _end_costs(a: str, b: str, state: State) -> tuple[float, float]:
    """(cost of breaking, cost of joining) at the line end between ``a`` and ``b``."""
    kind, several, width = state
    if not a.strip() or not b.strip():
        return 0.0, 8.0
    ended = a.rstrip()[-1] in ".;:?!\"”"
    short = len(a) + 1 + len(b.split()[0]) <= 0.92 * width  # the next word had room, ragged lines aside
    label = bool(_LABEL.match(b))
    cut = (0.0 if ended else 4.0) + (0.0 if short else 2.0) + (0.0 if label or b[:1].isupper() else 4.0)
    join = (3.0 if ended and short else 0.5) + (4.0 if label and ended else 0.0)
    if kind == "item" and not label and not ended:
        join = 0.0  # an item goes on in ragged lines
    if kind == "item" and label:
        cut = max(0.0, cut - 2.0)  # and is followed by the next one
    if not several and not ended:
        cut += 0.0 if short else 1.5  # one full line that has not ended is no paragraph
        join += 1.5 if _SHORT_LABEL.fullmatch(a) else 0.0  # a heading or a table line of its own
    return cut, join


def _plain_lines(text: str) -> list[str]:
    return text.replace("\r\n", "\n").replace("\r", "\n").split("\n")


Line = tuple[str, bool, bool]


def inspect(text: str, lexicon: Lexicon) -> tuple[bool, bool, bool, list[Line]]:
    """(hyphenation, misread, page number, possible headers) of one section, as the decoder finds them.

    A line that may be a running header is kept out of the stream. Whether it is one, the names of its
    document say later; for the other case it comes with the noise that it has between its neighbours."""
    lines = _plain_lines(text)
    numbers, headers = furniture(lines) if len(lines) > 2 else (set(), {})
    body = [(i, line) for i, line in enumerate(lines) if i not in numbers and line.strip()]
    _, noise = decode(pieces_of([line for i, line in body if i not in headers]), lexicon)
    asked: list[Line] = []
    for k, (i, line) in enumerate(body):
        if i in headers:
            _, own = decode(pieces_of([x for _, x in body[max(0, k - 1) : k + 2]]), lexicon)
            asked.append((headers[i], bool(own & HYPHEN), bool(own & MISREAD)))
    return bool(noise & HYPHEN), bool(noise & MISREAD), bool(numbers), asked


def repair(text: str, names: list[str | None], lexicon: Lexicon) -> tuple[str, int]:
    """(continuous text, paragraphs divided by a blank line; number of paragraphs)."""
    lines = _plain_lines(text)
    numbers, headers = furniture(lines) if len(lines) > 2 else (set(), {})
    gone = numbers | {i for i, h in headers.items() if header_matches(h, names)}
    kept: list[str] = []
    for i, line in enumerate(lines):
        if i in gone:
            while kept and not kept[-1].strip():
                kept.pop()
            continue
        if not line.strip() and i and i - 1 in gone:
            continue
        kept.append(line)
    out = [" ".join(decode(pieces_of(group), lexicon)[0]) for group in paragraphs(kept)]
    return "\n\n".join(out), len(out)


# ---- on tables ----------------------------------------------------------------------------------


def lexicon_of(sections: DataFrame, text: str = "text") -> Lexicon:
    """Words by the number of sections that hold them, over all rows; see LEXICON_SHARE.

    Counted where the texts are read and aggregated in Spark; only the words above the share, whose
    number is bounded, pass through the driver on their way to the tasks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}
        for batch in batches:
            for t in batch.column(0).to_pylist():
                for w in set(_TOKEN.findall(re.sub(r"[^\W\d_]*[-‐‑–¬\xad]\s*\n\s*[^\W\d_]*", " ", t.lower()))):
                    seen[w] = seen.get(w, 0) + 1
            if len(seen) > 200_000:
                yield pa.RecordBatch.from_pydict({"word": list(seen), "n": list(seen.values())})
                seen = {}
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})

    rows = sections.where(F.col(text).isNotNull()).select(text)
    counts = rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    known = rows.count()
    return Lexicon({r["word"]: r["n"] for r in counts.where(F.col("n") >= known * LEXICON_SHARE).toLocalIterator()}, known)


def scan_noise(sections: DataFrame, manifest: DataFrame) -> DataFrame:
    """(section_uid, noise) of the live sections: hyphenation, misread, page_furniture.

    ``sections``: section_uid, doc_id, text, made_at; ``manifest``: doc_id, issuer, title, doc_type,
    fetched_at. Texts are read twice where they lie, once for the lexicon and once to be decoded;
    only flags and lines that may be headers are shuffled. A line that is no header of its document is
    text like any other. Null keys and null texts give no row; a section without a manifest row has its
    page numbers found, and of headers none."""
    rows = sections.where("section_uid IS NOT NULL").select("section_uid", "doc_id", "made_at", "text")
    words = lexicon_of(rows)
    spread = rows.sparkSession.sparkContext.broadcast((words.counts, words.least / LEXICON_SHARE))
    asked = pa.list_(pa.struct([("line", pa.string()), ("hyphen", pa.bool_()), ("misread", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(*spread.value)
        for batch in batches:
            found = [inspect(t, lexicon) if t else (False, False, False, []) for t in batch.column(3).to_pylist()]
            h, m, n, lines = zip(*found) if found else ((), (), (), ())
            lines = pa.array([[dict(zip(("line", "hyphen", "misread"), x)) for x in ls] for ls in lines], asked)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(h, pa.bool_()), pa.array(m, pa.bool_()), pa.array(n, pa.bool_()), lines], names=["section_uid", "doc_id", "made_at", "hyphen", "misread", "number", "lines"])

    at = rows.schema["made_at"].dataType.simpleString()
    seen = rows.mapInArrow(run, f"section_uid string, doc_id string, made_at {at}, hyphen boolean, misread boolean, number boolean, lines array<struct<line:string,hyphen:boolean,misread:boolean>>")
    live = live_rows(seen, ["section_uid"], "made_at", ["doc_id", "hyphen", "misread", "number", "lines"])
    flat = stage(live, "scans-flags")
    named = live_rows(manifest, ["doc_id"], "fetched_at", ["issuer", "title", "doc_type"])

    @F.pandas_udf("page_furniture boolean, hyphenation boolean, misread boolean")
    def judged(lines, issuer, title, kind):
        import pandas as pd

        out = []
        for ls, *names in zip(lines, issuer, title, kind):
            heads = [header_matches(x["line"], names) for x in ls]
            out.append((any(heads), any(x["hyphen"] for x, h in zip(ls, heads) if not h), any(x["misread"] for x, h in zip(ls, heads) if not h)))
        return pd.DataFrame(out, columns=["page_furniture", "hyphenation", "misread"], dtype=bool)

    kinds = [("hyphenation", "hyphen"), ("misread", "misread"), ("page_furniture", "number")]
    lined = flat.where("size(lines) > 0").join(named, "doc_id", "left").withColumn("asked", judged("lines", "issuer", "title", "doc_type"))
    noise = F.array_compact(F.array(*[F.when(F.col(f"asked.{name}") & ~F.col(flag), F.lit(name)) for name, flag in kinds]))
    own = F.array_compact(F.array(*[F.when(F.col(flag), F.lit(name)) for name, flag in kinds]))
    return flat.select("section_uid", F.explode(own).alias("noise")).unionByName(lined.select("section_uid", F.explode(noise).alias("noise")))


def repaired_sections(sections: DataFrame, manifest: DataFrame) -> DataFrame:
    """section_uid, text, paragraphs: every live section as continuous paragraphs.

    A text without noise keeps its words; its line ends become blanks or paragraph ends. Null texts
    stay null with 0 paragraphs."""
    live = live_rows(sections, ["section_uid"], "made_at", ["doc_id", "text"])
    named = live_rows(manifest, ["doc_id"], "fetched_at", ["issuer", "title", "doc_type"])
    words = lexicon_of(sections)
    spread = sections.sparkSession.sparkContext.broadcast((words.counts, words.least / LEXICON_SHARE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(*spread.value)
        for batch in batches:
            done = [(None, 0) if t is None else repair(t, list(names), lexicon) for t, *names in zip(*(c.to_pylist() for c in batch.columns[1:]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int32())], names=["section_uid", "text", "paragraphs"])

    joined = live.join(named, "doc_id", "left").select("section_uid", "text", "issuer", "title", "doc_type")
    return joined.mapInArrow(run, "section_uid string, text string, paragraphs int")
