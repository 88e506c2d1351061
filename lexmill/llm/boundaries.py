"""Splitting oversized texts at natural boundaries.

Every run of white space between two words is a possible cut with a strength: 3 where a blank
line divides paragraphs, 2 at a line break or after ``.``, ``;`` or ``:`` before a capital or an
opening bracket, 1 elsewhere. A sparse table over the strengths answers "strongest cut in this
window of lengths, the rightmost on ties" in constant time, so a text of any length is cut in time
proportional to its cuts. Only where a window holds no white space is a cut made inside a word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.sources.tables import live_rows

PARAGRAPH, SENTENCE, WORD, NONE = 3, 2, 1, 0
LEVELS = {PARAGRAPH: "paragraph", SENTENCE: "sentence", WORD: "word", NONE: "none"}
EDGE = " \t\r\n\v\f"
_GAP = re.compile(r"\s+")
_BLANK_LINE = re.compile(r"\n[^\S\n]*\n|\r[^\S\r\n]*\r|\r\n[^\S\n]*\r\n")
PIECES = "text string, ordinal int, start int, end int, strength int"


class CutIndex:
    """Cuts of one text and a sparse table for range-maximum queries over their strengths."""

    def __init__(self, text: str):
        self.text = text
        ends, starts, strengths = [], [], []
        for gap in _GAP.finditer(text):
            a, b = gap.span()
            if a == 0 or b == len(text):
                continue
            blank = gap.group()
            if "\n" in blank or "\r" in blank:
                strength = PARAGRAPH if _BLANK_LINE.search(blank) else SENTENCE
            elif text[a - 1] in ".;:" and ("A" <= text[b] <= "Z" or text[b] == "("):
                strength = SENTENCE
            else:
                strength = WORD
            ends.append(a)
            starts.append(b)
            strengths.append(strength)
        self.ends = np.asarray(ends, np.int64)
        self.starts = np.asarray(starts, np.int64)
        self.strengths = np.asarray(strengths, np.int8)
        # table[j][i]: the index of the strongest cut among i .. i + 2**j - 1, rightmost on ties.
        self.table = [np.arange(len(ends))]
        width = 1
        while 2 * width <= len(ends):
            last = self.table[-1]
            left, right = last[:-width], last[width:]
            self.table.append(np.where(self.strengths[left] > self.strengths[right], left, right))
            width *= 2

    def strongest(self, low: int, high: int) -> int:
        """Index of the strongest cut among ``low`` .. ``high - 1``, the rightmost on ties."""
        j = (high - low).bit_length() - 1
        left, right = int(self.table[j][low]), int(self.table[j][high - (1 << j)])
        return left if self.strengths[left] > self.strengths[right] else right

    def choose(self, start: int, after: int, limit: int, least: int = 0) -> tuple[int, int, int]:
        """(end, next start, strength) of the cut for a piece from ``start`` of at most ``limit``.

        The cut lies beyond ``after`` and, where the window of lengths from ``least`` on holds any, there;
        with no white space up to the limit the word is divided."""
        low = int(np.searchsorted(self.ends, max(after, start + least - 1), "right"))
        high = int(np.searchsorted(self.ends, start + limit, "right"))
        if low >= high:
            low = int(np.searchsorted(self.ends, after, "right"))
        if low >= high:
            return start + limit, start + limit, NONE
        cut = self.strongest(low, high)
        return int(self.ends[cut]), int(self.starts[cut]), int(self.strengths[cut])


def split_text(text: str | None, limit: int = 1200, overlap: int = 150, least: int | None = None) -> list[tuple[str, int, int, int, int]]:
    """Pieces (text, ordinal, start, end, strength of the cut at the end) of at most ``limit``.

    The strongest cut among those that leave ``least`` characters or more (by default a quarter of the
    limit) is taken, so that a heading makes no piece of its own; where there is none, any cut is.

    ``end`` of a piece is where its own new content ends; each piece but the first opens with up
    to ``overlap`` characters of its predecessor, from a word start where there is one. Null or
    blank text has no piece. A text within the limit is one piece, trimmed."""
    if text is None or not 0 <= overlap < limit:
        if text is None:
            return []
        raise ValueError("0 <= overlap < limit is required")
    begin = len(text) - len(text.lstrip(EDGE))
    stop = len(text.rstrip(EDGE))
    if begin >= stop:
        return []
    if stop - begin <= limit:
        return [(text[begin:stop], 0, begin, stop, PARAGRAPH)]
    index = CutIndex(text)
    least = limit // 4 if least is None else least
    pieces: list[tuple[str, int, int, int, int]] = []
    start = fresh = begin
    while stop - start > limit:
        end, following, strength = index.choose(start, fresh, limit, least)
        pieces.append((text[start:end], len(pieces), start, end, strength))
        back = max(end - overlap, start + 1)
        if overlap:
            k = int(np.searchsorted(index.starts, back, "left"))
            word = int(index.starts[k]) if k < len(index.starts) else end
            start = word if word < end else (back if strength == NONE else following)
        else:
            start = following
        fresh = max(following, end)
        if fresh - start >= limit:  # a gap as long as a piece: nothing to overlap with
            start = fresh
    pieces.append((text[start:stop], len(pieces), start, stop, PARAGRAPH))
    return pieces


def weakest_cut(text: str | None, limit: int = 1200) -> int | None:
    """The weakest strength that splitting without overlap and without a least length needs, or None
    within the limit.

    Each piece ends at the strongest, rightmost cut of its window. As long as every paragraph fits these
    are paragraph cuts, else only sentence cuts as long as every sentence fits, and so on: the minimum
    over the cuts names the finest kind of part that must be used."""
    pieces = split_text(text, limit, overlap=0, least=0)
    return min(p[4] for p in pieces[:-1]) if len(pieces) > 1 else None


def split_oversized(df: DataFrame, text: str = "text", limit: int = 1200, overlap: int = 150) -> DataFrame:
    """Explode each row into its pieces; the other columns are kept, those of PIECES replaced.

    Rows stay where they are read: no shuffle. Nulls and blanks give no piece; repeated rows each
    give their pieces. Texts within the limit never leave the JVM."""
    taken = {"text", "ordinal", "start", "end", "strength"}
    kept = [c for c in df.columns if c not in taken]
    rows = df.select(*kept, F.col(text).alias("__text")).where(F.length(_trimmed("__text")) > 0)

    @F.pandas_udf(f"array<struct<{PIECES.replace(' ', ':').replace(',:', ',')}>>")
    def cut(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        names = ("text", "ordinal", "start", "end", "strength")
        for batch in texts:
            yield pd.Series([[dict(zip(names, p)) for p in split_text(t, limit, overlap)] for t in batch])

    lead = F.length(F.regexp_extract("__text", r"^([ \t\r\n\x0b\f]*)", 1))
    short = rows.where(F.length(_trimmed("__text")) <= limit).select(
        *kept, _trimmed("__text").alias("text"), F.lit(0).alias("ordinal"), lead.alias("start"),
        (lead + F.length(_trimmed("__text"))).alias("end"), F.lit(PARAGRAPH).alias("strength"),
    )
    long = rows.where(F.length(_trimmed("__text")) > limit)
    return short.unionByName(long.select(*kept, F.explode(cut("__text")).alias("__p")).select(*kept, "__p.*"))


def _trimmed(column: str) -> Column:
    return F.regexp_replace(column, r"^[ \t\r\n\x0b\f]+|[ \t\r\n\x0b\f]+$", "")


def boundary_findings(df: DataFrame, key: str, at: str, text: str = "text", limit: int = 1200) -> DataFrame:
    """(key, finding) of the live rows whose trimmed text exceeds ``limit``.

    The level is worked out where a row is read, and only (key, time, level) is shuffled to find
    the live row. Null keys and null texts give no row."""

    @F.pandas_udf("int")
    def level(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([weakest_cut(t, limit) for t in batch], dtype="Int32")

    # Texts that cannot exceed the limit reach Python as nulls.
    rows = df.select(key, at, level(F.when(F.length(text) > limit, F.col(text))).alias("level"))
    names = F.create_map(*[F.lit(x) for pair in LEVELS.items() for x in pair])
    live = live_rows(rows, [key], at, ["level"])
    return live.where("level IS NOT NULL").select(key, names[F.col("level")].alias("finding"))


def ordinal_findings(chunks: DataFrame) -> DataFrame:
    """Sections whose live chunks are numbered other than exactly 0 to n-1 (``ordinals``)."""
    live = live_rows(chunks, ["chunk_id"], "made_at", ["section_uid", "ordinal"])
    per = live.where("section_uid IS NOT NULL").groupBy("section_uid").agg(
        F.count("*").alias("n"), F.min("ordinal").alias("low"), F.max("ordinal").alias("high"),
        F.count_distinct("ordinal").alias("kinds"), F.count("ordinal").alias("known"),
    )
    right = (F.col("low") == 0) & (F.col("high") == F.col("n") - 1) & (F.col("kinds") == F.col("n")) & (F.col("known") == F.col("n"))
    return per.where(~F.coalesce(right, F.lit(False))).select(F.col("section_uid").alias("unit_id"), F.lit("ordinals").alias("finding"))
