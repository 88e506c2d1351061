"""Long spans shared word for word between records.

Each text is cut where its content says so: a gear hash rolls over the last 16 characters, and a
position is a cut-point where its hash is the least among the positions within 8 of it. Whether a
position is one depends on its surroundings only, so an insertion moves no cut-point outside them.
From every cut-point a variable chunk runs to the last cut-point within 64 characters; equal
digests of chunks bring records together, and the spans around them are measured on the texts.

Which chunks are shared is told by the least and the greatest text of each digest, so no group of a
digest is ever held by one task. A chunk that few texts share pairs them. Where many do, such as for
a stock phrase, the windows of the wanted length around it take the chunk's place: texts are paired
by a window only where they differ just before it, and shares need no pairs at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.plans.stage import broadcast_if_small, release, stage
from lexmill.sources.tables import live_rows

GEAR, NEAR, REACH = 16, 8, 64
LEAST = 140
HOT = 512  # texts above which those of a chunk are paired by windows of the whole length instead
SHARE_HOT = 32  # the same for shares, where windows need no pairs
CHARS, ROWS = 1 << 20, 1 << 18  # characters and windows that a task works on at once: a batch of records holds any number of either
DIGESTS = 500_000  # shared digests, of some 140 bytes in memory, that are broadcast; more are joined by a shuffle
_U = np.uint32


def _gear_table() -> np.ndarray:
    x = np.arange(1 << 16, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(32)).astype(_U)


_TABLE = _gear_table()
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def gear_hashes(codes: np.ndarray) -> np.ndarray:
    """The rolling hash at each position: sum of gear[c] << age over the last 16 characters."""
    h = _TABLE[codes & 0xFFFF]
    width = 1
    while width < GEAR:
        h = h.copy() if width == 1 else h
        h[width:] += h[:-width].copy() << _U(width)
        width *= 2
    return h


def cut_points(codes: np.ndarray) -> np.ndarray:
    """Positions whose gear hash is not above any within NEAR before or after.

    In a run of one character, or of a few that repeat, many positions tie and all are cut-points."""
    h = gear_hashes(codes)
    size = len(h)
    if size < 2 * NEAR + 1:
        return np.zeros(0, np.int64)
    low = h.copy()  # low[i]: least of h[i] .. h[i + NEAR - 1]
    width = 1
    while width < NEAR:
        low[:-width] = np.minimum(low[:-width], low[width:])
        width *= 2
    middle = np.arange(NEAR, size - NEAR)
    mine = h[middle]
    return middle[(mine <= low[middle - NEAR]) & (mine <= low[middle + 1])]


def chunk_digests(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, start, cut number, digest) of the variable chunks of each text."""
    raw = [t.encode("utf-32-le", "surrogatepass") for t in texts]
    codes = np.frombuffer(b"".join(raw), np.uint32)
    sizes = np.fromiter((len(r) // 4 for r in raw), np.int64, len(raw))
    empty = np.zeros(0, np.int64)
    if not len(codes):
        return empty, empty, empty, empty
    ends = np.cumsum(sizes)
    cuts = cut_points(codes)
    owner = np.searchsorted(ends, cuts, "right")
    # A cut-point whose surroundings reach into a neighbouring text is none.
    inside = (cuts - (ends - sizes)[owner] >= GEAR + NEAR - 1) & (cuts + NEAR < ends[owner])
    cuts, owner = cuts[inside], owner[inside]
    if not len(cuts):
        return empty, empty, empty, empty
    last = np.searchsorted(cuts, cuts + REACH, "right") - 1
    last = np.minimum(last, np.searchsorted(owner, owner, "right") - 1)
    number = np.arange(len(cuts))
    # Digest of codes[a:b] from prefix sums of code * BASE**position, brought to a common exponent.
    power, inverse = _powers(len(codes) + 1)
    mixed = _TABLE[codes & 0xFFFF].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + codes.astype(np.uint64)
    prefix = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(mixed * power[:-1], out=prefix[1:])
    a, b = cuts, cuts[last]
    digest = (prefix[b] - prefix[a]) * inverse[a] + (b - a).astype(np.uint64)
    digest = (digest ^ (digest >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    digest ^= digest >> np.uint64(32)
    # Of a repetition, whose chunks are all equal, the first and the last stand for the others.
    inner = np.zeros(len(cuts), bool)
    inner[1:-1] = (digest[1:-1] == digest[:-2]) & (digest[1:-1] == digest[2:]) & (owner[1:-1] == owner[:-2]) & (owner[1:-1] == owner[2:])
    kept = (last > number) & ~inner
    return owner[kept], (cuts - (ends - sizes)[owner])[kept], number[kept], digest.view(np.int64)[kept]


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    global _CACHE
    if len(_CACHE[0]) < size:
        n = 1 << (size - 1).bit_length()
        undo = np.uint64(pow(int(_BASE), -1, 1 << 64))
        power, inverse = np.full(n, _BASE), np.full(n, undo)
        power[0] = inverse[0] = 1
        _CACHE = np.cumprod(power), np.cumprod(inverse)
    return _CACHE[0][:size], _CACHE[1][:size]


_CACHE = (np.zeros(0, np.uint64), np.zeros(0, np.uint64))


def squeeze(text: str) -> str:
    """Each run of white space as one blank, the ends trimmed; nothing else is altered."""
    return " ".join(text.split())


def _names(texts: list[str]) -> tuple[pa.Array, pa.Array]:
    """The two halves of a 128-bit digest of each text."""
    halves = np.frombuffer(b"".join(xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")) for t in texts), ">i8").astype(np.int64)
    return pa.array(halves[::2]), pa.array(halves[1::2])


def _cut(texts: dict[int, str]) -> Iterator[pa.RecordBatch]:
    """digest, t1, place of the chunks of named texts, of at most CHARS characters at once, or of one text."""
    names, ends = list(texts), np.cumsum([0, *map(len, texts.values())])
    at = 0
    while at < len(names):
        stop = max(at + 1, int(np.searchsorted(ends, ends[at] + CHARS, "right")) - 1)
        owner, start, number, d = chunk_digests([texts[n] for n in names[at:stop]])
        place = (start << 32) | (number & 0xFFFFFFFF)
        yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(names[at:stop], pa.int64()).take(pa.array(owner)), pa.array(place)], names=["digest", "t1", "place"])
        at = stop


def _shared_chunks(records: DataFrame, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, chunks, texts): live records, the chunks that several live texts have, and all long texts."""
    rows = records.where("key IS NOT NULL AND text IS NOT NULL").select("key", "grp", "at", "text")
    at = rows.schema["at"].dataType.simpleString()

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [squeeze(t) for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *_names(texts), pa.array([len(t) for t in texts], pa.int32())], names=["key", "grp", "at", "t1", "t2", "chars"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies of a text are cut once a task, or once in so many texts
        for batch in batches:
            texts = [t for t in map(squeeze, batch.column(0).to_pylist()) if len(t) >= least]
            names = dict(zip(_names(texts)[0].to_pylist(), texts))
            fresh = {n: t for n, t in names.items() if n not in seen}
            if len(seen) > 500_000:
                seen.clear()
            seen.update(fresh)
            yield from _cut(fresh)

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t for t in map(squeeze, batch.column(0).to_pylist()) if len(t) >= least]
            yield pa.RecordBatch.from_arrays([*_names(texts), pa.array(texts, pa.string())], names=["t1", "t2", "text"])

    named = rows.mapInArrow(name, f"key string, grp string, at {at}, t1 long, t2 long, chars int")
    members = stage(live_rows(named, ["key"], "at", ["grp", "t1", "t2", "chars"]), "spans-members")
    # Superseded texts are cut too, and fall out where shared chunks meet the live texts.
    chunks = rows.select("text").where(F.length("text") >= least).mapInArrow(cut, "digest long, t1 long, place long")
    # A part of a text's digest tells two texts apart; the parts are aggregated where texts are cut.
    half = F.col("t1").bitwiseAND(0x7FFFFFFF).cast("int")
    ends = chunks.groupBy("digest").agg(F.min(half).alias("low"), F.max(half).alias("high"))
    several = stage(ends.where("low < high").select("digest"), "spans-several")
    shared = chunks.join(broadcast_if_small(several, DIGESTS), "digest", "left_semi").join(members.select("t1").distinct(), "t1", "left_semi")
    shared = shared.groupBy("digest", "t1", F.shiftright("place", 32).cast("int").alias("start")).agg(F.min(F.col("place").bitwiseAND(0xFFFFFFFF)).alias("cut"))
    before = Window.partitionBy("t1").orderBy("start")
    # The digest of the chunk that starts at the cut-point just before, if that one is shared too.
    shared = stage(shared.select("digest", "t1", "start", F.when(F.lag("cut").over(before) == F.col("cut") - 1, F.lag("digest").over(before)).alias("ahead")), "spans-chunks")
    release(several)
    texts = rows.select("text").where(F.length("text") >= least).mapInArrow(plain, "t1 long, t2 long, text string")
    return members, shared, texts


def _windows_around(shared: DataFrame, hot: DataFrame, texts: DataFrame, least: int) -> DataFrame:
    """digest, t1, start, ahead: the windows of ``least`` characters that hold a hot chunk's start and
    that several texts have, each with the digest of the window one character before it."""
    spots = shared.join(hot, "digest", "left_semi").groupBy("t1").agg(F.collect_set("start").alias("starts"))
    wide = spots.join(texts.dropDuplicates(["t1", "t2"]), "t1").select("t1", "starts", "text").mapInArrow(lambda it: _windows(it, least), "digest long, t1 long, start int, ahead long")
    wide = stage(wide, "spans-wide")
    several = wide.groupBy("digest").agg(F.min("t1").alias("low"), F.max("t1").alias("high")).where("low < high").select("digest")
    return wide.join(several, "digest", "left_semi")  # few of many


def _measured(pairs: DataFrame, members: DataFrame, long: DataFrame, least: int, used: list[DataFrame] = []) -> DataFrame:
    """a1, a2, b1, b2, a_from, b_from, chars: the spans around the places at which texts are paired.

    ``used``: staged tables that only the pairs are made from; they are dropped once these are written."""
    # One row for each pair and offset between the two texts, with the places to measure around.
    anchors = pairs.groupBy("a1", "b1", (F.col("a_at") - F.col("b_at")).alias("shift")).agg(F.collect_set("a_at").alias("at"))
    anchors = stage(anchors, "spans-anchors")
    release(*used)
    involved = anchors.select(F.col("a1").alias("t1")).union(anchors.select(F.col("b1").alias("t1"))).distinct()
    involved = involved.join(members, "t1", "left_semi")
    texts = stage(long.join(involved, "t1", "left_semi").dropDuplicates(["t1", "t2"]), "spans-texts")
    side = lambda s: texts.select(F.col("t1").alias(f"{s}1"), F.col("t2").alias(f"{s}2"), F.col("text").alias(f"{s}_text"))
    both = anchors.join(side("a"), "a1").join(side("b"), "b1").select("a1", "a2", "b1", "b2", "shift", "at", "a_text", "b_text")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 1024) for b in batches for i in range(0, len(b), 1024)):
            columns = batch.to_pydict()
            found = []
            codes: dict[str, np.ndarray] = {}
            for i, (shift, at, a, b) in enumerate(zip(columns["shift"], columns["at"], columns["a_text"], columns["b_text"])):
                ca, cb = (codes.get(t) if t in codes else codes.setdefault(t, np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)) for t in (a, b))
                found += [(i, s, s - shift, n) for s, n in _runs(ca, cb, shift, at, least)]
            i, s, r, n = (np.asarray(c, np.int64) for c in (zip(*found) if found else ((), (), (), ())))
            kept = batch.select([0, 1, 2, 3]).take(pa.array(i))
            yield pa.RecordBatch.from_arrays([*kept.columns, *(pa.array(c.astype(np.int32)) for c in (s, r, n))], names=["a1", "a2", "b1", "b2", "a_from", "b_from", "chars"])

    return both.mapInArrow(measure, "a1 long, a2 long, b1 long, b2 long, a_from int, b_from int, chars int")


def _counted(shared: DataFrame, hot: int) -> DataFrame:
    """The digests that more than ``hot`` texts share."""
    return stage(shared.groupBy("digest").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("digest"), "spans-hot")


def shared_spans(records: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(members, spans) of the live rows of ``records`` with columns key, grp, at and text.

    ``members``: key, grp, t1, t2, chars - each live record and the digest of its squeezed text, so
    that copies are one text. ``spans``: a1, a2, b1, b2, a_from, b_from, chars - for two different
    texts every maximal common span of at least ``least`` characters that a shared chunk lies in,
    a's digest the smaller. Null keys and null texts are left out; shorter texts are members only.

    A digest may be common to any number of texts; above HOT of them, texts are paired by the windows of
    the whole length around it, each pair at the first window the two have in common: what is paired has
    a span, so there are no more candidates than results. Of the chunks two texts share in a row only the
    first asks for a measurement. Texts are cut where they are read; only those that a shared chunk
    involves are compared, after one shuffle."""
    members, shared, long = _shared_chunks(records, least)
    hot = _counted(shared, HOT)
    used = [shared, hot]
    pairs = _joined(shared.join(hot, "digest", "left_anti").select("digest", "t1", "start", "ahead"))
    if hot.limit(1).count():
        wide = stage(_windows_around(shared, hot, long, least), "spans-windows")
        used.append(wide)
        # A window that all its texts have with the same one before it is paired there.
        first = wide.groupBy("digest").agg(F.min("ahead").alias("low"), F.max("ahead").alias("high"), F.count_if(F.col("ahead").isNull()).alias("n")).where("low < high OR n > 0").select("digest")
        pairs = pairs.unionByName(_joined(wide.join(first, "digest", "left_semi")))
    return members, _measured(pairs, members, long, least, used)


def _joined(shared: DataFrame) -> DataFrame:
    """a1, b1, a_at, b_at: two texts and the starts of a chunk they share, unless the chunk ahead of
    it is shared as well."""
    x, y = (shared.select("digest", F.col("t1").alias(f"{s}1"), F.col("start").alias(f"{s}_at"), F.col("ahead").alias(f"{s}_ahead")) for s in "ab")
    pairs = x.join(y, "digest").where((F.col("a1") < F.col("b1")) & F.coalesce(F.col("a_ahead") != F.col("b_ahead"), F.lit(True)))
    return pairs.select("a1", "b1", "a_at", "b_at")


def window_digests(codes: np.ndarray, size: int) -> np.ndarray:
    """The digest of the ``size`` characters from each position that has as many."""
    if len(codes) < size:
        return np.zeros(0, np.int64)
    power, inverse = _powers(len(codes) + 1)
    mixed = (_TABLE[codes & 0xFFFF].astype(np.uint64) + np.uint64(1)) * np.uint64(0xA0761D6478BD642F) ^ codes.astype(np.uint64)
    prefix = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(mixed * power[:-1], out=prefix[1:])
    digest = (prefix[size:] - prefix[:-size]) * inverse[: len(codes) - size + 1]
    digest = (digest ^ (digest >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return (digest ^ (digest >> np.uint64(30))).view(np.int64)


def _windows(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Digests of the windows of ``least`` characters that hold one of the starts, and of those before them.

    Of a repetition only the first and the last chunk are known, so the windows between them belong to it."""
    parts: list[tuple[np.ndarray, ...]] = []
    rows = 0
    for batch in batches:
        for t1, starts, text in (tuple(c.as_py() for c in row) for row in zip(*batch.columns)):
            digest = window_digests(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), least)
            wanted = np.zeros(len(digest), bool)
            starts = sorted(starts)
            for p, q in zip(starts, [*starts[1:], None]):
                wanted[max(0, p - least + 1) : p + 1] = True
                if q is not None and q - p > least and _repeats(text[p : q + 1]):
                    wanted[p : q + 1] = True
            at = np.flatnonzero(wanted)
            fresh = (at == 0) | ~wanted[np.maximum(at - 1, 0)]
            parts.append((digest[at], np.full(len(at), t1, np.int64), at.astype(np.int32), digest[np.maximum(at - 1, 0)], fresh))
            rows += len(at)
            if rows >= ROWS:
                yield _put_together(parts)
                parts, rows = [], 0
    if parts:
        yield _put_together(parts)


def _put_together(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    d, t, at, ahead, fresh = (np.concatenate(c) for c in zip(*parts))
    return pa.RecordBatch.from_arrays([pa.array(d), pa.array(t), pa.array(at), pa.array(ahead, mask=fresh)], names=["digest", "t1", "start", "ahead"])


def _repeats(text: str, longest: int = REACH) -> bool:
    """Whether a text is one short piece over and over."""
    k = text.find(text[:longest], 1)
    return 0 < k <= longest and text[k:] == text[:-k]


def _runs(a: np.ndarray, b: np.ndarray, shift: int, at: list[int], least: int) -> list[tuple[int, int]]:
    """(start in a, length) of the runs equal at this shift, of at least ``least``, that hold an anchor."""
    low, high = max(0, shift), min(len(a), len(b) + shift)
    if high - low < least:
        return []
    same = np.flatnonzero(a[low:high] != b[low - shift : high - shift])
    edges = np.concatenate(([-1], same, [high - low]))
    found = {}
    for p in at:
        k = int(np.searchsorted(edges, p - low, "right"))
        if k < len(edges) and edges[k] - edges[k - 1] - 1 >= least:
            found[int(edges[k - 1]) + 1 + low] = int(edges[k] - edges[k - 1] - 1)
    return list(found.items())


def shared_pairs(members: DataFrame, spans: DataFrame, least: int = LEAST) -> DataFrame:
    """(left, right) pairs of keys with a shared span; records of one non-null ``grp`` are no pair."""
    x = members.select(F.col("t1").alias("a1"), F.col("t2").alias("a2"), F.col("key").alias("x"), F.col("grp").alias("xg"), F.col("chars").alias("n"))
    y = members.select(F.col("t1").alias("b1"), F.col("t2").alias("b2"), F.col("key").alias("y"), F.col("grp").alias("yg"))
    across = spans.select("a1", "a2", "b1", "b2").distinct().join(x, ["a1", "a2"]).join(y, ["b1", "b2"])
    copies = x.where(F.col("n") >= least).join(y, (F.col("a1") == F.col("b1")) & (F.col("a2") == F.col("b2")) & (F.col("x") < F.col("y")))
    pairs = across.select("x", "xg", "y", "yg").union(copies.select("x", "xg", "y", "yg")).where(F.coalesce(F.col("xg") != F.col("yg"), F.lit(True)))
    return pairs.select(F.least("x", "y").alias("left"), F.greatest("x", "y").alias("right"))


def partners(asked: DataFrame, others: DataFrame, spans: DataFrame, least: int = LEAST) -> DataFrame:
    """key, partners: how many records of ``others`` each record of ``asked`` has a shared span with.

    Both are members of ``spans``. Records of one text are counted together and never listed."""
    held = others.groupBy("t1", "t2").agg(F.count("*").alias("n"))
    both = spans.select("a1", "a2", "b1", "b2")
    both = both.union(both.select("b1", "b2", "a1", "a2")).toDF("t1", "t2", "o1", "o2")
    texts = asked.select("t1", "t2", "chars").distinct()
    reached = texts.join(both, ["t1", "t2"]).select("t1", "t2", "o1", "o2").union(texts.where(F.col("chars") >= least).select("t1", "t2", F.col("t1").alias("o1"), F.col("t2").alias("o2"))).distinct()
    per = reached.join(held.toDF("o1", "o2", "n"), ["o1", "o2"]).groupBy("t1", "t2").agg(F.sum("n").alias("partners"))
    return asked.select("key", "t1", "t2").join(per, ["t1", "t2"]).select("key", "partners")


def shared_share(records: DataFrame, least: int = LEAST) -> DataFrame:
    """key, chars, shared_chars, share: how much of each live record lies in spans found elsewhere.

    A character is shared if a stretch of at least ``least`` characters around it stands in another
    text. Overlapping spans count once. A text that several records have is shared whole if it is of at
    least ``least`` characters. Records without a shared span have 0; an empty text has share 0.

    Chunks of at most SHARE_HOT texts are measured in pairs, so a text meets a bounded number of others
    by each; of the others all windows of ``least`` characters around them that several texts have
    cover it, without any pair."""
    members, shared, long = _shared_chunks(records, least)
    hot = _counted(shared, SHARE_HOT)
    spans = _measured(_joined(shared.join(hot, "digest", "left_anti").select("digest", "t1", "start", "ahead")), members, long, least)
    ends = spans.select(F.col("a1").alias("t1"), F.col("a_from").alias("s"), "chars").union(spans.select("b1", "b_from", "chars"))
    if hot.limit(1).count():
        ends = ends.union(_windows_around(shared, hot, long, least).select("t1", F.col("start").alias("s"), F.lit(least).alias("chars")))
    ends = ends.distinct()
    order = Window.partitionBy("t1").orderBy("s", "chars")
    stop = F.col("s") + F.col("chars")
    reach = F.coalesce(F.max(stop).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    covered = ends.select("t1", F.greatest(F.lit(0), stop - F.greatest(F.col("s"), reach)).alias("new")).groupBy("t1").agg(F.sum("new").alias("shared"))
    copies = members.groupBy("t1", "t2").agg(F.count("*").alias("copies"))
    rows = members.join(copies, ["t1", "t2"]).join(covered, "t1", "left")
    chars = F.when((F.col("copies") > 1) & (F.col("chars") >= least), F.col("chars")).otherwise(F.coalesce("shared", F.lit(0)))
    return rows.select("key", "chars", chars.cast("long").alias("shared_chars"), F.coalesce(F.try_divide(chars, "chars"), F.lit(0.0)).alias("share"))
