"""Near-duplicate texts that differ by small edits.

A text is the set of its three-word (or n-word) sequences. Equal sets are one class. A class has 90
min-wise hashes; one bit of 64 of them makes a fingerprint, and three of them make each of 30 keys of
shards. In each shard a BK-tree holds the fingerprints: a child hangs on the edge labelled with its
integer Hamming distance to the parent, and a query at distance d from a node follows only the edges
d - radius to d + radius. What lies within the radius is a candidate, and the sets themselves decide.

A shard above the size of a tree is divided again by pairs of further hashes, 24 ways, so that its
members meet only those they are likely to be alike to. Only what is still above that size after
five equal hashes is searched in blocks, each against the others: there nearly all pairs are results.

Trees are not sent to every executor: a tree of all fingerprints grows with the data. Each shard's
tree is built where its shard lies, and the queries that can match come to it by their key.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.plans.stage import broadcast_if_small, stage
from lexmill.sources.tables import live_rows

BITS = 64  # of a fingerprint
BANDS, ROWS = 30, 3  # at similarity 0.6 all bands miss with probability (1 - 0.6 ** 3) ** 30 = 0.07 %
HASHES = BANDS * ROWS
WAYS = 24  # pairs of hashes that divide a large shard: all miss with probability (1 - 0.6 ** 2) ** 24 = 0.002 %
BLOCK = 1024  # fingerprints of one tree
TEXTS = 200_000  # classes, by a key and a time of some 50 bytes, that are broadcast to fetch their texts
_WORD = re.compile("[a-z0-9]+")
_U = np.uint64


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: Multipliers of the min-wise hashes, from a rule.
_SEEDS = _mix(np.arange(1, HASHES + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)


def shingles(texts: list[str | None], n: int, words: _WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, text numbers) of the distinct n-word sequences, sorted by text number and hash."""
    flat: list[int] = []
    counts = []
    for text in texts:
        found = _WORD.findall(text.lower()) if text else []
        flat.extend(map(words.__getitem__, found))
        counts.append(len(found))
    lengths = np.asarray(counts, np.int64)
    h = np.asarray(flat, _U)
    if len(h) < n:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(texts)), lengths)
    acc = np.zeros(len(h) - n + 1, _U)
    for k in range(n):
        acc = acc * _U(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k]
    whole = owner[: len(acc)] == owner[n - 1 :]
    acc, owner = _mix(acc[whole]), owner[: len(acc)][whole]
    order = np.lexsort((acc, owner))
    acc, owner = acc[order], owner[order]
    first = np.ones(len(acc), bool)
    first[1:] = (acc[1:] != acc[:-1]) | (owner[1:] != owner[:-1])
    return acc[first], owner[first]


def sketches(texts: list[str | None], n: int, words: _WordHashes) -> dict[str, np.ndarray]:
    """Per text with a shingle: its number, a 128-bit digest of the set, size, fingerprint, keys, finer keys."""
    h, owner = shingles(texts, n, words)
    if not len(h):
        return {"i": np.zeros(0, np.int64), "d1": np.zeros(0, np.int64), "d2": np.zeros(0, np.int64), "size": np.zeros(0, np.int32), "fp": np.zeros(0, np.int64), "keys": np.zeros((0, BANDS), np.int64), "finer": np.zeros((0, WAYS), np.int32)}
    starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    mins = np.stack([np.minimum.reduceat(h * a, starts) for a in _SEEDS])
    mixed = _mix(mins)
    bits = (mixed[:BITS] >> _U(17)) & _U(1)
    fp = np.bitwise_or.reduce(bits << np.arange(BITS, dtype=_U)[:, None], axis=0)
    keys = np.stack([_mix(mixed[ROWS * b : ROWS * b + ROWS].sum(axis=0, dtype=_U) * _U(3) + mixed[ROWS * b] + _U(b)) for b in range(BANDS)], axis=1)
    # Pairs of hashes of different keys, none used twice as often as another.
    pairs = [(w, (w * 2 + HASHES // 2) % HASHES) for w in range(WAYS)]
    finer = np.stack([(_mix(mixed[i] * _U(5) + mixed[j] + _U(w)) >> _U(33)) for w, (i, j) in enumerate(pairs)], axis=1)
    return {
        "i": owner[starts],
        "d1": np.add.reduceat(_mix(h ^ _U(0x5851F42D4C957F2D)), starts).view(np.int64),
        "d2": np.add.reduceat(_mix(h + _U(0x14057B7EF767814F)), starts).view(np.int64),
        "size": np.diff(np.r_[starts, len(h)]).astype(np.int32),
        "fp": fp.view(np.int64),
        "keys": keys.view(np.int64),
        "finer": finer.astype(np.int32),
    }


class BKTree:
    """Fingerprints under integer Hamming distance; equal fingerprints share a node."""

    def __init__(self) -> None:
        self.prints: list[int] = []
        self.items: list[list[int]] = []
        self.edges: list[dict[int, int]] = []
        self.visited = 0  # nodes that queries looked at

    def add(self, fp: int, item: int) -> None:
        node = 0 if self.prints else -1
        while node >= 0:
            d = (self.prints[node] ^ fp).bit_count()
            if d == 0:
                self.items[node].append(item)
                return
            parent, node = node, self.edges[node].get(d, -1)
        if self.prints:
            self.edges[parent][d] = len(self.prints)
        self.prints.append(fp)
        self.items.append([item])
        self.edges.append({})

    def within(self, fp: int, radius: int) -> Iterator[int]:
        todo = [0] if self.prints else []
        while todo:
            node = todo.pop()
            self.visited += 1
            d = (self.prints[node] ^ fp).bit_count()
            if d <= radius:
                yield from self.items[node]
            todo += [child for edge, child in self.edges[node].items() if d - radius <= edge <= d + radius]


def search_radius(similarity: float) -> int:
    """Bits that differ at the similarity, and three and a half standard deviations more.

    A bit differs with probability (1 - similarity) / 2: one pair in some 4,000 lies beyond."""
    p = (1 - similarity) / 2
    return min(BITS, math.ceil(BITS * p + 3.5 * math.sqrt(BITS * p * (1 - p))))


def _sketched(df: DataFrame, key: str, group: str, at: str, text: str, n: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _WordHashes()
        for batch in batches:
            s = sketches(batch.column(3).to_pylist(), n, words)
            # A row without a sequence stays, with nulls: it may supersede one that has some.
            place, none = np.zeros(len(batch), np.int64), np.ones(len(batch), bool)
            place[s["i"]], none[s["i"]] = np.arange(len(s["i"])), False
            place = pa.array(place, mask=none)
            keys, finer = (pa.ListArray.from_arrays(np.arange(0, k * len(s["i"]) + 1, k, dtype=np.int32), pa.array(s[c].ravel())) for c, k in (("keys", BANDS), ("finer", WAYS)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(s[c]).take(place) for c in ("d1", "d2", "size", "fp")), keys.take(place), finer.take(place)], names=["key", "grp", "at", "d1", "d2", "size", "fp", "keys", "finer"])

    rows = df.select(F.col(key).cast("string").alias("key"), F.col(group).cast("string").alias("grp"), F.col(at).alias("at"), F.col(text).alias("text")).where("key IS NOT NULL")
    kind = rows.schema["at"].dataType.simpleString()
    return rows.mapInArrow(run, f"key string, grp string, at {kind}, d1 long, d2 long, size int, fp long, keys array<long>, finer array<int>")


def _candidates(classes: DataFrame, radius: int, block: int = BLOCK) -> DataFrame:
    """Distinct (a, b), a < b, of the first digests of classes that a shard's tree brings together.

    ``classes``: d1, fp, keys, finer. Counts are aggregated before their shuffle and joined back, so
    that no task holds a whole shard."""
    rows = classes.select(F.explode("keys").alias("shard"), F.col("d1").alias("item"), "fp")
    counts = stage(classes.select(F.explode("keys").alias("shard")).groupBy("shard").agg(F.count("*").alias("n")).where("n > 1"), "neardup-shards")
    small = rows.join(counts.where(F.col("n") <= block), "shard").select("shard", "item", "fp", "n")
    hot = counts.where(F.col("n") > block).select("shard")
    if hot.limit(1).count():
        # Members of a large shard meet where one of the further pairs of hashes is equal, too.
        again = rows.join(hot, "shard").join(classes.select(F.col("d1").alias("item"), "finer"), "item")
        again = again.select("shard", "item", "fp", F.posexplode("finer").alias("way", "part")).select(F.xxhash64("shard", "way", "part").alias("shard"), "item", "fp")
        again = stage(again, "neardup-finer")
        parts = again.groupBy("shard").agg(F.count("*").alias("n")).where("n > 1")
        small = small.unionByName(again.join(parts, "shard"))
    # A part that is still above the block size is cut into blocks: each member is held by the tree of
    # its own block and asks the trees of all blocks before it.
    rows = small.withColumn("own", F.pmod(F.xxhash64("item"), F.ceil(F.col("n") / block).cast("int")).cast("int"))
    rows = rows.select("shard", "item", "fp", "own", F.explode(F.sequence(F.lit(0), "own")).alias("tree"))
    rows = rows.repartition("shard", "tree").sortWithinPartitions("shard", "tree", "own", "item")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tree = None, BKTree()
        for batch in batches:
            left, right = [], []
            for shard_, item, fp, own, number in zip(*(c.to_pylist() for c in batch.columns)):
                if (shard_, number) != at:
                    at, tree = (shard_, number), BKTree()
                fp &= 0xFFFFFFFFFFFFFFFF
                for other in tree.within(fp, radius):
                    if other != item:
                        left.append(min(item, other))
                        right.append(max(item, other))
                if own == number:
                    tree.add(fp, item)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(df: DataFrame, key: str, group: str, at: str, text: str = "text", n: int = 3, similarity: float = 0.6) -> tuple[DataFrame, DataFrame]:
    """(members, links) over the live rows of ``df``.

    ``members``: key, grp, d1, d2 - the class of each live row, named by the digest of its set of
    n-word sequences. ``links``: a1, a2, b1, b2, similarity - the pairs of different classes whose
    sets share at least ``similarity`` of their union, each once, with a's digest the smaller.

    Null keys, null texts and texts of fewer than n words belong to no class. Copies, however many,
    are one class. Shards of any size are searched whole; see ``_candidates``."""
    sketched = stage(_sketched(df, key, group, at, text, n), "neardup-sketch")
    members = live_rows(sketched, ["key"], "at", ["grp", "d1", "d2"]).where("d1 IS NOT NULL")
    # Classes that only superseded rows have are none: they would link and bridge what is live.
    alive = sketched.join(members.select("d1", "d2").distinct(), ["d1", "d2"], "left_semi")
    classes = stage(alive.select("d1", "d2", "fp", "keys", "finer").dropDuplicates(["d1", "d2"]).select("d1", "fp", "keys", "finer"), "neardup-classes")
    pairs = stage(_candidates(classes, search_radius(similarity)), "neardup-candidates")

    involved = pairs.select(F.col("a").alias("d1")).union(pairs.select(F.col("b").alias("d1"))).distinct()
    sample = sketched.join(involved, "d1", "left_semi").groupBy("d1", "d2").agg(F.min_by(F.struct("key", "at"), F.struct("key", "at")).alias("row")).select("d1", "d2", "row.key", "row.at")
    sample = broadcast_if_small(stage(sample, "neardup-rows"), TEXTS)
    texts = df.select(F.col(key).cast("string").alias("key"), F.col(at).alias("at"), F.col(text).alias("text")).where("text IS NOT NULL")
    # Rows of one key and time are equal by the live-row rule; the digest is checked all the same.
    texts = texts.join(sample, (sample.key == texts.key) & sample["at"].eqNullSafe(texts["at"])).select("d1", "d2", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _WordHashes()
        for batch in batches:
            h, owner = shingles(batch.column(2).to_pylist(), n, words)
            ends = np.searchsorted(owner, np.arange(len(batch) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(ends, pa.array(h.view(np.int64)))], names=["d1", "d2", "grams"])

    grams = stage(texts.mapInArrow(sets, "d1 long, d2 long, grams array<long>").dropDuplicates(["d1", "d2"]), "neardup-sets")
    side = lambda x: grams.select(F.col("d1").alias(f"{x}1"), F.col("d2").alias(f"{x}2"), F.col("grams").alias(f"{x}g"))
    both = pairs.join(side("a"), F.col("a") == F.col("a1")).join(side("b"), F.col("b") == F.col("b1"))
    common = F.size(F.array_intersect("ag", "bg"))
    scored = both.select("a1", "a2", "b1", "b2", common.alias("common"), (F.size("ag") + F.size("bg")).alias("sizes"))
    scored = scored.withColumn("similarity", F.col("common") / (F.col("sizes") - F.col("common")))
    return members, scored.where(F.col("similarity") >= similarity - 1e-12).select("a1", "a2", "b1", "b2", "similarity")


def linked_keys(members: DataFrame, links: DataFrame) -> DataFrame:
    """Pairs (left, right) of keys of different ``grp`` that are alike, the smaller key first.

    The form for a result fixed as pairs of rows; elsewhere use classes and membership."""
    x = members.select(F.col("d1").alias("a1"), F.col("d2").alias("a2"), F.col("key").alias("x"), F.col("grp").alias("xg"))
    y = members.select(F.col("d1").alias("b1"), F.col("d2").alias("b2"), F.col("key").alias("y"), F.col("grp").alias("yg"))
    across = links.join(x, ["a1", "a2"]).join(y, ["b1", "b2"])
    inside = x.join(y, (F.col("a1") == F.col("b1")) & (F.col("a2") == F.col("b2")) & (F.col("x") < F.col("y")))
    pairs = across.select("x", "xg", "y", "yg").union(inside.select("x", "xg", "y", "yg")).where(~F.col("xg").eqNullSafe(F.col("yg")))
    return pairs.select(F.least("x", "y").alias("left"), F.greatest("x", "y").alias("right"))


def alike_sections(members: DataFrame, links: DataFrame, asked: DataFrame) -> DataFrame:
    """(id, found): for each id of ``asked`` (id, section) the number of distinct sections of other ``grp``
    with a member alike to a member of one of the id's sections.

    ``members`` has a column ``section`` besides. No pairs of members are made: sections with the same
    classes and group are counted together first, and an id reads those counts."""
    units = members.select("section", "grp", F.struct("d1", "d2").alias("class")).distinct()
    signed = units.groupBy("section", "grp").agg(F.xxhash64(F.array_sort(F.collect_set("class"))).alias("sign"))
    sizes = signed.groupBy("sign", "grp").agg(F.count("*").alias("n"))
    held = stage(units.join(signed, ["section", "grp"]).select("class", "sign").distinct(), "neardup-signs")
    name = lambda x: F.struct(F.col(f"{x}1").alias("d1"), F.col(f"{x}2").alias("d2"))
    both = links.select(name("a").alias("class"), name("b").alias("other"))
    both = both.union(both.select("other", "class"))
    own = asked.where("id IS NOT NULL AND section IS NOT NULL").distinct().join(units, "section").select("id", "grp", "class")
    reached = own.union(own.join(both, "class").select("id", "grp", "other")).distinct().join(held, "class").select("id", "grp", "sign").distinct()
    # An id that reaches a count from two groups may have all of it, from one group all but that group's.
    per = reached.groupBy("id", "sign").agg(F.count("*").alias("groups"), F.first("grp").alias("grp"))
    whole = sizes.groupBy("sign").agg(F.sum("n").alias("whole"))
    mine = sizes.select(F.col("sign").alias("s"), F.col("grp").alias("g"), "n")
    rows = per.join(whole, "sign").join(mine, (F.col("sign") == F.col("s")) & F.col("grp").eqNullSafe(F.col("g")), "left")
    share = F.col("whole") - F.when(F.col("groups") == 1, F.coalesce("n", F.lit(0))).otherwise(0)
    found = rows.groupBy("id").agg(F.sum(share).alias("found"))
    return asked.where("id IS NOT NULL").select("id").distinct().join(found, "id", "left").select("id", F.coalesce("found", F.lit(0)).alias("found"))


def components(links: DataFrame, rounds: int = 40) -> DataFrame:
    """(d1, d2, root): the smallest class of the connected component of each linked class.

    Alternates large-star and small-star steps; every round is written to the shared folder and
    only its changed-row count reaches the driver. ``rounds`` is a guard: star contraction needs
    about the logarithm of the longest chain, and not converging is an error, never a cut."""
    name = lambda x: F.struct(F.col(f"{x}1").alias("d1"), F.col(f"{x}2").alias("d2"))
    edges = stage(links.select(name("a").alias("u"), name("b").alias("v")).distinct(), "components")
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u")
        fresh = small.select("u", F.col("m").alias("v")).union(small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        fresh = stage(fresh.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "components")
        same = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        changed = fresh.exceptAll(same).limit(1).count() + same.exceptAll(fresh).limit(1).count()
        edges = fresh
        if not changed:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    stars = edges.select("u", F.col("v").alias("root"))
    roots = stars.select(F.col("root").alias("u"), "root").distinct()
    return stars.union(roots).groupBy("u").agg(F.min("root").alias("root")).select("u.d1", "u.d2", "root")
