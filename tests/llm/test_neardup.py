import datetime as dt
import random

import pytest

from lexmill.llm import neardup as N

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "key string, grp string, at timestamp_ntz, text string"


def grams(text, n=3):
    w = N._WORD.findall((text or "").lower())
    return set(zip(*(w[i:] for i in range(n))))


def corpus(families=25, seed=4):
    random.seed(seed)
    rows = []
    for f in range(families):
        base = [f"w{random.randrange(4000)}" for _ in range(60)]
        for v in range(4):
            words = list(base)
            for _ in range(v * 3):
                words[random.randrange(60)] = f"x{random.randrange(4000)}"
            rows.append((f"{f}-{v}", f"doc{(f + v) % 9}", T0, " ".join(words)))
    return rows


def brute(rows, similarity):
    sets = {k: (g, grams(t)) for k, g, _, t in rows}
    keys = sorted(sets)
    return {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if sets[a][0] != sets[b][0] and sets[a][1] | sets[b][1] and len(sets[a][1] & sets[b][1]) >= similarity * len(sets[a][1] | sets[b][1])}


def pairs(members, links):
    return {tuple(r) for r in N.linked_keys(members, links).collect()}


@pytest.mark.parametrize("block", [2, 1024])
def test_pairs_against_brute_force(spark, monkeypatch, block):
    rows = corpus() + [("same-1", "doc1", T0, "one two three four"), ("same-2", "doc2", T0, "One, two; THREE four!"), ("same-3", "doc1", T0, "one two three four"), ("short", "doc3", T0, "one two"), ("blank", "doc4", T0, ""), ("nil", "doc4", T0, None)]
    monkeypatch.setattr(N._candidates, "__defaults__", (block,))
    df = spark.createDataFrame([*rows, rows[0], (None, "d", T0, rows[0][3])], SCHEMA).selectExpr("*", "1 AS d1", "'x' AS keys")
    members, links = N.near_duplicates(df, "key", "grp", "at")
    assert pairs(members, links) == brute(rows, 0.6)


def test_superseded_texts_have_no_links(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [("a", "1", T0, text), ("a", "1", T0 + dt.timedelta(1), "quite another text here"), ("b", "2", T0, text + " more")]
    assert pairs(*N.near_duplicates(spark.createDataFrame(rows, SCHEMA), "key", "grp", "at")) == set()


def test_superseded_texts_are_in_no_group(spark, tmp_path):
    from lexmill.llm import queries

    words = [f"w{i}" for i in range(60)]
    text = lambda i, j: " ".join(words[i:j])
    rows = [
        ("own", "1", T0, text(0, 40)), ("own", "1", T0 + dt.timedelta(1), text(0, 40) + " more"),  # alike to its own old version only
        ("p", "2", T0, " ".join(f"p{i}" for i in range(40))), ("q", "3", T0, " ".join(f"p{i}" for i in range(16, 56))),  # 22 of 54 in common
        ("bridge", "4", T0, " ".join(f"p{i}" for i in range(8, 48))), ("bridge", "4", T0 + dt.timedelta(1), "quite another text here"),
        ("x", "5", T0, " ".join(f"x{i}" for i in range(40))), ("y", "6", T0, " ".join(f"x{i}" for i in range(41))),
        ("emptied", "7", T0, " ".join(f"x{i}" for i in range(39))), ("emptied", "7", T0 + dt.timedelta(1), ""),
        ("nulled", "8", T0, " ".join(f"x{i}" for i in range(39))), ("nulled", "8", T0 + dt.timedelta(1), None),
    ]
    spark.createDataFrame(rows, "chunk_id string, doc_id string, made_at timestamp_ntz, text string").write.parquet(str(tmp_path / "chunks.parquet"))
    got = sorted(map(tuple, queries.p2_groups(spark, str(tmp_path)).select("chunk_id", "group_id", "n_links").collect()))
    assert got == [("x", "x", 1), ("y", "x", 1)]
    assert [tuple(r) for r in queries.p2_found(spark, str(tmp_path)).collect()] == [("x", "y")]


def test_empty_table(spark):
    members, links = N.near_duplicates(spark.createDataFrame([], SCHEMA), "key", "grp", "at")
    assert pairs(members, links) == set() and N.components(links).count() == 0


def test_components_against_union_find(spark):
    random.seed(9)
    nodes = [(random.randrange(-99, 99), i) for i in range(60)]
    edges = [(*random.choice(nodes), *random.choice(nodes)) for _ in range(45)] + [(*nodes[i], *nodes[i + 1]) for i in range(0, 12)]
    edges = [e for e in edges if e[:2] != e[2:]]
    root = {n: n for e in edges for n in (e[:2], e[2:])}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for e in edges:
        a, b = sorted((find(e[:2]), find(e[2:])))
        root[b] = a
    got = {(r["d1"], r["d2"]): tuple(r["root"]) for r in N.components(spark.createDataFrame(edges, "a1 long, a2 long, b1 long, b2 long")).collect()}
    assert got == {n: find(n) for n in root}


def test_tree_finds_all_within_the_radius():
    random.seed(1)
    prints = [random.getrandbits(64) & random.getrandbits(64) for _ in range(300)]
    tree = N.BKTree()
    for i, p in enumerate(prints):
        tree.add(p, i)
    for q in prints[:20]:
        assert sorted(tree.within(q, 18)) == [i for i, p in enumerate(prints) if (p ^ q).bit_count() <= 18]


def test_digest_does_not_depend_on_order_or_batch():
    words = N._WordHashes()
    a = N.sketches(["x", "a b c d", None, "a b c d e f a b c"], 3, words)
    b = N.sketches(["a b c d e f a b c", "a b c d"], 3, words)
    assert list(a["i"]) == [1, 3] and list(a["d1"]) == list(b["d1"])[::-1] and list(a["fp"]) == list(b["fp"])[::-1] and list(a["size"]) == [2, 6]


def test_a_large_shard_is_divided_and_loses_no_pair(spark):
    """Forty thousand classes with one key: rows stay in proportion, and pairs alike are found."""
    n, near = 40_000, 300
    random.seed(3)
    rows = []
    for i in range(n):
        hashes = [random.getrandbits(31) - (1 << 30) for _ in range(N.WAYS)]
        rows.append((i, random.getrandbits(63), hashes))
    for i in range(near):  # alike: few bits and, of the 24 ways, some equal
        _, fp, hashes = rows[i]
        for b in random.sample(range(63), 12):
            fp ^= 1 << b
        rows.append((n + i, fp, [h if random.random() < 0.36 else random.getrandbits(31) - (1 << 30) for h in hashes]))
    df = spark.createDataFrame([(i, fp, [7], finer) for i, fp, finer in rows], "d1 long, fp long, keys array<long>, finer array<int>")
    got = {tuple(r) for r in N._candidates(df, N.search_radius(0.6)).collect()}
    want = {(i, n + i) for i in range(near)}
    assert len(want - got) <= 1 and len(got) < 10 * near


def test_sections_alike_are_counted_without_pairs(spark):
    rows = corpus(12, 5) + [(f"c{i}-0", f"doc{i % 9}", T0, "one two three four five") for i in range(30)] + [("nogrp-0", None, T0, "one two three four five")]
    members, links = N.near_duplicates(spark.createDataFrame(rows, SCHEMA), "key", "grp", "at")
    members = members.withColumn("section", members["key"].substr(1, 2))
    text = {k: (g, grams(t)) for k, g, _, t in rows}
    ids = {"a": ["c1"], "b": ["0-", "c2", "3-"], "none": ["zz"], "c": ["no"]}
    want = {}
    for name, sections in ids.items():
        found = set()
        for k, (g, s) in text.items():
            if k[:2] in sections:
                found |= {(o[:2], h) for o, (h, t) in text.items() if h != g and len(s & t) >= 0.6 * len(s | t)}
        want[name] = len(found)
    asked = spark.createDataFrame([(i, s) for i, ss in ids.items() for s in ss], "id string, section string")
    assert {r["id"]: r["found"] for r in N.alike_sections(members, links, asked).collect()} == want
