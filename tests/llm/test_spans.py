import datetime as dt
import random

import pyarrow as pa
import pytest

from lexmill.llm import spans as S

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "key string, grp string, at timestamp_ntz, text string"


def longest(a, b):
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0] + [row[j] + 1 if x == y else 0 for j, y in enumerate(b)]
        best = max(best, max(row))
    return best


def covered(plain, least=140):
    """Characters of each text in windows that another record has, by brute force."""
    owners = {}
    for k, t in plain.items():
        for i in range(len(t) - least + 1):
            owners.setdefault(t[i : i + least], set()).add(k)
    out = {}
    for k, t in plain.items():
        mine = set()
        for i in range(len(t) - least + 1):
            if len(owners[t[i : i + least]]) > 1:
                mine.update(range(i, i + least))
        out[k] = len(mine)
    return out


@pytest.mark.parametrize("hot", [512, 1])
def test_pairs_and_shares_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(S, "HOT", hot)
    random.seed(7)
    word = lambda: "".join(random.choices("abcdefgh", k=random.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    pool = [prose(40) for _ in range(6)]
    rows = []
    for i in range(40):
        base = random.choice(pool)
        a = random.randrange(0, 60)
        n = random.choice([60, 120, 139, 140, 141, 160, 200])
        rows.append((f"r{i:02d}", f"g{i % 11}" if i % 3 else None, T0, prose(6) + "#" + base[a : a + n] + "#" + prose(5)))
    rows += [("s1", None, T0, "same  text\n" * 20), ("s2", None, T0, "same text " * 20), ("s3", "g", T0, "tiny"), ("nil", None, T0, None), ("blank", None, T0, "")]
    df = spark.createDataFrame([*rows, rows[0]], SCHEMA).selectExpr("*", "0 AS digest", "'z' AS t1")
    members, spans = S.shared_spans(df)
    got = {tuple(r) for r in S.shared_pairs(members, spans).distinct().collect()}
    plain = {k: (g, S.squeeze(t)) for k, g, _, t in rows if t is not None}
    keys = sorted(plain)
    want = {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if not (plain[a][0] and plain[a][0] == plain[b][0]) and longest(plain[a][1], plain[b][1]) >= 140}
    assert got == want
    monkeypatch.setattr(S, "SHARE_HOT", hot)
    share = {r["key"]: r["shared_chars"] for r in S.shared_share(df).collect()}
    assert share == covered({k: t for k, (_, t) in plain.items()})


def test_partners_are_counted_by_text(spark):
    span = "a clause of some length that is repeated elsewhere word for word, " * 3
    rows = [("q1", None, T0, span), ("q2", None, T0, "other"), ("q3", None, T0, "x " + span)] + [(f"c{i}", None, T0, span if i < 5 else f"{i} " + span) for i in range(8)]
    members, spans = S.shared_spans(spark.createDataFrame(rows, SCHEMA))
    got = S.partners(members.where("key LIKE 'q%'"), members.where("key LIKE 'c%'"), spans)
    assert {r["key"]: r["partners"] for r in got.collect()} == {"q1": 8, "q3": 8}


def test_insertions_move_no_distant_cut():
    random.seed(3)
    text = "".join(random.choices("abcdefghij klmno", k=3000))
    owner, start, _, digest = S.chunk_digests([text, text[:1000] + "INSERTED" + text[1000:]])
    a, b = ({(int(s), int(d)) for o, s, d in zip(owner, start, digest) if o == k} for k in (0, 1))
    far = {(s, d) for s, d in a if s < 900} | {(s + 8, d) for s, d in a if s > 1030}
    assert len(far) > 100 and far <= b


def test_chunks_do_not_depend_on_the_batch():
    random.seed(8)
    one = ["".join(random.choices("abcdef ", k=n)) for n in (10, 500, 0, 800)]
    owner, start, _, digest = S.chunk_digests(one)
    for i, t in enumerate(one):
        _, s, _, d = S.chunk_digests([t])
        assert list(s) == list(start[owner == i]) and list(d) == list(digest[owner == i])


def test_superseded_and_empty(spark):
    text = "a clause of some length that is repeated elsewhere word for word, " * 4
    rows = [("a", None, T0, text), ("a", None, T0 + dt.timedelta(1), "other"), ("b", None, T0, "x" + text)]
    members, spans = S.shared_spans(spark.createDataFrame(rows, SCHEMA))
    assert S.shared_pairs(members, spans).count() == 0
    members, spans = S.shared_spans(spark.createDataFrame([], SCHEMA))
    assert S.shared_pairs(members, spans).count() == 0


def test_repetitions(spark):
    random.seed(5)
    prose = lambda n: "".join(random.choices("abcdefgh ", k=n))
    tail = prose(70)
    texts = {
        "dash1": prose(50) + "-" * 150 + prose(60), "dash2": prose(40) + "-" * 400 + prose(70), "dash3": prose(90) + "-" * 120 + prose(30),
        "two": prose(20) + "-" * 100 + prose(60) + "-" * 145 + prose(20), "pair1": prose(33) + "+=" * 80 + prose(44), "pair2": "+=" * 90 + prose(20),
        "end1": prose(30) + "." * 90 + tail, "end2": prose(60) + "." * 130 + tail, "long": "_" * 30_000, "long2": "x" + "_" * 30_001,
    }
    df = spark.createDataFrame([(k, None, T0, t) for k, t in texts.items()], SCHEMA)
    got = {tuple(r) for r in S.shared_pairs(*S.shared_spans(df)).distinct().collect()}
    keys = sorted(texts)
    plain = {k: S.squeeze(t) for k, t in texts.items()}
    want = {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if {a, b} == {"long", "long2"} or not {a, b} & {"long", "long2"} and longest(plain[a], plain[b]) >= 140}
    assert got == want
    assert len(S.chunk_digests([plain["long"]])[0]) <= S.REACH + 10


def test_a_stock_phrase_in_many_texts_is_no_pair(spark):
    random.seed(6)
    prose = lambda n: "".join(random.choices("abcdefgh ", k=n))
    phrase = prose(110)
    rows = [(f"r{i:03d}", None, T0, "x" + prose(60) + "#" + phrase + "#" + prose(60)) for i in range(600)]
    rows += [("s1", None, T0, prose(30) + "##" + phrase + "##" + "tail of some length that both have"), ("s2", None, T0, prose(50) + "##" + phrase + "##" + "tail of some length that both have")]
    members, spans = S.shared_spans(spark.createDataFrame(rows, SCHEMA))
    assert [tuple(r) for r in S.shared_pairs(members, spans).distinct().collect()] == [("s1", "s2")]


@pytest.mark.parametrize("n", [511, 512, 513])
def test_results_are_the_same_on_both_sides_of_the_bound(spark, n):
    random.seed(n)
    prose = lambda k: "".join(random.choices("abcdefgh ", k=k))
    phrase, longer = prose(120), prose(30)
    plain = {f"r{i:03d}": "x" + prose(40) + "#" + phrase + "#" + prose(40) + "x" for i in range(n - 4)}
    plain |= {f"s{i}": "x" + prose(40) + "#" + phrase + longer + "#" + prose(40) + "x" for i in range(4)}
    df = spark.createDataFrame([(k, None, T0, t) for k, t in plain.items()], SCHEMA)
    got = {tuple(r) for r in S.shared_pairs(*S.shared_spans(df)).distinct().collect()}
    assert got == {(f"s{i}", f"s{j}") for i in range(4) for j in range(i + 1, 4)}
    assert {r["key"]: r["shared_chars"] for r in S.shared_share(df).collect()} == covered({k: S.squeeze(t) for k, t in plain.items()})


def test_repetitions_are_covered_whole(spark, monkeypatch):
    monkeypatch.setattr(S, "SHARE_HOT", 1)
    random.seed(4)
    prose = lambda k: "".join(random.choices("abcdefgh ", k=k)).strip()
    plain = {"a": "s" + prose(30) + "-" * 700 + prose(30), "b": "s" + prose(50) + "-" * 900 + prose(20), "c": "s" + prose(200), "d": "+=" * 150 + prose(9), "e": prose(9) + "+=" * 100}
    df = spark.createDataFrame([(k, None, T0, t) for k, t in plain.items()], SCHEMA)
    assert {r["key"]: r["shared_chars"] for r in S.shared_share(df).collect()} == covered({k: S.squeeze(t) for k, t in plain.items()})


def test_one_boilerplate_in_many_texts_costs_rows_in_proportion(spark, monkeypatch):
    """Twenty thousand texts with one phrase: shares are told from windows, and no two texts are paired."""
    n, rows = 20_000, []
    random.seed(1)
    phrase = "".join(random.choices("abcdefgh ", k=160)).strip()
    sizes, keep = {}, S.stage

    def spy(df, name):
        table = keep(df, name)
        sizes[name] = table.count()
        return table

    monkeypatch.setattr(S, "stage", spy)
    rows = [(f"r{i}", None, T0, f"{i * 7919 % 104729:06d} start of it # {phrase} # end of it {i * 104729 % 7919:06d}") for i in range(n)]
    got = S.shared_share(spark.createDataFrame(rows, SCHEMA)).groupBy("shared_chars").count().collect()
    assert all(r["shared_chars"] >= len(phrase) for r in got) and sum(r["count"] for r in got) == n
    assert sizes["spans-anchors"] == 0 and sizes["spans-wide"] <= 400 * n


def test_a_task_works_on_bounded_pieces_of_a_batch(monkeypatch):
    """However many texts a batch of records has, what is held at once is bounded and the chunks and windows are the same."""
    random.seed(8)
    texts = {i: "".join(random.choices("abcdef ghij", k=random.randint(0, 600))) for i in range(200)} | {900: "xyz " * 1500}
    batch = pa.RecordBatch.from_arrays([pa.array(list(texts)), pa.array([[len(t) // 2] for t in texts.values()], pa.list_(pa.int32())), pa.array(list(texts.values()))], names=["t1", "starts", "text"])
    whole, windows = list(S._cut(texts)), list(S._windows(iter([batch]), 140))
    assert len(whole) == len(windows) == 1
    monkeypatch.setattr(S, "CHARS", 2000)
    monkeypatch.setattr(S, "ROWS", 500)
    seen = []
    digests = S.chunk_digests
    monkeypatch.setattr(S, "chunk_digests", lambda t: (seen.append(t), digests(t))[1])
    parts, some = list(S._cut(texts)), list(S._windows(iter([batch]), 140))
    assert sum(map(len, seen)) == len(texts) and all(sum(map(len, t)) <= 2000 or len(t) == 1 for t in seen)
    plain = lambda bs: [(d, t, p >> 32) for b in bs for d, t, p in zip(*(c.to_pylist() for c in b.columns))]
    assert plain(parts) == plain(whole)
    assert max(map(len, some)) < 500 + 140 and pa.Table.from_batches(some).to_pylist() == pa.Table.from_batches(windows).to_pylist()
