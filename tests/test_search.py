import math
import random

import pytest
from pyspark.sql import functions as F

from lexmill.operators import context, fusion, lexical, metrics, selection, vector


def ranked(spark, arms):
    return spark.createDataFrame([("q", u, i + 1) for i, u in enumerate(arms)], "query_id string, uid string, rank int")


def order(df, column="uid"):
    return [r[column] for r in df.orderBy("rank").collect()]


def test_bm25_against_brute_force(spark):
    random.seed(5)
    words = ["bank", "duty", "keep", "fund", "risk", "record"]
    units = {f"u{i:02d}": random.choices(words, k=random.randint(0, 12)) for i in range(40)}
    asked = {"q1": ["bank", "duty", "bank"], "q2": ["risk", "absent"], "q3": []}
    n, mean = len(units), sum(map(len, units.values())) / len(units)
    want = {}
    for q, terms in asked.items():
        for u, held in units.items():
            s = 0.0
            for t in sorted(set(terms)):
                df, tf = sum(t in x for x in units.values()), held.count(t)
                if tf:
                    s += math.log((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(held) / mean))
            if s:
                want[q, u] = round(s, 9)
    rows = spark.createDataFrame([*units.items(), (None, ["bank"]), ("nil", None)], "uid string, terms array<string>").withColumn("score", F.lit("clash"))
    got = lexical.bm25(rows.drop("score"), spark.createDataFrame(list(asked.items()), "query_id string, terms array<string>"), 100)
    assert {(r["query_id"], r["uid"]): r["score"] for r in got.collect()} == pytest.approx(want)
    top = order(got.where("query_id = 'q1' AND rank <= 5"))
    assert top == [u for _, u in sorted((-s, u) for (q, u), s in want.items() if q == "q1")][:5]


def test_near_ties_are_broken_by_identifier(spark):
    rows = [("q", u, 1.0 + 1e-12 * i) for i, u in enumerate("edcba")]
    got = lexical.top_k(spark.createDataFrame(rows, "query_id string, uid string, score double"), 3)
    assert order(got) == ["a", "b", "c"]


def test_reciprocal_ranks(spark):
    got = fusion.reciprocal_ranks([ranked(spark, "abc"), ranked(spark, "dab")], 10)
    assert order(got) == ["a", "b", "d", "c"]
    assert {r["uid"]: r["score"] for r in got.collect()} == pytest.approx({"a": 1 / 61 + 1 / 62, "b": 1 / 62 + 1 / 63, "d": 1 / 61, "c": 1 / 63}, abs=1e-9)


def test_rerank_keeps_the_tail_below(spark):
    rows = ranked(spark, "abcd").withColumn("score", F.lit(9.0)).withColumn("s", F.expr("CASE uid WHEN 'a' THEN 0.0 WHEN 'b' THEN 1.0 ELSE 5.0 END"))
    got = fusion.rerank(rows, F.col("s"), 4, top_n=2)
    assert order(got) == ["b", "a", "c", "d"]


def test_decomposition(spark):
    parts = spark.createDataFrame([("q", p, u, i + 1) for p, us in enumerate(["ax", "ay", "ba"]) for i, u in enumerate(us)], "query_id string, part int, uid string, rank int")
    assert order(fusion.fuse_parts(parts, 5))[0] == "a"
    rows = fusion.sub_questions(spark.createDataFrame([("q", "Who keeps the long records and who reviews the long records?"), ("n", None)], "query_id string, text string")).collect()
    assert [r["part"] for r in rows] == [0, 1, 2] and rows[1]["text"] == "Who keeps the long records"


@pytest.mark.parametrize("hits, gold, want", [
    ("abc", "a", {"hit_1": 1, "recall_5": 1, "full_5": 1, "mrr": 1, "ndcg_10": 1}),
    ("xab", "ab", {"hit_1": 0, "hit_5": 1, "recall_5": 1, "full_5": 1, "mrr": 0.5, "ndcg_10": (1 / math.log2(3) + 0.5) / (1 + 1 / math.log2(3))}),
    ("xyz", "ab", {"hit_5": 0, "recall_5": 0, "full_5": 0, "mrr": 0, "ndcg_10": 0}),
    ("aab", "ab", {"recall_5": 1, "mrr": 1, "ndcg_10": (1 + 0.5) / (1 + 1 / math.log2(3))}),
    ("abc", "", {"hit_5": 0, "full_5": 0, "recall_20": 0, "ndcg_10": 0}),
])
def test_metrics(spark, hits, gold, want):
    queries = spark.createDataFrame([("c", "q")], "config string, query_id string")
    g = spark.createDataFrame([("q", u) for u in gold] or [("other", "a")], "query_id string, uid string")
    row = metrics.ranking_metrics(ranked(spark, hits).withColumn("config", F.lit("c")), queries, g).first().asDict()
    assert {k: row[k] for k in want} == pytest.approx(want)


def test_displacement(spark):
    gold = spark.createDataFrame([("q", "a")], "query_id string, uid string")
    row = metrics.displacement(ranked(spark, "xa"), ranked(spark, "a"), gold).first()
    assert (row["first_before"], row["first_after"], row["move"]) == (2, 1, "promoted")


def brute_context(hits, budget, share, top):
    """The rule told backwards: try every number of excerpts and keep the longest that is allowed."""
    hits = hits[:top]

    def block(i, left):
        uid, label, text = hits[i]
        title = f"[{i + 1}] {label} ({uid})\n"
        space = min(int(budget * share), left - len(title))
        words = text.split()
        whole = " ".join(words)
        if len(whole) > space > 200:
            clipped = whole[:space]
            whole = (clipped[: clipped.rindex(" ")] if " " in clipped else clipped) + context.CUT
        return (title + whole) if space > 200 else None

    def build(i, left):
        first = block(i, left) if i < len(hits) else None
        return [first, *build(i + 1, left - len(first) - 2)] if first else []

    made = build(0, budget)
    return "\n\n".join(made), [h[0] for h in hits[: len(made)]], sum(m.endswith(context.CUT) for m in made), len(hits) - len(made)


@pytest.mark.parametrize("lengths", [[10, 20], [5000, 30, 30], [900, 900, 900, 900], [450, 450, 450, 450, 450, 450]])
def test_context_against_brute_force(spark, lengths):
    hits = [(f"u{i}", f"label {i}", ("word%d  " % i) * (n // 7 + 1)) for i, n in enumerate(lengths)]
    texts = spark.createDataFrame([*hits, ("null", "x", None)], "uid string, label string, text string")
    row = context.assemble(ranked(spark, [h[0] for h in hits]), texts, budget=2000).first()
    want = brute_context(hits, 2000, 0.4, 5)
    assert (row["text"], row["cited"], row["truncated"], row["dropped"]) == want


def test_dense_search_in_blocks_equals_brute_force(spark, monkeypatch):
    random.seed(2)
    rows = [(i, i % 7, [random.gauss(0, 1) for _ in range(8)]) for i in range(60)] + [(100, 1, None), (101, 1, [0.0] * 8), (102, 2, [1.0])]
    df = spark.createDataFrame(rows, "uid long, grp int, vec array<double>")
    queries = df.where("uid % 20 = 0 AND uid < 100").withColumnRenamed("uid", "query_id")
    monkeypatch.setattr(vector, "BLOCK", 1)
    monkeypatch.setattr(vector, "PART", 13)

    def d(a, b):
        return 1 - sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))

    full = [r for r in rows if r[2] and len(r[2]) == 8 and any(r[2])]
    for roll_up in (False, True):
        got = {(r["query_id"], r["rank"]): r["uid"] for r in vector.dense_top(df, queries, 4, roll_up).collect()}
        for q in rows[:60:20]:
            best = {}
            for u, g, v in full:
                key = g if roll_up else u
                best[key] = min(best.get(key, 9), round(d(q[2], v), 9))
            want = [k for _, k in sorted((v, k) for k, v in best.items())][:4]
            assert [got[q[0], i + 1] for i in range(4)] == want
    near = {r["query_id"]: r["near"] for r in vector.near_groups(df, queries, 0.8, 50).collect()}
    for q in rows[:60:20]:
        assert near[q[0]] == len({g for u, g, v in full if g != q[1] and round(d(q[2], v), 9) <= 0.8})


def test_indexed_search_against_the_exact_one(spark):
    """Vectors with structure: few cells hold nearly all neighbours; every row is in a cell."""
    import numpy as np

    from lexmill.operators import vector

    rng = np.random.default_rng(7)
    centres = rng.normal(size=(40, 16))
    rows = [(i, i % 40, (centres[i % 40] + 0.25 * rng.normal(size=16)).tolist()) for i in range(3000)]
    rows += [(9001, 1, None), (9002, 1, []), (9003, 1, [0.0] * 16), (9004, 1, [1.0])]
    corpus = spark.createDataFrame(rows, "uid long, grp int, vec array<double>").repartition(4)
    queries = corpus.where("uid % 20 = 0").withColumnRenamed("uid", "query_id")
    exact = {tuple(r) for r in vector.dense_top(corpus, queries, 10, roll_up=False).select("query_id", "uid").collect()}
    found = {tuple(r) for r in vector.dense_top(corpus, queries, 10, roll_up=False, index=(40, 4)).select("query_id", "uid").collect()}
    assert len(exact) == 1500 and len(exact & found) >= 0.9 * len(exact)
    whole = {tuple(r) for r in vector.dense_top(corpus, queries, 10, roll_up=False, index=(40, 40)).select("query_id", "uid").collect()}
    assert whole == exact
    grouped = vector.dense_top(corpus, queries, 3, roll_up=True).collect()
    assert grouped == vector.dense_top(corpus, queries, 3, roll_up=True, index=(40, 40)).collect()
    assert vector.dense_top(corpus.limit(0), queries, 3, roll_up=False, index=(4, 1)).count() == 0


def test_bm25_picks_the_newest_row(spark):
    import datetime as dt

    from lexmill.operators import lexical

    t0, t1 = dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1)
    rows = [("a", ["red", "fox"], t0), ("a", ["blue", "fox", "fox"], t1), ("a", ["blue", "fox", "fox"], t1), ("b", ["red", "red"], t0), ("c", None, t0), (None, ["red"], t0), ("d", [], t0), ("e", ["fox"], None)]
    units = spark.createDataFrame(rows, "uid string, terms array<string>, made_at timestamp_ntz")
    asked = spark.createDataFrame([("q", ["red", "fox", "fox"]), ("r", ["blue"]), ("n", None), ("z", [])], "query_id string, terms array<string>")
    live = spark.createDataFrame([("a", ["blue", "fox", "fox"]), ("b", ["red", "red"]), ("d", []), ("e", ["fox"])], "uid string, terms array<string>")
    want = sorted(map(tuple, lexical.bm25(live, asked, 9).collect()))
    assert sorted(map(tuple, lexical.bm25(units, asked, 9, at="made_at").collect())) == want and len(want) == 4


def test_running_sums_in_slices(spark):
    import random

    from pyspark.sql import functions as F

    from lexmill.operators.ordered import in_slices, running

    random.seed(1)
    rows = [(random.choice("aaaaab"), i, random.choice([1.0, 2.5, None]), random.choice([None, None, f"v{i}"])) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, i int, x double, v string").repartition(5)
    got = {r["i"]: (r["total"], r["last"]) for r in running(in_slices(df, ["k"], ["i"], "t"), ["k"], ["i"], {"total": F.col("x")}, {"last": F.col("v")}).collect()}
    for key in "ab":
        total, last = 0.0, None
        for k, i, x, v in rows:
            if k == key:
                total, last = total + (x or 0.0), v or last
                assert got[i] == (total, last)
    assert running(in_slices(df.limit(0), ["k"], ["i"], "t"), ["k"], ["i"], {"total": F.col("x")}).count() == 0


@pytest.mark.parametrize("width", [1, 2])
def test_bm25_passes_on_no_more_than_the_best_of_each_task(spark, monkeypatch, width):
    """What a search writes to disk follows the units and the wanted hits, not queries times units."""
    from lexmill.functions import text as T

    random.seed(3)
    words = ["Duty", "records", "a", "of", "bank", "SHALL", "keep", "Kept", "café", "x1y", "fund\nrisk"]
    texts = {f"u{i:03d}": " ".join(random.choices(words, k=random.randint(0, 30))) for i in range(300)}
    units = spark.createDataFrame([*texts.items(), ("nil", None)], "uid string, text string").repartition(3)
    asked = spark.createDataFrame([(f"q{i}", " ".join(random.choices(words, k=8))) for i in range(40)], "query_id string, text string")
    terms = T.tokens if width == 1 else T.bigrams
    asked = asked.select("query_id", terms("text").alias("terms")).localCheckpoint()
    held = {r["uid"]: r["t"] for r in units.where("text IS NOT NULL").select("uid", terms("text").alias("t")).collect()}
    mean, df = sum(map(len, held.values())) / len(held), {}
    for t in held.values():
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    want = []
    for q, wanted in asked.collect():
        scores = []
        for u, t in held.items():
            idf = {x: math.log((len(held) - df[x] + 0.5) / (df[x] + 0.5) + 1) for x in set(wanted) & set(t)}
            if idf:
                scores.append((-round(sum(v * t.count(x) * 2.2 / (t.count(x) + 1.2 * (0.25 + 0.75 * len(t) / mean)) for x, v in idf.items()), 9), u))
        want += [(q, u, -s, i + 1) for i, (s, u) in enumerate(sorted(scores)[:5])]
    tasks = []
    best = lexical._best
    monkeypatch.setattr(lexical, "_best", lambda *a: (lambda out: (tasks.append((a[0].rdd.getNumPartitions(), out.count())), out)[1])(best(*a)))
    monkeypatch.setattr(lexical, "SCORES", 400)
    rows = units.select("uid", F.lower("text").alias("terms"))
    got = sorted(map(tuple, lexical.bm25(rows, asked, 5, width=width).collect()))
    assert [g[:2] + g[3:] for g in got] == sorted(w[:2] + w[3:] for w in want)
    assert [g[2] for g in got] == pytest.approx([w[2] for w in sorted(want)], abs=2e-9)
    assert len(tasks) == 1 and tasks[0][1] <= tasks[0][0] * 40 * 5
    # In several rounds of queries the same comes out.
    monkeypatch.setattr(lexical, "PAIRS", 30)
    assert sorted(map(tuple, lexical.bm25(rows, asked, 5, width=width).collect())) == got and len(tasks) > 2
    assert lexical.bm25(rows, asked.limit(0), 5, width=width).count() == 0
    assert lexical.bm25(rows.limit(0), asked, 5, width=width).count() == 0


def searched(spark, folder, sections=1500, asked=40):
    """Tables in which every section shares words and word pairs with every question."""
    import datetime as dt

    at = dt.datetime(2024, 1, 1)
    random.seed(8)
    words = ["capital", "record", "keeper", "retain", "notice", "review"]
    text = lambda n: " ".join(["shall keep", *random.choices(words, k=n)])
    rows = [(f"d{i % 50}:{i // 50}", f"d{i % 50}", f"{i // 50}", "Records", i, text(random.randint(3, 9)), at) for i in range(sections)]
    spark.createDataFrame(rows, "section_uid string, doc_id string, section_path string, heading string, ordinal int, text string, made_at timestamp_ntz").repartition(4).write.parquet(f"{folder}/sections.parquet")
    spark.createDataFrame([(f"{r[0]}#0", r[0], 0, at) for r in rows], "chunk_id string, section_uid string, ordinal int, made_at timestamp_ntz").write.parquet(f"{folder}/chunks.parquet")
    items = [(f"gs-{i * 20:07d}", f"Who {r[5]} and who {text(3)}?", "a", "factual", [(r[1], r[2])], "ready", at) for i, r in enumerate(random.sample(rows, asked))]
    spark.createDataFrame(items, "id string, question string, answer string, query_type string, gold_spans array<struct<doc_id string, section_path string>>, status string, built_at timestamp_ntz").write.parquet(f"{folder}/items.parquet")


def shuffled(spark):
    """Bytes that this session's tasks have written to shuffles so far."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


@pytest.mark.parametrize("name", ["ranking_metrics", "saturation_gate", "sweep_aggregate", "bm25_chunk_units", "decomposed_rrf", "documents_of_hits", "rerank_window", "hybrid_rrf", "switch_verdicts", "context_budget", "displacement_tally", "negative_excerpts"])
def test_what_a_search_shuffles_does_not_follow_queries_times_sections(spark, tmp_path, name):
    """60,000 pairs of a question and a section share a word; scores of all of them would be some megabytes."""
    import __spark_entry__ as entry

    searched(spark, str(tmp_path))
    before = shuffled(spark)
    assert entry.queries()[name](spark, str(tmp_path)).collect()
    assert shuffled(spark) - before < 380_000


@pytest.mark.parametrize(("pairs", "meetings"), [(500_000, 1 << 20), (3, 5)])
def test_topical_units_against_brute_force(spark, monkeypatch, pairs, meetings):
    """Superseded rows, units without document, text or ordinal, words within longer ones, and ties; in one block and round, and in many."""
    monkeypatch.setattr(lexical, "PAIRS", pairs)
    monkeypatch.setattr(selection, "MEETINGS", meetings)
    random.seed(9)
    words = ["capital", "record", "keeper", "notice", "review"]
    kinds = [*words, "RECORDED", "bookkeepers", "re-view", "capi", "tal", "2notices"]
    rows = []
    for i in range(150):
        doc = random.choice(["long", "long", "long", "a", "b", None])
        for at in range(random.randint(1, 2)):
            text = random.choice([None, *[" ".join(random.choices([*kinds, "shall", "must"], k=random.randint(0, 12))) for _ in range(9)]])
            rows.append((f"u{i:03d}", at, doc, random.choice([None, *range(-2, 30)]), text))
    asked = {f"q{i}": random.sample(words, k=random.randint(0, 5)) for i in range(12)}
    ranked = [(q, f"u{u:03d}", i + 1) for q in asked for i, u in enumerate(random.sample(range(150), 4))]
    live = {r[0]: r for r in rows}  # the later row of a unit is the newer one
    want = set()
    for q, of in asked.items():
        hits = {u: rank for x, u, rank in ranked if x == q}
        for doc in {live[u][2] for u in hits}:
            found = [(0, hits[u], 0, u) for u in hits if live[u][2] == doc]
            for u, _, own, ordinal, text in live.values():
                n = sum(w in (text or "").lower() for w in of)
                if doc and own == doc and u not in hits and {"shall", "must"} & set((text or "").split()) and n >= 2:
                    found.append((1, -n, 99 if ordinal is None else ordinal, u))
            want |= {(q, doc, x[-1], i + 1) for i, x in enumerate(sorted(found)[:6])}
    units = spark.createDataFrame(rows, "uid string, at int, doc_id string, ordinal int, text string").repartition(3)
    queries = spark.createDataFrame(list(asked.items()), "query_id string, words array<string>")
    got = [tuple(r) for r in selection.topical_units(spark.createDataFrame(ranked, "query_id string, uid string, rank int"), units, queries).collect()]
    assert len(got) == len(want) > 100 and set(got) == want


def test_a_long_document_is_not_multiplied_by_the_questions_that_hit_it(spark, tmp_path):
    """Each of 40 questions finds two of its words in all 3,000 sections of one document: 120,000 rows if they were joined, which shuffled 283,245 bytes."""
    import datetime as dt

    import __spark_entry__ as entry

    at, folder = dt.datetime(2024, 1, 1), str(tmp_path)
    rows = [(f"d:{i}", "d", f"{i}", "Records", i, f"The keeper shall retain capital and case{i % 40:02d}.".replace("0", "a").replace("1", "b"), at) for i in range(3000)]
    spark.createDataFrame(rows, "section_uid string, doc_id string, section_path string, heading string, ordinal int, text string, made_at timestamp_ntz").repartition(4).write.parquet(f"{folder}/sections.parquet")
    items = [(f"gs-{i * 20:07d}", "Which keeper has capital?", "a", "factual", [("d", "0")], "ready", at) for i in range(40)]
    spark.createDataFrame(items, "id string, question string, answer string, query_type string, gold_spans array<struct<doc_id string, section_path string>>, status string, built_at timestamp_ntz").write.parquet(f"{folder}/items.parquet")
    before = shuffled(spark)
    assert entry.queries()["topical_clauses"](spark, folder).count() == 40 * 6
    assert shuffled(spark) - before < 150_000
