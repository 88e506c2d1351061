import datetime as dt
import random

from lexmill.operators import agentlog, golden, ingest
from lexmill.sources import live_rows
from pyspark.sql import functions as F

T0 = dt.datetime(2024, 1, 1)


def test_live_rows(spark):
    rows = [("a", T0, "old"), ("a", T0 + dt.timedelta(1), "new"), ("a", T0 + dt.timedelta(1), "new"), ("b", None, "only"), (None, T0, "x")]
    df = spark.createDataFrame(rows, "k string, at timestamp_ntz, v string").withColumn("__live", F.lit(1))
    assert sorted(map(tuple, live_rows(df, ["k"], "at", ["v"]).collect())) == [("a", "new"), ("b", "only")]
    assert live_rows(df.limit(0), ["k"], "at", ["v"]).count() == 0


def test_version_labels(spark):
    day = dt.date(2024, 3, 28)
    rows = [("d", "s1", T0, day), ("d", "s1", T0 + dt.timedelta(9), day), ("d", "s2", T0 + dt.timedelta(5), day), ("d", "s3", T0 + dt.timedelta(6), None), (None, "s", T0, day)]
    got = ingest.version_labels(spark.createDataFrame(rows, "doc_id string, sha256 string, fetched_at timestamp_ntz, effective_date date")).collect()
    assert {r["sha256"]: r["version_label"] for r in got} == {"s1": "2024-03-28", "s2": "2024-03-28-2", "s3": "2024-01-07"}


def test_path_dedupe_against_the_rule(spark):
    random.seed(1)
    rows = [(f"d{d}", i, random.choice(["1", "2", "3"]), random.choice([None, "A", "B"])) for d in range(20) for i in range(12)]
    got = {(r["doc_id"], r["pos"]): r["unique_path"] for r in ingest.dedupe_paths(spark.createDataFrame(rows, "doc_id string, pos int, path string, scope string")).collect()}
    seen = set()
    for d, i, path, scope in rows:
        if (d, path) not in seen:
            want = path
        elif scope and (d, f"{scope}/{path}") not in seen:
            want = f"{scope}/{path}"
        else:
            want = f"{path}#{i}"
        seen.add((d, want))
        assert got[d, i] == want


def test_sectionise(spark):
    rows = [("d", 0, "text", "front"), ("d", 1, "header", "1.2 Capital"), ("d", 2, "text", "a  duty"), ("d", 3, "furniture", "Page 3"), ("d", 4, "list", "1.3 another"), ("d", 5, "header", "Notes"), ("d", 6, "text", None)]
    got = ingest.sectionise(spark.createDataFrame(rows, "doc_id string, item int, kind string, text string")).orderBy("pos").collect()
    assert [(r["path"], r["heading"], r["text"]) for r in got] == [("0", None, "front"), ("1.2", "Capital", "a duty"), ("1.3", None, "another"), ("0", "Notes", "")]


def test_spine_and_ancestors(spark):
    rows = [(f"u{i}", "d", i, f"l{i}", p) for i, p in enumerate(["1", "1.1", "1.1.2", "2.1", "2.1.1", "3"])]
    df = spark.createDataFrame(rows, "section_uid string, doc_id string, ordinal int, label string, section_path string")
    spines = {r["section_uid"]: r["spine"] for r in ingest.spine(df).collect()}
    assert spines["u0"] == spines["u1"] == spines["u2"] == ["l0", "l1", "l2", "l3", "l4"] and spines["u5"] == ["l3", "l4", "l5"]
    up = {r["section_uid"]: (r["depth"], r["parent_uid"]) for r in ingest.ancestors(df).collect()}
    assert up == {"u0": (0, None), "u1": (1, "u0"), "u2": (2, "u1"), "u3": (0, None), "u4": (1, "u3"), "u5": (0, None)}


def test_golden_rules(spark):
    span = "array<struct<doc_id:string,section_path:string,span_sha256:string,why:string>>"
    rows = [
        ("gs-0001", "What must a bank keep?", "Records", "factual_lookup", [("d", "1", "h", "")], None),
        ("bad", "Short?", "", "multi_hop", [("d", "1", "h", "")], "why"),
        ("gs-0002", "What is not in here at all?", "No", "negative", [("d", "1", "h", "")], None),
        (None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, f"id string, question string, answer string, query_type string, gold_spans {span}, absence_reason string")
    got = [r["v"] for r in df.select(golden.violations().alias("v")).collect()]
    assert got[0] == [] and got[1] == ["id", "question", "answer", "absence_reason", "too_few_spans"] and got[2] == ["negative_with_spans", "absence_reason"]
    assert got[3] == ["id", "question", "answer", "query_type", "grounded_without_spans"]


def test_ceiling_ranked_values_and_findings(spark):
    rows = [("r", i, 1.0, 10.0 * i) for i in range(1, 8)] + [("s", 1, 1.0, None)]
    df = spark.createDataFrame(rows, "run string, seq int, one double, cost double")
    got = {r["run"]: (r["ceiling"], r["at"], r["steps"]) for r in agentlog.first_ceiling(df, "run", ["seq"], {"steps": ("one", 5), "cost": ("cost", 60.0)}).collect()}
    assert got == {"r": ("cost", 3, 7), "s": (None, None, 1)}
    random.seed(3)
    values = [random.randrange(30) for _ in range(41)]
    row = agentlog.ranked_values(spark.createDataFrame([("k", v) for v in values], "k string, v int"), ["k"], "v", {"a": 0.5, "b": 0.95, "c": 0.0}).first()
    s = sorted(values)
    assert (row["a"], row["b"], row["c"]) == tuple(s[min(40, int(q * 41))] for q in (0.5, 0.95, 0.0))
    events = spark.createDataFrame([("u", "d1", 1), ("u", "reset", 2), ("u", "d1", 3), ("u", "d2", 4), ("v", "d1", 5), ("u", "d1", 6)], "u string, d string, n int")
    assert sorted(map(tuple, agentlog.last_findings(events, "u", "d", "n", F.col("d") == "reset").collect())) == [("u", "d1", 6), ("u", "d2", 4), ("v", "d1", 5)]


def test_cited_pairs(spark):
    a, b = "0123456789abcdef", "fedcba9876543210"
    rows = [(1, f"see {a}, clause 4.2, and 7.1 of {b}"), (2, f"{a} " + "x" * 200 + " 9.9"), (3, None), (4, "")]
    got = agentlog.cited_pairs(spark.createDataFrame(rows, "k int, t string"), ["k"], "t").collect()
    assert sorted((r["k"], r["doc_id"], r["path"] or "") for r in got) == [(1, a, "4.2"), (1, b, "7.1"), (2, a, "")]
