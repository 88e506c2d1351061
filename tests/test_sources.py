from pyspark.sql import functions as F

from lexmill.operators import selection
from lexmill.sources import jsonl


def test_json_lines_round_trip(spark, tmp_path):
    path = str(tmp_path / "manifest")
    rows = spark.createDataFrame([("b", "https://e.org/2", None, 5), ("a", "https://e.org/1", "x", None), ("a", "https://e.org/3", "y", 7)], "doc_id string, url string, title string, bytes long")
    jsonl.write_json_lines(rows, path, ["doc_id", "url"])
    back, broken = jsonl.read_json_lines(spark, path, jsonl.MANIFEST)
    assert broken.count() == 0
    columns = ["doc_id", "url", "title", "bytes"]
    assert {tuple(r) for r in back.select(columns).collect()} == {tuple(r) for r in rows.select(columns).collect()}
    assert [tuple(r) for r in jsonl.repeated_keys(back, "doc_id").collect()] == [("a", 2)]


def test_broken_lines_are_named(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"doc_id": "a"}\n\n{"doc_id": \n')
    rows, broken = jsonl.read_json_lines(spark, str(tmp_path / "x.jsonl"), jsonl.MANIFEST)
    assert [r["doc_id"] for r in rows.collect()] == ["a"]
    assert [(r["file"].endswith("x.jsonl"), r["line"]) for r in broken.collect()] == [(True, '{"doc_id": ')]


def test_excerpts_keep_the_first_place_and_state_cuts(spark):
    arm = lambda us: spark.createDataFrame([("q", u, i + 1) for i, u in enumerate(us)], "query_id string, uid string, rank int")
    texts = spark.createDataFrame([(u, u * 30) for u in "abcd"], "uid string, text string")
    rows = selection.excerpts([arm("ba"), arm("cab")], texts, most=3, longest=10).orderBy("place").collect()
    assert [r["uid"] for r in rows] == ["b", "a", "c"] and rows[0]["text"] == "b" * 10 + " [cut at 10 of 30]"


def test_interleaving_and_round_robin(spark):
    df = spark.createDataFrame([(g, k, i) for g in "xy" for k in "pq" for i in range(5)], "g string, k string, i int").withColumn("id", F.concat("g", "k", "i"))
    rows = selection.interleaved(df, "g", "k", "id", 4).orderBy("g", "place").collect()
    assert [r["k"] for r in rows if r["g"] == "x"] == ["p", "q", "p", "q"]
    seeds = selection.round_robin(spark.createDataFrame([("a",), ("b",), ("c",)], "d string"), "d", ["r1", "r2"], 7).orderBy("seed").collect()
    assert [r["seed"] for r in seeds] == list(range(7)) and [r["reason"] for r in seeds] == ["r1", "r2"] * 3 + ["r1"]
    assert len({r["d"] for r in seeds[:3]}) == 3


def test_the_first_object_in_a_text(spark):
    from lexmill.sources.jsonl import first_object

    rows = [('x {"b": 1, "a": "}{"} {"c": 2}', '{"a": "}{", "b": 1}'), ("```json\n{}\n```", "{}"), ('{not} {"a": {"b": [1]}}', '{"a": {"b": [1]}}'), ("{", None), ("", None), (None, None), ('{"a": 1', None), ('{"a": "' + "x" * 50_000 + '"}', '{"a": "' + "x" * 50_000 + '"}')]
    df = spark.createDataFrame(rows, "t string, want string").select("want", first_object("t").alias("got"))
    assert all(r["got"] == r["want"] for r in df.collect())
    assert df.limit(0).count() == 0
