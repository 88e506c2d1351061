import random

import pytest
from pyspark.sql import functions as F

from lexmill.operators import checks, chunks, golden

CHECK = "id string, query_type string, drift string, leaks array<string>, entity_named boolean, answer_grounding double, judge_answerable boolean, closed_book_overlap double"


def test_status_and_confidence(spark):
    rows = [
        ("good", "factual_lookup", "resolved", [], True, 0.9, True, 0.1), ("moved", "factual_lookup", "moved", ["notice_number"], True, 0.9, True, 0.1), ("missing", "multi_hop", "missing", None, False, 0.125, False, 0.6),
        ("negative", "negative", "resolved", [], True, 1.0, True, 0.9), ("fine", "negative", "resolved", [], True, 1.0, False, 0.0), ("unasked", "comparative", "resolved", [], True, 0.5, None, None), ("nil", None, None, None, None, None, None, None),
    ]
    got = {r["id"]: (r["status"], r["failures"], r["confidence"]) for r in checks.verdicts(spark.createDataFrame(rows, CHECK)).collect()}
    assert got == {
        "good": ("machine_verified", [], 1.0), "moved": ("flagged", ["leak_notice_number", "span_moved"], 0.5),
        "missing": ("flagged", ["answer_grounding_0.13", "answerable_without_corpus", "entity_not_named", "judge_says_not_answerable_from_span", "span_missing"], 0.0),
        "negative": ("flagged", ["negative_is_answerable"], 0.4), "fine": ("machine_verified", [], 1.0), "unasked": ("machine_verified", [], 0.9), "nil": ("flagged", ["entity_not_named"], 0.7),
    }
    assert checks.verdicts(spark.createDataFrame([], CHECK)).count() == 0


def test_a_flag_is_never_cleared(spark):
    prior = spark.createDataFrame([("a", "flagged", ["x"]), ("b", "human_verified", None), ("c", "human_verified", ["y"]), ("d", "unverified", [])], "id string, status string, failures array<string>")
    fresh = spark.createDataFrame([("a", []), ("b", ["n", "m"]), ("c", None)], "id string, failures array<string>")
    assert {r["id"]: (r["status"], r["failures"]) for r in checks.reverified(fresh, prior).collect()} == {"a": ("flagged", ["x"]), "b": ("flagged", ["m", "n"]), "c": ("human_verified", ["y"]), "d": ("unverified", [])}


def test_gate_by_direction_and_band(spark):
    base = spark.createDataFrame([("up", 5.0), ("down", 5.0), ("p50", 4.0), ("zero", 0.0), ("shown", 1.0), ("gone", 1.0), ("other", 1.0)], "metric string, value double")
    verdict = lambda rows: {r["metric"]: r["verdict"] for r in checks.gate(base, spark.createDataFrame(rows, "metric string, value double"), ["up", "gone", "new"], ["down"], {"p50": 0.25, "zero": 0.25}, ["shown"]).collect()}
    assert verdict([("up", 5.0), ("down", 5.0), ("p50", 5.0), ("zero", 9.0), ("shown", 0.0), ("new", 1.0)]) == {"up": "ok", "down": "ok", "p50": "ok", "zero": "skipped", "shown": "reported", "gone": "skipped", "new": "skipped"}
    assert verdict([("up", 4.9), ("down", 5.1), ("p50", 5.01), ("gone", None)]) == {"up": "failed", "down": "failed", "p50": "failed", "zero": "skipped", "shown": "reported", "gone": "skipped"}


def test_references_are_kept_and_marked(spark):
    answers = spark.createDataFrame([("a", ["s1", "bad", "s1"], False), ("b", [], False), ("c", ["bad"], True), ("d", None, None)], "task string, cited_uids array<string>, abstained boolean").withColumn("text", F.lit("clash"))
    sections = spark.createDataFrame([("s1", "clause"), ("s2", None)], "section_uid string, text string")
    resolved = checks.resolved_citations(answers, sections, ["task"])
    assert sorted((r["task"], r["place"], r["found"], r["text"]) for r in resolved.collect()) == [("a", 0, True, "clause"), ("a", 1, False, "NOT FOUND IN THE INDEX"), ("a", 2, True, "clause"), ("c", 0, False, "NOT FOUND IN THE INDEX")]
    assert {r["task"]: (r["kept"], r["violations"]) for r in checks.reference_check(answers, resolved, ["task"]).collect()} == {"a": (["s1"], 1), "b": ([], 1), "c": ([], 0), "d": ([], 1)}


def test_names_of_classes(spark):
    rows = [("How must a bank act?", "Banks", True, True), ("How must it act?", "Banks", True, False), ("How must it act?", "Banks", False, True), ("x", None, True, True), (None, "Banks", True, False), ("x", "ab", None, True)]
    df = spark.createDataFrame(rows, "q string, e string, c boolean, want boolean").select("want", checks.entity_named("q", "e", F.col("c")).alias("got"))
    assert all(r["want"] is r["got"] for r in df.collect())


def test_references_to_other_documents(spark):
    sections = spark.createDataFrame([
        ("g:1", "g", "1", "See paragraph 2.1 of the Notice, and paragraphs 2.1 of the notice again."), ("n:2.1", "n", "2.1", "Nothing here."), ("x:1", "x", "1", "As paragraph 2.1 and the rest of MAS Notice  626 says; Notice 626, paragraph 9.9 does not."),
        ("n:3", "n", "3", "paragraph 2.1 of Notice 626"), ("y:1", "y", "1", None), (None, "x", "7", "paragraph 2.1 of Notice 626"),
    ], "section_uid string, doc_id string, section_path string, text string").withColumn("kind", F.lit("clash"))
    codes = spark.createDataFrame([("626", "n")], "code string, doc_id string")
    parents = spark.createDataFrame([("g", "n")], "doc_id string, parent_id string")
    got = sorted(map(tuple, golden.cross_references(sections, codes, parents).collect()))
    assert got == [("g:1", "n:2.1", "guideline_to_notice"), ("x:1", "n:2.1", "explicit_citation")]
    kinds = spark.createDataFrame([("The Banking (Amendment No. 2) 2020 takes effect with effect from 1 May 2020",), ("[Deleted by Notice 626]",), ("applies with effect from 3 June 2021",), ("none",), (None,)], "t string").select(golden.time_kind("t").alias("k"))
    assert [r["k"] for r in kinds.collect()] == ["amendment", "deleted", "effect", None, None]


def test_quota_and_top_up(spark):
    assert golden.scaled_quota({"a": 12, "b": 6, "c": 4, "d": 3, "e": 5}, 10) == {"a": 4, "b": 2, "c": 1, "d": 1, "e": 2}
    rows = spark.range(10).withColumnRenamed("id", "k")
    got = [tuple(r) for r in golden.with_top_up(rows, rows.where("k IN (7, 9)"), "k", 4, F.col("k")).orderBy("place").collect()]
    assert got == [(7, 1, False), (9, 2, False), (0, 3, True), (1, 4, True)]


def test_packed_pieces(spark):
    random.seed(2)
    for _ in range(60):
        text = ""
        for _ in range(random.randint(1, 60)):
            text += " ".join("".join(random.choices("abcdef", k=random.randint(1, 12))) for _ in range(random.randint(1, 40))).capitalize() + random.choice([". ", ".\n", ";\n", "\n\n"])
        pieces = chunks.packed(text)
        assert all(len(p) <= chunks.LONGEST for p in pieces[:-1]) and len(pieces[-1]) <= chunks.LONGEST + chunks.TAIL + 1
        words, k = text.split(), 0
        for p in pieces:  # every word is there, in order, and a piece opens with words of the one before
            own = p.split()
            back = next(i for i in range(len(own) + 1) if own[i:] == words[k : k + len(own) - i])
            assert len(" ".join(own[:back])) <= chunks.OVERLAP and own[:back] == words[k - back : k]
            k += len(own) - back
        assert k == len(words)
    assert chunks.packed("") == [] and chunks.packed(" a ") == ["a"] and all(len(p) <= 1200 for p in chunks.packed("x" * 5000))
    df = spark.createDataFrame([("s", "d", "b " * 900), ("t", "d", " short "), ("n", "d", None), ("e", "d", " \n"), (None, "d", "x")], "section_uid string, doc_id string, text string").withColumn("ordinal", F.lit(9))
    got = chunks.pack_sections(df).orderBy("section_uid", "ordinal").collect()
    assert [(r["section_uid"], r["ordinal"]) for r in got] == [("s", 0), ("s", 1), ("t", 0)] and got[-1]["text"] == "short"


def test_contexts_and_arms(spark):
    rows = spark.createDataFrame([("c1", "s", "one", None), ("c2", "s", "two", "old"), ("c3", None, "three", "own"), ("c4", "t", None, "x"), (None, "s", "y", None)], "chunk_id string, section_uid string, text string, context_text string")
    contexts = spark.createDataFrame([("s", "new"), ("s", None), (None, "z"), ("u", "w")], "section_uid string, context string")
    inputs = chunks.embedding_inputs(chunks.with_context(rows, contexts))
    assert sorted(map(tuple, inputs.collect())) == [("c1", "+ctx", "new\n\none"), ("c1", "plain", "one"), ("c2", "+ctx", "new\n\ntwo"), ("c2", "plain", "two"), ("c3", "+ctx", "own\n\nthree"), ("c3", "plain", "three")]
    fresh = spark.createDataFrame([("c9", "plain", "nine")], "chunk_id string, arm string, input string")
    assert sorted(r["chunk_id"] for r in chunks.replace_arms(inputs, fresh).collect()) == ["c1", "c2", "c3", "c9"]


@pytest.mark.parametrize("n", [0, 1])
def test_aligned_paths(spark, n):
    text = "shall keep records of every customer account and review them yearly"
    rows = [("a:1", "1", "A", text), ("b:1", "1", "B", text + " promptly"), ("b:0", "1", "B", text), ("c:2", "2", "C", text), ("d:2", "2", "D", "quite other words about nothing alike whatsoever"), ("e:3", "3", "E", text), ("n:1", "1", None, text)]
    df = spark.createDataFrame(rows, "section_uid string, section_path string, entity string, text string").withColumn("place", F.lit(0)).limit(n * 100)
    got = {r["section_path"]: (r["uids"], r["widest"], r["differ"]) for r in golden.aligned_paths(df).collect()}
    assert got == ({"1": ("a:1 b:0", 0.0, False)} if n else {})
