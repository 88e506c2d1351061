import datetime as dt
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexmill.llm import boundaries as B

T0 = dt.datetime(2024, 1, 1)
texts = st.text(alphabet="ab. ;A(\n", max_size=160)


def parts(text, level):
    out = re.split(r"\n[^\S\n]*\n", text)
    if level <= 2:
        out = [q for p in out for q in re.split(r"(?<=[.;:])\s+(?=[A-Z(])|\n", p)]
    if level <= 1:
        out = [q for p in out for q in p.split()]
    return max((len(p.strip()) for p in out), default=0)


@settings(max_examples=400, deadline=None)
@given(texts)
def test_level_against_its_definition(text):
    got = B.weakest_cut(text, 12)
    if len(text.strip()) <= 12:
        assert got is None
    else:
        assert got == next((n for n in (3, 2, 1) if parts(text.strip(), n) <= 12), 0)


@settings(max_examples=400, deadline=None)
@given(texts, st.integers(0, 8))
def test_pieces(text, overlap):
    pieces = B.split_text(text, 20, overlap)
    assert [p[1] for p in pieces] == list(range(len(pieces)))
    assert all(0 < len(p[0]) <= 20 and p[0] == text[p[2] : p[3]] for p in pieces)
    covered = set()
    for _, _, a, b, _ in pieces:
        covered |= set(range(a, b))
    assert all(text[i].isspace() for i in range(len(text)) if i not in covered)
    for (_, _, _, end, _), (_, _, start, stop, _) in zip(pieces, pieces[1:]):
        assert end - overlap <= start or start >= end
        assert stop > end


def test_strongest_cut_is_the_rightmost():
    index = B.CutIndex("a b. C d\n\ne f\n\ng h")
    for low in range(len(index.strengths)):
        for high in range(low + 1, len(index.strengths) + 1):
            best = max(index.strengths[low:high])
            assert index.strongest(low, high) == max(i for i in range(low, high) if index.strengths[i] == best)


def test_long_words_blanks_and_nulls():
    assert B.split_text(None) == [] and B.split_text(" \n ") == []
    pieces, rebuilt = B.split_text("x" * 3000), ""
    for text, _, start, _, _ in pieces:
        rebuilt += text[len(rebuilt) - start :]
    assert rebuilt == "x" * 3000
    assert B.weakest_cut("x" * 3000) == 0
    assert [len(p[0]) for p in B.split_text("a" + " " * 3000 + "b")] == [1, 1]
    with pytest.raises(ValueError):
        B.split_text("a", 10, 10)


def test_on_tables(spark):
    rows = [("s1", T0, "old " * 400), ("s1", T0 + dt.timedelta(1), "short"), ("s2", T0, "word " * 400), ("s2", T0, "word " * 400), (None, T0, "word " * 400), ("s3", T0, None), ("s4", None, "y" * 1300)]
    df = spark.createDataFrame(rows, "uid string, at timestamp_ntz, text string").selectExpr("*", "1 AS level", "2 AS finding")
    assert sorted(map(tuple, B.boundary_findings(df, "uid", "at").collect())) == [("s2", "word"), ("s4", "none")]
    assert B.boundary_findings(df.limit(0), "uid", "at").count() == 0
    out = B.split_oversized(df.where("uid = 's2'").withColumnRenamed("level", "ordinal"))
    assert out.count() == 4 and "finding" in out.columns and out.columns.count("ordinal") == 1


def test_ordinals(spark):
    rows = [("a#0", "a", 0), ("a#1", "a", 1), ("b#0", "b", 0), ("b#2", "b", 2), ("c#1", "c", 1), ("d#0", "d", None), ("e#0", "e", 0), ("e#0", "e", 0), ("f#0", "f", 0), ("f#x", "f", 0)]
    df = spark.createDataFrame([(c, u, o, T0) for c, u, o in rows], "chunk_id string, section_uid string, ordinal int, made_at timestamp_ntz")
    assert sorted(r["unit_id"] for r in B.ordinal_findings(df).collect()) == ["b", "c", "d", "f"]


def test_a_heading_is_no_piece_of_its_own():
    text = "Heading\n\n" + "A duty of some length is stated here. " * 60
    pieces = B.split_text(text)
    assert all(len(p[0]) >= 300 for p in pieces[:-1]) and pieces[0][0].startswith("Heading\n\nA duty")
    # Where no cut leaves the least length, the strongest of the others is taken before a word is divided.
    assert B.split_text("ab\n\n" + "x" * 1300, 1200, 0)[0][0] == "ab"
    assert B.weakest_cut("A heading\n\n" + "A duty. " * 149) == B.PARAGRAPH
