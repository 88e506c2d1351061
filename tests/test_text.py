import hashlib

import pytest
from pyspark.sql import functions as F

from lexmill.functions import text as T


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "v string").select(expression("v").alias("x")).first()["x"]


@pytest.mark.parametrize("url, canonical", [
    ("HTTPS://WWW.Example.org/A/b/?q=1#x", "https://www.example.org/A/b"),
    ("https://example.org", "https://example.org/"),
    ("https://example.org/;p=1", "https://example.org/"),
    (None, None),
])
def test_canonical_url(spark, url, canonical):
    assert one(spark, url, T.canonical_url) == canonical
    if canonical:
        assert one(spark, url, T.document_id) == hashlib.sha256(canonical.encode()).hexdigest()[:16]


@pytest.mark.parametrize("title, code", [
    ("Notice 626 Prevention of Money Laundering - Banks", "626"),
    ("FAA-N06 Notice on Records", "FAA-N06"),
    ("Notice PSN01AA", "PSN01AA"),
    ("Guidelines on Outsourcing", None),
    (None, None),
])
def test_notice_code(spark, title, code):
    assert one(spark, title, T.notice_code) == code


@pytest.mark.parametrize("title, name", [
    ("Notice 626 Prevention of Money Laundering – Merchant Banks", "Merchant Banks"),
    ("Notice SFA04-N02 to Approved Trustees on Prevention of Crime", "Approved Trustees"),
    ("Notice 12 - a lower case tail", None),
    ("Cross-Border Arrangements", None),
])
def test_entity_class(spark, title, name):
    assert one(spark, title, T.entity_class) == name


def test_tokens_and_bigrams(spark):
    assert one(spark, "A duty, the Duty's x9y end", T.tokens) == ["duty", "the", "duty", "end"]
    assert one(spark, "one two three", T.bigrams) == ["one two", "two three"]
    assert one(spark, "one", T.bigrams) == [] and one(spark, "", T.bigrams) == []


def test_content_words_and_overlap(spark):
    assert set(one(spark, "The bank shall keep records, records", T.content_words)) == {"bank", "keep", "records"}
    assert one(spark, None, T.content_words) == []
    assert one(spark, "", lambda c: T.jaccard(T.content_words(c), F.array(F.lit("bank")))) == 0.0


def test_leaks_links_and_slugs(spark):
    assert one(spark, "What does Notice 626 say in paragraph 4.1?", T.leak_names) == ["notice_number", "paragraph_number"]
    assert one(spark, '<a href="x/A.PDF">a</a><A class=k href=\'b.pdf?v=1\'>b</A><a href="x/A.PDF">', T.html_links) == ["x/A.PDF", "b.pdf"]
    assert one(spark, "<loc>https://e.org/a/b</loc><loc>https://e.org/a/</loc><loc> https://e.org/a/c </loc>", lambda c: T.sitemap_locations(c, "https://e.org/a/")) == ["https://e.org/a/b", "https://e.org/a/c"]
    assert one(spark, "a b/c.pdf", T.file_slug) == "a-b-c.pdf"
    assert len(one(spark, "x" * 300 + ".pdf", T.file_slug)) == 120
