"""Column expressions on text: tokens, normal forms, identities and overlaps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of four letters and more that carry no content.
STOP_WORDS = (
    "shall must with that this from such under which have been financial institution institutions their when where other sub "
    "paragraph including should would there these those into than also does each more made make will them they were what"
).split()

# Patterns by which a question names its own source.
LEAK_PATTERNS = {
    "notice_number": r"\b(?:MAS\s+)?Notice\s+(?:No\.\s*)?[A-Z0-9][A-Z0-9\-]{1,11}\b",
    "instrument_code": r"\b(?:[A-Z]{2,7}\s?\d{0,2}[A-Z]{0,2}-N\d{2}[A-Z]?|PSN\d{2}[A-Z]{0,2})\b",
    "paragraph_number": r"(?i)\b(?:paragraph|para|clause|section)s?\s+\d{1,2}(?:\.\d{1,3})*\b",
}
# Fixed value: an instrument code at the head of a title.
CODE_PATTERN = r"\b(?:MAS\s+)?(?:Notice\s+)?((?:[A-Z]{2,7}\s?\d{0,2}[A-Z]{0,2}-N\d{2}[A-Z]?)|(?:PSN\d{2}[A-Z]{0,2})|(?:\d{3,4}[A-Z]?))\b"
# The two shapes in which a title names the class it binds.
CLASS_AFTER_TO = r"\bNotice\s+[A-Z0-9\- ]{3,12}\s+to\s+((?:the\s+)?[A-Z][^,]{3,60}?)\s+on\s+Prevention\b"
CLASS_AFTER_DASH = r"(?:[–—]|\s-\s)\s*([^–—]{4,90})\s*$"
# Fixed value: wordings that bind someone.
OBLIGATION_PATTERN = r"(?i)\b(shall|must|is required to|are required to|should|may not|shall not)\b"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text: str | Column) -> Column:
    """Runs of two or more ASCII letters of the lower-cased text, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]{2,}"), 0)


def bigrams(text: str | Column) -> Column:
    """Adjacent token pairs joined by a blank, in order."""
    t = tokens(text)
    return F.when(F.size(t) < 2, F.array().cast("array<string>")).otherwise(F.zip_with(F.slice(t, F.lit(1), F.greatest(F.size(t) - 1, F.lit(0))), F.slice(t, F.lit(2), F.greatest(F.size(t) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b)))


def content_words(text: str | Column) -> Column:
    """Distinct words of four ASCII letters or more that are no stop words; empty for null."""
    found = F.regexp_extract_all(F.lower(F.coalesce(col(text), F.lit(""))), F.lit("([a-z]{4,})"), 1)
    return F.array_except(F.array_distinct(found), F.array(*[F.lit(w) for w in STOP_WORDS]))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct elements; 0 where either side is empty."""
    empty = (F.size(a) == 0) | (F.size(b) == 0)
    return F.when(empty, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def coverage(part: Column, whole: Column) -> Column:
    """Share of the elements of ``part`` that ``whole`` has; 0 where ``part`` is empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(part, whole)), F.size(part)), F.lit(0.0))


def squeeze(text: str | Column) -> Column:
    return F.trim(F.regexp_replace(col(text), r"\s+", " "))


def span_hash(text: str | Column) -> Column:
    """SHA-256 of the text with each run of white space as one blank."""
    return F.sha2(squeeze(text), 256)


def canonical_url(url: str | Column) -> Column:
    """Scheme and host in lower case, no query, parameters, fragment or trailing slash."""
    u = F.regexp_replace(F.trim(col(url)), r"[?#;].*$", "")
    head = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/]*)", 1))
    path = F.regexp_replace(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/]*(.*)$", 1), r"/+$", "")
    return F.concat(head, F.when(path == "", F.lit("/")).otherwise(path))


def document_id(url: str | Column) -> Column:
    """The first 16 hexadecimal digits of the SHA-256 of the canonical URL."""
    return F.substring(F.sha2(canonical_url(url), 256), 1, 16)


def file_slug(name: str | Column, longest: int = 120) -> Column:
    """A file name of safe characters; the suffix survives if it has at most 8 characters."""
    safe = F.regexp_replace(col(name), r"[^A-Za-z0-9._\-]+", "-")
    suffix = F.regexp_extract(safe, r"(\.[A-Za-z0-9]{1,7})$", 1)
    stem = F.substring(safe, F.lit(1), F.length(safe) - F.length(suffix))
    return F.concat(F.substring(stem, F.lit(1), F.lit(longest) - F.length(suffix)), suffix)


def notice_code(title: str | Column) -> Column:
    return F.nullif(F.upper(squeeze(F.regexp_extract(col(title), CODE_PATTERN, 1))), F.lit(""))


def entity_class(title: str | Column) -> Column:
    """The class a title binds, null where it names none."""
    direct = F.nullif(squeeze(F.regexp_extract(col(title), CLASS_AFTER_TO, 1)), F.lit(""))
    tail = F.regexp_replace(squeeze(F.regexp_extract(F.trim(col(title)), CLASS_AFTER_DASH, 1)), r"\.+$", "")
    named = F.substring(tail, 1, 1).rlike("[A-Z]") & (F.size(F.split(tail, " ")) <= 10)
    return F.coalesce(direct, F.when(named, tail))


def leak_names(question: str | Column) -> Column:
    """Names of the leak patterns a question shows."""
    return F.array_compact(F.array(*[F.when(col(question).rlike(p), F.lit(n)) for n, p in LEAK_PATTERNS.items()]))


def token_estimate(text: str | Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))


def html_links(html: str | Column, suffix: str = ".pdf") -> Column:
    """Distinct targets of anchors that end in ``suffix``, in the order first seen."""
    found = F.regexp_extract_all(col(html), F.lit(r"(?is)<a\s[^>]*?href\s*=\s*[\"']([^\"'#?]+)"), 1)
    return F.array_distinct(F.filter(found, lambda u: F.lower(u).endswith(suffix)))


def sitemap_locations(xml: str | Column, prefix: str = "") -> Column:
    """Distinct sorted ``<loc>`` addresses below a prefix, without the prefix page itself."""
    found = F.regexp_extract_all(col(xml), F.lit(r"(?is)<loc>\s*([^<\s]+)\s*</loc>"), 1)
    return F.array_sort(F.array_distinct(F.filter(found, lambda u: u.startswith(prefix) & (F.rtrim(u) != prefix))))


# Words of a question that name no topic.
TOPIC_STOP = "what when which where who how must may does shall should the and for are has have need under with that this its from been before after each every any all own into not can cannot to of in is it do be by or an on at as if long often".split()


def topic_terms(question: str | Column) -> Column:
    """Words of a question between blanks, without signs at their ends, stop words and words below three letters."""
    bare = F.transform(F.split(F.lower(F.coalesce(col(question), F.lit(""))), " "), lambda w: F.regexp_replace(w, r"^[^a-z0-9]+|[^a-z0-9]+$", ""))
    return F.filter(bare, lambda w: (F.length(w) > 2) & ~w.isin(TOPIC_STOP))


def scope_label(heading: str | Column, longest: int = 40) -> Column:
    """A heading as one line cut at a word, without signs at its ends and with no slash; null for none."""
    t = squeeze(heading)
    head = F.substring(t, 1, longest + 1)
    cut = F.when(F.length(t) <= longest, t).when(head.contains(" "), F.regexp_replace(head, r" [^ ]*$", "")).otherwise(F.substring(t, 1, longest))
    return F.nullif(F.regexp_replace(F.btrim(cut, F.lit(" ,.;:-")), "/", "-"), F.lit(""))


def registry_hash(name: str, value: str) -> Column:
    """SHA-256 over all names and values of a group in the order of names: an aggregate."""
    each = F.array_sort(F.collect_list(F.struct(F.col(name).alias("n"), F.col(value).alias("v"))))
    return F.sha2(F.array_join(F.transform(each, lambda x: F.concat(x["n"], F.lit("\x01"), x["v"])), "\x02"), 256)
