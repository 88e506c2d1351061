"""Checks and selections over golden items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import text as T

#: Items of each query type in a task set.
TASK_QUOTA = {"factual_lookup": 12, "multi_hop": 6, "comparative": 4, "temporal": 3, "negative": 5}


def violations() -> Column:
    """Names of the rules a golden row breaks; null fields break the rules that need them."""
    spans = F.size(F.coalesce("gold_spans", F.array().cast("array<struct<doc_id:string,section_path:string,span_sha256:string,why:string>>")))
    negative = F.coalesce(F.col("query_type") == "negative", F.lit(False))
    several = F.coalesce(F.col("query_type").isin("multi_hop", "comparative"), F.lit(False))
    rules = {
        "id": ~F.coalesce(F.col("id").rlike(r"^gs-\d{4,7}$"), F.lit(False)),
        "question": ~F.coalesce((F.length("question") >= 15) & F.col("question").endswith("?"), F.lit(False)),
        "answer": ~F.coalesce(F.length("answer") >= 2, F.lit(False)),
        "query_type": ~F.coalesce(F.col("query_type").isin(*TASK_QUOTA), F.lit(False)),
        "negative_with_spans": negative & (spans > 0),
        "grounded_without_spans": ~negative & (spans == 0),
        "absence_reason": negative != F.col("absence_reason").isNotNull(),
        "too_few_spans": several & (spans < 2),
    }
    return F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]))


def span_states(items: DataFrame, sections: DataFrame) -> DataFrame:
    """id, drift, spans, moved, missing: the worst state of each item's spans against live sections.

    ``items``: id, gold_spans; ``sections``: section_uid, text. A span whose section is gone is
    missing, one whose text has another hash moved. An item without spans is resolved."""
    spans = items.select("id", F.explode_outer("gold_spans").alias("g")).select("id", F.when(F.col("g").isNotNull(), F.concat_ws(":", "g.doc_id", "g.section_path")).alias("section_uid"), "g.span_sha256")
    live = sections.select("section_uid", T.span_hash(F.coalesce("text", F.lit(""))).alias("now"))
    rows = spans.join(live, "section_uid", "left")
    moved = F.col("now").isNotNull() & ~F.col("now").eqNullSafe(F.col("span_sha256"))
    missing = F.col("section_uid").isNotNull() & F.col("now").isNull()
    per = rows.groupBy("id").agg(F.count("section_uid").alias("spans"), F.count(F.when(moved, 1)).alias("moved"), F.count(F.when(missing, 1)).alias("missing"))
    return per.select("id", F.when(F.col("missing") > 0, "missing").when(F.col("moved") > 0, "moved").otherwise("resolved").alias("drift"), "spans", "moved", "missing")


def grounding(items: DataFrame, sections: DataFrame) -> DataFrame:
    """id, answer_grounding, vocab_overlap against the words of the item's live gold sections.

    Grounding is the share of the answer's content words that the sections have, 1 without spans;
    overlap is the Jaccard similarity of the question's and the sections' words."""
    spans = items.select("id", F.explode("gold_spans").alias("g")).select("id", F.concat_ws(":", "g.doc_id", "g.section_path").alias("section_uid")).distinct()
    words = spans.join(sections.select("section_uid", T.content_words("text").alias("w")), "section_uid").groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("w"))).alias("w"))
    rows = items.select("id", "question", "answer", F.coalesce(F.size("gold_spans"), F.lit(0)).alias("n")).join(words, "id", "left").withColumn("w", F.coalesce("w", F.array().cast("array<string>")))
    share = F.when(F.col("n") <= 0, F.lit(1.0)).otherwise(T.coverage(T.content_words("answer"), F.col("w")))
    return rows.select("id", F.round(share, 4).alias("answer_grounding"), F.round(T.jaccard(T.content_words("question"), F.col("w")), 4).alias("vocab_overlap"))


def spread(items: DataFrame, sections: DataFrame) -> DataFrame:
    """id, clauses, widest: the greatest word distance between two gold sections of an item.

    Pairs are formed within an item's own span list, which its author bounds."""
    spans = items.select("id", F.explode("gold_spans").alias("g")).select("id", F.concat_ws(":", "g.doc_id", "g.section_path").alias("section_uid")).distinct()
    words = spans.join(sections.select("section_uid", T.content_words("text").alias("w")), "section_uid")
    pairs = words.alias("x").join(words.alias("y"), (F.col("x.id") == F.col("y.id")) & (F.col("x.section_uid") < F.col("y.section_uid")))
    widest = pairs.groupBy(F.col("x.id").alias("id")).agg(F.round(F.max(1 - T.jaccard(F.col("x.w"), F.col("y.w"))), 4).alias("widest"))
    return words.groupBy("id").agg(F.count("*").alias("clauses")).join(widest, "id", "left")


def task_quota(items: DataFrame, quota: dict[str, int] = TASK_QUOTA) -> DataFrame:
    """The first verified items of each type by id, as many as the quota names."""
    order = Window.partitionBy("query_type").orderBy("id")
    most = F.create_map(*[x for k, v in quota.items() for x in (F.lit(k), F.lit(v))])[F.col("query_type")]
    rows = items.where(F.col("query_type").isin(*quota)).withColumn("place", F.row_number().over(order))
    return rows.where(F.col("place") <= most)


def stratified_sample(rows: DataFrame, key: str, size: str, each: int, seed: str = "42") -> DataFrame:
    """``each`` rows of every size bucket (10, 50, 100 and above) in the order of a seeded hash."""
    bucket = F.when(F.col(size) <= 10, "a").when(F.col(size) <= 50, "b").when(F.col(size) <= 100, "c").otherwise("d")
    order = Window.partitionBy("bucket").orderBy(F.sha2(F.concat(F.lit(seed), F.col(key)), 256), key)
    return rows.where(F.col(key).isNotNull() & F.col(size).isNotNull()).withColumn("bucket", bucket).withColumn("place", F.row_number().over(order)).where(F.col("place") <= each)


def band(count: str) -> Column:
    return F.when(F.col(count) >= 5, "contested").when(F.col(count) >= 1, "moderate").when(F.col(count) == 0, "isolated")


def references(sections: DataFrame) -> DataFrame:
    """section_uid, path, target_uid: numbered paragraphs a text refers to and the section of its own
    document that has the number, null where there is none. Each reference once; none to itself."""
    found = F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?i)\bparagraphs?\s+(\d{1,2}(?:\.\d{1,3}){1,3})"), 1))
    rows = sections.where("text IS NOT NULL").select("section_uid", "doc_id", F.explode(found).alias("path"))
    targets = sections.select("doc_id", F.col("section_path").alias("path"), F.col("section_uid").alias("target_uid"))
    return rows.join(targets, ["doc_id", "path"], "left").where(~F.col("target_uid").eqNullSafe(F.col("section_uid"))).select("section_uid", "path", "target_uid")


# How a text refers to a numbered paragraph of another document, and what it says of its own times.
OF_CODE = r"(?i)paragraphs?\s+(\d{1,2}(?:\.\d{1,3}){0,3})[^.]{0,40}?of\s+(?:MAS\s+)?Notice\s+([A-Z0-9\- ]{3,12}?)\b"
CODE_OF = r"(?i)(?:MAS\s+)?Notice\s+([A-Z0-9\- ]{3,12}?)[,\s]+paragraphs?\s+(\d{1,2}(?:\.\d{1,3}){0,3})\b"
OF_PARENT = r"(?i)paragraphs?\s+(\d{1,2}(?:\.\d{1,3}){0,3})\s+of\s+the\s+Notice\b"
AMENDED = r"(?i)([A-Z0-9][A-Za-z0-9 /\-]{1,40}\(Amendment(?:\s+No\.\s*\d+)?\)\s*\d{4})[^.]{0,200}?with effect from\s+(\d{1,2}\s+\w+\s+\d{4})"
DELETED = r"\[Deleted by ([^\]]{3,80})\]"
IN_EFFECT = r"(?i)with effect from\s+\d{1,2}\s+\w+\s+\d{4}"


def cross_references(sections: DataFrame, codes: DataFrame, parents: DataFrame, of_parent: str = OF_PARENT) -> DataFrame:
    """section_uid, target_uid, kind: references to a clause of another document that resolve, each once.

    ``sections``: section_uid, doc_id, section_path, text; ``codes``: code, doc_id of the document that
    carries it; ``parents``: doc_id, parent_id of the document that "the Notice" stands for. Kinds are
    guideline_to_notice and explicit_citation; of a pair found both ways the first counts."""
    rows = sections.where("text IS NOT NULL AND section_uid IS NOT NULL").select("section_uid", "doc_id", "text")
    each = lambda pattern, a, b: F.explode(F.arrays_zip(F.regexp_extract_all("text", F.lit(pattern), a).alias("path"), F.regexp_extract_all("text", F.lit(pattern), b).alias("code")))
    said = rows.select("section_uid", "doc_id", each(OF_CODE, 1, 2).alias("r")).union(rows.select("section_uid", "doc_id", each(CODE_OF, 2, 1).alias("r")))
    said = said.select("section_uid", "doc_id", "r.path", F.upper(T.squeeze("r.code")).alias("code")).distinct()
    named = said.join(codes.select("code", F.col("doc_id").alias("target")), "code").select("section_uid", "doc_id", "path", "target", F.lit("explicit_citation").alias("kind"))
    own = rows.join(parents.select("doc_id", F.col("parent_id").alias("target")), "doc_id").select("section_uid", "doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(of_parent), 1))).alias("path"), "target", F.lit("guideline_to_notice").alias("kind"))
    there = sections.select(F.col("doc_id").alias("target"), F.col("section_path").alias("path"), F.col("section_uid").alias("target_uid"))
    both = named.unionByName(own).where(F.col("target") != F.col("doc_id")).join(there, ["target", "path"])
    return both.groupBy("section_uid", "target_uid").agg(F.max("kind").alias("kind"))


def time_kind(text: str) -> Column:
    """The first that a text has of amendment, deleted and effect; null for none."""
    c = F.col(text)
    return F.when(c.rlike(AMENDED), "amendment").when(c.rlike(DELETED), "deleted").when(c.rlike(IN_EFFECT), "effect")


def scaled_quota(quota: dict[str, int], limit: int) -> dict[str, int]:
    """A quota scaled to a limit: at least one of each, halves to the even number."""
    whole = sum(quota.values())
    return {k: max(1, round(v * limit / whole)) for k, v in quota.items()}


def with_top_up(rows: DataFrame, picked: DataFrame, key: str, n: int, order: Column) -> DataFrame:
    """``picked`` (key) and, while it has fewer than ``n`` rows, further keys of ``rows`` in order."""
    have = picked.select(key).distinct().withColumn("first", F.lit(0))
    rest = rows.select(key).distinct().join(have, key, "left_anti").withColumn("o", order).orderBy("o", key).limit(n).select(key).withColumn("first", F.lit(1))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("first", order, key))  # at most n and those picked
    return have.unionByName(rest).withColumn("place", place).where(F.col("place") <= n).select(key, "place", (F.col("first") == 1).alias("topped_up"))


def aligned_paths(sections: DataFrame, most: int = 3, widest: float = 0.25) -> DataFrame:
    """section_path, uids, widest, differ: paths that sections of several classes share and that speak alike.

    ``sections``: section_uid, section_path, entity, text. Of each class the section of least uid counts,
    of the classes the first ``most`` by their section; alike are those whose content words are all within
    ``widest`` (Jaccard distance). ``differ`` tells whether their first 400 characters do."""
    one = sections.where("section_path IS NOT NULL AND entity IS NOT NULL AND text IS NOT NULL").groupBy("section_path", "entity").agg(F.min(F.struct("section_uid", T.squeeze("text").alias("text"))).alias("s"))
    place = F.row_number().over(Window.partitionBy("section_path").orderBy("s.section_uid"))
    picked = one.withColumn("place", place).where(F.col("place") <= most).select("section_path", "place", "s.section_uid", "s.text", T.content_words("s.text").alias("w"))
    pairs = picked.alias("x").join(picked.alias("y"), (F.col("x.section_path") == F.col("y.section_path")) & (F.col("x.place") < F.col("y.place")))
    per = pairs.groupBy(F.col("x.section_path").alias("section_path")).agg(F.round(F.max(1 - T.jaccard(F.col("x.w"), F.col("y.w"))), 4).alias("widest")).where(F.col("widest") <= widest)
    whole = picked.groupBy("section_path").agg(F.array_join(F.array_sort(F.collect_list("section_uid")), " ").alias("uids"), (F.count_distinct(F.substring("text", 1, 400)) > 1).alias("differ"))
    return per.join(whole, "section_path")
