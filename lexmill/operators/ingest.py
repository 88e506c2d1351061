"""From manifests and reading-order items to versions, clauses and outlines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators.ordered import in_slices, running

NUMBER = r"^(\d{1,2}(?:\.\d{1,3}){0,3})\.?$"
HEADER = r"^(\d{1,2}(?:\.\d{1,3}){0,3})\.?\s+(\S.*)$"


def version_labels(manifest: DataFrame) -> DataFrame:
    """doc_id, sha256, version_label, fetched_at: one row per distinct content of a document.

    A version is minted at the first fetch of its bytes; its label is the effective date, else the
    fetch date, with -2, -3 ... from the second version of a label on. Null ids or hashes mint none."""
    first = manifest.where("doc_id IS NOT NULL AND sha256 IS NOT NULL").groupBy("doc_id", "sha256").agg(F.min(F.struct("fetched_at", F.coalesce(F.col("effective_date").cast("string"), F.date_format("fetched_at", "yyyy-MM-dd")).alias("base"))).alias("v"))
    rows = first.select("doc_id", "sha256", "v.fetched_at", "v.base")
    n = F.row_number().over(Window.partitionBy("doc_id", "base").orderBy("fetched_at", "sha256"))
    return rows.select("doc_id", "sha256", F.concat("base", F.when(n > 1, F.concat(F.lit("-"), n.cast("string"))).otherwise("")).alias("version_label"), "fetched_at")


def merge_documents(stored: DataFrame, arrived: DataFrame, key: str = "doc_id") -> DataFrame:
    """Upsert by key: stored rows whose key did not arrive, and the arrived rows."""
    return stored.join(arrived.select(key).distinct(), key, "left_anti").unionByName(arrived)


def dedupe_paths(sections: DataFrame) -> DataFrame:
    """Unique paths within a document: the first bare, a repeat below its scope, a further one with
    its position.

    ``sections``: doc_id, pos, path, scope (nullable). Adds ``unique_path``; positions count from 0."""
    bare = F.row_number().over(Window.partitionBy("doc_id", "path").orderBy("pos"))
    rows = sections.withColumn("nth", bare)
    scoped = F.row_number().over(Window.partitionBy("doc_id", "scope", "path").orderBy("pos"))
    repeats = rows.where((F.col("nth") > 1) & F.col("scope").isNotNull()).withColumn("in_scope", scoped)
    rest = rows.where((F.col("nth") == 1) | F.col("scope").isNull()).withColumn("in_scope", F.lit(None).cast("int"))
    path = F.when(F.col("nth") == 1, F.col("path")).when(F.col("in_scope") == 1, F.concat_ws("/", "scope", "path")).otherwise(F.concat_ws("#", "path", "pos"))
    return rest.unionByName(repeats).withColumn("unique_path", path).drop("nth", "in_scope")


def sectionise(items: DataFrame) -> DataFrame:
    """Clauses from reading-order items: doc_id, pos, path, heading, scope, text.

    ``items``: doc_id, item (order), kind (header, list, text, furniture), text. A numbered header or
    list item opens a clause; an unnumbered header sets the scope and opens one without a number,
    path ``0`` before any number; everything else is text of the clause it follows. Page furniture
    is left out. A clause without text keeps an empty one."""
    rows = items.where("doc_id IS NOT NULL AND kind <> 'furniture'").withColumn("t", T.squeeze(F.coalesce("text", F.lit(""))))
    number = F.when(F.col("kind") == "header", F.coalesce(F.nullif(F.regexp_extract("t", HEADER, 1), F.lit("")), F.nullif(F.regexp_extract("t", NUMBER, 1), F.lit("")))).when(F.col("kind") == "list", F.nullif(F.regexp_extract("t", HEADER, 1), F.lit("")))
    title = F.when(F.col("kind") == "header", F.when(number.isNotNull(), F.nullif(F.regexp_extract("t", HEADER, 2), F.lit(""))).otherwise(F.col("t")))
    rows = rows.withColumn("number", number).withColumn("title", title)
    opens = F.col("number").isNotNull() | (F.col("kind") == "header")
    # Clauses are numbered by a running sum in slices, so that a document of any length is spread over the tasks.
    rows = in_slices(rows.withColumn("opens", opens), ["doc_id"], ["item"], "clauses")
    named = F.when((F.col("kind") == "header") & F.col("number").isNull(), F.substring("t", 1, 40))
    rows = running(rows.drop("scope", "section"), ["doc_id"], ["item"], {"section": F.col("opens").cast("int")}, {"scope": named}).withColumn("section", F.col("section").cast("long"))
    body = F.when(~F.col("opens"), F.col("t")).when((F.col("kind") == "list"), F.regexp_extract("t", HEADER, 2))
    parts = F.transform(F.array_sort(F.collect_list(F.when(body.isNotNull(), F.struct("item", body.alias("b"))))), lambda p: p["b"])
    return rows.groupBy("doc_id", "section").agg(
        F.coalesce(F.max("number"), F.lit("0")).alias("path"), F.max("title").alias("heading"), F.max(F.when(F.col("opens") | (F.col("section") == 0), F.col("scope"))).alias("scope"), F.concat_ws("\n", parts).alias("text"),
    ).withColumnRenamed("section", "pos")


def spine(sections: DataFrame, width: int = 5) -> DataFrame:
    """section_uid, spine: the labels two before to two after each clause; the first ``width`` at the head.

    ``sections``: section_uid, doc_id, ordinal, label. Neighbours come by an equi-join on document and
    ordinal, so a document of any length is spread over the tasks."""
    rows = sections.where("section_uid IS NOT NULL AND doc_id IS NOT NULL AND ordinal IS NOT NULL")
    first = F.greatest(F.lit(0), F.col("ordinal") - 2)
    wanted = rows.select("section_uid", "doc_id", F.explode(F.sequence(first, first + width - 1)).alias("ordinal"))
    near = wanted.join(rows.select("doc_id", "ordinal", "label"), ["doc_id", "ordinal"])
    return near.groupBy("section_uid").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "label"))), lambda x: x["label"]).alias("spine"))


def ancestors(sections: DataFrame) -> DataFrame:
    """section_uid, depth, parent_uid: existing sections above each path of dotted numbers.

    ``sections``: section_uid, doc_id, section_path. Each path is expanded to its prefixes, which
    are matched by an equi-join; nothing recurses."""
    rows = sections.where("section_uid IS NOT NULL AND section_path IS NOT NULL")
    parts = F.split("section_path", r"\.")
    cuts = F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>"))
    above = rows.select("section_uid", "doc_id", F.explode(F.transform(cuts, lambda n: F.struct(n.alias("n"), F.array_join(F.slice(parts, F.lit(1), n), ".").alias("path")))).alias("a"))
    there = above.select("section_uid", "doc_id", "a.n", F.col("a.path").alias("section_path")).join(rows.select("doc_id", "section_path", F.col("section_uid").alias("up")), ["doc_id", "section_path"])
    found = there.groupBy("section_uid").agg(F.count("*").alias("depth"), F.max_by("up", "n").alias("parent_uid"))
    return rows.select("section_uid").distinct().join(found, "section_uid", "left").select("section_uid", F.coalesce("depth", F.lit(0)).alias("depth"), "parent_uid")
