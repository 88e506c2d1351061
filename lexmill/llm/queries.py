"""Queries of the training-text operators over the tables of a scale-factor folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import abuse, boundaries, mixing, neardup, packing, pairs, scans, spans
from lexmill.sources.tables import live_rows, read_table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    sections = boundaries.boundary_findings(read_table(spark, sf_dir, "sections"), "section_uid", "made_at")
    chunks = read_table(spark, sf_dir, "chunks")
    units = boundaries.boundary_findings(chunks, "chunk_id", "made_at")
    found = sections.withColumnRenamed("section_uid", "unit_id").unionByName(units.withColumnRenamed("chunk_id", "unit_id"))
    return found.unionByName(boundaries.ordinal_findings(chunks))


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = live_rows(read_table(spark, sf_dir, "sections"), ["section_uid"], "made_at", ["doc_id", "text"])
    pieces = boundaries.split_oversized(live)
    return pieces.select(F.concat_ws("#", "section_uid", "ordinal").alias("chunk_id"), "doc_id", "section_uid", "ordinal", "text", F.length("text").alias("char_len"))


def _alike(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return neardup.near_duplicates(read_table(spark, sf_dir, "chunks"), "chunk_id", "doc_id", "made_at", n=3, similarity=0.6)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.linked_keys(*_alike(spark, sf_dir)).select(F.col("left").alias("chunk_a"), F.col("right").alias("chunk_b"))


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each live chunk that is alike to or equals another one, with its class, group and links."""
    members, links = _alike(spark, sf_dir)
    roots = neardup.components(links)
    ends = links.select(F.col("a1").alias("d1"), F.col("a2").alias("d2")).union(links.select("b1", "b2"))
    degree = ends.groupBy("d1", "d2").agg(F.count("*").alias("n_links"))
    sizes = members.groupBy("d1", "d2").agg(F.count("*").alias("copies"), F.min("key").alias("class_id"))
    classes = sizes.join(degree, ["d1", "d2"], "left").join(roots, ["d1", "d2"], "left").where("copies > 1 OR n_links > 0")
    classes = classes.withColumn("root", F.coalesce("root", F.struct("d1", "d2")))
    names = classes.groupBy("root").agg(F.min("class_id").alias("group_id"))
    classes = classes.join(names, "root").select("d1", "d2", "class_id", "group_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return members.join(classes, ["d1", "d2"]).select(F.col("key").alias("chunk_id"), "class_id", "group_id", "n_links")


def p2_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kept counts of near-duplicates beside those found: sections of other documents that have
    a chunk alike to one of the candidate's, or of any gold section of the item."""
    members, links = _alike(spark, sf_dir)
    members = members.withColumn("section", F.regexp_extract("key", r"^(.*)#[^#]*$", 1))
    candidates = read_table(spark, sf_dir, "candidates").where("candidate_id IS NOT NULL").select(F.lit("candidate").alias("kind"), F.col("candidate_id").cast("string").alias("id"), F.col("near_dups").alias("kept"), F.array("primary_uid").alias("uids"))
    items = live_rows(read_table(spark, sf_dir, "items"), ["id"], "built_at", ["gold_spans", F.col("near_duplicates_at_0_10").alias("kept")])
    items = items.select(F.lit("item").alias("kind"), "id", "kept", F.transform("gold_spans", lambda g: F.concat_ws(":", g["doc_id"], g["section_path"])).alias("uids"))
    asked = candidates.unionByName(items)
    name = F.concat_ws("|", "kind", "id")
    found = neardup.alike_sections(members, links, asked.select(name.alias("id"), F.explode("uids").alias("section"))).withColumnRenamed("id", "name")
    return asked.select("kind", "id", "kept", name.alias("name")).join(found, "name", "left").select("kind", "id", "kept", F.coalesce("found", F.lit(0)).alias("found"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.defective_pairs(read_table(spark, sf_dir, "answer_rows"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = read_table(spark, sf_dir, "chunks").select(F.col("chunk_id").alias("key"), F.col("section_uid").alias("grp"), F.col("made_at").alias("at"), "text")
    return chunks.union(read_table(spark, sf_dir, "items").select("id", F.lit(None).cast("string"), "built_at", "question"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs_ = spans.shared_pairs(*spans.shared_spans(_records(spark, sf_dir)))
    return pairs_.select(F.col("left").alias("record_a"), F.col("right").alias("record_b")).distinct()


def p4_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each record stands elsewhere: (record, chars, shared_chars, share)."""
    return spans.shared_share(_records(spark, sf_dir)).withColumnRenamed("key", "record")


def p4_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items whose question shares a long span with a chunk, beside what the checks report."""
    members, found = spans.shared_spans(_records(spark, sf_dir))
    is_item = F.col("key").startswith("gs-")
    per = spans.partners(members.where(is_item), members.where(~is_item), found)
    checks = live_rows(read_table(spark, sf_dir, "checks"), ["item_id"], "checked_at", ["leaks"])
    both = checks.join(per.select(F.col("key").alias("item_id"), F.col("partners").alias("chunks")), "item_id", "full")
    reported = F.coalesce(F.size("leaks") > 0, F.lit(False))
    return both.select("item_id", reported.alias("reported"), (F.coalesce("chunks", F.lit(0)) > 0).alias("found"), F.coalesce("chunks", F.lit(0)).alias("chunks"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.scan_noise(read_table(spark, sf_dir, "sections"), read_table(spark, sf_dir, "manifest"))


def p5_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.repaired_sections(read_table(spark, sf_dir, "sections"), read_table(spark, sf_dir, "manifest"))


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "containers"))


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill(p6_containers(spark, sf_dir), read_table(spark, sf_dir, "containers"))


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A mixture as large as the texts of all listed sources together; short sources stay at their cap."""
    return mixing.mix(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "mix_targets"), of_listed=1.0)


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[1]


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.unsafe_documents(read_table(spark, sf_dir, "documents"))


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.content_scores(read_table(spark, sf_dir, "documents"))


def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.source_rates(read_table(spark, sf_dir, "documents"))


def queries() -> dict:
    own = (p1_found, p1_pieces, p2_found, p2_groups, p2_counts, p3_found, p4_found, p4_shares, p4_leaks, p5_found, p5_repaired, p6_containers, p6_fill, p7_mixture, p7_shares, p8_found, p8_scores, p8_rates)
    return {f.__name__: f for f in own}
