"""Queries that pick, group and tally: excerpts, documents of a hit list, samples, failure counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import selection
from lexmill.plans import search_queries as S
from lexmill.plans.corpus_queries import _CHUNKS, _ITEMS, _MAN, _SEC
from lexmill.sources.tables import live_rows, read_table

REASONS = ["out_of_scope", "not_stated", "future_rule", "wrong_entity", "invented_detail"]


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.live_sections(spark, sf_dir).withColumnRenamed("section_uid", "uid")


def negative_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    arms = [S._arm(spark, sf_dir, 10), S._arm(spark, sf_dir, 10, 2)]
    rows = selection.excerpts(arms, _units(spark, sf_dir))
    return rows.select("query_id", "uid", "place", F.length("text").alias("chars"))


def documents_of_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = selection.hits_by_document(S._arm(spark, sf_dir, 20), _units(spark, sf_dir))
    return rows.select("query_id", "doc_id", "place", F.array_join("uids", " ").alias("uids"))


def topical_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = S.questions(spark, sf_dir).select("query_id", T.content_words("text").alias("words"))
    rows = read_table(spark, sf_dir, "sections").select(F.col("section_uid").alias("uid"), F.col("made_at").alias("at"), "doc_id", "ordinal", "text")
    return selection.topical_units(S._arm(spark, sf_dir, 8), rows, asked)


def search_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live notices and guidelines in force from 2024 on; a document without a date is excluded."""
    rows = live_rows(read_table(spark, sf_dir, "manifest"), ["doc_id"], "fetched_at", ["issuer", "doc_type", "effective_date"])
    return rows.where("doc_type IN ('notices', 'guidelines') AND effective_date >= DATE'2024-01-01'").select("doc_id", "issuer", "doc_type", F.col("effective_date").cast("string").alias("effective_date"))


def resume_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the manifest that have no live section yet."""
    there = S.live_sections(spark, sf_dir).select("doc_id").distinct()
    return live_rows(read_table(spark, sf_dir, "manifest"), ["doc_id"], "fetched_at", ["filename"]).join(there, "doc_id", "left_anti")


def first_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Norm of the first vector of each label."""
    norm = F.sqrt(F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x))
    rows = read_table(spark, sf_dir, "embeddings").select("label", "vec_id", F.round(norm, 6).alias("norm"))
    return rows.groupBy("label").agg(F.min("vec_id").alias("vec_id"), F.min_by("norm", "vec_id").alias("norm"))


def guideline_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guidelines and the notice that carries the same number in its title; the smaller id on ties."""
    rows = live_rows(read_table(spark, sf_dir, "manifest"), ["doc_id"], "fetched_at", ["title", "doc_type"]).withColumn("code", T.notice_code("title"))
    notices = rows.where("doc_type = 'notices' AND code IS NOT NULL").groupBy("code").agg(F.min("doc_id").alias("notice_id"))
    return rows.where("doc_type = 'guidelines'").join(notices, "code").select("doc_id", "code", "notice_id")


def band_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to six candidates of each band, taking the query types in turn."""
    rows = read_table(spark, sf_dir, "candidates").where("candidate_id IS NOT NULL AND band IS NOT NULL AND query_type IS NOT NULL")
    return selection.interleaved(rows, "band", "query_type", "candidate_id", 6).select("band", "place", "candidate_id", "query_type")


def negative_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.round_robin(live_rows(read_table(spark, sf_dir, "manifest"), ["doc_id"], "fetched_at", ["url"]), "doc_id", REASONS, 35)


def hop_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One resolved reference of each section that has any."""
    from lexmill.operators import golden

    return selection.one_per_source(golden.references(S.live_sections(spark, sf_dir)), "section_uid", "target_uid")


def comparable_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that sections of several issuers share, with their spread of length."""
    issuers = live_rows(read_table(spark, sf_dir, "manifest"), ["doc_id"], "fetched_at", ["issuer"])
    rows = S.live_sections(spark, sf_dir).where("length(text) >= 200").join(issuers, "doc_id")
    return rows.groupBy("section_path").agg(F.count_distinct("issuer").alias("issuers"), F.count("*").alias("sections"), F.min(F.length("text")).alias("shortest"), F.max(F.length("text")).alias("longest")).where("issuers >= 2")


def temporal_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections by the first kind of time they speak of: a date, a period or a recurrence."""
    rows = S.live_sections(spark, sf_dir)
    kind = F.when(F.col("text").rlike(r"\d{1,2} (January|February|March|April|May|June|July|August|September|October|November|December)"), "date").when(F.col("text").rlike(r"within \d+"), "period").when(F.col("text").rlike(r"every \d+|at least \d+ times"), "recurrence")
    return rows.select("section_uid", kind.alias("kind")).where("kind IS NOT NULL").groupBy("kind").agg(F.count("*").alias("n"), F.min("section_uid").alias("first"))


def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty items of least confidence: the report a reviewer opens."""
    rows = live_rows(read_table(spark, sf_dir, "items"), ["id"], "built_at", ["status", "confidence", "human_reviewed"])
    return rows.where("NOT coalesce(human_reviewed, false)").orderBy(F.col("confidence").asc_nulls_last(), "id").limit(20).select("id", "status", "confidence")


def calibration_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty tasks to judge by hand: those where an abstention is contested first."""
    rows = live_rows(read_table(spark, sf_dir, "answer_rows"), ["arm", "task_id"], "made_at", ["abstained", "must_abstain", "refusal_marker"])
    contested = F.coalesce(F.col("abstained") != F.col("must_abstain"), F.lit(False)) | F.coalesce(F.col("abstained") != F.col("refusal_marker"), F.lit(False))
    return rows.withColumn("contested", contested).orderBy(F.col("contested").desc(), "task_id", "arm").limit(20).select("arm", "task_id", "contested")


def check_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures of the kept checks by name; an unknown outcome is no failure."""
    rows = live_rows(read_table(spark, sf_dir, "checks"), ["item_id"], "checked_at", ["drift", "leaks", "answer_grounding", "entity_named", "judge_answerable"])
    leaks = F.transform(F.coalesce("leaks", F.array().cast("array<string>")), lambda _: F.lit("leak"))
    names = [F.when(F.col("drift") != "resolved", F.concat(F.lit("span_"), F.col("drift"))), F.when(F.col("answer_grounding") < 0.25, F.lit("answer_grounding")), F.when(F.col("entity_named").eqNullSafe(F.lit(False)), F.lit("entity_not_named")), F.when(F.col("judge_answerable").eqNullSafe(F.lit(False)), F.lit("not_answerable"))]
    return rows.select(F.explode(F.concat(F.array_compact(F.array(*names)), leaks)).alias("failure")).groupBy("failure").agg(F.count("*").alias("n"))


def build_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of each document type: how many, their median and 95th percentile length, and how many a section."""
    kinds = live_rows(read_table(spark, sf_dir, "manifest"), ["doc_id"], "fetched_at", ["doc_type"])
    rows = live_rows(read_table(spark, sf_dir, "chunks"), ["chunk_id"], "made_at", ["doc_id", "section_uid", F.length("text").alias("chars")]).join(kinds, "doc_id")
    from lexmill.operators.metrics import nearest_rank

    return rows.groupBy("doc_type").agg(F.count("*").alias("chunks"), F.percentile("chars", 0.5).alias("median_chars"), nearest_rank("chars", 0.95).cast("double").alias("p95_chars"), F.round(F.count("*") / F.count_distinct("section_uid"), 4).alias("per_section"))


def minimum_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept minimum of tool calls against one more than the distinct gold documents."""
    rows = live_rows(read_table(spark, sf_dir, "answer_rows"), ["arm", "task_id"], "made_at", ["min_tool_calls", "gold_doc_ids"])
    due = 1 + F.size(F.array_distinct(F.coalesce("gold_doc_ids", F.array().cast("array<string>"))))
    return rows.select("min_tool_calls", due.alias("due")).groupBy("min_tool_calls", "due").agg(F.count("*").alias("n"))


QUERIES = [negative_excerpts, documents_of_hits, topical_clauses, search_filter, resume_scan, first_vectors, guideline_parents, band_picks, negative_seeds, hop_picks, comparable_paths, temporal_buckets, review_queue, calibration_picks, check_tally, build_stats, minimum_calls]

# ---- the same in SQL ----------------------------------------------------------------------------

_WORDS = "list_filter(list_distinct(regexp_extract_all(lower(coalesce({0}, '')), '[a-z]{{4,}}')), lambda x: NOT list_contains(" + repr(T.STOP_WORDS) + ", x))"
_BINDS = "regexp_matches(text, '(?i)\\b(shall|must|is required to|are required to|should|may not|shall not)\\b')"
_CODE = f"nullif(upper(trim(regexp_replace(regexp_extract(title, '{T.CODE_PATTERN}', 1), '\\s+', ' ', 'g'))), '')"
_ANS = "ans AS (SELECT * FROM answer_rows WHERE arm IS NOT NULL AND task_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY arm, task_id ORDER BY made_at DESC NULLS LAST) = 1)"
_CHECKS = f"ck AS (SELECT * FROM {S.live_sql('checks', 'item_id', 'checked_at')})"
_REASONS = "[" + ", ".join(f"'{r}'" for r in REASONS) + "]"

SQL = {
    "negative_excerpts": f"""WITH {S._BASE}, {S._bm25_sql('p1', 10)}, {S._bm25_sql('p2', 10, terms=S._PAIRS)}, u AS (SELECT query_id, uid, min(a * 1000 + rank) AS spot FROM (SELECT 0 AS a, query_id, uid, rank FROM p1 UNION ALL SELECT 1, query_id, uid, rank FROM p2) GROUP BY 1, 2),
k AS (SELECT query_id, uid, row_number() OVER (PARTITION BY query_id ORDER BY spot, uid) AS place FROM u QUALIFY place <= 12)
SELECT query_id, uid, place, CASE WHEN length(text) > 6000 THEN 6000 + length(' [cut at 6000 of ' || length(text) || ']') ELSE length(text) END AS chars FROM k JOIN sec USING (uid)""",
    "documents_of_hits": f"""WITH {S._BASE}, {S._bm25_sql('p', 20)}, g AS (SELECT query_id, doc_id, min(rank) AS first, string_agg(uid, ' ' ORDER BY rank) AS uids FROM p JOIN sec USING (uid) WHERE doc_id IS NOT NULL GROUP BY 1, 2)
SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY first, doc_id) AS place, uids FROM g QUALIFY place <= 4""",
    "topical_clauses": f"""WITH {S._BASE}, {S._bm25_sql('p', 8)}, so AS (SELECT section_uid AS uid, doc_id, ordinal, text FROM {S.live_sql('sections', 'section_uid')}), h AS (SELECT query_id, doc_id, uid, rank FROM p JOIN so USING (uid)), qw AS (SELECT query_id, {_WORDS.format('text')} AS w FROM q),
f AS (SELECT d.query_id, so.doc_id, so.uid, len(list_filter(w, lambda x: contains(lower(so.text), x))) AS n, ordinal FROM (SELECT DISTINCT query_id, doc_id FROM h) d JOIN qw USING (query_id) JOIN so ON so.doc_id = d.doc_id WHERE {_BINDS.replace('text', 'so.text')}),
b AS (SELECT query_id, doc_id, uid, 0 AS src, 0 AS less, rank FROM h UNION ALL SELECT query_id, doc_id, uid, 1, -n, ordinal FROM f WHERE n >= 2),
m AS (SELECT query_id, doc_id, uid, min((src, less, rank)) AS spot FROM b GROUP BY 1, 2, 3)
SELECT query_id, doc_id, uid, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY spot, uid) AS place FROM m QUALIFY place <= 6""",
    "search_filter": f"WITH {_MAN} SELECT doc_id, issuer, doc_type, effective_date::VARCHAR AS effective_date FROM man WHERE doc_type IN ('notices', 'guidelines') AND effective_date >= DATE '2024-01-01'",
    "resume_scan": f"WITH {_MAN} SELECT doc_id, filename FROM man WHERE doc_id NOT IN (SELECT doc_id FROM sections WHERE doc_id IS NOT NULL AND section_uid IS NOT NULL)",
    "first_vectors": "SELECT label, min(vec_id) AS vec_id, arg_min(round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6), vec_id) AS norm FROM embeddings GROUP BY 1",
    "guideline_parents": f"WITH {_MAN}, c AS (SELECT doc_id, doc_type, {_CODE} AS code FROM man), n AS (SELECT code, min(doc_id) AS notice_id FROM c WHERE doc_type = 'notices' AND code IS NOT NULL GROUP BY 1) SELECT doc_id, code, notice_id FROM c JOIN n USING (code) WHERE doc_type = 'guidelines'",
    "band_picks": "WITH t AS (SELECT *, row_number() OVER (PARTITION BY band, query_type ORDER BY sha256('42' || candidate_id), candidate_id) AS turn FROM candidates WHERE candidate_id IS NOT NULL AND band IS NOT NULL AND query_type IS NOT NULL) SELECT band, row_number() OVER (PARTITION BY band ORDER BY turn, query_type, candidate_id) AS place, candidate_id, query_type FROM t QUALIFY place <= 6",
    "negative_seeds": f"""WITH {_MAN}, f AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('42' || doc_id), doc_id) - 1 AS spot FROM man QUALIFY spot < 35), n AS (SELECT *, count(*) OVER () AS total FROM f)
SELECT doc_id, seed, {_REASONS}[seed % 5 + 1] AS reason FROM (SELECT doc_id, unnest(range(spot, 35, total)) AS seed FROM n)""",
    "hop_picks": f"""WITH {_SEC}, r AS (SELECT DISTINCT section_uid, doc_id, unnest(regexp_extract_all(text, '(?i)\\bparagraphs?\\s+(\\d{{1,2}}(?:\\.\\d{{1,3}}){{1,3}})', 1)) AS path FROM sec WHERE text IS NOT NULL),
e AS (SELECT r.section_uid, t.section_uid AS target_uid FROM r JOIN sec t ON t.doc_id = r.doc_id AND t.section_path = r.path WHERE t.section_uid <> r.section_uid)
SELECT section_uid, target_uid FROM e QUALIFY row_number() OVER (PARTITION BY section_uid ORDER BY sha256('42' || section_uid || '|' || target_uid), target_uid) = 1""",
    "comparable_paths": f"WITH {_SEC}, {_MAN} SELECT section_path, count(DISTINCT issuer) AS issuers, count(*) AS sections, min(length(text)) AS shortest, max(length(text)) AS longest FROM sec JOIN man USING (doc_id) WHERE length(text) >= 200 GROUP BY 1 HAVING count(DISTINCT issuer) >= 2",
    "temporal_buckets": f"""WITH {_SEC}, k AS (SELECT section_uid, CASE WHEN regexp_matches(text, '\\d{{1,2}} (January|February|March|April|May|June|July|August|September|October|November|December)') THEN 'date' WHEN regexp_matches(text, 'within \\d+') THEN 'period' WHEN regexp_matches(text, 'every \\d+|at least \\d+ times') THEN 'recurrence' END AS kind FROM sec)
SELECT kind, count(*) AS n, min(section_uid) AS first FROM k WHERE kind IS NOT NULL GROUP BY 1""",
    "review_queue": f"WITH {_ITEMS} SELECT id, status, confidence FROM it WHERE NOT coalesce(human_reviewed, false) ORDER BY confidence NULLS LAST, id LIMIT 20",
    "calibration_picks": f"WITH {_ANS}, c AS (SELECT *, coalesce(abstained <> must_abstain, false) OR coalesce(abstained <> refusal_marker, false) AS contested FROM ans) SELECT arm, task_id, contested FROM c ORDER BY contested DESC, task_id, arm LIMIT 20",
    "check_tally": f"""WITH {_CHECKS} SELECT failure, count(*) AS n FROM (SELECT CASE WHEN drift <> 'resolved' THEN 'span_' || drift END AS failure FROM ck UNION ALL SELECT CASE WHEN answer_grounding < 0.25 THEN 'answer_grounding' END FROM ck UNION ALL SELECT CASE WHEN entity_named IS NOT DISTINCT FROM false THEN 'entity_not_named' END FROM ck
UNION ALL SELECT CASE WHEN judge_answerable IS NOT DISTINCT FROM false THEN 'not_answerable' END FROM ck UNION ALL SELECT 'leak' FROM (SELECT unnest(leaks) FROM ck)) WHERE failure IS NOT NULL GROUP BY 1""",
    "build_stats": f"WITH {_CHUNKS}, {_MAN} SELECT doc_type, count(*) AS chunks, quantile_cont(length(text), 0.5) AS median_chars, quantile_disc(length(text), 0.95)::DOUBLE AS p95_chars, round(count(*) / count(DISTINCT section_uid), 4) AS per_section FROM ch JOIN man USING (doc_id) GROUP BY 1",
    "minimum_calls": f"WITH {_ANS} SELECT min_tool_calls, 1 + len(list_distinct(coalesce(gold_doc_ids, []))) AS due, count(*) AS n FROM ans GROUP BY 1, 2",
}
