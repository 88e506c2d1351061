"""Queries on the corpus itself and on golden items: identities, versions, clauses, checks, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import golden, ingest
from lexmill.plans.search_queries import items, live_sections, live_sql
from lexmill.sources.tables import live_rows, read_table


def manifest_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live_rows(read_table(spark, sf_dir, "manifest"), ["doc_id"], "fetched_at", ["url", "doc_type", "sha256", "n_bytes"])


def document_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "manifest").select("doc_id", "url").distinct()
    return rows.select("doc_id", "url", T.canonical_url("url").alias("canonical"), T.document_id("url").alias("url_id"), F.coalesce(F.col("doc_id") == T.document_id("url"), F.lit(False)).alias("agrees"))


def document_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.version_labels(read_table(spark, sf_dir, "manifest"))


def stale_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First against newest fetch of each document: which bytes changed."""
    rows = read_table(spark, sf_dir, "manifest").where("doc_id IS NOT NULL")
    per = rows.groupBy("doc_id").agg(F.min(F.struct("fetched_at", "sha256"))["sha256"].alias("recorded"), F.max(F.struct("fetched_at", "sha256"))["sha256"].alias("now"))
    return per.select("doc_id", "recorded", "now", (~F.col("recorded").eqNullSafe(F.col("now"))).alias("stale"))


def versioned_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections loaded late merged over those loaded before: documents that arrived again are replaced whole."""
    rows = live_rows(read_table(spark, sf_dir, "sections"), ["section_uid"], "made_at", ["doc_id", "ordinal", "loaded_at", "made_at"])
    late = F.col("loaded_at") > F.col("made_at") + F.expr("INTERVAL 7 DAYS")
    merged = ingest.merge_documents(rows.where(~late), rows.where(late))
    return merged.select("section_uid", "doc_id", "ordinal")


def path_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = live_sections(spark, sf_dir).where("section_path IS NOT NULL")
    scope = F.nullif(F.regexp_extract("section_path", r"^(.*)/[^/]*$", 1), F.lit(""))
    parts = rows.select("section_uid", "doc_id", F.col("ordinal").alias("pos"), F.regexp_extract("section_path", r"([^/]*)$", 1).alias("path"), scope.alias("scope"))
    return ingest.dedupe_paths(parts).select("section_uid", "path", "scope", "unique_path")


def clauses_from_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses rebuilt from a reading-order stream of headers and lines of the live sections."""
    rows = live_sections(spark, sf_dir).where("section_path IS NOT NULL")
    number = F.regexp_extract("section_path", r"([^/]*)$", 1)
    head = F.struct(F.lit(0).alias("line"), F.lit("header").alias("kind"), F.concat_ws(" ", number, F.coalesce("heading", F.lit("clause"))).alias("text"))
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda t, i: F.struct((i + 1).alias("line"), F.lit("text").alias("kind"), t.alias("text")))
    flat = rows.select("doc_id", "ordinal", "section_uid", F.explode(F.concat(F.array(head), lines)).alias("l"))
    stream = flat.select("doc_id", F.struct("ordinal", "section_uid", "l.line").alias("item"), "l.kind", "l.text")
    return ingest.sectionise(stream).select("doc_id", "pos", "path", "heading", F.sha2("text", 256).alias("text_sha"))


def section_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = live_sections(spark, sf_dir).select("section_uid", "doc_id", "ordinal", F.concat_ws(" ", "section_path", "heading").alias("label"))
    return ingest.spine(rows).select("section_uid", F.array_join("spine", " | ").alias("spine"))


def section_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.ancestors(live_sections(spark, sf_dir))


def representative_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = live_rows(read_table(spark, sf_dir, "chunks"), ["chunk_id"], "made_at", ["section_uid", "ordinal", F.sha2("text", 256).alias("sha"), F.length("text").alias("chars"), T.token_estimate("text").alias("tokens")])
    first = F.min(F.struct("ordinal", "chunk_id", "sha"))
    return live.where("section_uid IS NOT NULL AND ordinal IS NOT NULL").groupBy("section_uid").agg(first["chunk_id"].alias("chunk_id"), first["sha"].alias("sha"), F.count("*").alias("chunks"), F.sum("chars").alias("chars"), F.sum("tokens").alias("tokens"))


def lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document to versions, sections, chunks and characters."""
    versions = ingest.version_labels(read_table(spark, sf_dir, "manifest")).groupBy("doc_id").agg(F.count("*").alias("versions"))
    sections = live_rows(read_table(spark, sf_dir, "sections"), ["section_uid"], "made_at", ["doc_id", F.length("text").alias("chars")]).groupBy("doc_id").agg(F.count("*").alias("sections"), F.sum("chars").alias("section_chars"))
    chunks = live_rows(read_table(spark, sf_dir, "chunks"), ["chunk_id"], "made_at", ["doc_id"]).groupBy("doc_id").agg(F.count("*").alias("chunks"))
    titles = live_rows(read_table(spark, sf_dir, "manifest"), ["doc_id"], "fetched_at", ["issuer", "doc_type"])
    return titles.join(versions, "doc_id", "left").join(sections, "doc_id", "left").join(chunks, "doc_id", "left").fillna(0, ["versions", "sections", "section_chars", "chunks"])


def scan_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with under 200 characters of text go to recognition; front matter by its path."""
    rows = live_sections(spark, sf_dir).where("doc_id IS NOT NULL")
    per = rows.groupBy("doc_id").agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"), F.min(F.struct("ordinal", "section_uid"))["section_uid"].alias("front"))
    return per.select("doc_id", "chars", (F.col("chars") < 200).alias("route_to_scan"), "front")


def eligible_obligations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = live_sections(spark, sf_dir).where("section_path <> '0' AND NOT contains(section_path, '#') AND length(text) >= 200")
    return rows.select("section_uid", "doc_id", F.col("text").rlike(T.OBLIGATION_PATTERN).alias("binds"))


def title_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = live_rows(read_table(spark, sf_dir, "manifest"), ["doc_id"], "fetched_at", ["title", "filename"])
    return rows.select("doc_id", "title", T.notice_code("title").alias("code"), T.file_slug(F.concat("title", F.lit(".pdf")), 40).alias("slug"))


def golden_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "items").select("id", "question", "answer", "query_type", "gold_spans", "absence_reason")
    return rows.select("id", F.array_join(golden.violations(), ",").alias("violations")).groupBy("id", "violations").agg(F.count("*").alias("rows"))


def span_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = golden.span_states(items(spark, sf_dir), live_sections(spark, sf_dir))
    kept = live_rows(read_table(spark, sf_dir, "checks"), ["item_id"], "checked_at", [F.col("drift").alias("kept")])
    return now.join(kept, now["id"] == kept["item_id"], "left").select("id", "drift", "spans", "moved", "missing", "kept")


def answer_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golden.grounding(items(spark, sf_dir), live_sections(spark, sf_dir))


def clause_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golden.spread(items(spark, sf_dir), live_sections(spark, sf_dir))


def question_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("id", F.array_join(F.when(F.col("query_type") == "negative", F.array().cast("array<string>")).otherwise(T.leak_names("question")), ",").alias("leaks"))


def paragraph_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golden.references(live_sections(spark, sf_dir))


def task_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = live_rows(read_table(spark, sf_dir, "items"), ["id"], "built_at", ["query_type", "status"])
    return golden.task_quota(rows.where("status = 'machine_verified'")).select("id", "query_type", "place")


def page_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = live_rows(read_table(spark, sf_dir, "manifest"), ["doc_id"], "fetched_at", ["n_sections"])
    return golden.stratified_sample(rows, "doc_id", "n_sections", 5).select("doc_id", "bucket", "place")


def candidate_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "candidates").select("candidate_id", "query_type", "band", golden.band("near_dups").alias("due"))
    return rows.groupBy("query_type", "due").agg(F.count("*").alias("n"), F.count(F.when(F.col("band").eqNullSafe(F.col("due")), 1)).alias("agree"))


def harvest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most five newest documents of each source page: the report a crawl shows."""
    rows = live_rows(read_table(spark, sf_dir, "manifest"), ["doc_id"], "fetched_at", ["source_page", "url", "fetched_at"])
    place = F.row_number().over(_window("source_page", F.col("fetched_at").desc_nulls_last(), F.col("doc_id")))
    return rows.where("source_page IS NOT NULL").select("source_page", "doc_id", place.alias("place")).where("place <= 5")


def _window(key, *order):
    from pyspark.sql import Window

    return Window.partitionBy(key).orderBy(*order)


QUERIES = [manifest_latest, document_identity, document_versions, stale_hashes, versioned_upsert, path_dedupe, clauses_from_items, section_spine, section_tree, representative_chunk, lineage, scan_routing, eligible_obligations, title_catalogue, golden_violations, span_drift, answer_grounding, clause_spread, question_leaks, paragraph_references, task_quota, page_sample, candidate_bands, harvest]

# ---- the same in SQL ----------------------------------------------------------------------------

_SEC = f"sec AS (SELECT * FROM {live_sql('sections', 'section_uid')})"
_ITEMS = f"it AS (SELECT * FROM {live_sql('items', 'id', 'built_at')})"
_CHUNKS = f"ch AS (SELECT * FROM {live_sql('chunks', 'chunk_id')})"
_MAN = f"man AS (SELECT * FROM {live_sql('manifest', 'doc_id', 'fetched_at')})"
_VERSIONS = """ver AS (SELECT doc_id, sha256, fetched_at, base || CASE WHEN n > 1 THEN '-' || n ELSE '' END AS version_label FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, base ORDER BY fetched_at, sha256) AS n FROM (
    SELECT doc_id, sha256, fetched_at, coalesce(effective_date::VARCHAR, strftime(fetched_at, '%Y-%m-%d')) AS base FROM manifest WHERE doc_id IS NOT NULL AND sha256 IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY doc_id, sha256 ORDER BY fetched_at, base) = 1)))"""
_CANON = "regexp_replace(trim(url), '[?#;].*$', '')"
_URL = f"lower(regexp_extract({_CANON}, '^([A-Za-z][A-Za-z0-9+.\\-]*://[^/]*)', 1)) || CASE WHEN regexp_replace(regexp_extract({_CANON}, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/]*(.*)$', 1), '/+$', '') = '' THEN '/' ELSE regexp_replace(regexp_extract({_CANON}, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/]*(.*)$', 1), '/+$', '') END"
_HASH = "sha256(trim(regexp_replace(coalesce({0}, ''), '\\s+', ' ', 'g')))"
_WORDS = "list_filter(list_distinct(regexp_extract_all(lower(coalesce({0}, '')), '[a-z]{{4,}}')), lambda x: NOT list_contains(" + repr(T.STOP_WORDS) + ", x))"
_GOLD = "sp AS (SELECT DISTINCT id, g.doc_id || ':' || g.section_path AS section_uid FROM (SELECT id, unnest(gold_spans) AS g FROM it))"
_JACCARD = "CASE WHEN len({0}) = 0 OR len({1}) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect({0}, {1})) / len(list_distinct(list_concat({0}, {1}))) END"

SQL = {
    "manifest_latest": f"WITH {_MAN} SELECT doc_id, url, doc_type, sha256, n_bytes FROM man",
    "document_identity": f"SELECT doc_id, url, c AS canonical, substr(sha256(c), 1, 16) AS url_id, coalesce(doc_id = substr(sha256(c), 1, 16), false) AS agrees FROM (SELECT DISTINCT doc_id, url, {_URL} AS c FROM manifest)",
    "document_versions": f"WITH {_VERSIONS} SELECT * FROM ver",
    "stale_hashes": "SELECT doc_id, arg_min(sha256, (fetched_at, sha256)) AS recorded, arg_max(sha256, (fetched_at, sha256)) AS now, arg_min(sha256, (fetched_at, sha256)) IS DISTINCT FROM arg_max(sha256, (fetched_at, sha256)) AS stale FROM manifest WHERE doc_id IS NOT NULL GROUP BY 1",
    "versioned_upsert": f"WITH {_SEC}, l AS (SELECT * FROM sec WHERE loaded_at > made_at + INTERVAL 7 DAYS) SELECT section_uid, doc_id, ordinal FROM sec WHERE loaded_at <= made_at + INTERVAL 7 DAYS AND doc_id NOT IN (SELECT doc_id FROM l) UNION ALL SELECT section_uid, doc_id, ordinal FROM l",
    "path_dedupe": f"""WITH {_SEC}, p AS (SELECT section_uid, doc_id, ordinal, regexp_extract(section_path, '([^/]*)$', 1) AS path, nullif(regexp_extract(section_path, '^(.*)/[^/]*$', 1), '') AS scope FROM sec WHERE section_path IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, path ORDER BY ordinal) AS nth FROM p), r AS (SELECT section_uid, row_number() OVER (PARTITION BY doc_id, scope, path ORDER BY ordinal) AS k FROM n WHERE nth > 1 AND scope IS NOT NULL)
SELECT section_uid, path, scope, CASE WHEN nth = 1 THEN path WHEN k = 1 THEN scope || '/' || path ELSE path || '#' || ordinal END AS unique_path FROM n LEFT JOIN r USING (section_uid)""",
    "clauses_from_items": f"""WITH {_SEC} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ordinal, section_uid) AS pos, regexp_extract(section_path, '([^/]*)$', 1) AS path, trim(regexp_replace(coalesce(heading, 'clause'), '\\s+', ' ', 'g')) AS heading,
sha256(array_to_string(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), chr(10))) AS text_sha FROM sec WHERE section_path IS NOT NULL AND doc_id IS NOT NULL""",
    "section_spine": f"""WITH {_SEC}, s AS (SELECT section_uid, doc_id, ordinal, concat_ws(' ', section_path, heading) AS label FROM sec WHERE doc_id IS NOT NULL AND ordinal IS NOT NULL)
SELECT a.section_uid, string_agg(b.label, ' | ' ORDER BY b.ordinal, b.label) AS spine FROM s a JOIN s b ON a.doc_id = b.doc_id AND b.ordinal BETWEEN greatest(0, a.ordinal - 2) AND greatest(0, a.ordinal - 2) + 4 GROUP BY 1""",
    "section_tree": f"""WITH {_SEC}, s AS (SELECT section_uid, doc_id, section_path, string_split(section_path, '.') AS parts FROM sec WHERE section_path IS NOT NULL),
a AS (SELECT section_uid, doc_id, n, array_to_string(parts[1:n], '.') AS path FROM (SELECT *, unnest(range(1, len(parts))) AS n FROM s)),
u AS (SELECT a.section_uid, n, s.section_uid AS up FROM a JOIN s ON s.doc_id = a.doc_id AND s.section_path = a.path)
SELECT s.section_uid, coalesce(depth, 0) AS depth, parent_uid FROM (SELECT DISTINCT section_uid FROM s) s LEFT JOIN (SELECT section_uid, count(*) AS depth, arg_max(up, n) AS parent_uid FROM u GROUP BY 1) USING (section_uid)""",
    "representative_chunk": f"WITH {_CHUNKS} SELECT section_uid, arg_min(chunk_id, (ordinal, chunk_id)) AS chunk_id, arg_min(sha256(text), (ordinal, chunk_id)) AS sha, count(*) AS chunks, sum(length(text))::BIGINT AS chars, sum(greatest(1, length(text) // 4))::BIGINT AS tokens FROM ch WHERE section_uid IS NOT NULL AND ordinal IS NOT NULL GROUP BY 1",
    "lineage": f"""WITH {_MAN}, {_SEC}, {_CHUNKS}, {_VERSIONS} SELECT doc_id, issuer, doc_type, coalesce(versions, 0) AS versions, coalesce(sections, 0) AS sections, coalesce(section_chars, 0)::BIGINT AS section_chars, coalesce(chunks, 0) AS chunks FROM man
LEFT JOIN (SELECT doc_id, count(*) AS versions FROM ver GROUP BY 1) USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS sections, sum(length(text)) AS section_chars FROM sec GROUP BY 1) USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS chunks FROM ch GROUP BY 1) USING (doc_id)""",
    "scan_routing": f"WITH {_SEC} SELECT doc_id, coalesce(sum(length(text)), 0)::BIGINT AS chars, coalesce(sum(length(text)), 0) < 200 AS route_to_scan, arg_min(section_uid, (ordinal, section_uid)) AS front FROM sec WHERE doc_id IS NOT NULL GROUP BY 1",
    "eligible_obligations": f"WITH {_SEC} SELECT section_uid, doc_id, regexp_matches(text, '(?i)\\b(shall|must|is required to|are required to|should|may not|shall not)\\b') AS binds FROM sec WHERE section_path <> '0' AND NOT contains(section_path, '#') AND length(text) >= 200",
    "title_catalogue": f"""WITH {_MAN} SELECT doc_id, title, nullif(upper(trim(regexp_replace(regexp_extract(title, '{T.CODE_PATTERN}', 1), '\\s+', ' ', 'g'))), '') AS code,
substr(regexp_replace(title, '[^A-Za-z0-9._\\-]+', '-', 'g'), 1, 36) || '.pdf' AS slug FROM man""",
    "golden_violations": """WITH v AS (SELECT id, len(coalesce(gold_spans, [])) AS n, * EXCLUDE (id) FROM items)
SELECT id, concat_ws(',', CASE WHEN NOT coalesce(regexp_matches(id, '^gs-\\d{4,7}$'), false) THEN 'id' END, CASE WHEN NOT coalesce(length(question) >= 15 AND question LIKE '%?', false) THEN 'question' END, CASE WHEN NOT coalesce(length(answer) >= 2, false) THEN 'answer' END,
CASE WHEN NOT coalesce(query_type IN ('factual_lookup', 'multi_hop', 'comparative', 'temporal', 'negative'), false) THEN 'query_type' END, CASE WHEN query_type = 'negative' AND n > 0 THEN 'negative_with_spans' END, CASE WHEN query_type IS DISTINCT FROM 'negative' AND n = 0 THEN 'grounded_without_spans' END,
CASE WHEN (query_type IS NOT DISTINCT FROM 'negative') <> (absence_reason IS NOT NULL) THEN 'absence_reason' END, CASE WHEN query_type IN ('multi_hop', 'comparative') AND n < 2 THEN 'too_few_spans' END) AS violations, count(*) AS rows FROM v GROUP BY 1, 2""",
    "span_drift": f"""WITH {_SEC}, {_ITEMS}, ck AS (SELECT item_id, drift AS kept FROM {live_sql('checks', 'item_id', 'checked_at')}),
g AS (SELECT id, g.doc_id || ':' || g.section_path AS uid, g.span_sha256 AS h FROM (SELECT id, unnest(gold_spans) AS g FROM it)),
s AS (SELECT g.id, count(*) AS spans, count(*) FILTER (section_uid IS NOT NULL AND {_HASH.format('text')} IS DISTINCT FROM h) AS moved, count(*) FILTER (section_uid IS NULL) AS missing FROM g LEFT JOIN sec ON section_uid = uid GROUP BY 1)
SELECT it.id, CASE WHEN coalesce(missing, 0) > 0 THEN 'missing' WHEN coalesce(moved, 0) > 0 THEN 'moved' ELSE 'resolved' END AS drift, coalesce(spans, 0) AS spans, coalesce(moved, 0) AS moved, coalesce(missing, 0) AS missing, kept FROM it LEFT JOIN s USING (id) LEFT JOIN ck ON item_id = it.id""",
    "answer_grounding": f"""WITH {_SEC}, {_ITEMS}, {_GOLD}, w AS (SELECT id, list_distinct(flatten(list({_WORDS.format('text')}))) AS w FROM sp JOIN sec USING (section_uid) GROUP BY 1),
r AS (SELECT it.id, len(coalesce(gold_spans, [])) AS n, {_WORDS.format('answer')} AS a, {_WORDS.format('question')} AS q, coalesce(w, []) AS w FROM it LEFT JOIN w USING (id))
SELECT id, round(CASE WHEN n = 0 THEN 1.0::DOUBLE WHEN len(a) = 0 THEN 0 ELSE len(list_intersect(a, w)) / len(a) END, 4) AS answer_grounding, round({_JACCARD.format('q', 'w')}, 4) AS vocab_overlap FROM r""",
    "clause_spread": f"""WITH {_SEC}, {_ITEMS}, {_GOLD}, w AS (SELECT id, section_uid, {_WORDS.format('text')} AS w FROM sp JOIN sec USING (section_uid)),
p AS (SELECT a.id, round(max(1 - {_JACCARD.format('a.w', 'b.w')}), 4) AS widest FROM w a JOIN w b ON a.id = b.id AND a.section_uid < b.section_uid GROUP BY 1)
SELECT id, clauses, widest FROM (SELECT id, count(*) AS clauses FROM w GROUP BY 1) LEFT JOIN p USING (id)""",
    "question_leaks": f"WITH {_ITEMS} SELECT id, CASE WHEN query_type = 'negative' THEN '' ELSE concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches(question, '{p}') THEN '{n}' END" for n, p in T.LEAK_PATTERNS.items()) + ") END AS leaks FROM it",
    "paragraph_references": f"""WITH {_SEC}, r AS (SELECT DISTINCT section_uid, doc_id, unnest(regexp_extract_all(text, '(?i)\\bparagraphs?\\s+(\\d{{1,2}}(?:\\.\\d{{1,3}}){{1,3}})', 1)) AS path FROM sec WHERE text IS NOT NULL)
SELECT r.section_uid, path, t.section_uid AS target_uid FROM r LEFT JOIN sec t ON t.doc_id = r.doc_id AND t.section_path = r.path WHERE t.section_uid IS DISTINCT FROM r.section_uid""",
    "task_quota": f"WITH {_ITEMS} SELECT id, query_type, row_number() OVER (PARTITION BY query_type ORDER BY id) AS place FROM it WHERE status = 'machine_verified' QUALIFY place <= CASE query_type WHEN 'factual_lookup' THEN 12 WHEN 'multi_hop' THEN 6 WHEN 'comparative' THEN 4 WHEN 'temporal' THEN 3 WHEN 'negative' THEN 5 END",
    "page_sample": f"WITH {_MAN}, b AS (SELECT doc_id, CASE WHEN n_sections <= 10 THEN 'a' WHEN n_sections <= 50 THEN 'b' WHEN n_sections <= 100 THEN 'c' ELSE 'd' END AS bucket FROM man WHERE n_sections IS NOT NULL) SELECT doc_id, bucket, row_number() OVER (PARTITION BY bucket ORDER BY sha256('42' || doc_id), doc_id) AS place FROM b QUALIFY place <= 5",
    "candidate_bands": "SELECT query_type, due, count(*) AS n, count(*) FILTER (band IS NOT DISTINCT FROM due) AS agree FROM (SELECT *, CASE WHEN near_dups >= 5 THEN 'contested' WHEN near_dups >= 1 THEN 'moderate' WHEN near_dups = 0 THEN 'isolated' END AS due FROM candidates) GROUP BY 1, 2",
    "harvest": f"WITH {_MAN} SELECT source_page, doc_id, row_number() OVER (PARTITION BY source_page ORDER BY fetched_at DESC NULLS LAST, doc_id) AS place FROM man WHERE source_page IS NOT NULL QUALIFY place <= 5",
}
