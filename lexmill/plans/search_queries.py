"""Search, fusion, evaluation and sweep queries over sections, items and embeddings.

Queries of a search are the items whose number is divisible by 20; they are held against all live
sections. Vector queries are the embeddings whose id is divisible by 20, held against all rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import context, fusion, lexical, metrics, vector
from lexmill.sources.tables import live_rows, read_table

K = 20
NEAR = 0.45  # cosine distance of near groups among the test vectors


def live_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live_rows(read_table(spark, sf_dir, "sections"), ["section_uid"], "made_at", ["doc_id", "section_path", "heading", "ordinal", "text"])


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live_rows(read_table(spark, sf_dir, "items"), ["id"], "built_at", ["question", "answer", "query_type", "gold_spans"])


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir).where(F.try_to_number(F.substring("id", 4, 20), F.lit("99999999999999999999")) % 20 == 0)
    return rows.select(F.col("id").alias("query_id"), F.col("question").alias("text"), "query_type", "gold_spans")


def gold_of(asked: DataFrame) -> DataFrame:
    return asked.select("query_id", F.explode("gold_spans").alias("g")).select("query_id", F.concat_ws(":", "g.doc_id", "g.section_path").alias("uid"))


def _body(sections: DataFrame):
    return F.concat_ws(" ", F.coalesce("heading", F.lit("")), F.coalesce("text", F.lit("")))


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of the sections in lower case: the search itself divides them and picks the newest, by narrow rows."""
    sections = read_table(spark, sf_dir, "sections")
    return sections.select(F.col("section_uid").alias("uid"), "made_at", F.lower(_body(sections)).alias("terms"))


def _arm(spark: SparkSession, sf_dir: str, k: int, width: int = 1) -> DataFrame:
    """Search by single words, or with ``width`` 2 by word pairs."""
    asked = questions(spark, sf_dir).select("query_id", (T.tokens if width == 1 else T.bigrams)("text").alias("terms"))
    return lexical.bm25(_units(spark, sf_dir), asked, k, at="made_at", width=width)


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _arm(spark, sf_dir, K)


def bm25_chunk_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = live_rows(read_table(spark, sf_dir, "chunks"), ["chunk_id"], "made_at", ["section_uid", "ordinal"])
    return lexical.spread_to_chunks(_arm(spark, sf_dir, K), chunks, K)


def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    arms = [_arm(spark, sf_dir, fusion.POOL), _arm(spark, sf_dir, fusion.POOL, 2)]
    return fusion.reciprocal_ranks(arms, K)


def rerank_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = questions(spark, sf_dir).select("query_id", T.content_words("text").alias("q_words"))
    words = live_sections(spark, sf_dir).select(F.col("section_uid").alias("uid"), T.content_words("text").alias("s_words"))
    rows = _arm(spark, sf_dir, 70).join(asked, "query_id").join(words, "uid")
    return fusion.rerank(rows, T.jaccard(F.col("q_words"), F.col("s_words")), 60)


def decomposed_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = fusion.sub_questions(questions(spark, sf_dir)).select(F.concat_ws("|", "query_id", "part").alias("query_id"), T.tokens("text").alias("terms"))
    ranked = lexical.bm25(_units(spark, sf_dir), parts, fusion.POOL, at="made_at")
    split = ranked.select(F.split_part("query_id", F.lit("|"), F.lit(1)).alias("query_id"), F.split_part("query_id", F.lit("|"), F.lit(2)).cast("int").alias("part"), "uid", "rank")
    return fusion.fuse_parts(split, K)


def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = live_sections(spark, sf_dir).select(F.col("section_uid").alias("uid"), F.concat_ws(" · clause ", "heading", "section_path").alias("label"), "text")
    return context.assemble(_arm(spark, sf_dir, context.TOP), texts)


def _configs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Ranked lists of every configuration, and the questions."""
    asked = questions(spark, sf_dir)
    # Each arm is searched once; its list is short, staged and read three times.
    arms = [_arm(spark, sf_dir, fusion.POOL, width) for width in (1, 2)]
    lists = {"terms": arms[0].where(F.col("rank") <= K), "bigrams": arms[1].where(F.col("rank") <= K), "fused": fusion.reciprocal_ranks(arms, K)}
    ranked = reduce(DataFrame.unionByName, [r.select(F.lit(c).alias("config"), "query_id", "uid", "rank") for c, r in lists.items()])
    return ranked, asked


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked, asked = _configs(spark, sf_dir)
    each = asked.select(F.explode(F.array(F.lit("terms"), F.lit("bigrams"), F.lit("fused"))).alias("config"), "query_id")
    return metrics.ranking_metrics(ranked, each, gold_of(asked)).join(asked.select("query_id", "query_type"), "query_id")


def ranking_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _metrics(spark, sf_dir)
    return rows.select("config", "query_id", "query_type", "n_gold", *[F.round(m, 9).alias(m) for m in metrics.METRICS])


def sweep_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.sweep(_metrics(spark, sf_dir).where("n_gold > 0"))


def saturation_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether both single arms exceed 0.80 in hit@5, by query type and overall."""
    rows = _metrics(spark, sf_dir).where("n_gold > 0 AND config <> 'fused'")
    arms = rows.groupingSets([["query_type"], []], "query_type").agg(*[F.round(F.avg(F.when(F.col("config") == c, F.col("hit_5"))), 4).alias(f"{c}_hit_5") for c in ("terms", "bigrams")])
    return arms.withColumn("saturated", F.least("terms_hit_5", "bigrams_hit_5") > 0.80)


def displacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The list of single terms is searched once: its first K are the ones before, and it is an arm of the fused one.
    arms = [_arm(spark, sf_dir, fusion.POOL, width) for width in (1, 2)]
    return metrics.displacement(arms[0].where(F.col("rank") <= K), fusion.reciprocal_ranks(arms, K), gold_of(questions(spark, sf_dir)))


def switch_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MRR deltas of each configuration against single terms; flat within one question's weight."""
    table = metrics.sweep(_metrics(spark, sf_dir).where("n_gold > 0")).select("config", F.coalesce("query_type", F.lit("all")).alias("query_type"), "n", "mrr")
    base = table.where("config = 'terms'").select("query_type", F.col("mrr").alias("base"))
    rows = table.where("config <> 'terms'").join(base, "query_type")
    delta = F.round(F.col("mrr") - F.col("base"), 4)
    verdict = F.when(F.abs(delta) <= 1 / F.col("n"), "flat").when(delta > 0, "helps").otherwise("hurts")
    return rows.select("config", "query_type", "n", delta.alias("delta"), verdict.alias("verdict"))


def baseline_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of the fused run against single terms as the baseline: fails where one falls."""
    table = metrics.sweep(_metrics(spark, sf_dir).where("n_gold > 0")).where("query_type IS NULL")
    long = table.unpivot(["config"], metrics.METRICS, "metric", "value")
    base, now = (long.where(F.col("config") == c).select("metric", F.col("value").alias(n)) for c, n in (("terms", "baseline"), ("fused", "now")))
    return base.join(now, "metric").select("metric", "baseline", "now", (F.col("now") < F.col("baseline") - 0.005).alias("failed"))


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("uid"), F.col("label").alias("grp"), F.col("embedding").cast("array<double>").alias("vec"))
    return rows, rows.where("uid % 20 = 0").withColumnRenamed("uid", "query_id")


def dense_rollup_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector.dense_top(*_vectors(spark, sf_dir), 5, roll_up=True)


def dense_chunk_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector.dense_top(*_vectors(spark, sf_dir), K, roll_up=False)


INDEX = (32, 21)  # cells, probes: the test vectors have little structure, so many cells must be looked into


def dense_index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of the index at 20 against the exact search over the same queries and all rows."""
    corpus, queries = _vectors(spark, sf_dir)
    exact = vector.dense_top(corpus, queries, K, roll_up=False).select("query_id", "uid")
    found = vector.dense_top(corpus, queries, K, roll_up=False, index=INDEX).select("query_id", "uid", F.lit(1).alias("there"))
    return exact.join(found, ["query_id", "uid"], "left").agg(F.count("*").alias("wanted"), F.count("there").alias("found")).withColumn("enough", F.col("found") >= 0.9 * F.col("wanted"))


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector.near_groups(*_vectors(spark, sf_dir), NEAR, 50)


QUERIES = [bm25_topk, bm25_chunk_units, hybrid_rrf, rerank_window, decomposed_rrf, context_budget, ranking_metrics, sweep_aggregate, saturation_gate, displacement, switch_verdicts, baseline_gate, dense_rollup_topk, dense_chunk_topk, dense_index_recall, near_duplicates]

# ---- the same in SQL ----------------------------------------------------------------------------


def live_sql(table: str, key: str, at: str = "made_at") -> str:
    return f"(SELECT * FROM {table} WHERE {key} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY {at} DESC NULLS LAST) = 1)"


_BASE = f"""sec AS (SELECT section_uid AS uid, doc_id, section_path, heading, text, coalesce(heading, '') || ' ' || coalesce(text, '') AS body FROM {live_sql("sections", "section_uid")}),
q AS (SELECT id AS query_id, question AS text, query_type, gold_spans FROM {live_sql("items", "id", "built_at")} WHERE try_cast(substr(id, 4) AS BIGINT) % 20 = 0),
sec_t AS (SELECT uid, list_filter(string_split_regex(lower(body), '[^a-z]+'), lambda x: length(x) >= 2) AS t FROM sec),
q_t AS (SELECT query_id, list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: length(x) >= 2) AS t FROM q)"""
_PAIRS = "list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])"


def _bm25_sql(name: str, k: int, units: str = "sec_t", asked: str = "q_t", terms: str = "t") -> str:
    return f"""{name}_u AS (SELECT uid, {terms} AS t FROM {units}), {name}_n AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM {name}_u),
{name}_a AS (SELECT DISTINCT query_id, unnest({terms}) AS term FROM {asked}),
{name}_p AS (SELECT uid, size, term, count(*) AS tf FROM (SELECT uid, len(t) AS size, unnest(t) AS term FROM {name}_u) WHERE term IN (SELECT term FROM {name}_a) GROUP BY ALL),
{name}_d AS (SELECT term, count(*) AS df FROM {name}_p GROUP BY 1),
{name}_s AS (SELECT query_id, uid, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))), 9) AS score
  FROM {name}_a JOIN {name}_d USING (term) JOIN {name}_p USING (term), {name}_n GROUP BY 1, 2),
{name} AS (SELECT query_id, uid, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, uid) AS rank FROM {name}_s QUALIFY rank <= {k})"""


_RRF = """fused_s AS (SELECT query_id, uid, round(coalesce(min(CASE WHEN arm = 0 THEN 1.0::DOUBLE / (60 + rank) END), 0) + coalesce(min(CASE WHEN arm = 1 THEN 1.0::DOUBLE / (60 + rank) END), 0), 9) AS score
  FROM (SELECT 0 AS arm, query_id, uid, rank FROM p1 UNION ALL SELECT 1, query_id, uid, rank FROM p2) GROUP BY 1, 2),
fused AS (SELECT query_id, uid, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, uid) AS rank FROM fused_s QUALIFY rank <= 20)"""
_ARMS = f"{_BASE}, {_bm25_sql('p1', 50)}, {_bm25_sql('p2', 50, terms=_PAIRS)}, {_RRF}"
_GOLD = "gold AS (SELECT DISTINCT query_id, g.doc_id || ':' || g.section_path AS uid FROM (SELECT query_id, unnest(gold_spans) AS g FROM q))"
_METRICS = f"""{_ARMS}, {_GOLD},
lists AS (SELECT 'terms' AS config, query_id, uid, rank FROM p1 WHERE rank <= 20 UNION ALL SELECT 'bigrams', query_id, uid, rank FROM p2 WHERE rank <= 20 UNION ALL SELECT 'fused', query_id, uid, rank FROM fused),
hits AS (SELECT config, query_id, min(rank) AS rank FROM lists JOIN gold USING (query_id, uid) GROUP BY config, query_id, uid),
per AS (SELECT config, query_id, count(*) FILTER (rank <= 1) AS in_1, count(*) FILTER (rank <= 5) AS in_5, count(*) AS in_20, min(rank) AS first, sum(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) END) AS dcg FROM hits GROUP BY 1, 2),
rows AS (SELECT c.config, q.query_id, q.query_type, coalesce(n_gold, 0) AS n_gold, coalesce(in_1, 0) AS in_1, coalesce(in_5, 0) AS in_5, coalesce(in_20, 0) AS in_20, first, coalesce(dcg, 0) AS dcg
  FROM q CROSS JOIN (VALUES ('terms'), ('bigrams'), ('fused')) c(config) LEFT JOIN (SELECT query_id, count(*) AS n_gold FROM gold GROUP BY 1) USING (query_id) LEFT JOIN per ON per.config = c.config AND per.query_id = q.query_id),
m AS (SELECT config, query_id, query_type, n_gold, (in_1 > 0)::DOUBLE AS hit_1, (in_5 > 0)::DOUBLE AS hit_5, (in_20 > 0)::DOUBLE AS hit_20,
  CASE WHEN n_gold > 0 THEN in_5 / n_gold ELSE 0 END AS recall_5, CASE WHEN n_gold > 0 THEN in_20 / n_gold ELSE 0 END AS recall_20,
  (n_gold > 0 AND in_5 = n_gold)::DOUBLE AS full_5, (n_gold > 0 AND in_20 = n_gold)::DOUBLE AS full_20, coalesce(1 / first, 0) AS mrr,
  CASE WHEN n_gold > 0 THEN dcg / list_sum(list_transform(range(1, least(n_gold, 10) + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END AS ndcg_10 FROM rows)"""
_MEANS = ", ".join(f"round(avg({m}), 4) AS {m}" for m in metrics.METRICS)
_SWEEP = f"{_METRICS}, sw AS (SELECT config, query_type, count(*) AS n, {_MEANS} FROM m WHERE n_gold > 0 GROUP BY GROUPING SETS ((config, query_type), (config)))"
_COSINE = """v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
d AS (SELECT a.vec_id AS query_id, a.label AS own, b.vec_id AS uid, b.label AS grp, 1 - list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) AS d FROM v a, v b WHERE a.vec_id % 20 = 0)"""


def _best(uid: str, k: int) -> str:
    return f"""WITH {_COSINE}, s AS (SELECT query_id, {uid} AS uid, 1 - min(round(d, 9)) AS score FROM d GROUP BY 1, 2)
SELECT query_id, uid, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, uid) AS rank FROM s QUALIFY rank <= {k}"""


SQL = {
    "bm25_topk": f"WITH {_BASE}, {_bm25_sql('p', 20)} SELECT * FROM p",
    "bm25_chunk_units": f"""WITH {_BASE}, {_bm25_sql('p', 20)}
SELECT query_id, chunk_id, section_uid, score, row_number() OVER (PARTITION BY query_id ORDER BY rank, ordinal NULLS LAST, chunk_id) AS place FROM p JOIN {live_sql("chunks", "chunk_id")} c ON c.section_uid = p.uid QUALIFY place <= 20""".replace("AS place", "AS rank").replace("QUALIFY place", "QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY p.rank, ordinal NULLS LAST, chunk_id)").replace("ORDER BY rank,", "ORDER BY p.rank,"),
    "hybrid_rrf": f"WITH {_ARMS} SELECT * FROM fused",
    "rerank_window": f"""WITH {_BASE}, {_bm25_sql('p', 70)},
w AS (SELECT uid, list_filter(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z]{{4,}}')), lambda x: NOT list_contains({T.STOP_WORDS!r}, x)) AS sw FROM sec),
qw AS (SELECT query_id, list_filter(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z]{{4,}}')), lambda x: NOT list_contains({T.STOP_WORDS!r}, x)) AS qw FROM q),
s AS (SELECT query_id, uid, rank AS base, CASE WHEN rank <= 50 THEN round(CASE WHEN len(sw) = 0 OR len(qw) = 0 THEN 0 ELSE len(list_intersect(sw, qw)) / len(list_distinct(list_concat(sw, qw))) END, 9) END AS s FROM p JOIN w USING (uid) JOIN qw USING (query_id)),
f AS (SELECT query_id, uid, round(CASE WHEN base <= 50 THEN s ELSE min(s) OVER (PARTITION BY query_id) - base END, 9) AS score FROM s)
SELECT query_id, uid, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, uid) AS rank FROM f QUALIFY rank <= 60""",
    "context_budget": f"""WITH RECURSIVE {_BASE}, {_bm25_sql('p', context.TOP)},
hits AS (SELECT query_id, uid, row_number() OVER (PARTITION BY query_id ORDER BY rank, uid) AS k, coalesce(concat_ws(' · clause ', heading, section_path), uid) AS label, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS body FROM p JOIN sec USING (uid) WHERE text IS NOT NULL),
f AS (SELECT DISTINCT query_id, 0::BIGINT AS k, '' AS text, []::VARCHAR[] AS cited, 0::BIGINT AS used, 0 AS truncated, 0 AS dropped FROM hits
  UNION ALL SELECT query_id, k, CASE WHEN shut THEN text ELSE text || CASE WHEN text = '' THEN '' ELSE chr(10) || chr(10) END || block END, CASE WHEN shut THEN cited ELSE list_append(cited, uid) END, CASE WHEN shut THEN used ELSE used + length(block) + 2 END,
    CASE WHEN shut OR NOT over THEN truncated ELSE truncated + 1 END, CASE WHEN shut THEN dropped + 1 ELSE dropped END
  FROM (SELECT *, head || CASE WHEN over THEN CASE WHEN contains(part, ' ') THEN regexp_replace(part, ' [^ ]*$', '') ELSE part END || '{context.CUT}' ELSE body END AS block
    FROM (SELECT *, dropped > 0 OR room <= {context.ROOM} AS shut, length(body) > room AS over, substr(body, 1, room) AS part
      FROM (SELECT f.query_id, h.k, f.text, cited, used, truncated, dropped, uid, body, '[' || h.k || '] ' || label || ' (' || uid || ')' || chr(10) AS head, least({int(context.BUDGET * context.SHARE)}, {context.BUDGET} - used - length('[' || h.k || '] ' || label || ' (' || uid || ')' || chr(10))) AS room
        FROM f JOIN hits h ON h.query_id = f.query_id AND h.k = f.k + 1))))
SELECT query_id, text, cited, length(text) AS chars, truncated, dropped FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY k DESC) = 1""",
    "decomposed_rrf": f"""WITH {_BASE},
c AS (SELECT query_id, text, list_filter(list_transform(string_split_regex(text, '\\s+and\\s+|[,;]\\s*'), lambda x: trim(x)), lambda x: length(x) >= 15 AND x <> trim(text)) AS parts FROM q WHERE text IS NOT NULL),
parts AS (SELECT query_id, unnest(range(0, len(l))) AS part, unnest(l) AS text FROM (SELECT query_id, list_concat([text], parts[1:3]) AS l FROM c)),
dq_t AS (SELECT query_id || '|' || part AS query_id, list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: length(x) >= 2) AS t FROM parts), {_bm25_sql('p', 50, asked='dq_t')},
s AS (SELECT split_part(query_id, '|', 1) AS query_id, uid, round(sum(1.0::DOUBLE / (60 + rank) ORDER BY split_part(query_id, '|', 2)), 9) AS score FROM p GROUP BY 1, 2)
SELECT query_id, uid, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, uid) AS rank FROM s QUALIFY rank <= 20""",
    "ranking_metrics": f"WITH {_METRICS} SELECT config, query_id, query_type, n_gold, {', '.join(f'round({m}, 9) AS {m}' for m in metrics.METRICS)} FROM m",
    "sweep_aggregate": f"WITH {_SWEEP} SELECT * FROM sw",
    "saturation_gate": f"""WITH {_METRICS}, a AS (SELECT query_type, round(avg(hit_5) FILTER (config = 'terms'), 4) AS terms_hit_5, round(avg(hit_5) FILTER (config = 'bigrams'), 4) AS bigrams_hit_5 FROM m WHERE n_gold > 0 AND config <> 'fused' GROUP BY GROUPING SETS ((query_type), ()))
SELECT *, least(terms_hit_5, bigrams_hit_5) > 0.80 AS saturated FROM a""",
    "displacement": f"""WITH {_ARMS}, {_GOLD}, b AS (SELECT query_id, min(rank) AS first_before FROM p1 JOIN gold USING (query_id, uid) WHERE rank <= 20 GROUP BY 1), a AS (SELECT query_id, min(rank) AS first_after FROM fused JOIN gold USING (query_id, uid) GROUP BY 1)
SELECT query_id, first_before, first_after, first_after - first_before AS shift, CASE WHEN first_after IS NULL THEN 'dropped' WHEN first_before IS NULL THEN 'entered' WHEN first_after > first_before THEN 'demoted' WHEN first_after < first_before THEN 'promoted' ELSE 'unchanged' END AS move FROM b FULL JOIN a USING (query_id)""",
    "switch_verdicts": f"""WITH {_SWEEP}, t AS (SELECT config, coalesce(query_type, 'all') AS query_type, n, mrr FROM sw)
SELECT x.config, query_type, x.n, round(x.mrr - b.mrr, 4) AS delta, CASE WHEN abs(round(x.mrr - b.mrr, 4)) <= 1 / x.n THEN 'flat' WHEN x.mrr > b.mrr THEN 'helps' ELSE 'hurts' END AS verdict FROM t x JOIN t b USING (query_type) WHERE x.config <> 'terms' AND b.config = 'terms'""",
    "baseline_gate": f"""WITH {_SWEEP}, l AS (UNPIVOT (SELECT * EXCLUDE (query_type, n) FROM sw WHERE query_type IS NULL) ON {', '.join(metrics.METRICS)} INTO NAME metric VALUE value)
SELECT metric, b.value AS baseline, a.value AS now, a.value < b.value - 0.005 AS failed FROM l b JOIN l a USING (metric) WHERE b.config = 'terms' AND a.config = 'fused'""",
    "dense_rollup_topk": _best("grp", 5),
    "dense_chunk_topk": _best("uid", 20),
    "near_duplicates": f"WITH {_COSINE} SELECT query_id, least(50, count(DISTINCT CASE WHEN round(d, 9) <= {NEAR} AND grp <> own THEN grp END)) AS near FROM d GROUP BY 1",
}
