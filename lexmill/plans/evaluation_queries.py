"""Queries on answers of agents, their spending, readers' labels, and the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators import agentlog
from lexmill.operators.metrics import nearest_rank
from lexmill.plans.search_queries import live_sections, live_sql
from lexmill.sources.tables import live_rows, read_table
from lexmill.streaming import stream

_ANSWER = ["query_type", "gold_doc_ids", "gold_uids", "must_cite", "must_abstain", "min_tool_calls", "cited_uids", "asserted", "unresolvable", "n_tool_calls", "steps", "in_tokens", "out_tokens", "stopped_by", "refusal_marker", "abstained", "error"]


def answers(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return live_rows(read_table(spark, sf_dir, "answer_rows"), ["arm", "task_id"], "made_at", [*_ANSWER, *more])


def _rate(flag: str, where=None):
    value = F.col(flag).cast("double") if where is None else F.when(where, F.col(flag).cast("double"))
    return F.round(F.avg(value), 4)


def agent_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of each arm, whole (null query_type) and by query type."""
    rows = agentlog.outcomes(answers(spark, sf_dir))
    parts = ["retrieved_gold", "cited_resolvable", "abstained_correctly", "within_budget", "success"]
    return rows.groupingSets([["arm", "query_type"], ["arm"]], "arm", "query_type").agg(
        F.count("*").alias("n"), *[F.sum(F.col(p).cast("long")).alias(p) for p in parts],
        F.round(F.avg("efficiency"), 4).alias("efficiency"), F.round(F.avg("recall"), 4).alias("recall"), F.round(F.avg("precision"), 4).alias("precision"),
        F.sum(F.coalesce("asserted", F.lit(0))).alias("asserted"), F.sum(F.coalesce("unresolvable", F.lit(0))).alias("unresolvable"),
        F.sum(F.coalesce("in_tokens", F.lit(0)) + F.coalesce("out_tokens", F.lit(0))).alias("tokens"),
    )


def abstention_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rates, never one: grounded tasks declined and negative tasks answered without error."""
    rows = answers(spark, sf_dir).withColumn("answered", ~F.col("abstained"))
    negative, clean = F.col("must_abstain"), F.coalesce("error", F.lit("")) == ""
    return rows.groupBy("arm").agg(
        F.count(F.when(~negative, 1)).alias("grounded"), F.count(F.when(negative, 1)).alias("negatives"),
        _rate("abstained", ~negative).alias("false_abstention"), _rate("answered", negative & clean).alias("false_answer"), _rate("abstained", negative).alias("correct_abstention"),
    )


def stop_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = answers(spark, sf_dir)
    return rows.where("stopped_by <> ''").groupBy("arm", "stopped_by").agg(F.count("*").alias("n"), F.round(F.avg("steps"), 4).alias("mean_steps"))


def refusal_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept refusal marks against the phrase list and the abstention flag."""
    rows = answers(spark, sf_dir, "answer").withColumn("phrase", agentlog.says_no("answer"))
    return rows.groupBy("arm", "refusal_marker", "phrase", "abstained").agg(F.count("*").alias("n"))


def percentiles_four_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest rank, index, upper median and interpolated median of the tokens of each arm."""
    rows = answers(spark, sf_dir).select("arm", "in_tokens")
    ranks = agentlog.ranked_values(rows, ["arm"], "in_tokens", {"p95_index": 0.95, "upper_median": 0.5})
    exact = rows.groupBy("arm").agg(nearest_rank("in_tokens", 0.5).cast("double").alias("p50_rank"), nearest_rank("in_tokens", 0.95).cast("double").alias("p95_rank"), F.percentile("in_tokens", 0.5).alias("median"))
    return exact.join(ranks, "arm")


def citation_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cited sections of each arm held against the live ones; unresolved are counted, not dropped."""
    cited = answers(spark, sf_dir).select("arm", "task_id", F.explode(F.array_distinct("cited_uids")).alias("section_uid"))
    there = live_sections(spark, sf_dir).select("section_uid", F.lit(True).alias("there"))
    return cited.join(there, "section_uid", "left").groupBy("arm").agg(F.count("*").alias("cited"), F.count("there").alias("resolved"), F.count(F.when(F.col("there").isNull(), 1)).alias("unresolved"))


def gold_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of gold sections cited, by arm and query type, over tasks with gold."""
    none = F.array().cast("array<string>")
    rows = answers(spark, sf_dir).select("arm", "query_type", F.array_distinct(F.coalesce("gold_uids", none)).alias("g"), F.array_distinct(F.coalesce("cited_uids", none)).alias("c")).where(F.size("g") > 0)
    hit = F.size(F.array_intersect("g", "c"))
    return rows.groupBy("arm", "query_type").agg(F.count("*").alias("n"), F.sum(hit).cast("long").alias("hits"), F.round(F.avg(hit / F.size("g")), 4).alias("mean_recall"), F.count(F.when(hit == F.size("g"), 1)).alias("full"))


def run_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two arms field by field over all tasks, those of one arm only included."""
    rows = answers(spark, sf_dir)
    fields = ["abstained", "stopped_by", "n_tool_calls", "asserted", "cited_uids"]
    left, right = (rows.where(F.col("arm") == a).select("task_id", F.lit(True).alias(f"{s}_in"), *[F.col(f).alias(f"{s}_{f}") for f in fields]) for a, s in (("single_agent", "l"), ("supervisor", "r")))
    both = left.join(right, "task_id", "full")
    differs = F.array_compact(F.array(*[F.when(~F.col(f"l_{f}").eqNullSafe(F.col(f"r_{f}")), F.lit(f)) for f in fields]))
    side = F.when(F.col("r_in").isNull(), "left_only").when(F.col("l_in").isNull(), "right_only").when(F.size(differs) == 0, "same").otherwise("differs")
    return both.select("task_id", side.alias("state"), F.when(F.col("l_in") & F.col("r_in"), F.array_join(differs, ",")).alias("fields"))


def reader_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agentlog.reader_agreement(read_table(spark, sf_dir, "content_labels"))


def cited_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = live_rows(read_table(spark, sf_dir, "answer_rows"), ["arm", "task_id"], "made_at", ["answer"])
    return agentlog.cited_pairs(rows, ["arm", "task_id"], "answer")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events").withColumn("tokens", F.get_json_object("props", "$.k").cast("double")).withColumn("one", F.lit(1.0))


def budget_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of steps, value and tokens a user's events reach first."""
    return agentlog.first_ceiling(_events(spark, sf_dir), "user_id", ["ts", "event_id"], {"steps": ("one", 40), "seconds": ("value", 600.0), "tokens": ("tokens", 2500)})


def spend_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir)
    return rows.rollup("event_type", F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count("*").alias("steps"), F.round(F.sum(F.coalesce("value", F.lit(0.0))), 2).alias("seconds"), F.sum(F.coalesce("tokens", F.lit(0.0))).cast("long").alias("tokens"))


def streamed_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily spend of each kind of event, worked out by a stream that reads the whole table once."""
    return stream.run_available(spark, f"{sf_dir}/events.parquet", stream.spend_windows, "spend")


def streamed_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions minted by a stream that reads the whole manifest once: one for each new content of a document."""
    return stream.run_available(spark, f"{sf_dir}/manifest.parquet", stream.new_versions, "versions", "append").select("doc_id", "sha256")


def findings_reducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each kind after a user's last error, which clears what came before."""
    return agentlog.last_findings(read_table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), "user_id", "event_type", "event_id", F.col("event_type") == "error")


def trace_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reproducible tenth of the events by hash, and every error: a sampling operator."""
    rows = read_table(spark, sf_dir, "events")
    kept = rows.where((F.conv(F.substring(F.sha2(F.col("event_id").cast("string"), 256), 1, 4), 16, 10).cast("int") < 6554) | (F.col("event_type") == "error"))
    return kept.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "lineitem").where("l_shipdate <= TIMESTAMP_NTZ'1998-09-02 00:00:00'")
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(price), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("mean_discount"), F.count("*").alias("n"))


def nation_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, orders, customer, nation, region = (read_table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "nation", "region"))
    rows = line.join(orders, line.l_orderkey == orders.o_orderkey).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupingSets([["r_name", "n_name"], ["r_name"], []], "r_name", "n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("lines"))


QUERIES = [agent_scorecard, abstention_rates, stop_reasons, refusal_markers, percentiles_four_ways, citation_resolution, gold_citations, run_diff, reader_agreement, cited_pairs, budget_ceiling, spend_rollup, streamed_spend, streamed_versions, findings_reducer, trace_sample, pricing_summary, nation_revenue]

# ---- the same in SQL ----------------------------------------------------------------------------

_ANS = "ans AS (SELECT * FROM answer_rows WHERE arm IS NOT NULL AND task_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY arm, task_id ORDER BY made_at DESC NULLS LAST) = 1)"
_OUT = f"""{_ANS}, o AS (SELECT *, list_distinct(coalesce(gold_doc_ids, [])) AS g, list_distinct(list_transform(coalesce(cited_uids, []), lambda u: split_part(u, ':', 1))) AS c FROM ans),
r AS (SELECT *, len(list_intersect(g, c)) = len(g) AS retrieved_gold, NOT coalesce(must_cite, false) OR len(c) > 0 AS cited_resolvable, coalesce(abstained, false) = coalesce(must_abstain, false) AS abstained_correctly, coalesce(stopped_by, '') = '' AND coalesce(error, '') = '' AS within_budget,
  CASE WHEN coalesce(n_tool_calls, 0) > 0 THEN round(least(1.0::DOUBLE, min_tool_calls / n_tool_calls), 4) ELSE 0 END AS efficiency, CASE WHEN len(g) > 0 THEN round(len(list_intersect(g, c)) / len(g), 4) END AS recall, CASE WHEN len(g) > 0 AND len(c) > 0 THEN round(len(list_intersect(g, c)) / len(c), 4) END AS precision FROM o)"""
_EV = "ev AS (SELECT *, (props->>'$.k')::DOUBLE AS tokens FROM events)"

SQL = {
    "agent_scorecard": f"""WITH {_OUT} SELECT arm, query_type, count(*) AS n, sum(retrieved_gold::INT)::BIGINT AS retrieved_gold, sum(cited_resolvable::INT)::BIGINT AS cited_resolvable, sum(abstained_correctly::INT)::BIGINT AS abstained_correctly, sum(within_budget::INT)::BIGINT AS within_budget, sum((retrieved_gold AND cited_resolvable AND abstained_correctly AND within_budget)::INT)::BIGINT AS success,
round(avg(efficiency), 4) AS efficiency, round(avg(recall), 4) AS recall, round(avg(precision), 4) AS precision, sum(coalesce(asserted, 0))::BIGINT AS asserted, sum(coalesce(unresolvable, 0))::BIGINT AS unresolvable, sum(coalesce(in_tokens, 0) + coalesce(out_tokens, 0))::BIGINT AS tokens FROM r GROUP BY GROUPING SETS ((arm, query_type), (arm))""",
    "abstention_rates": f"WITH {_ANS} SELECT arm, count(*) FILTER (NOT must_abstain) AS grounded, count(*) FILTER (must_abstain) AS negatives, round(avg(abstained::INT) FILTER (NOT must_abstain), 4) AS false_abstention, round(avg((NOT abstained)::INT) FILTER (must_abstain AND coalesce(error, '') = ''), 4) AS false_answer, round(avg(abstained::INT) FILTER (must_abstain), 4) AS correct_abstention FROM ans GROUP BY 1",
    "stop_reasons": f"WITH {_ANS} SELECT arm, stopped_by, count(*) AS n, round(avg(steps), 4) AS mean_steps FROM ans WHERE stopped_by <> '' GROUP BY 1, 2",
    "refusal_markers": f"WITH {_ANS} SELECT arm, refusal_marker, regexp_matches(lower(coalesce(answer, '')), '{'|'.join(agentlog.REFUSAL_MARKERS)}') AS phrase, abstained, count(*) AS n FROM ans GROUP BY ALL",
    "percentiles_four_ways": f"""WITH {_ANS}, s AS (SELECT arm, in_tokens, row_number() OVER (PARTITION BY arm ORDER BY in_tokens) - 1 AS i, count(in_tokens) OVER (PARTITION BY arm) AS n FROM ans WHERE in_tokens IS NOT NULL)
SELECT arm, quantile_disc(in_tokens, 0.5)::DOUBLE AS p50_rank, quantile_disc(in_tokens, 0.95)::DOUBLE AS p95_rank, quantile_cont(in_tokens, 0.5) AS median, max(CASE WHEN i = least(n - 1, floor(0.95 * n)) THEN in_tokens END) AS p95_index, max(CASE WHEN i = least(n - 1, floor(0.5 * n)) THEN in_tokens END) AS upper_median FROM s GROUP BY 1""",
    "citation_resolution": f"WITH {_ANS}, c AS (SELECT arm, task_id, unnest(list_distinct(cited_uids)) AS uid FROM ans), s AS (SELECT DISTINCT section_uid FROM sections) SELECT arm, count(*) AS cited, count(section_uid) AS resolved, count(*) FILTER (section_uid IS NULL) AS unresolved FROM c LEFT JOIN s ON uid = section_uid GROUP BY 1",
    "gold_citations": f"WITH {_ANS}, r AS (SELECT arm, query_type, list_distinct(coalesce(gold_uids, [])) AS g, list_distinct(coalesce(cited_uids, [])) AS c FROM ans) SELECT arm, query_type, count(*) AS n, sum(len(list_intersect(g, c)))::BIGINT AS hits, round(avg(len(list_intersect(g, c)) / len(g)), 4) AS mean_recall, count(*) FILTER (len(list_intersect(g, c)) = len(g)) AS full FROM r WHERE len(g) > 0 GROUP BY 1, 2",
    "run_diff": f"""WITH {_ANS}, l AS (SELECT * FROM ans WHERE arm = 'single_agent'), r AS (SELECT * FROM ans WHERE arm = 'supervisor'),
d AS (SELECT coalesce(l.task_id, r.task_id) AS task_id, l.task_id IS NOT NULL AS inl, r.task_id IS NOT NULL AS inr, concat_ws(',', CASE WHEN l.abstained IS DISTINCT FROM r.abstained THEN 'abstained' END, CASE WHEN l.stopped_by IS DISTINCT FROM r.stopped_by THEN 'stopped_by' END, CASE WHEN l.n_tool_calls IS DISTINCT FROM r.n_tool_calls THEN 'n_tool_calls' END, CASE WHEN l.asserted IS DISTINCT FROM r.asserted THEN 'asserted' END, CASE WHEN l.cited_uids IS DISTINCT FROM r.cited_uids THEN 'cited_uids' END) AS f FROM l FULL JOIN r ON l.task_id = r.task_id)
SELECT task_id, CASE WHEN NOT inr THEN 'left_only' WHEN NOT inl THEN 'right_only' WHEN f = '' THEN 'same' ELSE 'differs' END AS state, CASE WHEN inl AND inr THEN f END AS fields FROM d""",
    "reader_agreement": """WITH r AS (SELECT doc_id, reader, max(unsafe) AS own FROM content_labels WHERE unsafe IS NOT NULL AND reader IS NOT NULL AND doc_id IS NOT NULL GROUP BY 1, 2), w AS (SELECT doc_id, sum(own) AS yes, count(*) AS n FROM r GROUP BY 1),
o AS (SELECT reader, own, 2 * (yes - own) - (n - 1) AS lean FROM r JOIN w USING (doc_id) WHERE n > 1)
SELECT reader, count(*) AS n, count(*) FILTER (own = (lean > 0)::INT) AS agree, count(*) FILTER (own > (lean > 0)::INT) AS harsher, count(*) FILTER (own < (lean > 0)::INT) AS lenient FROM o WHERE lean <> 0 GROUP BY 1""",
    "budget_ceiling": f"""WITH {_EV}, s AS (SELECT user_id, row_number() OVER w AS step, round(sum(coalesce(value, 0)) OVER w, 6) AS seconds, round(sum(coalesce(tokens, 0)) OVER w, 6) AS tok FROM ev WHERE user_id IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
h AS (SELECT user_id, step, CASE WHEN step >= 40 THEN 'steps' WHEN seconds >= 600 THEN 'seconds' WHEN tok >= 2500 THEN 'tokens' END AS hit FROM s)
SELECT user_id, arg_min(hit, step) FILTER (hit IS NOT NULL) AS ceiling, min(step) FILTER (hit IS NOT NULL) AS at, max(step) AS steps FROM h GROUP BY 1""",
    "spend_rollup": f"WITH {_EV}, m AS (SELECT *, strftime(ts, '%Y-%m') AS month FROM ev) SELECT event_type, month, count(*) AS steps, round(sum(coalesce(value, 0)), 2) AS seconds, sum(coalesce(tokens, 0))::BIGINT AS tokens FROM m GROUP BY ROLLUP (event_type, month)",
    "streamed_spend": f"WITH {_EV} SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS steps, round(sum(coalesce(value, 0)), 2) AS seconds, sum(coalesce(tokens, 0))::BIGINT AS tokens FROM ev GROUP BY 1, 2",
    "streamed_versions": "SELECT DISTINCT doc_id, sha256 FROM manifest WHERE doc_id IS NOT NULL AND sha256 IS NOT NULL",
    "findings_reducer": "WITH c AS (SELECT user_id, max(event_id) AS cleared FROM events WHERE event_type = 'error' GROUP BY 1) SELECT user_id, event_type, max(event_id) AS event_id FROM events LEFT JOIN c USING (user_id) WHERE event_type <> 'error' AND user_id IS NOT NULL AND (cleared IS NULL OR event_id > cleared) GROUP BY 1, 2",
    "trace_sample": "SELECT event_type, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events WHERE ('0x' || substr(sha256(event_id::VARCHAR), 1, 4))::INT < 6554 OR event_type = 'error' GROUP BY 1",
    "pricing_summary": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS mean_discount, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2",
    "nation_revenue": "SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY GROUPING SETS ((r_name, n_name), (r_name), ())",
}
