"""Ranking metrics and their aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEPTH = 20
METRICS = ["hit_1", "hit_5", "hit_20", "recall_5", "recall_20", "full_5", "full_20", "mrr", "ndcg_10"]


def ranking_metrics(ranked: DataFrame, queries: DataFrame, gold: DataFrame) -> DataFrame:
    """One row per (config, query_id) of ``queries``: n_gold and METRICS over the first 20 ranks.

    ``ranked``: config, query_id, uid, rank; ``queries``: config, query_id; ``gold``: query_id, uid.
    A unit that a list repeats counts at its first rank. Without gold every metric is 0."""
    wanted = gold.where("uid IS NOT NULL").select("query_id", "uid").distinct()
    n_gold = wanted.groupBy("query_id").agg(F.count("*").alias("n_gold"))
    hits = ranked.where(F.col("rank") <= DEPTH).join(wanted, ["query_id", "uid"]).groupBy("config", "query_id", "uid").agg(F.min("rank").alias("rank"))
    counts = [F.count(F.when(F.col("rank") <= k, 1)).alias(f"in_{k}") for k in (1, 5, 20)]
    gain = F.sum(F.when(F.col("rank") <= 10, 1 / F.log2(F.col("rank") + 1)))
    per = hits.groupBy("config", "query_id").agg(*counts, F.min("rank").alias("first"), gain.alias("dcg"))
    rows = queries.join(n_gold, "query_id", "left").join(per, ["config", "query_id"], "left").fillna(0, ["n_gold", "in_1", "in_5", "in_20"])
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least("n_gold", F.lit(10)).cast("int"))), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + F.lit(1)))
    has = F.col("n_gold") > 0
    columns = [(F.col(f"in_{k}") > 0).cast("double").alias(f"hit_{k}") for k in (1, 5, 20)]
    columns += [F.coalesce(F.try_divide(F.col(f"in_{k}"), F.col("n_gold")), F.lit(0.0)).alias(f"recall_{k}") for k in (5, 20)]
    columns += [(has & (F.col(f"in_{k}") == F.col("n_gold"))).cast("double").alias(f"full_{k}") for k in (5, 20)]
    columns += [F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"), F.when(has, F.coalesce("dcg", F.lit(0.0)) / ideal).otherwise(0.0).alias("ndcg_10")]
    return rows.select("config", "query_id", "n_gold", *columns)


def sweep(metrics: DataFrame) -> DataFrame:
    """Means of METRICS by configuration and query type and, with a null type, by configuration."""
    grouped = metrics.groupingSets([["config", "query_type"], ["config"]], "config", "query_type")
    return grouped.agg(F.count("*").alias("n"), *[F.round(F.avg(m), 4).alias(m) for m in METRICS])


def nearest_rank(value: str, p: float) -> Column:
    """The value at rank ceil(p n), a member of the sample; null values are left out."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})")


def displacement(before: DataFrame, after: DataFrame, gold: DataFrame) -> DataFrame:
    """query_id, first_before, first_after, shift, move: how the first gold rank moved.

    ``before``/``after``: query_id, uid, rank. A gold unit in neither list gives no row."""
    def first(r: DataFrame, name: str) -> DataFrame:
        return r.join(gold.select("query_id", "uid").distinct(), ["query_id", "uid"]).groupBy("query_id").agg(F.min("rank").alias(name))

    both = first(before, "first_before").join(first(after, "first_after"), "query_id", "full")
    shift = F.col("first_after") - F.col("first_before")
    move = F.when(F.col("first_after").isNull(), "dropped").when(F.col("first_before").isNull(), "entered").when(shift > 0, "demoted").when(shift < 0, "promoted").otherwise("unchanged")
    return both.select("query_id", "first_before", "first_after", shift.alias("shift"), move.alias("move"))
