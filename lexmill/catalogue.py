"""The registered queries and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import text
from lexmill.operators import lexical, metrics
from lexmill.plans import check_queries, corpus_queries, evaluation_queries, search_queries, selection_queries

_MODULES = (search_queries, corpus_queries, evaluation_queries, selection_queries, check_queries)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 search for every item, scored against its gold sections."""
    rows = search_queries.items(spark, sf_dir).select(F.col("id").alias("query_id"), "question", "query_type", "gold_spans")
    units = search_queries._units(spark, sf_dir)
    ranked = lexical.bm25(units, rows.select("query_id", text.tokens("question").alias("terms")), metrics.DEPTH, at="made_at")
    one = F.lit("terms").alias("config")
    return metrics.ranking_metrics(ranked.select("*", one), rows.select("query_id", one), search_queries.gold_of(rows))


def queries() -> dict:
    return {q.__name__: q for module in _MODULES for q in module.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.SQL.items()}
