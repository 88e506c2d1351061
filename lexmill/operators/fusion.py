"""Combining ranked lists: reciprocal ranks, windowed reranking, decomposition."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.operators.lexical import top_k

RRF_K, POOL = 60, 50


def reciprocal_ranks(arms: list[DataFrame], k: int, rrf_k: int = RRF_K) -> DataFrame:
    """Fuse (query_id, uid, rank) lists: the sum of 1 / (rrf_k + rank) over the arms that have a uid.

    Arms are summed in their order, so that equal inputs give equal last digits."""
    marked = [a.select("query_id", "uid", F.lit(i).alias("arm"), "rank") for i, a in enumerate(arms)]
    both = reduce(DataFrame.unionByName, marked)
    parts = [F.coalesce(F.min(F.when(F.col("arm") == i, 1.0 / (rrf_k + F.col("rank")))), F.lit(0.0)) for i in range(len(arms))]
    return top_k(both.groupBy("query_id", "uid").agg(reduce(Column.__add__, parts).alias("score")), k)


def rerank(ranked: DataFrame, scores: Column, k: int, top_n: int = 50) -> DataFrame:
    """Reorder the first ``top_n`` of each query by ``scores``; the rest keeps its order below.

    A row beyond the window scores the least reranked score less its base rank."""
    query = Window.partitionBy("query_id")
    scored = ranked.withColumn("base", F.col("rank")).withColumn("s", F.when(F.col("rank") <= top_n, F.round(scores, 9)))
    floor = F.min("s").over(query)
    return top_k(scored.select("query_id", "uid", "base", F.when(F.col("base") <= top_n, F.col("s")).otherwise(floor - F.col("base")).alias("score")), k).select("query_id", "uid", "score", "rank")


def sub_questions(queries: DataFrame, most: int = 3, shortest: int = 15) -> DataFrame:
    """(query_id, part, text): the question itself as part 0 and up to ``most`` clauses of it.

    Clauses are divided at commas, semicolons and ``and``; those equal to the question or shorter
    than ``shortest`` are left out. Null questions have no part."""
    clauses = F.transform(F.split("text", r"\s+and\s+|[,;]\s*"), lambda x: F.trim(x))
    kept = F.slice(F.filter(clauses, lambda x: (F.length(x) >= shortest) & (x != F.trim("text"))), 1, most)
    return queries.where("text IS NOT NULL").select("query_id", F.posexplode(F.concat(F.array("text"), kept)).alias("part", "text"))


def fuse_parts(ranked_parts: DataFrame, k: int, rrf_k: int = RRF_K) -> DataFrame:
    """Fuse the lists of a question's parts (query_id, part, uid, rank) into one of the question."""
    score = F.aggregate(F.array_sort(F.collect_list(F.struct("part", "rank"))), F.lit(0.0), lambda a, r: a + 1.0 / (rrf_k + r["rank"]))
    return top_k(ranked_parts.groupBy("query_id", "uid").agg(score.alias("score")), k)
