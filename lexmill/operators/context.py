"""Assembling ranked texts under a budget of characters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import squeeze

BUDGET, SHARE, ROOM, TOP = 24_000, 0.4, 200, 5
CUT = " […truncated]"


def assemble(ranked: DataFrame, texts: DataFrame, budget: int = BUDGET, share: float = SHARE, top: int = TOP) -> DataFrame:
    """query_id, text, cited, chars, truncated, dropped of each query's first ``top`` hits.

    ``ranked``: query_id, uid, rank; ``texts``: uid, label, text. Excerpts are numbered and headed
    by their label; one may take ``share`` of the budget, is cut at a word and then says so; when 200
    characters or fewer are left, the rest is dropped and counted. What a cut excerpt takes depends
    on those before it, so the state is folded over the at most ``top`` hits of a query. Hits
    without a text or with a null one are skipped; a query without any hit has no row."""
    rows = ranked.where(F.col("rank") <= top).join(texts.where("text IS NOT NULL"), "uid")
    rows = rows.select("query_id", "rank", "uid", F.coalesce("label", "uid").alias("label"), squeeze("text").alias("body"))
    hits = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "uid", "label", "body"))).alias("hits"))
    limit = int(budget * share)
    start = F.struct(F.lit("").alias("text"), F.array().cast("array<string>").alias("cited"), F.lit(0).alias("used"), F.lit(0).alias("n"), F.lit(0).alias("truncated"), F.lit(0).alias("dropped"))

    def step(s, h):
        n = s["n"] + 1
        head = F.concat(F.lit("["), n.cast("string"), F.lit("] "), h["label"], F.lit(" ("), h["uid"], F.lit(")\n"))
        room = F.least(F.lit(limit), F.lit(budget) - s["used"] - F.length(head))
        full = (s["dropped"] > 0) | (room <= ROOM)
        long = F.length(h["body"]) > room
        part = F.substring(h["body"], F.lit(1), room)
        body = F.when(long, F.concat(F.when(part.contains(" "), F.regexp_replace(part, r" [^ ]*$", "")).otherwise(part), F.lit(CUT))).otherwise(h["body"])
        block = F.concat(head, body)
        return F.struct(
            F.when(full, s["text"]).otherwise(F.concat(s["text"], F.when(s["text"] == "", F.lit("")).otherwise(F.lit("\n\n")), block)).alias("text"),
            F.when(full, s["cited"]).otherwise(F.concat(s["cited"], F.array(h["uid"]))).alias("cited"),
            F.when(full, s["used"]).otherwise(s["used"] + F.length(block) + 2).alias("used"),
            n.alias("n"),
            F.when(full | ~long, s["truncated"]).otherwise(s["truncated"] + 1).alias("truncated"),
            F.when(full, s["dropped"] + 1).otherwise(s["dropped"]).alias("dropped"),
        )

    done = hits.select("query_id", F.aggregate("hits", start, step).alias("s"))
    return done.select("query_id", "s.text", "s.cited", F.length("s.text").alias("chars"), "s.truncated", "s.dropped")
