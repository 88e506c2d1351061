"""Analytics over answers, tool use, spending and readers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.operators.ordered import in_slices, running

# Substrings by which a text says that the material does not answer.
REFUSAL_MARKERS = (
    "does not contain", "does not address", "does not cover", "do not contain", "do not address", "does not answer",
    "not addressed in the corpus", "no clause", "no provision", "could not find", "cannot be answered", "is not answered",
    "unable to find", "corpus does not", "material does not answer", "not stated in the",
)


def says_no(text: str) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.exists(F.array(*[F.lit(m) for m in REFUSAL_MARKERS]), lambda m: low.contains(m))


def outcomes(rows: DataFrame) -> DataFrame:
    """Adds retrieved_gold, cited_resolvable, abstained_correctly, within_budget, success, efficiency,
    recall and precision of the documents cited against the gold ones.

    Null arrays count as empty, null flags as false. Recall and precision are null where they have
    no denominator; efficiency is 0 without a call."""
    none = F.array().cast("array<string>")
    docs = F.array_distinct(F.transform(F.coalesce("cited_uids", none), lambda u: F.substring_index(u, ":", 1)))
    gold = F.array_distinct(F.coalesce("gold_doc_ids", none))
    both = F.size(F.array_intersect(gold, docs))
    flag = lambda c: F.coalesce(c, F.lit(False))
    out = rows.withColumns({
        "retrieved_gold": F.size(F.array_except(gold, docs)) == 0,
        "cited_resolvable": ~flag("must_cite") | (F.size(docs) > 0),
        "abstained_correctly": flag("abstained") == flag("must_abstain"),
        "within_budget": (F.coalesce("stopped_by", F.lit("")) == "") & (F.coalesce("error", F.lit("")) == ""),
        "efficiency": F.when(F.coalesce("n_tool_calls", F.lit(0)) > 0, F.round(F.least(F.lit(1.0), F.try_divide("min_tool_calls", "n_tool_calls")), 4)).otherwise(0.0),
        "recall": F.when(F.size(gold) > 0, F.round(F.try_divide(both, F.size(gold)), 4)),
        "precision": F.when((F.size(gold) > 0) & (F.size(docs) > 0), F.round(F.try_divide(both, F.size(docs)), 4)),
    })
    return out.withColumn("success", F.col("retrieved_gold") & F.col("cited_resolvable") & F.col("abstained_correctly") & F.col("within_budget"))


def ranked_values(rows: DataFrame, keys: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """For each group the values at index min(n - 1, int(q n)), without collecting the group.

    Values are first counted by group and value; the window then runs over distinct values."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("c"))
    order = Window.partitionBy(*keys).orderBy(value)
    upto = counts.withColumn("upto", F.sum("c").over(order)).withColumn("n", F.sum("c").over(Window.partitionBy(*keys)))
    picks = [F.min(F.when(F.col("upto") > F.least(F.col("n") - 1, F.floor(F.lit(q) * F.col("n"))), F.col(value))).alias(name) for name, q in quantiles.items()]
    return upto.groupBy(*keys).agg(*picks)


def first_ceiling(events: DataFrame, key: str, order: list[str], limits: dict[str, tuple[str, float]]) -> DataFrame:
    """key, ceiling, at, steps: the first limit a run reaches, in the order the limits are named.

    ``limits``: name -> (numeric column, limit); running sums per run decide, in slices, so that a run of
    any length is spread over the tasks. Null amounts add 0; a run that reaches none has a null ceiling."""
    rows = in_slices(events.where(F.col(key).isNotNull()), [key], order, "ceilings")
    rows = running(rows, [key], order, {"step": F.lit(1)} | {f"sum_{name}": F.col(column) for name, (column, _) in limits.items()})
    rows = rows.withColumn("step", F.col("step").cast("int"))
    hit = F.coalesce(*[F.when(F.round(f"sum_{name}", 6) >= limit, F.lit(name)) for name, (_, limit) in limits.items()])
    per = rows.withColumn("hit", hit).groupBy(key).agg(F.min_by("hit", F.when(F.col("hit").isNotNull(), F.col("step"))).alias("ceiling"), F.min(F.when(F.col("hit").isNotNull(), F.col("step"))).alias("at"), F.max("step").alias("steps"))
    return per


def last_findings(events: DataFrame, key: str, item: str, order: str, reset: Column) -> DataFrame:
    """The last row of each (key, item) after the key's last reset; a reset clears what came before."""
    cleared = events.where(reset).groupBy(key).agg(F.max(order).alias("cleared"))
    rows = events.where(~reset & F.col(key).isNotNull() & F.col(item).isNotNull()).join(cleared, key, "left").where(F.col("cleared").isNull() | (F.col(order) > F.col("cleared")))
    return rows.groupBy(key, item).agg(F.max(order).alias(order))


def reader_agreement(labels: DataFrame) -> DataFrame:
    """reader, n, agree, harsher, lenient against the majority of the other readers of a document.

    A tie of the others, or no other reader, leaves a label out; null labels and readers too."""
    rows = labels.where("unsafe IS NOT NULL AND reader IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id", "reader").agg(F.max("unsafe").alias("own"))
    whole = rows.groupBy("doc_id").agg(F.sum("own").alias("yes"), F.count("*").alias("n"))
    others = rows.join(whole, "doc_id").withColumn("lean", 2 * (F.col("yes") - F.col("own")) - (F.col("n") - 1)).where((F.col("n") > 1) & (F.col("lean") != 0))
    most = (F.col("lean") > 0).cast("int")
    return others.groupBy("reader").agg(F.count("*").alias("n"), F.count(F.when(F.col("own") == most, 1)).alias("agree"), F.count(F.when(F.col("own") > most, 1)).alias("harsher"), F.count(F.when(F.col("own") < most, 1)).alias("lenient"))


def cited_pairs(rows: DataFrame, key: list[str], text: str, reach: int = 140) -> DataFrame:
    """key, doc_id, path: each 16-digit hexadecimal id in a text with the clause number nearest to it
    within ``reach`` characters on either side; ties go to the number before, none gives a null path.

    Null texts give no row; an id named several times with one number is one row."""

    @F.pandas_udf("array<struct<doc_id:string,path:string>>")
    def find(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import re

        ids, numbers = re.compile(r"\b[0-9a-f]{16}\b"), re.compile(r"(?<![\w.])\d{1,2}(?:\.\d{1,3}){1,3}(?![\w])")
        for batch in texts:
            out = []
            for t in batch:
                spots = [(m.start(), m.end(), m.group()) for m in numbers.finditer(t or "")]
                found, k = [], 0
                for m in ids.finditer(t or ""):
                    while k < len(spots) and spots[k][0] < m.start():
                        k += 1
                    # Spots lie in order and apart, so only the neighbours on either side can be nearest.
                    near = [(max(a - m.end(), m.start() - b), a, n) for a, b, n in spots[max(0, k - 1) : k + 1]]
                    near = [x for x in near if x[0] <= reach]
                    found.append({"doc_id": m.group(), "path": min(near)[2] if near else None})
                out.append(found)
            yield pd.Series(out)

    return rows.where(F.col(text).isNotNull()).select(*key, F.explode(find(text)).alias("c")).select(*key, "c.doc_id", "c.path").distinct()
