"""Filling containers of fixed capacity.

Documents fall into randomised groups of bounded size; in each group first-fit decreasing runs over
a tournament tree whose nodes hold the greatest free space below them, so that the first container
with room is found by one descent. Groups are independent tasks, and the space they leave in their
last containers is bounded by one container a group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.tokens import VOCABULARY, token_count
from lexmill.plans.stage import stage

GROUP = 20_000  # documents of one group, about


class Tournament:
    """Containers in order; ``place`` puts an item into the first one with enough room."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.free = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        free, node = self.free, 1
        if free[1] < size:
            raise ValueError("no container has room")
        while node < self.leaves:
            node *= 2
            if free[node] < size:
                node += 1
        free[node] -= size
        where = node - self.leaves
        while node > 1:
            node //= 2
            best = max(free[2 * node], free[2 * node + 1])
            if free[node] == best:
                break
            free[node] = best
        return where


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each item; items of equal size keep their order."""
    order = np.argsort(-sizes, kind="stable")
    out = np.zeros(len(sizes), np.int64)
    if not len(sizes):
        return out
    # First fit leaves at most one container half empty or more, and one for items without size.
    tree = Tournament(min(len(sizes), 2 * int(sizes.sum()) // capacity + 2), capacity)
    for i in order.tolist():
        out[i] = tree.place(int(sizes[i]))
    return out


def pack(sizes: DataFrame, containers: DataFrame, group: int = GROUP) -> DataFrame:
    """Assign items to containers of every kind.

    ``sizes``: doc_id, tokens; ``containers``: container_kind, capacity_tokens. The result has
    container_kind, container, doc_id, piece, first_token, tokens. An item is whole (piece 0)
    unless it alone exceeds the capacity: then it is cut into pieces that fill containers of their
    own, and the rest is placed like any other item. Null ids and null sizes are left out, items of
    size 0 are placed, and rows that repeat an id count once, at their greatest size. Kinds with a
    null or non-positive capacity hold nothing."""
    known = sizes.where("tokens IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("tokens").cast("long").alias("tokens"))
    sized = stage(known, "packing-sizes")
    groups = max(1, -(-sized.count() // group))
    # The kinds are a configuration of a few rows, not data.
    kinds = containers.where("container_kind IS NOT NULL AND capacity_tokens > 0").select("container_kind", "capacity_tokens").distinct().collect()
    if not kinds:
        return sized.select(F.lit("").alias("container_kind"), F.lit("").alias("container"), "doc_id", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("first_token"), "tokens").limit(0)
    kind = F.explode(F.array(*[F.struct(F.lit(k).alias("container_kind"), F.lit(c).cast("long").alias("capacity")) for k, c in kinds]))
    rows = sized.select("doc_id", F.col("tokens").alias("total"), kind.alias("kind")).select("doc_id", "total", "kind.*")
    last = F.greatest(F.lit(0), F.ceil(F.col("total") / F.col("capacity")).cast("int") - 1)
    rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), last))).withColumn("first_token", F.col("piece") * F.col("capacity"))
    rows = rows.withColumn("tokens", F.least(F.col("total") - F.col("first_token"), F.col("capacity")))
    columns = ["container_kind", "container", "doc_id", "piece", "first_token", "tokens"]
    full = rows.where("tokens = capacity").withColumn("container", F.concat_ws("-", F.lit("full"), "doc_id", "piece")).select(columns)
    rest = rows.where("tokens < capacity").withColumn("grp", F.pmod(F.xxhash64("doc_id"), F.lit(groups)).cast("int"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id", kind="stable")
        where = first_fit_decreasing(pdf["tokens"].to_numpy(np.int64), int(pdf["capacity"].iloc[0]))
        return pdf.assign(container=[f"{g}-{w}" for g, w in zip(pdf["grp"], where)])[columns]

    placed = rest.groupBy("container_kind", "grp").applyInPandas(run, "container_kind string, container string, doc_id long, piece int, first_token long, tokens long")
    return placed.unionByName(full)


def pack_documents(documents: DataFrame, containers: DataFrame, vocabulary: str = VOCABULARY, group: int = GROUP) -> DataFrame:
    """``pack`` over the texts of ``documents``, sized in tokens where they are read."""
    return pack(documents.select("doc_id", token_count("text", vocabulary).alias("tokens")), containers, group)


def fill(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """container_kind, containers, tokens, capacity, unused_share of each kind that holds anything."""
    per = packed.groupBy("container_kind", "container").agg(F.sum("tokens").alias("tokens"))
    per = per.groupBy("container_kind").agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"))
    per = per.join(containers.select("container_kind", "capacity_tokens").distinct(), "container_kind")
    room = F.col("containers") * F.col("capacity_tokens")
    return per.select("container_kind", "containers", "tokens", room.alias("capacity"), (1 - F.col("tokens") / room).alias("unused_share"))
