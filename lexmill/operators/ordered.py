"""Running sums over long ordered groups, in slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.plans.stage import stage

SLICE = "__slice"


def in_slices(rows: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """``rows`` with a slice number: ranges of ``order`` within ``keys``, each a task of its own.

    Rows are divided by range over keys and order together, so a group of any length is spread over the
    tasks; the result is written once, so that its slices stay what they are."""
    ranged = rows.repartitionByRange(*keys, *order)
    return stage(ranged.withColumn(SLICE, F.spark_partition_id()), name)


def running(rows: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column], lasts: dict[str, Column] | None = None) -> DataFrame:
    """``rows`` of ``in_slices`` with running sums, and last non-null values, up to and including each row.

    Summed within a slice, plus what the slices before it hold: of those there is one row a group and
    slice. Nulls add 0."""
    lasts = lasts or {}
    rows = rows.withColumns({f"__{n}": F.coalesce(c.cast("double"), F.lit(0.0)) for n, c in sums.items()} | {f"__{n}": c for n, c in lasts.items()})
    latest = lambda n: F.max_by(f"__{n}", F.when(F.col(f"__{n}").isNotNull(), F.struct(*order)))
    per = rows.groupBy(*keys, SLICE).agg(*[F.sum(f"__{n}").alias(f"__of_{n}") for n in sums], *[latest(n).alias(f"__of_{n}") for n in lasts])
    before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)  # one row a slice
    held = [F.coalesce(F.sum(f"__of_{n}").over(before), F.lit(0.0)).alias(f"__before_{n}") for n in sums]
    held += [F.last(f"__of_{n}", ignorenulls=True).over(before).alias(f"__before_{n}") for n in lasts]
    rows = rows.join(per.select(*keys, SLICE, *held), [*keys, SLICE])
    inner = Window.partitionBy(*keys, SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = {n: F.col(f"__before_{n}") + F.sum(f"__{n}").over(inner) for n in sums}
    found |= {n: F.coalesce(F.last(f"__{n}", ignorenulls=True).over(inner), F.col(f"__before_{n}")) for n in lasts}
    return rows.withColumns(found).drop(SLICE, *[f"{x}{n}" for n in [*sums, *lasts] for x in ("__", "__before_")])
