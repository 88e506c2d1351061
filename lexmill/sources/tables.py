"""Parquet sources and the live-row rule (the newest row of a key counts)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a scale-factor folder; only the selected columns reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def live_rows(df: DataFrame, keys: list[str], at: str, keep: list[str | Column]) -> DataFrame:
    """The row of each key with the greatest ``at``, reduced to ``keys`` and ``keep``.

    Rows with a null in a key are dropped (they identify nothing); a null ``at`` counts as the
    oldest. Partial aggregation runs before the shuffle, so a key repeated many times is reduced
    where it is read. ``keep`` should be narrow: do the work on long texts before, not after.
    """
    columns = [F.col(c) if isinstance(c, str) else c for c in keep]
    df = df.dropna(subset=keys)
    newest = F.max_by(F.struct(*columns), F.struct(F.col(at), F.xxhash64(*columns)))
    return df.groupBy(*keys).agg(newest.alias("__live")).select(*keys, "__live.*")
