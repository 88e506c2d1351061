"""Writing an intermediate table once, where every executor can read it again."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where none is set, one of our own on a local master.

    A cluster must set it to storage that all executors reach, and without it this is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors reach")
        folder = "file://" + tempfile.mkdtemp(prefix="lexmill-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts lineage, so a lost executor costs no recomputation of the stages before, and lets
    several consumers share one computation with column pruning. The folder is never reused.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for paths in _SCOPES:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Paths staged within each open scope, the outermost first.
_SCOPES: list[list[str]] = []


@contextmanager
def staged_scope(spark: SparkSession) -> Iterator[None]:
    """Drop at its end the tables that were staged within it.

    A result must be written or counted inside the scope; afterwards its staged sources are gone."""
    paths: list[str] = []
    _SCOPES.append(paths)
    try:
        yield
    finally:
        _SCOPES.remove(paths)
        drop(spark, paths)


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Delete staged tables; one that is gone already is no error."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def release(*tables: DataFrame) -> None:
    """Drop staged tables that nothing reads any more, such as those an already staged one was made from."""
    for table in tables:
        files = table.inputFiles()
        if files:
            drop(table.sparkSession, [files[0].rsplit("/", 1)[0]])


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else as it is.

    The count stops at ``rows`` + 1. Use it on a staged table, so that counting costs a scan of a
    narrow file; beyond the bound the join is left to shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
