"""Structured Streaming forms of the incremental operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.plans.stage import shared_folder


def spend_windows(events: DataFrame, lateness: str = "1 day") -> DataFrame:
    """day, event_type, steps, seconds, tokens by day of event time.

    State is one row a day and kind; days that the watermark has passed are dropped from it."""
    rows = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", lateness)
    tokens = F.get_json_object("props", "$.k").cast("double")
    per = rows.groupBy(F.window("at", "1 day").alias("w"), "event_type").agg(F.count("*").alias("steps"), F.sum(F.coalesce("value", F.lit(0.0))).alias("seconds"), F.sum(F.coalesce(tokens, F.lit(0.0))).alias("tokens"))
    return per.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "steps", F.round("seconds", 2).alias("seconds"), F.col("tokens").cast("long").alias("tokens"))


def new_versions(manifest: DataFrame, lateness: str = "30 days") -> DataFrame:
    """The first row of each (doc_id, sha256) within the lateness: a version is minted only on new bytes."""
    rows = manifest.where("doc_id IS NOT NULL AND sha256 IS NOT NULL").withColumn("at", F.col("fetched_at").cast("timestamp"))
    return rows.withWatermark("at", lateness).dropDuplicatesWithinWatermark(["doc_id", "sha256"]).drop("at")


def run_available(spark: SparkSession, path: str, operator: Callable[[DataFrame], DataFrame], name: str, mode: str = "complete") -> DataFrame:
    """Read what lies at ``path`` as a stream, apply ``operator`` and return the written result.

    Offsets and results go to the shared folder, so a restarted stream goes on where it stopped. With
    mode complete each batch replaces the result, with append it adds to it."""
    schema = spark.read.parquet(path).schema
    base = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    source = spark.readStream.schema(schema)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isFile():
        # A stream's source is a folder: a single file is picked out of its own by name.
        folder, _, name_ = path.rpartition("/")
        source, path = source.option("pathGlobFilter", name_), folder
    result = operator(source.parquet(path))

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{base}/out")

    query = result.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/offsets").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{base}/out")
