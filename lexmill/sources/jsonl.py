"""JSON-lines sources and sinks with declared schemas."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as t

BROKEN = "_broken"

MANIFEST = t.StructType([t.StructField(n, t.StringType()) for n in ("doc_id", "url", "source_page", "issuer", "doc_type", "title", "filename", "sha256")] + [t.StructField("bytes", t.LongType()), t.StructField("fetched_at", t.StringType())])


def read_json_lines(spark: SparkSession, path: str, schema: t.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, broken): rows of the schema, and the file and text of lines that are no JSON of it.

    Blank lines count as neither."""
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.input_file_name().alias("file")).where(F.trim("line") != "")
    wide = t.StructType([*schema.fields, t.StructField(BROKEN, t.StringType())])
    parsed = lines.select("file", "line", F.from_json("line", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN}).alias("r"))
    bad = F.col(f"r.{BROKEN}").isNotNull()
    return parsed.where(~bad).select(*[f"r.{f.name}" for f in schema.fields]), parsed.where(bad).select("file", "line")


def repeated_keys(rows: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("rows")).where("rows > 1")


def write_json_lines(rows: DataFrame, path: str, order: list[str], partition_by: list[str] | None = None) -> None:
    """One JSON object a line with sorted keys, in the given order across and within the part files."""
    ordered = rows.select(*sorted(rows.columns)).orderBy(*order)
    (ordered.write.partitionBy(*partition_by) if partition_by else ordered.write).json(path)


def first_object(text: str | Column) -> Column:
    """The first JSON object that stands anywhere in a text, whatever is around it, as JSON with sorted keys.

    Fences and braces in prose or strings do not mislead it: each opening brace is tried in turn. Null where
    there is none; objects of any length are read whole."""

    @F.pandas_udf("string")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        decode = json.JSONDecoder().raw_decode
        for batch in batches:
            out: list[str | None] = []
            for t in batch:
                at, found = (t or "").find("{"), None
                while at >= 0 and found is None:
                    try:
                        found = json.dumps(decode(t, at)[0], sort_keys=True, ensure_ascii=False)
                    except (ValueError, RecursionError):
                        at = t.find("{", at + 1)
                out.append(found)
            yield pd.Series(out, dtype=object)

    return find(text)
