"""The same compiled queries over streams of documents."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.collections import Collection
from ..plans.projection import project_typed, project_variant


def json_stream(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """New files of one type folder as a stream of (type, id, doc VARIANT); malformed files give a null doc."""
    rows = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", max_files).option("pathGlobFilter", "*.json").load(folder)
    parts = F.split(F.url_decode(F.col("_metadata.file_path")), "/")
    return rows.select(F.element_at(parts, -2).alias("type"), F.regexp_replace(F.element_at(parts, -1), r"\.json$", "").alias("id"), F.try_parse_json("value").alias("doc"))


def stream_query(collection: Collection, filter: Mapping[str, Any], projection: Mapping[str, int] | None = None) -> DataFrame:
    """Filter and projection over a streaming collection; a stream has no end, so no sort, skip or limit."""
    out = collection.where(filter)
    if not projection:
        return out
    return (project_variant if collection.variant else project_typed)(out, projection, collection.resolver)


def windowed_counts(stream: DataFrame, time: str, window: str, keys: list[str], late: str) -> DataFrame:
    """Counts by event-time window and keys; rows later than ``late`` behind the newest are dropped."""
    stream = stream.withColumn(time, F.col(time).cast("timestamp"))
    return stream.withWatermark(time, late).groupBy(F.window(time, window), *keys).agg(F.count("*").alias("n")).select("window.start", "window.end", *keys, "n")
