"""Store statistics and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stats(docs: DataFrame, size: Column, type_: str | None = None) -> DataFrame:
    """One row (count, bytes) of a type, or of all documents; zeros where there are none."""
    docs = docs if type_ is None else docs.where(F.col("type") == type_)
    return docs.agg(F.count("*").alias("count"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("bytes"))


def detailed_stats(docs: DataFrame, size: Column, by_type: bool = True) -> DataFrame:
    """count, bytes, avg_bytes, min_bytes, max_bytes: a row with null type for all, one for each type."""
    zero = lambda c, kind: F.coalesce(c, F.lit(0)).cast(kind)
    measures = [
        F.count("*").alias("count"), zero(F.sum(size), "long").alias("bytes"), zero(F.avg(size), "double").alias("avg_bytes"),
        zero(F.min(size), "long").alias("min_bytes"), zero(F.max(size), "long").alias("max_bytes"),
    ]
    return docs.rollup("type").agg(*measures) if by_type else docs.agg(*measures)


def percentiles(samples: DataFrame, value: str, points=(0.5, 0.95, 0.99), by: list[str] | None = None) -> DataFrame:
    """Nearest-rank percentiles p50, p95 ... of ``value``."""
    measures = [F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY `{value}`)").alias(f"p{p * 100:g}".replace(".", "_")) for p in points]
    return samples.groupBy(*(by or [])).agg(*measures)


def hit_rate(samples: DataFrame, hits: str = "hits", misses: str = "misses", by: list[str] | None = None) -> DataFrame:
    """hits / (hits + misses), 0 without any."""
    total = F.sum(F.col(hits) + F.col(misses))
    return samples.groupBy(*(by or [])).agg(F.when(total > 0, F.sum(hits) / total).otherwise(0.0).alias("hit_rate"))


def counters(samples: DataFrame, labels: list[str]) -> DataFrame:
    return samples.groupBy(*labels).agg(F.count("*").alias("n"))
