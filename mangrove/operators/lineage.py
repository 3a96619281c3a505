"""Cutting the lineage of iterative plans."""

from __future__ import annotations

from pyspark.sql import DataFrame


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once: checkpointed into the shared folder where the session names one, so lost executors
    cost no recomputation of earlier rounds, else persisted (memory and disk)."""
    spark = df.sparkSession
    if spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return df.checkpoint()
    return df.persist()
