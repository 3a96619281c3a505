"""Parquet tables as typed collections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.collections import Catalog, Collection

#: Key columns of the sample tables.
KEYS = {
    "region": "r_regionkey", "nation": "n_nationkey", "supplier": "s_suppkey", "customer": "c_custkey", "part": "p_partkey",
    "orders": "o_orderkey", "lineitem": ["l_orderkey", "l_linenumber"], "events": "event_id", "documents": "doc_id",
    "labels": "doc_id", "pages": "page_id", "benchmark": "item_id", "conversations": ["conv_id", "turn"], "embeddings": "vec_id",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def collection(spark: SparkSession, folder: str, name: str, **how) -> Collection:
    return Collection(name, table(spark, folder, name), KEYS[name], **how)


def catalog(spark: SparkSession, folder: str, names: list[str], **how) -> Catalog:
    return Catalog([collection(spark, folder, n, **how) for n in names])
