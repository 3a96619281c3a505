"""The thin queries opN_<name> over whole ``documents`` tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, exact_dedup, language, licenses, line_dedup, media, mixing, sharding, simhash, toxicity
from .common import spread


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For the operators whose work is done row by row in Python."""
    return spread(_documents(spark, sf_dir))


def queries() -> dict:
    return {
        "op1_mixing": lambda s, d: mixing.op1_query(_documents(s, d)),
        "op2_simhash": lambda s, d: simhash.op2_query(_spread(s, d)),
        "op3_licenses": lambda s, d: licenses.op3_query(_documents(s, d)),
        "op4_sharding": lambda s, d: sharding.op4_query(_documents(s, d)),
        "op5_exact_dedup": lambda s, d: exact_dedup.op5_query(_documents(s, d)),
        "op6_bpe": lambda s, d: bpe.op6_query(_spread(s, d)),
        "op7_toxicity": lambda s, d: toxicity.op7_query(_spread(s, d), s.read.parquet(f"{d}/labels.parquet")),
        "op8_language": lambda s, d: language.op8_query(_spread(s, d)),
        "op9_media": lambda s, d: media.op9_query(_spread(s, d)),
        "op10_line_dedup": lambda s, d: line_dedup.op10_query(_spread(s, d)),
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": mixing.SQL, "op3_licenses": licenses.sql(), "op4_sharding": sharding.sql(), "op5_exact_dedup": exact_dedup.SQL}
