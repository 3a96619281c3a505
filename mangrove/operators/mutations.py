"""Batch upserts and deletes over (type, id, ...) DataFrames, change detection, format counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["type", "id"]


def changes(old: DataFrame, new: DataFrame, text: str = "raw") -> DataFrame:
    """(type, id, status) of every key in ``new``: added, changed or same (equal canonical text)."""
    before = old.select(*KEY, F.col(text).alias("_old"))
    after = new.select(*KEY, F.col(text).alias("_new"))
    joined = after.join(before, KEY, "left")
    status = F.when(F.col("_old").isNull(), "added").when(F.col("_old") == F.col("_new"), "same").otherwise("changed")
    return joined.select(*KEY, status.alias("status"))


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """``old`` with the documents of ``new`` put in.  ``new`` holds each key once; columns meet by name."""
    return old.join(new.select(*KEY), KEY, "left_anti").unionByName(new, allowMissingColumns=True)


def touched(old: DataFrame, new: DataFrame, text: str = "raw") -> DataFrame:
    """The documents of ``new`` that an upsert has to write: equal ones are left out."""
    same = changes(old, new, text).where("status = 'same'").select(*KEY)
    return new.join(same, KEY, "left_anti")


def remove(old: DataFrame, keys: DataFrame) -> DataFrame:
    """``old`` without the given keys; unknown keys change nothing."""
    return old.join(keys.select(*KEY), KEY, "left_anti")


def needs_format(docs: DataFrame, canonical: Column, text: str = "raw") -> DataFrame:
    """Documents whose text is not canonical."""
    return docs.withColumn("canonical", canonical).where(F.col(text) != F.col("canonical"))


def sidecars(docs: DataFrame, files: DataFrame) -> DataFrame:
    """Markdown fields (type, id, field, path, sha256) joined to their files (type, id, path, content): with
    content and error (E_MD_MISSING, E_MD_SHA, or none)."""
    out = docs.join(files, ["type", "id", "path"], "left")
    wrong = F.col("sha256").isNotNull() & (F.sha2("content", 256) != F.lower("sha256"))
    return out.withColumn("error", F.when(F.col("content").isNull(), "E_MD_MISSING").when(wrong, "E_MD_SHA"))
