"""Equality indexes, slug and alias tables as DataFrames.

An index is flat, a row (type, field, key, id) for each different pair, so a key that a third of all documents
have needs no task that holds all its ids; ``as_arrays`` gives the grouped form for indexes known to be small.
"""

from __future__ import annotations

import time
from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ValidationError
from ..functions.names import validate_name
from ..plans.fields import Absent, Variant
from ..plans.values import kind_of
from .collections import Collection

RESERVED = ("_slug", "_alias")
#: What keeps keys of different kinds apart.
PREFIXES = ("__num__", "__bool__", "__null__")
NESTED = 4


def number_text(value: Column, kind: T.DataType) -> Column:
    """A number the way JSON prints it: no trailing ``.0``, plain digits where short."""
    if isinstance(kind, T.IntegralType):
        return value.cast("string")
    value = value.cast("double")
    whole = (value == F.floor(value)) & (F.abs(value) < 1e21)
    plain = F.regexp_replace(value.cast("decimal(38,18)").cast("string"), r"\.?0+$", "")
    text = value.cast("string")
    return F.when(whole, value.cast("decimal(38,0)").cast("string")).when(text.contains("E") & (F.abs(value) >= 1e-6) & (F.abs(value) < 1e19), plain).otherwise(text)


def _string_key(text: Column) -> Column:
    escaped = text.rlike("^(" + "|".join(PREFIXES) + ")")
    return F.when(escaped, F.concat(F.lit("__str__:"), text)).otherwise(text)


def _variant_keys(value: Variant, nested: int = NESTED) -> Column:
    v = value._as
    one = (
        F.when(value.is_kind("string"), _string_key(v("string")))
        .when(value.is_kind("number"), F.concat(F.lit("__num__"), F.when(value._tag() == "BIGINT", v("bigint").cast("string")).otherwise(number_text(v("double"), T.DoubleType()))))
        .when(value.is_kind("boolean"), F.concat(F.lit("__bool__"), v("string")))
        .when(value.is_kind("null"), F.lit("__null__"))
        .otherwise(F.concat(F.lit("__obj__:"), F.to_json(v("variant"))))
    )
    if not nested:
        return F.array(one)
    each = F.flatten(F.transform(v("array<variant>"), lambda x: _variant_keys(Variant(x, []), nested - 1)))
    return F.when(value.is_kind("array"), each).otherwise(F.array(one))


def _typed_keys(column: Column, kind: T.DataType, nulls: bool) -> Column:
    if isinstance(kind, T.VariantType):
        return _variant_keys(Variant(column, []))
    if isinstance(kind, T.ArrayType):
        return F.flatten(F.transform(column, lambda x: _typed_keys(x, kind.elementType, True)))
    if isinstance(kind, T.BooleanType):
        one = F.concat(F.lit("__bool__"), column.cast("string"))
    elif isinstance(kind, T.NumericType):
        one = F.concat(F.lit("__num__"), number_text(column, kind))
    elif isinstance(kind, (T.StructType, T.MapType)):
        one = F.concat(F.lit("__obj__:"), F.to_json(F.parse_json(F.to_json(column))))
    else:
        one = _string_key(column.cast("string"))
    return F.array(F.coalesce(one, F.lit("__null__")) if nulls else one)


def index_keys(field) -> Column:
    """The keys of a field's value: one for a scalar, one for each element of an array, NULL where missing."""
    if isinstance(field, Absent):
        return F.lit(None).cast("array<string>")
    if isinstance(field, Variant):
        return F.when(field.get("variant").isNotNull(), _variant_keys(field))
    keys = _typed_keys(field.column, field.type, field.nulls)
    return keys if field.nulls else F.when(field.column.isNotNull(), keys)


def key_of(value: Any) -> str:
    """The key that a literal is looked up by."""
    kind = kind_of(value)
    if kind == "string":
        return f"__str__:{value}" if value.startswith(PREFIXES) else value
    if kind == "number":
        from ..functions.canonical import _number

        return "__num__" + (str(value) if isinstance(value, int) else _number(value))
    if kind == "boolean":
        return f"__bool__{str(value).lower()}"
    if kind == "null":
        return "__null__"
    raise ValidationError("indexes are looked up by scalars")


def build_index(collection: Collection, field: str) -> DataFrame:
    """(type, field, key, id), each pair once: one explode and one distinct, combined map-side."""
    if field in RESERVED:
        raise ValidationError(f"{field} is a reserved index name")
    keys = index_keys(collection.resolver.field(field))
    rows = collection.df.select(F.explode(keys).alias("key"), collection.resolver.id_column().cast("string").alias("id"))
    rows = rows.where(F.col("key").isNotNull()).distinct()
    return rows.select(F.lit(collection.name).alias("type"), F.lit(field).alias("field"), "key", "id")


def as_arrays(index: DataFrame) -> DataFrame:
    """(type, field, key, ids): sorted ids by key."""
    return index.groupBy("type", "field", "key").agg(F.sort_array(F.collect_set("id")).alias("ids"))


def key_counts(index: DataFrame) -> DataFrame:
    """(key, n, first_id) by key."""
    return index.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


def _with_value(index: DataFrame, value: Any) -> DataFrame:
    keys = [key_of(v) for v in (value if isinstance(value, (list, tuple)) else [value])]
    return index.where(F.col("key").isin(keys))


def lookup(index: DataFrame, value: Any) -> DataFrame:
    """Sorted distinct ids of one value or of any value in a list."""
    return _with_value(index, value).select("id").distinct().orderBy("id")


def query_with_index(collection: Collection, index: DataFrame, field: str, value: Any, filter: Mapping[str, Any] | None = None) -> DataFrame:
    """Documents of a value through the index; the filter is checked again, so a stale index adds no rows."""
    found = Collection(collection.name, collection.lookup(_with_value(index, value).select("id")), None if collection.variant else collection.resolver.key, coercion=collection.coercion)
    same = {field: {"$in": list(value)} if isinstance(value, (list, tuple)) else value}
    return found.where(same if filter is None else filter)


def update_index(index: DataFrame, changed: Collection, field: str, removed: DataFrame | None = None) -> DataFrame:
    """The index after ``changed`` documents were put and ids in ``removed`` deleted."""
    gone = changed.df.select(changed.resolver.id_column().cast("string").alias("id"))
    if removed is not None:
        gone = gone.unionByName(removed.select(F.col("id").cast("string")))
    kept = index.join(gone.distinct(), "id", "left_anti").select(*index.columns)
    return kept.unionByName(build_index(changed, field))


def index_stats(collection: Collection, index: DataFrame) -> DataFrame:
    """One row: docs scanned, keys, entries, bytes of keys and ids."""
    empty = lambda kind: F.lit(None).cast(kind)
    rows = index.select("key", (F.octet_length("key") + F.octet_length("id")).alias("size"), F.lit(0).alias("doc"))
    rows = rows.unionByName(collection.df.select(empty("string").alias("key"), empty("int").alias("size"), F.lit(1).alias("doc")))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return rows.groupBy("key").agg(F.count("size").alias("n"), zero("size").alias("size"), zero("doc").alias("docs")).agg(
        zero("docs").alias("docs_scanned"), F.count("key").alias("keys"), zero("n").alias("entries"), zero("size").alias("bytes"))


@dataclass
class FieldSummary:
    type: str
    field: str
    docs_scanned: int
    keys: int
    bytes: int
    duration_ms: float


class IndexStore:
    """Indexes kept as Parquet under ``root``/<type>/<field>; a build always replaces what is there."""

    def __init__(self, root: str):
        self.root = root.rstrip("/")

    def _path(self, type_: str, field: str) -> str:
        validate_name(type_, "type")
        if field in RESERVED:
            raise ValidationError(f"{field} is a reserved index name")
        return f"{self.root}/{type_}/{field}"

    def _fs(self, spark, path: str):
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where

    def ensure(self, collection: Collection, field: str) -> FieldSummary:
        began = time.perf_counter()
        build_index(collection, field).write.mode("overwrite").parquet(self._path(collection.name, field))
        stats = index_stats(collection, self.read(collection.df.sparkSession, collection.name, field)).first()
        return FieldSummary(collection.name, field, stats.docs_scanned, stats["keys"], stats["bytes"], (time.perf_counter() - began) * 1000)

    def read(self, spark, type_: str, field: str) -> DataFrame:
        return spark.read.parquet(self._path(type_, field))

    def exists(self, spark, type_: str, field: str) -> bool:
        fs, where = self._fs(spark, self._path(type_, field) + "/_SUCCESS")
        return fs.exists(where)

    def fields(self, spark, type_: str) -> list[str]:
        fs, where = self._fs(spark, f"{self.root}/{type_}")
        return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []

    def remove(self, spark, type_: str, field: str) -> bool:
        fs, where = self._fs(spark, self._path(type_, field))
        return fs.delete(where, True)

    def reindex(self, collections: list[Collection], fields: Mapping[str, list[str]] | None = None, force: bool = False) -> list[FieldSummary]:
        """Rebuilds the given fields, or the union of given and existing ones; ``force`` deletes first."""
        out = []
        for c in collections:
            spark = c.df.sparkSession
            wanted = sorted((set((fields or {}).get(c.name, ())) | set(self.fields(spark, c.name))) - set(RESERVED))
            for field in wanted:
                if force:
                    self.remove(spark, c.name, field)
                out.append(self.ensure(c, field))
        return out


def reindex_totals(summaries: list[FieldSummary]) -> dict[str, Any]:
    docs = {s.type: s.docs_scanned for s in summaries}
    return {"types": sorted(docs), "total_docs": sum(docs.values()), "total_indexes": len(summaries), "duration_ms": sum(s.duration_ms for s in summaries)}


# slug and alias tables: (type, scope, slug, id) and (type, scope, alias, id)


def slug_conflicts(claims: DataFrame) -> DataFrame:
    """Slugs claimed by more than one document in a scope, with the holder (smallest id)."""
    out = claims.groupBy("type", "scope", "slug").agg(F.countDistinct("id").alias("claims"), F.min("id").alias("holder"))
    return out.where("claims > 1")


def claim_slugs(table: DataFrame, claims: DataFrame) -> DataFrame:
    """Claims with ok and holder: a slug that another document holds is refused; among new claims the smallest
    id wins."""
    held = table.select("type", "scope", "slug", F.col("id").alias("held_by"))
    first = claims.groupBy("type", "scope", "slug").agg(F.min("id").alias("first"))
    out = claims.join(held, ["type", "scope", "slug"], "left").join(first, ["type", "scope", "slug"])
    holder = F.coalesce("held_by", "first")
    return out.select("type", "scope", "slug", "id", (holder == F.col("id")).alias("ok"), holder.alias("holder"))


def release_slugs(table: DataFrame, released: DataFrame) -> DataFrame:
    """The table without the (type, scope, slug, id) rows of ``released``."""
    return table.join(released, ["type", "scope", "slug", "id"], "left_anti")


def update_aliases(slugs: DataFrame, aliases: DataFrame, add: DataFrame, remove: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(aliases after the update, refused additions).  An alias is refused if another document holds it as a
    slug or as an alias."""
    if remove is not None:
        aliases = aliases.join(remove, ["type", "scope", "alias", "id"], "left_anti")
    taken = slugs.select("type", "scope", F.col("slug").alias("alias"), "id").unionByName(aliases).withColumnRenamed("id", "holder")
    judged = add.join(taken, ["type", "scope", "alias"], "left").groupBy("type", "scope", "alias", "id").agg(
        F.max(F.when(F.col("holder") != F.col("id"), F.col("holder"))).alias("holder"))
    good = judged.where(F.col("holder").isNull()).drop("holder")
    return aliases.unionByName(good).distinct(), judged.where(F.col("holder").isNotNull())


def resolve_slugs(wanted: DataFrame, slugs: DataFrame, aliases: DataFrame) -> DataFrame:
    """``wanted`` (type, scope, slug) with id: by slug, else by alias, else NULL."""
    by_slug = slugs.withColumnRenamed("id", "_slug_id")
    by_alias = aliases.withColumnsRenamed({"id": "_alias_id", "alias": "slug"})
    out = wanted.join(by_slug, ["type", "scope", "slug"], "left").join(by_alias, ["type", "scope", "slug"], "left")
    return out.withColumn("id", F.coalesce("_slug_id", "_alias_id")).drop("_slug_id", "_alias_id")
