"""Collections of documents and catalogs of collections."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import DocumentNotFoundError, QueryError
from ..plans.ordering import order_keys
from ..plans.predicates import compile_filter
from ..plans.projection import project_typed, project_variant
from ..plans.resolver import TypedResolver, VariantResolver
from ..plans.spec import QuerySpec


class Collection:
    """Documents of one type, either a typed DataFrame with key columns or rows (type, id, doc VARIANT)."""

    def __init__(self, name: str, df: DataFrame, key: str | list[str] | None = None, *, null_means: str = "missing", coercion: str = "js"):
        self.name, self.df, self.coercion = name, df, coercion
        self.variant = key is None
        if self.variant:
            self.resolver = VariantResolver()
        else:
            self.resolver = TypedResolver(df, name, [key] if isinstance(key, str) else list(key), null_means)

    def _type_column(self):
        names = self.df.columns
        return F.col("type") if "type" in names else None

    def where(self, filter: Mapping[str, Any]) -> DataFrame:
        return self.df.where(compile_filter(filter, self.resolver, self.coercion)) if filter else self.df

    def query(self, spec: QuerySpec | Mapping[str, Any], *, ordered: bool | None = None, utf16: bool = False) -> DataFrame:
        """Runs filter -> sort -> skip/limit -> projection.

        Rows are ordered where the order shows: with a sort, a limit or a skip, or if ``ordered``; the latter
        costs a global sort, so a plain filter does without it."""
        spec = QuerySpec.of(spec)
        if spec.type is not None and spec.type != self.name:
            raise QueryError(f"collection {self.name} holds no documents of type {spec.type}")
        out = self.where(spec.filter)
        sliced = spec.limit is not None or bool(spec.skip)
        if ordered or spec.sort or sliced:
            out = out.orderBy(*order_keys(spec.sort, self.resolver, self._type_column(), utf16))
        if spec.skip:
            out = out.offset(spec.skip)
        if spec.limit is not None:
            out = out.limit(spec.limit)
        if not spec.projection:
            return out
        return (project_variant if self.variant else project_typed)(out, spec.projection, self.resolver)

    def get(self, id: str) -> DataFrame:
        """The document with this id: one row or none."""
        return self.where({"id": id}).limit(1)

    def require(self, id: str) -> DataFrame:
        found = self.get(id)
        if found.isEmpty():
            raise DocumentNotFoundError(f"{self.name}/{id}")
        return found

    def ids(self, limit: int | None = None) -> DataFrame:
        """Ids in string order."""
        out = self.df.select(self.resolver.id_column().cast("string").alias("id")).orderBy("id")
        return out if limit is None else out.limit(limit)

    def lookup(self, ids: DataFrame, column: str = "id") -> DataFrame:
        """Documents whose id is in ``ids``; a semi-join, so repeated ids give a document once."""
        wanted = ids.select(F.col(column).cast("string").alias("_wanted"))
        return self.df.join(wanted, self.resolver.id_column().cast("string") == F.col("_wanted"), "left_semi")

    def count(self, filter: Mapping[str, Any] | None = None) -> int:
        return self.where(filter or {}).count()

    def keyed(self) -> DataFrame:
        """The documents with ``type`` and ``id`` (string) as first columns."""
        names = [c for c in self.df.columns if c not in ("type", "id")]
        kind = F.col("type") if "type" in self.df.columns else F.lit(self.name)
        return self.df.select(kind.alias("type"), self.resolver.id_column().cast("string").alias("id"), *[F.col(f"`{c}`") for c in names])


class Catalog:
    """Collections by type name; a query without a type runs over all of them."""

    def __init__(self, collections: list[Collection]):
        self.collections = {c.name: c for c in sorted(collections, key=lambda c: c.name)}

    def types(self) -> list[str]:
        """Type names in order; names starting with ``_`` or ``.`` are hidden."""
        return [t for t in self.collections if not t.startswith(("_", "."))]

    def union(self) -> Collection:
        """All visible collections as one: typed columns by name, absent ones null."""
        parts = [self.collections[t] for t in self.types()]
        if not parts:
            raise QueryError("the catalog is empty")
        df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [c.keyed() for c in parts])
        variant = all(c.variant for c in parts)
        return Collection("*", df, None if variant else "id", coercion=parts[0].coercion)

    def query(self, spec: QuerySpec | Mapping[str, Any], **how) -> DataFrame:
        spec = QuerySpec.of(spec)
        if spec.type is None:
            return self.union().query(spec, **how)
        if spec.type not in self.collections:
            raise QueryError(f"no collection {spec.type}")
        return self.collections[spec.type].query(spec, **how)
