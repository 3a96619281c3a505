"""A versioned store of VARIANT documents on any Hadoop file system, for batches of any size.

Each type has a folder of immutable Parquet versions and a file CURRENT that names the valid one; a commit writes
a whole new version beside the old one and renames CURRENT last, so readers always see one full version and a
failed job leaves the old one in place.  One writer at a time per type.

``put`` takes a batch through the same steps as a single document: key check, schema check, slug, comparison
with what is stored, write, slug and alias tables, derived indexes.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import reduce
from typing import Any, Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import DocumentNotFoundError, DocumentWriteError, ValidationError
from ..functions.names import is_name, validate_name, validate_type_name
from ..functions.slugs import MAX_SLUG, slug_base, slug_error, slug_source
from ..operators import indexes
from ..operators.collections import Catalog, Collection
from ..operators.mutations import remove, touched, upsert
from ..operators.unique_slugs import numbered_slug, unique_slugs
from ..operators.validation import split_valid

DOCUMENTS, SLUGS, ALIASES = "documents", "slugs", "aliases"
_SCHEMAS = {
    DOCUMENTS: "type string, id string, doc variant",
    SLUGS: "type string, scope string, slug string, id string",
    ALIASES: "type string, scope string, alias string, id string",
}
_KEPT = 2


class IndexAdapter(Protocol):
    """A derived table: built from a type's documents and committed with them under its name."""

    name: str

    def build(self, documents: Collection) -> DataFrame: ...


@dataclass
class EqualityIndex:
    """The adapter of an equality index on one field."""

    on: str

    @property
    def name(self) -> str:
        return f"index-{self.on}"

    def build(self, documents: Collection) -> DataFrame:
        return indexes.build_index(documents, self.on)


@dataclass
class SlugPolicy:
    """Where a type's slugs come from: source paths, scope paths (or a function of the resolver), length."""

    source: list[str]
    scope: list[str] | Callable[[Any], Column] = field(default_factory=list)
    max_length: int = MAX_SLUG
    unicode: bool = True
    keep_aliases: bool = True

    def scope_column(self, resolver) -> Column:
        if callable(self.scope):
            return self.scope(resolver)
        parts = [F.coalesce(resolver.field(p)._as("string"), F.lit("")) for p in self.scope]
        return F.concat_ws("/", *parts) if parts else F.lit("")


@dataclass
class Result:
    """What a batch did."""

    written: int
    unchanged: int
    quarantined: DataFrame | None = None


class DocumentStore:
    def __init__(self, spark: SparkSession, root: str, slugs: Mapping[str, SlugPolicy] | None = None, adapters: Mapping[str, list[IndexAdapter]] | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        self.slugs, self.adapters = dict(slugs or {}), {k: list(v) for k, v in (adapters or {}).items()}

    # files

    def _fs(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _path(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _current(self, type_: str, name: str) -> str | None:
        fs, at = self._fs(f"{self.root}/{type_}/{name}/CURRENT")
        if not fs.exists(at):
            return None
        stream = fs.open(at)
        try:
            return bytearray(stream.readAllBytes()).decode().strip()
        finally:
            stream.close()

    def _commit(self, type_: str, name: str, df: DataFrame) -> None:
        folder, version = f"{self.root}/{type_}/{name}", uuid.uuid4().hex
        df.write.parquet(f"{folder}/{version}")
        fs, at = self._fs(f"{folder}/.CURRENT-{version}")
        stream = fs.create(at, True)
        stream.write(bytearray(version.encode()))
        stream.close()
        target = self._path(f"{folder}/CURRENT")
        context = self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        rename = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        try:
            context.rename(at, target, options)
        except Exception as bad:
            raise DocumentWriteError(f"{type_}/{name}: {bad}") from bad
        self._drop_old(fs, folder, version)

    def _drop_old(self, fs, folder: str, version: str) -> None:
        """Keeps the newest versions, so that readers of the one before can finish."""
        found = [s for s in fs.listStatus(self._path(folder)) if s.isDirectory() and s.getPath().getName() != version]
        for s in sorted(found, key=lambda s: -s.getModificationTime())[_KEPT - 1 :]:
            fs.delete(s.getPath(), True)

    def table(self, type_: str, name: str = DOCUMENTS) -> DataFrame | None:
        version = self._current(validate_name(type_, "type"), name)
        return None if version is None else self.spark.read.parquet(f"{self.root}/{type_}/{name}/{version}")

    def _table_or_empty(self, type_: str, name: str) -> DataFrame:
        found = self.table(type_, name)
        return self.spark.createDataFrame([], _SCHEMAS[name]) if found is None else found

    # reading

    def types(self) -> list[str]:
        fs, at = self._fs(self.root)
        if not fs.exists(at):
            return []
        names = sorted(s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory())
        return [n for n in names if not n.startswith(("_", ".")) and validate_type_name(n) and self._current(n, DOCUMENTS)]

    def collection(self, type_: str, **how) -> Collection:
        return Collection(type_, self._table_or_empty(type_, DOCUMENTS), **how)

    def catalog(self, **how) -> Catalog:
        return Catalog([self.collection(t, **how) for t in self.types()])

    def query(self, spec, **how) -> DataFrame:
        return self.catalog().query(spec, **how)

    def by_slug(self, type_: str, slug: str, scope: str = "") -> DataFrame:
        """The document that holds a slug, or had it (alias)."""
        wanted = self.spark.createDataFrame([(type_, scope, slug)], "type string, scope string, slug string")
        ids = indexes.resolve_slugs(wanted, self._table_or_empty(type_, SLUGS), self._table_or_empty(type_, ALIASES))
        return self.collection(type_).lookup(ids.where(F.col("id").isNotNull()))

    def require(self, type_: str, id_: str) -> DataFrame:
        found = self.collection(type_).get(id_)
        if found.isEmpty():
            raise DocumentNotFoundError(f"{type_}/{id_}")
        return found

    # writing

    def put(self, docs: DataFrame, schema: Mapping[str, Any] | None = None, mode: str = "strict") -> Result:
        """Puts a batch (type, id, doc VARIANT), each key once.  Bad keys raise; documents that fail ``schema``
        in strict mode are quarantined and the rest is written.  Equal documents are not written again."""
        docs = docs.select("type", "id", "doc")
        agree = lambda k: F.coalesce(F.try_variant_get("doc", f"$.{k}", "string") == F.col(k), F.lit(False))
        checks = docs.agg(
            F.count(F.when(~(is_name(F.col("type")) & is_name(F.col("id")) & agree("type") & agree("id")), 1)).alias("bad"),
            F.count("*").alias("n"), F.countDistinct("type", "id").alias("keys"), F.collect_set("type").alias("types")).first()
        if checks.bad or checks.n != checks["keys"]:
            raise ValidationError(f"{checks.bad} documents with bad keys, {checks.n - checks['keys']} repeated keys")
        quarantined, written, unchanged = None, 0, 0
        parts = []
        for type_ in sorted(checks.types):
            batch = docs.where(F.col("type") == type_)
            if schema is not None:
                batch, bad = split_valid(Collection(type_, batch), schema, mode=mode)
                parts.append(bad)
            w, u = self._put_type(type_, batch)
            written, unchanged = written + w, unchanged + u
        if parts:
            quarantined = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        return Result(written, unchanged, quarantined)

    def _put_type(self, type_: str, batch: DataFrame) -> tuple[int, int]:
        old = self._table_or_empty(type_, DOCUMENTS)
        total = batch.count()
        if type_ in self.slugs:
            batch = self._with_slugs(type_, batch)
        text = lambda df: df.withColumn("raw", F.to_json("doc"))  # noqa: E731 - sorted keys, so equal values are equal texts
        new = touched(text(old), text(batch)).drop("raw")
        n = new.count()
        if n:
            self._commit(type_, DOCUMENTS, upsert(old, new))
            self._derive(type_)
        return n, total - n

    def _with_slugs(self, type_: str, batch: DataFrame) -> DataFrame:
        """Documents with ``slug``: a held slug is kept while its base and scope stay, others get a free one."""
        policy, resolver = self.slugs[type_], Collection(type_, batch).resolver
        held, aliases = self._table_or_empty(type_, SLUGS), self._table_or_empty(type_, ALIASES)
        source = slug_source(*[resolver.field(p)._as("string") for p in policy.source])
        rows = batch.withColumn("scope", policy.scope_column(resolver)).withColumn("_source", source)
        rows = rows.withColumn("base", slug_base(F.col("_source"), policy.max_length, unicode=policy.unicode))
        failed = rows.withColumn("_e", slug_error(F.col("_source"), F.col("base"))).where(F.col("_e").isNotNull()).select("id", "_e").first()
        if failed is not None:
            raise ValidationError(f"{type_}/{failed.id}: no slug ({failed._e})")
        mine = held.select("id", F.col("scope").alias("_scope"), F.col("slug").alias("_slug"))
        rows = rows.join(mine, "id", "left")
        number = F.regexp_extract("_slug", r"-([0-9]+)$", 1)
        # a held slug is its base, or its base cut to make room for its number
        numbered = (number != "") & (F.col("_slug") == numbered_slug(F.col("base"), F.greatest(F.try_to_number(number, F.lit("9" * 18)), F.lit(2)), policy.max_length))
        keeps = (F.col("_scope") == F.col("scope")) & ((F.col("_slug") == F.col("base")) | numbered)
        rows = rows.withColumn("_keeps", F.coalesce(keeps, F.lit(False)))
        others = held.join(rows.select("id"), "id", "left_anti").select("scope", F.col("slug").alias("base"), F.lit("").alias("id"), F.lit(True).alias("_fixed"))
        kept = rows.where("_keeps").select("scope", F.col("_slug").alias("base"), F.lit("").alias("id"), F.lit(True).alias("_fixed"))
        free = rows.where("NOT _keeps").select("scope", "base", "id", F.lit(False).alias("_fixed"))
        given = unique_slugs(others.unionByName(kept).unionByName(free), ["scope"], max_length=policy.max_length).where("NOT _fixed").select("id", F.col("slug").alias("_new"))
        rows = rows.join(given, "id", "left").withColumn("slug", F.when(F.col("_keeps"), F.col("_slug")).otherwise(F.col("_new")))
        self._commit(type_, "_staged", rows.select("type", "id", "doc", "scope", "slug", "_scope", "_slug"))
        rows = self.table(type_, "_staged")  # the tables that slugs were chosen from change below
        table = held.join(rows.select("id"), "id", "left_anti").select(*held.columns).unionByName(rows.select("type", "scope", "slug", "id"))
        if policy.keep_aliases:
            moved = rows.where(F.col("_slug").isNotNull() & ((F.col("_slug") != F.col("slug")) | (F.col("_scope") != F.col("scope"))))
            after, _ = indexes.update_aliases(table, aliases, moved.select("type", F.col("_scope").alias("scope"), F.col("_slug").alias("alias"), "id"))
            self._commit(type_, ALIASES, after)
        entries = F.map_concat(F.map_filter(F.try_variant_get("doc", "$", "map<string,variant>"), lambda k, _: k != "slug"), F.create_map(F.lit("slug"), F.parse_json(F.concat(F.lit('"'), "slug", F.lit('"')))))
        out = rows.select("type", "id", F.to_variant_object(entries).alias("doc"))
        self._commit(type_, SLUGS, table)
        return out

    def remove(self, keys: DataFrame) -> int:
        """Deletes documents by (type, id) and releases their slugs and aliases; the number deleted."""
        gone = 0
        for (type_,) in keys.select("type").distinct().collect():
            part, old = keys.where(F.col("type") == type_), self.table(type_)
            if old is None:
                continue
            n = old.join(part.select("type", "id"), ["type", "id"], "left_semi").count()
            if n:
                self._commit(type_, DOCUMENTS, remove(old, part))
                for name in (SLUGS, ALIASES):
                    if (table := self.table(type_, name)) is not None:
                        self._commit(type_, name, remove(table, part))
                self._derive(type_)
                gone += n
        return gone

    # derived tables

    def _derive(self, type_: str) -> None:
        for adapter in self.adapters.get(type_, ()):
            self._commit(type_, adapter.name, adapter.build(self.collection(type_)))

    def ensure_index(self, type_: str, on: str) -> DataFrame:
        """Builds an equality index, which later puts and removes keep up to date; building again replaces it."""
        adapters = self.adapters.setdefault(type_, [])
        adapter = EqualityIndex(on)
        if adapter.name not in [a.name for a in adapters]:
            adapters.append(adapter)
        self._commit(type_, adapter.name, adapter.build(self.collection(type_)))
        return self.table(type_, adapter.name)

    def find(self, type_: str, on: str, value: Any) -> DataFrame:
        """Documents by value, through the index where there is one."""
        index = self.table(type_, f"index-{on}")
        if index is None:
            return self.collection(type_).where({on: {"$in": list(value)} if isinstance(value, (list, tuple)) else value})
        return indexes.query_with_index(self.collection(type_), index, on, value)
