"""JSON Schema validation compiled to an array-of-errors column.

Supported: type, enum, const, required, properties, additionalProperties (false or true), items, minimum,
maximum, exclusiveMinimum, exclusiveMaximum, minLength, maxLength, pattern, format, local $ref.  Any other
keyword that restricts documents raises when the schema is compiled.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ValidationError
from ..functions.names import format_check, resolve_pointer, validate_schema_ref
from ..plans.fields import Absent, Typed, Variant, _any

DRAFT = "https://json-schema.org/draft/2020-12/schema"
ANNOTATIONS = {"$id", "$schema", "$defs", "definitions", "$comment", "title", "description", "default", "examples", "deprecated", "readOnly", "writeOnly"}
KEYWORDS = {
    "type", "enum", "const", "required", "properties", "additionalProperties", "items", "minimum", "maximum", "exclusiveMinimum",
    "exclusiveMaximum", "minLength", "maxLength", "pattern", "format", "$ref",
}
ERROR = "array<struct<code:string,pointer:string,message:string>>"
MAX_REFS = 16

Format = Callable[[Column], Column]


def _text(field) -> Column:
    return field._as("string") if isinstance(field, Variant) else field.column


def _number(field) -> Column:
    return field._as("double") if isinstance(field, Variant) else field.column


def _is(field, name: str) -> Column:
    if isinstance(field, Absent):
        return F.lit(False)
    if name == "integer":
        if isinstance(field, Typed) and isinstance(field.type, T.IntegralType):
            return field.column.isNotNull()
        return _is(field, "number") & (_number(field) == F.floor(_number(field)))
    if name == "null":
        return field.is_kind("null") if isinstance(field, Variant) else F.lit(False)
    if name == "object" and isinstance(field, Variant):
        return field.is_kind("object")
    return field.type_is(name)


class SchemaCompiler:
    def __init__(self, schema: Mapping[str, Any], resolver, formats: Mapping[str, Format] | None = None):
        self.root, self.resolver, self.formats = schema, resolver, formats or {}

    def errors(self) -> Column:
        """All errors of a document."""
        return self._join(self._object(self.root, [], F.lit(""), 0))

    @staticmethod
    def _join(parts: list[Column]) -> Column:
        return F.flatten(F.array(*parts)) if parts else F.array().cast(ERROR)

    @staticmethod
    def _error(bad: Column, code: str, pointer: Column, message: str) -> Column:
        one = F.struct(F.lit(code).alias("code"), pointer.alias("pointer"), F.lit(message).alias("message"))
        return F.when(F.coalesce(bad, F.lit(False)), F.array(one)).otherwise(F.array().cast(ERROR))

    def _checked(self, schema: Any, depth: int) -> Mapping[str, Any]:
        if schema is True:
            return {}
        if not isinstance(schema, Mapping):
            raise ValidationError(f"unsupported schema {schema!r}")
        if extra := set(schema) - KEYWORDS - ANNOTATIONS:
            raise ValidationError(f"unsupported schema keywords: {', '.join(sorted(extra))}")
        if "$ref" in schema:
            if depth > MAX_REFS:
                raise ValidationError("schema references go too deep")
            ref = schema["$ref"]
            if not ref.startswith("#"):
                raise ValidationError(f"only local references are supported, not {ref!r}")
            try:
                target = resolve_pointer(self.root, ref)
            except (KeyError, IndexError, ValueError):
                raise ValidationError(f"unresolved reference {ref!r}") from None
            return {**self._checked(target, depth + 1), **{k: v for k, v in schema.items() if k != "$ref"}}
        return schema

    def _object(self, schema: Any, path: list[str], pointer: Column, depth: int) -> list[Column]:
        """Errors of the object at ``path`` (the document itself for an empty one)."""
        schema = self._checked(schema, depth)
        inside = F.lit(True) if not path else _is(self.resolver.field(".".join(path)), "object")
        out = []
        for name in schema.get("required", ()):
            missing = inside & self.resolver.field(".".join([*path, name])).exists(False)
            out.append(self._error(missing, "required", F.concat(pointer, F.lit(f"/{name}")), f"must have property {name}"))
        for name, part in schema.get("properties", {}).items():
            below = [*path, name]
            at = F.concat(pointer, F.lit(f"/{name}"))
            out += self._value(self.resolver.field(".".join(below)), part, at, depth)
            part = self._checked(part, depth)
            if "properties" in part or "required" in part or "additionalProperties" in part:
                out += self._object(part, below, at, depth + 1)
        extra = schema.get("additionalProperties", True)
        if extra is False:
            out.append(self._error(self._extra(set(schema.get("properties", {})), path), "additional", pointer, "must not have additional properties"))
        elif extra is not True:
            raise ValidationError("additionalProperties must be true or false")
        return out

    def _extra(self, known: set[str], path: list[str]) -> Column:
        field = self.resolver.field(".".join(path)) if path else None
        if path and isinstance(field, Variant) or not path and hasattr(self.resolver, "column"):
            value = field or Variant(F.col(self.resolver.column), [])
            names = F.map_keys(value._as("map<string,variant>"))
            return F.size(F.array_except(names, F.array(*map(F.lit, sorted(known))) if known else F.array().cast("array<string>"))) > 0
        if path and isinstance(field, Typed) and isinstance(field.type, T.StructType):
            return _any([field.column.getField(n).isNotNull() for n in field.type.names if n not in known])
        names = self.resolver.schema.names if not path else []
        return _any([F.col(f"`{n}`").isNotNull() for n in names if n not in known])

    def _value(self, field, schema: Any, pointer: Column, depth: int) -> list[Column]:
        """Errors of one value against the keywords that look at the value alone."""
        schema = self._checked(schema, depth)
        if isinstance(field, Absent):
            return []
        there = field.exists(True)
        out = []

        def check(keyword: str, code: str, bad: Column, message: str) -> None:
            if keyword in schema:
                out.append(self._error(bad, code, pointer, message))

        if "type" in schema:
            names = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
            check("type", "type", there & ~F.coalesce(_any([_is(field, n) for n in names]), F.lit(False)), f"must be {','.join(names)}")
        if "enum" in schema:
            check("enum", "enum", there & ~F.coalesce(field.isin(schema["enum"]), F.lit(False)), "must be equal to one of the allowed values")
        if "const" in schema:
            check("const", "custom", there & ~F.coalesce(field.isin([schema["const"]]), F.lit(False)), "must be equal to constant")
        number, text = _is(field, "number"), _is(field, "string")
        for keyword, code, bad, sign in (
            ("minimum", "minimum", lambda x, v: x < v, ">="),
            ("exclusiveMinimum", "minimum", lambda x, v: x <= v, ">"),
            ("maximum", "maximum", lambda x, v: x > v, "<="),
            ("exclusiveMaximum", "maximum", lambda x, v: x >= v, "<"),
        ):
            if keyword in schema and self._may(field, "number"):
                check(keyword, code, number & bad(_number(field), F.lit(schema[keyword])), f"must be {sign} {schema[keyword]}")
        if self._may(field, "string"):
            if "minLength" in schema:
                check("minLength", "minLength", text & (F.length(_text(field)) < schema["minLength"]), f"must NOT have fewer than {schema['minLength']} characters")
            if "maxLength" in schema:
                check("maxLength", "maxLength", text & (F.length(_text(field)) > schema["maxLength"]), f"must NOT have more than {schema['maxLength']} characters")
            if "pattern" in schema:
                check("pattern", "pattern", text & ~_text(field).rlike(schema["pattern"]), f'must match pattern "{schema["pattern"]}"')
            if "format" in schema:
                name = schema["format"]
                good = self.formats[name](_text(field)) if name in self.formats else format_check(name, _text(field))
                check("format", "format", text & ~good, f'must match format "{name}"')
        if "items" in schema:
            out += self._items(field, schema["items"], pointer, depth)
        return out

    @staticmethod
    def _may(field, kind: str) -> bool:
        return isinstance(field, Variant) or field.kind == kind

    def _items(self, field, schema: Any, pointer: Column, depth: int) -> list[Column]:
        def each(x: Column, i: Column) -> Column:
            element = Variant(x, []) if variant else Typed(x, kind)
            return self._join(self._value(element, schema, F.concat(pointer, F.lit("/"), i.cast("string")), depth + 1))

        variant = isinstance(field, Variant)
        if not variant and field.kind != "array":
            return []
        kind = None if variant else field.type.elementType
        variant_items, variant = (field._as("array<variant>"), True) if variant else (field.column, isinstance(kind, T.VariantType))
        found = F.flatten(F.transform(variant_items, each))
        return [F.coalesce(found, F.array().cast(ERROR))]


class SchemaRegistry:
    """Schemas by reference ``schema/<kind>@<major>``."""

    def __init__(self):
        self.schemas: dict[str, Mapping[str, Any]] = {}
        self.digests: dict[str, str] = {}

    def add(self, schema: Mapping[str, Any], filename: str | None = None) -> str:
        ref = schema.get("$id", "")
        validate_schema_ref(ref)
        if schema.get("$schema", DRAFT).rstrip("#") != DRAFT:
            raise ValidationError(f"{ref}: only draft 2020-12 is supported")
        if filename is not None and filename.removesuffix(".json") != ref.removeprefix("schema/"):
            raise ValidationError(f"{filename} should be named {ref.removeprefix('schema/')}.json")
        self.schemas[ref] = schema
        self.digests[ref] = hashlib.sha256(json.dumps(schema, sort_keys=True).encode()).hexdigest()
        return ref

    def load(self, root: str | Path) -> list[str]:
        """All schemas in ``root``/_meta/schemas, in name order; none if the folder is absent."""
        folder = Path(root) / "_meta" / "schemas"
        return [self.add(json.loads(p.read_text()), p.name) for p in sorted(folder.glob("*.json"))] if folder.is_dir() else []

    def save(self, root: str | Path, schema: Mapping[str, Any]) -> Path:
        ref = self.add(schema)
        at = Path(root) / "_meta" / "schemas" / f"{ref.removeprefix('schema/')}.json"
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(json.dumps(schema, indent=2) + "\n")
        return at

    def refs(self) -> list[str]:
        return sorted(self.schemas)


def validate(collection, schema: Mapping[str, Any] | str, mode: str = "strict", registry: SchemaRegistry | None = None, formats=None) -> DataFrame:
    """The collection's documents with ``ok`` and ``errors``.

    ``off`` accepts all; ``lenient`` lists no additional-property errors, though they still make ``ok`` false;
    an unknown reference gives the one error ``ref``."""
    none = F.array().cast(ERROR)
    if mode not in ("strict", "lenient", "off"):
        raise ValidationError(f"unknown mode {mode!r}")
    if mode == "off":
        return collection.df.withColumns({"ok": F.lit(True), "errors": none})
    if isinstance(schema, str):
        found = registry.schemas.get(schema) if registry else None
        if found is None:
            one = F.array(F.struct(F.lit("ref").alias("code"), F.lit("").alias("pointer"), F.lit(f"Schema not found: {schema}").alias("message")))
            return collection.df.withColumns({"ok": F.lit(False), "errors": one})
        schema = found
    out = collection.df.withColumn("errors", SchemaCompiler(schema, collection.resolver, formats).errors())
    out = out.withColumn("ok", F.size("errors") == 0)
    if mode == "lenient":
        out = out.withColumn("errors", F.filter("errors", lambda e: e["code"] != "additional"))
    return out


def validate_by_reference(collection, registry: SchemaRegistry, defaults: Mapping[str, str] | None = None, mode: str = "strict", ref_field: str = "schemaRef", kind_field: str = "kind", formats=None) -> DataFrame:
    """Every document against the schema it names, else its kind's default: with ``schema``, ``ok``, ``errors``.

    One pass: a branch per registered schema.  Without any schema a document is fine, except in strict mode,
    where it has the error ``ref``; so has one that names an unknown schema."""

    def text(path: str) -> Column:
        field = collection.resolver.field(path)
        return F.lit(None).cast("string") if isinstance(field, Absent) else _text(field)

    ref, kind = text(ref_field), text(kind_field)
    for name, default in (defaults or {}).items():
        ref = F.coalesce(ref, F.when(kind == name, default))
    none = F.array().cast(ERROR)

    def missing(message: Column) -> Column:
        return F.array(F.struct(F.lit("ref").alias("code"), F.lit("").alias("pointer"), message.alias("message")))

    unnamed = missing(F.lit("No schema for document")) if mode == "strict" else none
    errors = F.when(ref.isNull(), unnamed)
    for name in registry.refs():
        errors = errors.when(ref == name, SchemaCompiler(registry.schemas[name], collection.resolver, formats).errors())
    errors = errors.otherwise(missing(F.concat(F.lit("Schema not found: "), ref)))
    out = collection.df.withColumn("schema", ref).withColumn("errors", none if mode == "off" else errors)
    out = out.withColumn("ok", F.size("errors") == 0)
    if mode == "lenient":
        out = out.withColumn("errors", F.filter("errors", lambda e: e["code"] != "additional"))
    return out


def validation_errors(collection, schema, **how) -> DataFrame:
    """(type, id, code, pointer, message), one row per error."""
    rows = validate(collection, schema, **how)
    kind = F.col("type") if "type" in collection.df.columns else F.lit(collection.name)
    rows = rows.select(kind.alias("type"), collection.resolver.id_column().alias("id"), F.explode("errors").alias("e"))
    return rows.select("type", "id", "e.*")


def split_valid(collection, schema, mode: str = "strict", **how) -> tuple[DataFrame, DataFrame]:
    """(good documents, quarantined documents with their errors).  Lenient mode quarantines nothing."""
    rows = validate(collection, schema, mode=mode, **how)
    if mode != "strict":
        return rows.drop("ok", "errors"), rows.limit(0)
    return rows.where("ok").drop("ok", "errors"), rows.where("NOT ok").drop("ok")


def validation_summary(collection, schema, ref_field: str = "schemaRef", **how) -> DataFrame:
    """One row: total, valid, warnings (documents without a schema reference), errors."""
    rows = validate(collection, schema, **how)
    named = collection.resolver.field(ref_field).exists(True)
    return rows.agg(
        F.count("*").alias("total"), F.count(F.when(named & F.col("ok"), 1)).alias("valid"),
        F.count(F.when(~named, 1)).alias("warnings"), F.count(F.when(named & ~F.col("ok"), 1)).alias("errors"))

