"""Fields of documents behind one interface: typed columns, VARIANT paths, keys and absent fields.

A predicate method may give NULL where the field has no value; ``predicates`` decides where that matters.
Comparisons stay bare wherever the types agree, so they reach the Parquet scan.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.binding import let
from .values import column_number, compare, kind_of, literal, number_of

def _all(parts: Sequence[Column]) -> Column:
    out = F.lit(True)
    for k, part in enumerate(parts):
        out = part if not k else out & part
    return out


def _any(parts: Sequence[Column]) -> Column:
    out = F.lit(False)
    for k, part in enumerate(parts):
        out = part if not k else out | part
    return out


class Absent:
    """A path that no document of the collection has."""

    def eq(self, value: Any) -> Column:
        return F.lit(False)

    def ne(self, value: Any) -> Column:
        return F.lit(True)

    def isin(self, values: Any) -> Column:
        return F.lit(False)

    def nin(self, values: Any) -> Column:
        return F.lit(isinstance(values, (list, tuple)))

    def cmp(self, op: str, value: Any, coercion: str) -> Column:
        return F.lit(False)

    def exists(self, wanted: Any) -> Column:
        return F.lit(wanted is False)

    def type_is(self, name: Any) -> Column:
        return F.lit(name == "undefined")

    def sort_keys(self, utf16: bool = False) -> list[Column]:
        return []

    def value(self) -> Column | None:
        return None


def typed_kind(kind: T.DataType) -> str:
    """JSON kind of a Spark type; times are a kind of their own, compared natively with ISO texts."""
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, T.NumericType):
        return "number"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "time"
    if isinstance(kind, T.ArrayType):
        return "array"
    if isinstance(kind, (T.StructType, T.MapType)):
        return "object"
    return "string"


class Typed:
    """A column of a known type.  SQL NULL means missing, or JSON null under ``null_means="null"``."""

    def __init__(self, column: Column, kind: T.DataType, null_means: str = "missing", parent: Column | None = None):
        self.column, self.type, self.kind = column, kind, typed_kind(kind)
        self.nulls = null_means == "null"
        self.present = parent.isNotNull() if parent is not None else F.lit(True)

    def _literal(self, value: Any) -> Column | None:
        """``value`` as a literal that may equal the column, or None where the kinds differ."""
        kind = kind_of(value)
        if self.kind == "time" and kind == "string":
            return F.lit(value).try_cast(self.type)
        if kind != self.kind or kind in ("array", "object") or (isinstance(value, float) and math.isnan(value)):
            return None
        return literal(value)

    def eq(self, value: Any) -> Column:
        if self.kind == "array":
            element = Typed(F.lit(None), self.type.elementType)
            if value is None:
                return F.exists(self.column, lambda x: x.isNull())
            if isinstance(self.type.elementType, T.VariantType):
                return F.exists(self.column, lambda x: Variant(x, []).scalar_eq(value))
            same = element._literal(value)
            return F.lit(False) if same is None else F.array_contains(self.column, same)
        if value is None:
            return self.column.isNull() & self.present if self.nulls else F.lit(False)
        same = self._literal(value)
        return F.lit(False) if same is None else self.column == same

    def ne(self, value: Any) -> Column:
        if value is None:
            return ~(self.column.isNull() & self.present) if self.nulls else F.lit(True)
        same = None if self.kind == "array" else self._literal(value)
        return F.lit(True) if same is None else ~self.column.eqNullSafe(same)

    def _in(self, values: Any) -> Column | None:
        same = [x for x in map(self._literal, values) if x is not None] if self.kind != "array" else []
        parts = [self.column.isin(same)] if same else []
        if self.nulls and any(v is None for v in values):
            parts.append(self.column.isNull() & self.present)
        return _any(parts) if parts else None

    def isin(self, values: Any) -> Column:
        found = self._in(values) if isinstance(values, (list, tuple)) else None
        return F.lit(False) if found is None else found

    def nin(self, values: Any) -> Column:
        if not isinstance(values, (list, tuple)):
            return F.lit(False)
        if len(values) <= 20 and not self.nulls and self.kind != "array":
            return _all([~self.column.eqNullSafe(x) for x in map(self._literal, values) if x is not None])
        found = self._in(values)
        return F.lit(True) if found is None else ~F.coalesce(found, F.lit(False))

    def _number(self) -> Column:
        if self.kind == "string":
            return column_number(self.column)
        return self.column.cast("int") if self.kind == "boolean" else self.column

    def cmp(self, op: str, value: Any, coercion: str) -> Column:
        kind = kind_of(value)
        if kind in ("array", "object") or self.kind in ("array", "object"):
            return F.lit(False)
        if self.kind == "time":
            return compare(op, self.column, F.lit(value).try_cast(self.type)) if kind == "string" else F.lit(False)
        if kind == self.kind and kind in ("string", "number"):
            out = compare(op, self.column, literal(value))
            if isinstance(self.type, (T.DoubleType, T.FloatType)) and op in ("$gt", "$gte"):
                out = out & ~F.isnan(self.column)  # NaN sorts last in Spark and compares with nothing here
        elif coercion == "strict":
            return F.lit(False)
        else:
            number = number_of(value)
            if isinstance(number, float) and math.isnan(number):
                return F.lit(False)
            out = compare(op, self._number(), literal(number))
        if self.nulls and coercion != "strict":
            number = number_of(value)
            zero = not (isinstance(number, float) and math.isnan(number)) and compare(op, 0.0, float(number))
            out = F.when(self.column.isNull() & self.present, F.lit(bool(zero))).otherwise(out)
        return out

    def exists(self, wanted: Any) -> Column:
        if not isinstance(wanted, bool):
            return F.lit(False)
        found = self.present if self.nulls else self.column.isNotNull()
        return found if wanted else ~found

    def type_is(self, name: Any) -> Column:
        own = {"time": "string"}.get(self.kind, self.kind)
        parts = [self.column.isNotNull()] if name == own else []
        if name == "undefined":
            parts.append(~self.present if self.nulls else self.column.isNull())
        if name == "object" and self.nulls:
            parts.append(self.column.isNull() & self.present)
        return _any(parts)

    def sort_keys(self, utf16: bool = False) -> list[Column]:
        if self.kind in ("array", "object"):
            return [self.column.isNotNull()]
        return [F.encode(self.column, "UTF-16BE") if utf16 and self.kind == "string" else self.column]

    def value(self) -> Column:
        return self.column


class Key(Typed):
    """The document id: the text of a key column, compared natively where the key is an integer."""

    def __init__(self, column: Column, kind: T.DataType):
        super().__init__(column.cast("string"), T.StringType())
        self.native, self.integral = column, isinstance(kind, T.IntegralType)

    def _literal(self, value: Any) -> Column | None:
        if not isinstance(value, str):
            return None
        if self.integral:  # "007" is the text of no integer
            return F.lit(int(value)) if re.fullmatch(r"0|-?[1-9][0-9]{0,17}", value) else None
        return F.lit(value)

    def eq(self, value: Any) -> Column:
        same = self._literal(value)
        return F.lit(False) if same is None else (self.native if self.integral else self.column) == same

    def ne(self, value: Any) -> Column:
        return ~F.coalesce(self.eq(value), F.lit(False))

    def _in(self, values: Any) -> Column | None:
        same = [x for x in map(self._literal, values) if x is not None]
        return (self.native if self.integral else self.column).isin(same) if same else None

    def nin(self, values: Any) -> Column:
        if not isinstance(values, (list, tuple)):
            return F.lit(False)
        found = self._in(values)
        return F.lit(True) if found is None else ~F.coalesce(found, F.lit(False))


def _step(segment: str) -> str:
    escaped = segment.replace("\\", "\\\\").replace('"', '\\"')
    return f'["{escaped}"]'


class Variant:
    """A path into a VARIANT: JSON null and missing differ, and every value brings its own kind."""

    def __init__(self, base: Column, segments: Sequence[str]):
        self.base, self.segments = base, list(segments)

    def _paths(self, segments: Sequence[str]) -> list[str]:
        """Spark paths of a dotted path; an all-digit segment is a key or a place in an array."""
        steps = [[_step(s), f"[{s}]"] if re.fullmatch(r"0|[1-9][0-9]{0,8}", s) else [_step(s)] for s in segments]
        return ["$" + "".join(p) for p in itertools.product(*steps)]

    def get(self, kind: str) -> Column:
        """The value cast to ``kind`` (NULL where missing or not castable)."""
        found = [F.try_variant_get(self.base, p, kind) for p in self._paths(self.segments)]
        out = found[0] if len(found) == 1 else F.coalesce(*found)
        if kind == "variant" and self.segments and (self.segments[-1] == "length" or self.segments[-1].isdigit()):
            parent = Variant(self.base, self.segments[:-1])
            text = F.when(parent.is_kind("string"), parent.get("string"))
            if self.segments[-1] == "length":
                own = F.coalesce(F.length(text), F.size(parent.get("array<variant>"))).cast("string")
                own = F.when(parent.is_kind("string") | parent.is_kind("array"), own)
            else:
                at = int(self.segments[-1])
                own = F.when(F.length(text) > at, F.to_json(F.struct(F.substring(text, at + 1, 1).alias("x"))))
                own = F.regexp_extract(own, r'^\{"x":(.*)\}$', 1)
            out = F.coalesce(out, F.try_parse_json(own))
        return out

    def _tag(self) -> Column:
        return F.schema_of_variant(self.get("variant"))

    def is_kind(self, kind: str) -> Column:
        tag = self._tag()
        if kind == "number":
            return tag.isin("BIGINT", "DOUBLE", "FLOAT", "INT") | tag.startswith("DECIMAL")
        return {"string": tag == "STRING", "boolean": tag == "BOOLEAN", "null": tag == "VOID", "array": tag.startswith("ARRAY"), "object": tag.startswith("OBJECT")}[kind]

    def _as(self, kind: str) -> Column:
        if not self.segments or not (self.segments[-1] == "length" or self.segments[-1].isdigit()):
            return self.get(kind)
        return F.try_variant_get(self.get("variant"), "$", kind)

    def scalar_eq(self, value: Any) -> Column:
        kind = kind_of(value)
        if kind in ("array", "object") or (isinstance(value, float) and math.isnan(value)):
            return F.lit(False)
        if kind == "null":
            return self.is_kind("null")
        if kind == "number":
            whole = isinstance(value, int) and -(2**63) <= value < 2**63
            same = self._as("double") == F.lit(float(value))
            if whole:  # integers stay exact beyond 2^53
                same = F.when(self._tag() == "BIGINT", self._as("bigint") == F.lit(value)).otherwise(same)
            return self.is_kind("number") & same
        return self.is_kind(kind) & (self._as(kind) == F.lit(value))

    def eq(self, value: Any) -> Column:
        inside = F.exists(self._as("array<variant>"), lambda x: F.coalesce(Variant(x, []).scalar_eq(value), F.lit(False)))
        if kind_of(value) in ("array", "object"):
            return F.lit(False)
        return self.scalar_eq(value) | (self.is_kind("array") & inside)

    def ne(self, value: Any) -> Column:
        return ~F.coalesce(self.scalar_eq(value), F.lit(False))

    def isin(self, values: Any) -> Column:
        return _any([self.scalar_eq(v) for v in values]) if isinstance(values, (list, tuple)) else F.lit(False)

    def nin(self, values: Any) -> Column:
        return _all([self.ne(v) for v in values]) if isinstance(values, (list, tuple)) else F.lit(False)

    def _number(self) -> Column:
        return (
            F.when(self.is_kind("number"), self._as("double"))
            .when(self.is_kind("boolean"), self._as("boolean").cast("double"))
            .when(self.is_kind("null"), F.lit(0.0))
            .when(self.is_kind("string"), column_number(self._as("string")))
        )

    def cmp(self, op: str, value: Any, coercion: str) -> Column:
        kind = kind_of(value)
        if kind in ("array", "object"):
            return F.lit(False)
        number = number_of(value)
        comparable = not (isinstance(number, float) and math.isnan(number))
        if coercion == "strict":
            if kind not in ("string", "number"):
                return F.lit(False)
            return self.is_kind(kind) & compare(op, self._as("string" if kind == "string" else "double"), literal(value))
        numeric = compare(op, self._number(), F.lit(float(number))) if comparable else F.lit(False)
        if kind == "string":
            return F.when(self.is_kind("string"), compare(op, self._as("string"), F.lit(value))).otherwise(numeric)
        return numeric

    def exists(self, wanted: Any) -> Column:
        if not isinstance(wanted, bool):
            return F.lit(False)
        found = self.get("variant").isNotNull()
        return found if wanted else ~found

    def type_is(self, name: Any) -> Column:
        if name == "undefined":
            return self.get("variant").isNull()
        if name == "object":
            return self.is_kind("object") | self.is_kind("null")
        return self.is_kind(name) if name in ("string", "number", "boolean", "array") else F.lit(False)

    def sort_keys(self, utf16: bool = False) -> list[Column]:
        """One struct: rank (null and missing 0, boolean 1, number 2, string 3, others 4), then the value of each
        kind.  Structs compare field by field, so its order is theirs."""

        def key(v: Column, tag: Column) -> Column:
            of = lambda cast: F.try_variant_get(v, "$", cast)
            number = tag.isin("BIGINT", "DOUBLE", "FLOAT", "INT") | tag.startswith("DECIMAL")
            text = F.when(tag == "STRING", of("string"))
            rank = F.when(tag.isNull() | (tag == "VOID"), 0).when(tag == "BOOLEAN", 1).when(number, 2).when(tag == "STRING", 3).otherwise(4)
            return F.struct(
                rank.alias("rank"), F.when(tag == "BOOLEAN", of("boolean")).alias("boolean"), F.when(number, of("double")).alias("number"),
                (F.encode(text, "UTF-16BE") if utf16 else text).alias("string"))

        return [let(self.get("variant"), lambda v: let(F.schema_of_variant(v), lambda tag: key(v, tag)))]

    def value(self) -> Column:
        return self.get("variant")
