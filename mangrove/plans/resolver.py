"""From dotted paths to fields, for typed collections and for VARIANT documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .fields import Absent, Key, Typed, Variant


class TypedResolver:
    """Paths into the columns of a DataFrame.  ``id`` and ``type`` name the key and the collection unless
    columns of those names exist."""

    def __init__(self, df: DataFrame, type_name: str, key: list[str], null_means: str = "missing"):
        if null_means not in ("missing", "null"):
            raise ValueError("null_means is 'missing' or 'null'")
        self.schema, self.type_name, self.key, self.null_means = df.schema, type_name, key, null_means

    def id_column(self):
        columns = [F.col(f"`{k}`") for k in self.key]
        return columns[0] if len(columns) == 1 else F.concat_ws("-", *[c.cast("string") for c in columns])

    def field(self, path: str):
        head, *rest = path.split(".")
        if head not in self.schema.names:
            if rest or head not in ("id", "type"):
                return Absent()
            if head == "type":
                return Typed(F.lit(self.type_name), T.StringType())
            single = len(self.key) == 1
            return Key(self.id_column(), self.schema[self.key[0]].dataType if single else T.StringType())
        return self._walk(F.col(f"`{head}`"), self.schema[head].dataType, None, rest)

    def _walk(self, column, kind, parent, rest):
        if isinstance(kind, T.VariantType):
            return Variant(column, rest)
        if not rest:
            return Typed(column, kind, self.null_means, parent)
        step, *rest = rest
        if isinstance(kind, T.StructType):
            if step not in kind.names:
                return Absent()
            return self._walk(column.getField(step), kind[step].dataType, column, rest)
        if isinstance(kind, T.MapType):
            return self._walk(F.element_at(column, step), kind.valueType, column, rest)
        if isinstance(kind, T.ArrayType):
            if step == "length":
                return self._walk(F.when(column.isNotNull(), F.size(column)), T.IntegerType(), column, rest)
            if step.isdigit():
                return self._walk(F.get(column, F.lit(int(step))), kind.elementType, column, rest)
        if isinstance(kind, T.StringType):
            if step == "length":
                return self._walk(F.length(column), T.IntegerType(), column, rest)
            if step.isdigit():
                at = int(step)
                return self._walk(F.when(F.length(column) > at, F.substring(column, at + 1, 1)), T.StringType(), column, rest)
        return Absent()


class VariantResolver:
    """Paths into a VARIANT column ``doc`` beside the columns ``type`` and ``id``."""

    def __init__(self, column: str = "doc"):
        self.column = column

    def id_column(self):
        return F.col("id")

    def field(self, path: str):
        if path in ("id", "type"):  # kept beside the document, so they prune and push down
            return Typed(F.col(path), T.StringType())
        return Variant(F.col(self.column), path.split("."))
