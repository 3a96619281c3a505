"""Filters compiled to boolean Columns.

In positive position a leaf may be NULL where the field is missing: the row is dropped, which is right, and the
bare comparison reaches the scan.  Under ``$not`` every leaf is made two-valued first, as NOT NULL would drop
rows that the negation keeps.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import QueryError
from .fields import _all, _any
from .values import COMPARE

LEAVES = {
    "$eq": lambda f, r: f.eq(r),
    "$ne": lambda f, r: f.ne(r),
    "$in": lambda f, r: f.isin(r),
    "$nin": lambda f, r: f.nin(r),
    "$exists": lambda f, r: f.exists(r),
    "$type": lambda f, r: f.type_is(r),
}


class Compiler:
    def __init__(self, resolver, coercion: str = "js"):
        if coercion not in ("js", "strict"):
            raise QueryError("coercion is 'js' or 'strict'")
        self.resolver, self.coercion = resolver, coercion

    def compile(self, spec: Mapping[str, Any], safe: bool = False) -> Column:
        """``safe``: the result is never NULL."""
        if not isinstance(spec, Mapping):
            raise QueryError(f"a filter must be an object, not {spec!r}")
        return _all([self._entry(key, value, safe) for key, value in spec.items()])

    def _entry(self, key: str, value: Any, safe: bool) -> Column:
        if key in ("$and", "$or"):
            if not isinstance(value, (list, tuple)):
                raise QueryError(f"{key} takes an array")
            return (_all if key == "$and" else _any)([self.compile(part, safe) for part in value])
        if key == "$not":
            return ~self.compile(value, safe=True)
        if key.startswith("$"):
            raise QueryError(f"unknown operator {key}")
        return self._field(key, value, safe)

    def _field(self, path: str, condition: Any, safe: bool) -> Column:
        field = self.resolver.field(path)
        if not isinstance(condition, Mapping):
            return self._leaf(field.eq(condition), safe)
        return _all([self._operator(field, op, r, safe) for op, r in condition.items()])

    def _operator(self, field, op: str, r: Any, safe: bool) -> Column:
        if op in COMPARE:
            return self._leaf(field.cmp(op, r, self.coercion), safe)
        if op not in LEAVES:
            raise QueryError(f"unknown operator {op}")
        return self._leaf(LEAVES[op](field, r), safe)

    @staticmethod
    def _leaf(leaf: Column, safe: bool) -> Column:
        return F.coalesce(leaf, F.lit(False)) if safe else leaf


def compile_filter(spec: Mapping[str, Any], resolver, coercion: str = "js", null_safe: bool = False) -> Column:
    """``spec`` as a Column for ``where``; with ``null_safe`` it is never NULL, for use as a value."""
    return Compiler(resolver, coercion).compile(spec, safe=null_safe)
