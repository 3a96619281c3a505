"""Sort specifications as order keys: a total order over values of all kinds, ties by (type, id) ascending."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column


def order_keys(sort: Mapping[str, int] | None, resolver, type_column: Column | None = None, utf16: bool = False) -> list[Column]:
    """Keys for ``orderBy``: null and missing first ascending, last descending; any value but 1 descends.

    Text sorts by code point; ``utf16`` sorts it by UTF-16 code unit instead."""
    keys: list[Column] = []
    for path, direction in (sort or {}).items():
        parts = resolver.field(path).sort_keys(utf16)
        keys += [p.asc_nulls_first() if direction == 1 else p.desc_nulls_last() for p in parts]
    if type_column is not None:
        keys.append(type_column.asc())
    keys.append(resolver.id_column().cast("string").asc())
    return keys
