"""Projections: inclusion by (dotted) path, exclusion by top-level name."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def split_projection(projection: Mapping[str, int] | None) -> tuple[list[str], list[str]]:
    """(included, excluded) paths; values other than 0 and 1 are ignored."""
    items = (projection or {}).items()
    return [k for k, v in items if v == 1], [k for k, v in items if v == 0]


def project_typed(df: DataFrame, projection, resolver) -> DataFrame:
    """A dotted inclusion gives a column named by the whole path; absent paths give none; dotted exclusions
    change nothing.  The key is not added."""
    included, excluded = split_projection(projection)
    if included:
        fields = [(path, resolver.field(path).value()) for path in included]
        return df.select(*[value.alias(path) for path, value in fields if value is not None])
    return df.drop(*[f for f in excluded if "." not in f])


def project_variant(df: DataFrame, projection, resolver) -> DataFrame:
    """Rows (type, id, doc) with ``doc`` rebuilt: included paths as flat keys where present, or without the
    excluded top-level names."""
    included, excluded = split_projection(projection)
    if included:
        parts = []
        for path in included:
            value = resolver.field(path).value()
            text = F.to_json(value) if path not in ("id", "type") else F.regexp_extract(F.to_json(F.struct(value.alias("x"))), r'^\{"x":(.*)\}$', 1)
            parts.append(F.when(value.isNotNull(), F.concat(F.lit(json.dumps(path) + ":"), text)))
        doc = F.parse_json(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")))
        return df.withColumn(resolver.column, doc)
    names = [f for f in excluded if "." not in f]
    if not names:
        return df
    entries = F.try_variant_get(F.col(resolver.column), "$", "map<string,variant>")
    kept = F.map_filter(entries, lambda k, _: ~k.isin(names))
    return df.withColumn(resolver.column, F.to_variant_object(kept))
