"""Naming a value inside an expression, so that it is computed once wherever it is used several times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once a row."""
    return F.transform(F.array(value), lambda x: body(x))[0]
