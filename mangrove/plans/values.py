"""JSON kinds of literals and of values, and text as a number the way document queries coerce it."""

from __future__ import annotations

import math
import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

DECIMAL = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
_WHITE = "\t\n\x0b\x0c\r                  　﻿"


def kind_of(value: Any) -> str:
    """null, boolean, number, string, array or object."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    if isinstance(value, str):
        return "string"
    return "array" if isinstance(value, (list, tuple)) else "object"


def text_number(text: str) -> float:
    """The number a text stands for; NaN where it stands for none.  Blank text is 0."""
    text = text.strip(_WHITE)
    if not text:
        return 0.0
    if re.fullmatch(DECIMAL, text):
        return float(text)
    if m := re.fullmatch(r"([+-]?)Infinity", text):
        return -math.inf if m[1] == "-" else math.inf
    for prefix, base, digits in (("0x", 16, "0-9a-f"), ("0o", 8, "0-7"), ("0b", 2, "01")):
        if re.fullmatch(f"{prefix}[{digits}]+", text.lower()):
            return float(int(text[2:], base))
    return math.nan


def number_of(value: Any) -> float | int:
    """A scalar literal as the number it is compared as."""
    kind = kind_of(value)
    if kind == "number":
        return value
    if kind == "string":
        return text_number(value)
    return int(bool(value))


def column_number(text: Column) -> Column:
    """``text_number`` of a string column; NULL for no number."""
    text = F.btrim(text, F.lit(_WHITE))
    based = lambda prefix, base, digits: F.when(text.rlike(f"^(?i){prefix}[{digits}]+$"), F.conv(F.substring(text, 3, 2**31 - 1), base, 10).cast("double"))
    return (
        F.when(text == "", F.lit(0.0))
        .when(text.rlike(f"^{DECIMAL}$"), text.try_cast("double"))
        .when(text.isin("Infinity", "+Infinity"), F.lit(math.inf))
        .when(text == "-Infinity", F.lit(-math.inf))
        .otherwise(F.coalesce(based("0x", 16, "0-9a-f"), based("0o", 8, "0-7"), based("0b", 2, "01")))
    )


def literal(value: Any) -> Column:
    """A literal; integers beyond 64 bits become doubles."""
    if isinstance(value, int) and not isinstance(value, bool) and not -(2**63) <= value < 2**63:
        return F.lit(float(value))
    return F.lit(value)


COMPARE = {"$gt": "__gt__", "$gte": "__ge__", "$lt": "__lt__", "$lte": "__le__"}


def compare(op: str, left: Any, right: Any) -> Any:
    """``left`` op ``right`` for Columns or plain values."""
    return getattr(left, COMPARE[op])(right)
