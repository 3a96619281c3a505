"""Canonical JSON: sorted keys, fixed indent, one trailing line end."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INDEX = re.compile(r"0|[1-9][0-9]{0,9}")


def _number(value: float) -> str:
    """A double the way JSON writers of web engines print it: shortest digits, exponents from 1e21 and 1e-7."""
    if not math.isfinite(value):
        return "null"
    if value == 0:
        return "0"
    sign, text = ("-" if value < 0 else ""), repr(abs(value))
    mantissa, _, exponent = text.partition("e")
    whole, _, part = mantissa.partition(".")
    digits = (whole + ("" if part == "0" else part)).lstrip("0")
    part = "" if part == "0" else part
    point = (len(whole) if whole != "0" else -(len(part) - len(part.lstrip("0")))) + int(exponent or 0)
    digits = digits.rstrip("0") or "0"
    n = len(digits)
    if n <= point <= 21:
        return sign + digits + "0" * (point - n)
    if 0 < point <= 21:
        return f"{sign}{digits[:point]}.{digits[point:]}"
    if -6 < point <= 0:
        return f"{sign}0.{'0' * -point}{digits}"
    e = point - 1
    return f"{sign}{digits[0]}{'.' + digits[1:] if n > 1 else ''}e{'+' if e > 0 else '-'}{abs(e)}"


def _ordered(keys, order: Sequence[str] | bool) -> list[str]:
    """Integer-like keys first by value (as objects of web engines enumerate them), then listed keys in their
    order, then the rest by UTF-16 code units; ``order=False`` keeps the given order after the integers."""
    index = sorted((k for k in keys if _INDEX.fullmatch(k) and int(k) < 2**32 - 1), key=int)
    rest = [k for k in keys if k not in set(index)]
    if order is False:
        return index + rest
    place = {k: i for i, k in enumerate(order if order is not True else ())}
    return index + sorted(rest, key=lambda k: (place.get(k, len(place)), b"" if k in place else k.encode("utf-16-be", "surrogatepass")))


def _lines(value, order, pad: str, step: str) -> str:
    inner = pad + step
    open_, between, close = (f"\n{inner}", f",\n{inner}", f"\n{pad}") if step else ("", ",", "")
    if isinstance(value, dict):
        if not value:
            return "{}"
        colon = ": " if step else ":"
        return "{" + open_ + between.join(json.dumps(k, ensure_ascii=False) + colon + _lines(value[k], order, inner, step) for k in _ordered(value, order)) + close + "}"
    if isinstance(value, list):
        return "[" + open_ + between.join(_lines(v, order, inner, step) for v in value) + close + "]" if value else "[]"
    if isinstance(value, float):
        return _number(value)
    return json.dumps(value, ensure_ascii=False)


def canonical_text(value, order: Sequence[str] | bool = True, indent: int = 2, eol: str = "LF", trailing_newline: bool = True) -> str:
    """Canonical text of a parsed JSON value."""
    text = _lines(value, order, "", " " * indent)
    text += "\n" if trailing_newline else ""
    return text.replace("\n", "\r\n") if eol == "CRLF" else text


def parse(text: str):
    """Parsed JSON; of repeated keys the last counts; NaN and infinities are refused."""

    def refuse(name: str):
        raise ValueError(f"{name} is no JSON")

    return json.loads(text, parse_constant=refuse)


def canonical_json(text: Column, **how) -> Column:
    """Struct (value, error) of a JSON text column: the exact canonical text, or why it could not be parsed."""

    def run(texts: pa.Array) -> pa.Array:
        values, errors = [], []
        for t in texts.to_pylist():
            try:
                values.append(None if t is None else canonical_text(parse(t.removeprefix("﻿")), **how))
                errors.append(None)
            except ValueError as bad:
                values.append(None)
                errors.append(str(bad))
        return pa.StructArray.from_arrays([pa.array(values, pa.string()), pa.array(errors, pa.string())], ["value", "error"])

    kind = T.StructType([T.StructField("value", T.StringType()), T.StructField("error", T.StringType())])
    return F.arrow_udf(run, kind)(text)


def compact_json(text: Column) -> Column:
    """Compact text with sorted keys, all in the JVM; NULL for malformed text.  Numbers keep Spark's form."""
    return F.to_json(F.try_parse_json(text))


def json_equal(a: Column, b: Column) -> Column:
    """Whether two texts hold the same JSON whatever the order of keys; false if either is malformed."""
    return F.coalesce(compact_json(a) == compact_json(b), F.lit(False))


def safe_parse(text: Column) -> Column:
    """Struct (value VARIANT, error): the parse result without failing."""
    value = F.try_parse_json(text)
    bad = F.when(value.isNull() & text.isNotNull(), "malformed JSON")
    return F.struct(value.alias("value"), bad.alias("error"))
