"""A plain-Python model of the filter semantics, for differential tests."""

import math

from mangrove.plans.values import kind_of, text_number

MISSING = object()


def path(doc, dotted):
    for part in dotted.split("."):
        if isinstance(doc, dict):
            doc = doc.get(part, MISSING)
        elif isinstance(doc, (list, str)) and part.isdigit():
            doc = doc[int(part)] if int(part) < len(doc) else MISSING
        elif isinstance(doc, (list, str)) and part == "length":
            doc = len(doc)
        else:
            return MISSING
        if doc is MISSING:
            return MISSING
    return doc


def strict(a, b):
    if a is MISSING or kind_of(a) != kind_of(b) or kind_of(a) in ("array", "object"):
        return False
    return a == b


def number(v):
    k = kind_of(v)
    return text_number(v) if k == "string" else float(v or 0)


def relation(op, v, r):
    if v is MISSING or kind_of(v) in ("array", "object") or kind_of(r) in ("array", "object"):
        return False
    if kind_of(v) != "string" or kind_of(r) != "string":
        v, r = number(v), number(r)
        if math.isnan(v) or math.isnan(r):
            return False
    return {"$gt": v > r, "$gte": v >= r, "$lt": v < r, "$lte": v <= r}[op]


def leaf(op, v, r):
    if op == "$eq":
        return any(strict(x, r) for x in v) if isinstance(v, list) else strict(v, r)
    if op == "$ne":
        return not strict(v, r)
    if op in ("$in", "$nin"):
        return isinstance(r, list) and any(strict(v, x) for x in r) == (op == "$in")
    if op == "$exists":
        return isinstance(r, bool) and (v is not MISSING) == r
    if op == "$type":
        own = "undefined" if v is MISSING else {"null": "object"}.get(kind_of(v), kind_of(v))
        return own == r
    return relation(op, v, r)


def matches(doc, spec):
    for key, value in spec.items():
        if key == "$and":
            ok = all(matches(doc, s) for s in value)
        elif key == "$or":
            ok = any(matches(doc, s) for s in value)
        elif key == "$not":
            ok = not matches(doc, value)
        else:
            v = path(doc, key)
            ok = all(leaf(o, v, r) for o, r in value.items()) if isinstance(value, dict) else leaf("$eq", v, value)
        if not ok:
            return False
    return True
