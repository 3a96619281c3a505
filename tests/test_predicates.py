"""Filters, sorts, pages and projections over VARIANT and typed documents."""

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mangrove.errors import QueryError
from mangrove.operators.collections import Catalog, Collection
from mangrove.plans.predicates import compile_filter
from mangrove.plans.spec import CLI, SERVICE, QuerySpec
from tests.model import matches

VALUES = [5, 0, -1.5, "5", "", "abc", "0x10", "1e1", True, False, None, [], [5, "abc", None], {"a": 5, "b": [1, {"c": "x"}]}, "__absent__"]
LITERALS = [5, 0, "5", "", "abc", "zz", "16", True, False, None, [5], {"a": 5}]


def docs_of(values):
    return [{"id": f"{i:03}", "type": "task", **({} if v == "__absent__" else {"v": v})} for i, v in enumerate(values)]


def ids(collection, spec):
    return [r.id for r in collection.query(spec, ordered=True).collect()]


def found_by(collection, filters):
    """Ids found by each filter, in one job."""
    flags = [compile_filter(f, collection.resolver, null_safe=True).alias(f"f{i}") for i, f in enumerate(filters)]
    rows = collection.df.select("id", *flags).collect()
    return [sorted(r.id for r in rows if r[f"f{i}"]) for i in range(len(filters))]


def test_truth_table(documents):
    docs = docs_of(VALUES)
    c = documents(docs)
    filters = [{"v": {op: r}} for op in ("$eq", "$ne", "$gt", "$gte", "$lt", "$lte") for r in LITERALS]
    filters += [{"v": {op: r}} for op in ("$in", "$nin") for r in ([], [5, "abc"], [None], [True, "5"], 5, None)]
    filters += [{"v": {"$exists": r}} for r in (True, False, 1)] + [{"v": {"$type": t}} for t in ("string", "number", "boolean", "array", "object", "undefined", "null")]
    filters += [{"$not": f} for f in filters]
    for k in range(0, len(filters), 40):
        part = filters[k : k + 40]
        for f, got in zip(part, found_by(c, part)):
            assert got == [d["id"] for d in docs if matches(d, f)], f


def test_paths_and_logic(documents):
    docs = docs_of(VALUES)
    c = documents(docs)
    filters = [
        {"v.a": 5}, {"v.b.0": 1}, {"v.b.1.c": "x"}, {"v.length": 3}, {"v.0": "a"}, {"v.0": 5}, {"v.zz": {"$exists": False}}, {"v.b.length": 2},
        {"$and": []}, {"$or": []}, {"$not": {}}, {}, {"v": {}}, {"$and": [{"v": {"$gte": 0}}, {"$not": {"v": None}}]}, {"$or": [{"v": 5}, {"v": "abc"}], "v": {"$ne": 5}},
    ]
    for f, got in zip(filters, found_by(c, filters)):
        assert got == [d["id"] for d in docs if matches(d, f)], f


scalars = st.one_of(st.integers(-3, 3), st.sampled_from(["", "a", "b", "1", " 2 "]), st.booleans(), st.none())
values = st.one_of(scalars, st.lists(scalars, max_size=2), st.dictionaries(st.sampled_from("xy"), scalars, max_size=2))
leaves = st.one_of(
    scalars,
    st.builds(lambda o, r: {o: r}, st.sampled_from(["$eq", "$ne", "$gt", "$gte", "$lt", "$lte"]), scalars),
    st.builds(lambda o, r: {o: r}, st.sampled_from(["$in", "$nin"]), st.lists(scalars, max_size=3)),
    st.builds(lambda r: {"$exists": r}, st.booleans()),
)
filters = st.recursive(
    st.dictionaries(st.sampled_from(["a", "b", "a.x", "b.0"]), leaves, max_size=2),
    lambda f: st.one_of(st.builds(lambda x: {"$and": x}, st.lists(f, max_size=2)), st.builds(lambda x: {"$or": x}, st.lists(f, max_size=2)), st.builds(lambda x: {"$not": x}, f)),
    max_leaves=4,
)


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.fixed_dictionaries({}, optional={"a": values, "b": values}), min_size=1, max_size=8), st.lists(filters, min_size=1, max_size=6))
def test_differential(documents, rows, specs):
    docs = [{"id": str(i), "type": "t", **r} for i, r in enumerate(rows)]
    for spec, got in zip(specs, found_by(documents(docs), specs)):
        assert got == [d["id"] for d in docs if matches(d, spec)], spec


def test_sort_order(documents):
    c = documents([{"id": "1", "value": 10}, {"id": "2", "value": "hello"}, {"id": "3", "value": True}, {"id": "4"}, {"id": "5", "value": None}, {"id": "6", "value": [1]}, {"id": "7", "value": False}])
    assert ids(c, {"filter": {}, "sort": {"value": 1}}) == ["4", "5", "7", "3", "1", "2", "6"]
    assert ids(c, {"filter": {}, "sort": {"value": -1}}) == ["6", "2", "1", "3", "7", "4", "5"]
    c = documents([{"id": i, "priority": p, "title": t} for i, p, t in (("1", 5, "B"), ("2", 3, "C"), ("3", 8, "A"), ("4", 5, "A"))])
    assert ids(c, {"filter": {}, "sort": {"priority": -1, "title": 1}}) == ["3", "4", "1", "2"]
    assert ids(c, {"filter": {}, "sort": {"priority": -1}}) == ["3", "1", "4", "2"]


def test_pages_and_string_ids(documents):
    c = documents([{"id": str(i)} for i in range(1, 11)])
    assert ids(c, {"filter": {}, "limit": 3}) == ["1", "10", "2"]
    assert ids(c, {"filter": {"id": {"$in": list("12345")}}, "skip": 1, "limit": 2}) == ["2", "3"]
    assert ids(c, {"filter": {}, "skip": 9}) == ["9"]


def test_projection(documents):
    c = documents([{"id": "1", "name": "A", "address": {"city": "X", "zip": None}, "n": None}])
    doc = lambda p: json.loads(c.query({"filter": {}, "projection": p}).select(F.to_json("doc")).first()[0])
    assert doc({"type": 1, "id": 1, "address.city": 1}) == {"type": "task", "id": "1", "address.city": "X"}
    assert doc({"n": 1, "address.zip": 1, "zz": 1}) == {"n": None, "address.zip": None}
    assert doc({"name": 0, "address.city": 0, "id": 0}) == {"address": {"city": "X", "zip": None}, "n": None}
    with pytest.raises(QueryError):
        c.query({"filter": {}, "projection": {"a": 0, "b": 1}})


@pytest.mark.parametrize("bad", [{"$nor": []}, {"a": {"$regex": "x"}}, {"$and": {}}, {"$or": 1}, {"a": {"$not": {}}}, {"$not": 5}])
def test_bad_filters_raise_at_once(documents, bad):
    with pytest.raises(QueryError):
        documents([{"id": "1"}]).query({"filter": bad})


def test_spec_limits():
    for bad in ({"limit": 0}, {"limit": -1}, {"skip": -1}, {"limit": 2.5}, {"limit": True}, {"nonsense": 1}):
        with pytest.raises(QueryError):
            QuerySpec.of({"filter": {}, **bad})
    with pytest.raises(QueryError):
        QuerySpec.of({"type": "x"})
    assert QuerySpec.of({"filter": {}}, SERVICE).limit == 100
    with pytest.raises(QueryError):
        QuerySpec.of({"filter": {}, "limit": 1001}, SERVICE)
    assert QuerySpec.of({"filter": {}, "limit": 0}, CLI).limit == 0


def test_catalog(documents):
    both = Catalog([documents([{"id": "1", "status": "open"}, {"id": "2", "status": "closed"}]), documents([{"id": "1", "status": "open", "type": "note"}], "note"), documents([], "_hidden")])
    assert both.types() == ["note", "task"]
    assert [(r.type, r.id) for r in both.query({"filter": {"status": "open"}}, ordered=True).collect()] == [("note", "1"), ("task", "1")]
    with pytest.raises(QueryError):
        both.query({"filter": {}, "type": "x"})


def test_typed_nulls(spark):
    df = spark.createDataFrame([(1, "a", [1]), (2, None, None)], "k long, s string, xs array<long>")
    missing, null = Collection("t", df, "k"), Collection("t", df, "k", null_means="null")
    got = lambda c, f: [r.k for r in c.query({"filter": f}, ordered=True).collect()]
    assert got(missing, {"s": None}) == [] and got(null, {"s": None}) == [2]
    assert got(missing, {"s": {"$exists": False}}) == [2] and got(null, {"s": {"$exists": False}}) == []
    assert got(missing, {"s": {"$ne": "a"}}) == [2] and got(missing, {"$not": {"s": "a"}}) == [2]
    assert got(null, {"s": {"$gte": 0}}) == [2] and got(missing, {"s": {"$gte": 0}}) == []
    assert got(null, {"s": {"$type": "object"}}) == [2] and got(missing, {"s": {"$type": "undefined"}}) == [2]
    assert got(missing, {"xs": 1}) == [1] and got(missing, {"xs": {"$ne": 1}}) == [1, 2] and got(missing, {"xs.0": {"$gte": 1}}) == [1]
    assert got(missing, {"id": "1"}) == [1] and got(missing, {"id": {"$gt": "1"}}) == [2] and got(missing, {"id": {"$nin": ["1", 2]}}) == [2]


def test_strict_coercion(documents):
    c = documents([{"id": "1", "v": "10"}, {"id": "2", "v": 10}], coercion="strict")
    assert ids(c, {"filter": {"v": {"$gt": 5}}}) == ["2"]
    assert ids(c, {"filter": {"v": {"$gt": "1"}}}) == ["1"]


def test_pushdown(spark):
    from mangrove.sources.tables import collection

    plan = collection(spark, "/root/testdata/sf0.001", "orders").query({"filter": {"o_orderstatus": {"$ne": "F"}, "o_totalprice": {"$gte": 1000}}, "projection": {"o_orderkey": 1}})
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_totalprice" in text and "Not(EqualNullSafe(o_orderstatus" in text and "o_custkey" not in text


def test_lookup_and_count(documents, spark):
    c = documents([{"id": str(i), "p": i % 2} for i in range(6)])
    wanted = spark.createDataFrame([("1",), ("1",), ("4",), ("x",)], "id string")
    assert sorted(r.id for r in c.lookup(wanted).collect()) == ["1", "4"]
    assert c.count({"p": 1}) == 3 and c.get("5").count() == 1 and c.get("9").isEmpty()
