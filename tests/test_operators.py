"""Indexes, slugs, hierarchies, validation, statistics, mutations."""

import pytest
from pyspark.sql import functions as F

from mangrove.errors import ValidationError
from mangrove.operators import hierarchy, indexes, mutations, stats, validation
from mangrove.operators.collections import Collection
from mangrove.operators.unique_slugs import unique_slugs


def as_dict(index):
    return {r.key: r.ids for r in indexes.as_arrays(index).collect()}


def test_index_keys(documents):
    c = documents([
        {"id": "001", "n": 42, "tags": ["urgent", "bug", "urgent"], "s": "__num__test", "o": {"b": 1, "a": 2}, "x": None},
        {"id": "002", "n": 100, "tags": ["feature", "urgent"], "s": "plain", "b": True},
        {"id": "003", "n": 42.0, "tags": [["bug"], []], "m": 2.5},
    ])
    built = lambda f: as_dict(indexes.build_index(c, f))
    assert built("n") == {"__num__42": ["001", "003"], "__num__100": ["002"]}
    assert built("tags") == {"urgent": ["001", "002"], "bug": ["001", "003"], "feature": ["002"]}
    assert built("s") == {"__str__:__num__test": ["001"], "plain": ["002"]}
    assert built("o") == {'__obj__:{"a":2,"b":1}': ["001"]} and built("x") == {"__null__": ["001"]} and built("b") == {"__bool__true": ["002"]}
    assert built("m") == {"__num__2.5": ["003"]} and built("zz") == {}
    index = indexes.build_index(c, "tags")
    assert [r.id for r in indexes.lookup(index, ["bug", "feature"]).collect()] == ["001", "002", "003"]
    with pytest.raises(ValidationError):
        indexes.build_index(c, "_slug")


def test_index_agrees_with_scan(documents):
    docs = [{"id": f"{i:03}", "status": ("closed", "open", "pending")[i % 3], "priority": i % 5 + 1} for i in range(1, 101)]
    c = documents(docs)
    for field, value in (("status", "open"), ("priority", 3), ("status", ["open", "closed"]), ("status", "none")):
        index = indexes.build_index(c, field)
        spec = {field: {"$in": value} if isinstance(value, list) else value}
        scan = {r.id for r in c.where(spec).collect()}
        assert {r.id for r in indexes.query_with_index(c, index, field, value).collect()} == scan
    stale = indexes.build_index(documents([{"id": d["id"], "status": "open"} for d in docs]), "status")
    assert indexes.query_with_index(c, stale, "status", "open").count() == 34


def test_index_store(documents, spark, tmp_path):
    store, c = indexes.IndexStore(str(tmp_path)), documents([{"id": "1", "a": 1, "b": "x"}, {"id": "2", "a": 1}])
    summary = store.ensure(c, "a")
    assert (summary.docs_scanned, summary.keys) == (2, 1) and store.exists(spark, "task", "a") and not store.exists(spark, "task", "b")
    done = store.reindex([c], {"task": ["b", "_slug"]}, force=True)
    assert [s.field for s in done] == ["a", "b"] and indexes.reindex_totals(done)["total_indexes"] == 2
    assert store.fields(spark, "task") == ["a", "b"] and store.remove(spark, "task", "a") and store.fields(spark, "task") == ["b"]


def test_slug_tables(spark):
    table = spark.createDataFrame([("city", "", "paris", "1")], "type string, scope string, slug string, id string")
    claims = spark.createDataFrame([("city", "", "paris", "2"), ("city", "", "rome", "4"), ("city", "", "rome", "3"), ("city", "", "paris", "1")], table.schema)
    got = {(r.slug, r.id): (r.ok, r.holder) for r in indexes.claim_slugs(table, claims).collect()}
    assert got == {("paris", "2"): (False, "1"), ("rome", "4"): (False, "3"), ("rome", "3"): (True, "3"), ("paris", "1"): (True, "1")}
    assert indexes.release_slugs(table, table).isEmpty()
    aliases = spark.createDataFrame([("city", "", "lutetia", "1")], "type string, scope string, alias string, id string")
    add = spark.createDataFrame([("city", "", "paris", "2"), ("city", "", "lutetia", "3"), ("city", "", "new", "3")], aliases.schema)
    kept, refused = indexes.update_aliases(table, aliases, add)
    assert {(r.alias, r.id) for r in kept.collect()} == {("lutetia", "1"), ("new", "3")}
    assert {(r.alias, r.holder) for r in refused.collect()} == {("paris", "1"), ("lutetia", "1")}


def one_by_one(rows):
    """Slugs given in id order, as the sequential rule has it; bases first where they are free."""
    taken, out = set(), {}
    for scope, base, id_ in sorted(rows, key=lambda r: r[2]):
        slug, n = base, 1
        while (scope, slug) in taken:
            n += 1
            slug = f"{base}-{n}"
        taken.add((scope, slug))
        out[id_] = slug
    return out


def test_unique_slugs_part_where_hashes_meet(spark, monkeypatch):
    from mangrove.operators import unique_slugs as module

    monkeypatch.setattr(module, "MAX_NUMBER", 1)
    rows = spark.range(12_000).selectExpr("'s' AS scope", "'same' AS base", "cast(id AS string) AS id")
    first = rows.selectExpr("substring(sha2(id, 256), 1, 6) AS h").distinct().count()
    got = unique_slugs(rows, ["scope"])
    assert first < 12_000 and got.select("slug").distinct().count() == 12_000


def test_unique_slugs(spark):
    rows = [("x", "portland", "1"), ("x", "portland", "2"), ("y", "portland", "3"), ("x", "rome", "4"), ("x", "portland", "5")]
    df = spark.createDataFrame(rows, "scope string, base string, id string")
    assert {r.id: r.slug for r in unique_slugs(df, ["scope"]).collect()} == one_by_one(rows)
    many = [("x", "foo", f"{i:04}") for i in range(101)]
    got = {r.id: r.slug for r in unique_slugs(spark.createDataFrame(many, df.schema), ["scope"]).collect()}
    assert got["0100"] == "foo-101" and len(set(got.values())) == 101
    clash = [("x", "foo", "1"), ("x", "foo", "2"), ("x", "foo-2", "3"), ("x", "foo", "4")]
    got = {r.id: r.slug for r in unique_slugs(spark.createDataFrame(clash, df.schema), ["scope"]).collect()}
    assert len(set(got.values())) == 4 and got["1"] == "foo" and got["3"] == "foo-2"
    long = [("x", "a" * 64, "1"), ("x", "a" * 64, "2")]
    assert {r.slug for r in unique_slugs(spark.createDataFrame(long, df.schema), ["scope"]).collect()} == {"a" * 64, "a" * 62 + "-2"}


def test_hierarchy(spark):
    nodes = spark.createDataFrame([("us", "us", None), ("ny", "ny", "us"), ("nyc", "nyc", "ny"), ("lost", "lost", "nowhere"), ("c1", "c1", "c2"), ("c2", "c2", "c1")], "id string, slug string, parent_id string")
    tree = hierarchy.place_tree(nodes)
    assert {r.id: r.path for r in tree.collect()} == {"us": "/us", "ny": "/us/ny", "nyc": "/us/ny/nyc", "lost": None, "c1": None, "c2": None}
    placed = hierarchy.place_children(nodes.where("id IN ('ny', 'lost')"), tree.where("id = 'us'"))
    assert {r.id: (r.path, r.error) for r in placed.collect()} == {"ny": ("/us/ny", None), "lost": (None, "parent")}
    docs = spark.createDataFrame([("t", "1", "/a"), ("t", "2", "/a/b"), ("t", "3", "/a"), ("t", "4", "bad"), ("t", "5", None)], "type string, id string, path string")
    index, errors = hierarchy.path_index(docs)
    assert {(r.path, r.id) for r in index.collect()} == {("/a", "1"), ("/a/b", "2")}
    assert {(r.id, r.error) for r in errors.collect()} == {("3", "taken"), ("4", "start")}
    assert tuple(hierarchy.repair(docs).first()) == (4, 2, 2)
    assert [r.id for r in hierarchy.get_by_path(index, "a", "b").collect()] == ["2"]
    with pytest.raises(ValidationError):
        hierarchy.get_by_path(index, "A", "b")
    assert [r.path for r in hierarchy.list_children(index, "/a").collect()] == ["/a/b"]
    assert hierarchy.documents_at(index, docs.drop("path")).count() == 2


SCHEMA = {
    "$id": "schema/user@1", "type": "object", "required": ["name", "age"], "additionalProperties": False,
    "properties": {
        "id": {"type": "string"}, "type": {"const": "user"}, "schemaRef": {"type": "string"}, "name": {"type": "string", "minLength": 2, "maxLength": 5, "pattern": "^[A-Z]"},
        "age": {"type": "integer", "exclusiveMinimum": 0, "maximum": 150}, "mail": {"$ref": "#/$defs/mail"}, "kind": {"enum": ["a", 1, None]},
        "tags": {"type": "array", "items": {"type": "string", "minLength": 2}}, "address": {"type": "object", "required": ["city"], "properties": {"city": {"type": "string"}}},
    },
    "$defs": {"mail": {"type": "string", "format": "email"}},
}


def test_validation(documents):
    docs = [
        {"id": "1", "type": "user", "name": "Anna", "age": 5, "tags": ["ab"], "kind": None, "address": {"city": "X"}, "mail": "a@b.co"},
        {"id": "2", "type": "user", "name": "x", "age": 0.5, "extra": 1, "tags": ["ab", "c", 5], "kind": "z", "address": {}, "mail": "no"},
        {"id": "3", "type": "user", "name": 5, "age": 200},
        {"id": "4", "type": "user"},
    ]
    c = documents(docs, "user")
    got = {r.id: {(e.code, e.pointer) for e in r.errors} for r in validation.validate(c, SCHEMA).collect()}
    assert got["1"] == set()
    assert got["2"] == {("minLength", "/name"), ("pattern", "/name"), ("type", "/age"), ("additional", ""), ("minLength", "/tags/1"), ("type", "/tags/2"), ("enum", "/kind"), ("required", "/address/city"), ("format", "/mail")}
    assert got["3"] == {("type", "/name"), ("maximum", "/age")}
    assert got["4"] == {("required", "/name"), ("required", "/age")}
    lenient = {r.id: (r.ok, {e.code for e in r.errors}) for r in validation.validate(documents([{**docs[0], "zz": 1}], "user"), SCHEMA, mode="lenient").collect()}
    assert lenient == {"1": (False, set())}
    assert validation.validate(c, SCHEMA, mode="off").where("ok").count() == 4
    good, bad = validation.split_valid(c, SCHEMA)
    assert [r.id for r in good.collect()] == ["1"] and bad.count() == 3
    unknown = validation.validate(c, "schema/none@1", registry=validation.SchemaRegistry()).first()
    assert unknown.errors[0].code == "ref" and not unknown.ok
    for wrong in ({"allOf": []}, {"properties": {"a": {"format": "nonsense"}}}, {"properties": {"a": {"$ref": "http://x"}}}, {"properties": {"a": {"$ref": "#/none"}}}):
        with pytest.raises(ValidationError):
            validation.validate(c, wrong)
    own = validation.validate(c, {"properties": {"name": {"format": "short"}}}, formats={"short": lambda x: F.length(x) < 3})
    assert {r.id for r in own.where("NOT ok").collect()} == {"1"}


def test_registry(tmp_path):
    registry = validation.SchemaRegistry()
    registry.save(tmp_path, SCHEMA)
    again = validation.SchemaRegistry()
    assert again.load(tmp_path) == ["schema/user@1"] == again.refs() and again.digests == registry.digests
    for bad in ({"$id": "x"}, {"$id": "schema/a@1", "$schema": "http://json-schema.org/draft-07/schema#"}):
        with pytest.raises(ValidationError):
            registry.add(bad)
    with pytest.raises(ValidationError):
        registry.add({"$id": "schema/a@1"}, "b@1.json")


def test_stats(spark):
    docs = spark.createDataFrame([("small", 5), ("small", 7), ("large", 1000)], "type string, n int")
    rows = {r.type: (r["count"], r.bytes, r.avg_bytes, r.min_bytes, r.max_bytes) for r in stats.detailed_stats(docs, F.col("n")).collect()}
    assert rows == {None: (3, 1012, 1012 / 3, 5, 1000), "small": (2, 12, 6.0, 5, 7), "large": (1, 1000, 1000.0, 1000, 1000)}
    assert tuple(stats.stats(docs, F.col("n"), "none").first()) == (0, 0) and tuple(stats.stats(docs, F.col("n")).first()) == (3, 1012)
    assert tuple(stats.detailed_stats(docs.limit(0), F.col("n"), by_type=False).first()) == (0, 0, 0.0, 0, 0)
    samples = spark.createDataFrame([(float(i),) for i in range(1, 101)], "ms double")
    assert tuple(stats.percentiles(samples, "ms").first()) == (50.0, 95.0, 99.0)
    assert stats.hit_rate(spark.createDataFrame([(0, 0)], "hits int, misses int")).first()[0] == 0


def test_mutations(spark):
    old = spark.createDataFrame([("t", "1", "a"), ("t", "2", "b")], "type string, id string, raw string")
    new = spark.createDataFrame([("t", "2", "b"), ("t", "1", "A"), ("t", "3", "c")], old.schema)
    assert {(r.id, r.status) for r in mutations.changes(old, new).collect()} == {("1", "changed"), ("2", "same"), ("3", "added")}
    assert {(r.id, r.raw) for r in mutations.upsert(old, new).collect()} == {("1", "A"), ("2", "b"), ("3", "c")}
    assert {r.id for r in mutations.touched(old, new).collect()} == {"1", "3"}
    assert {r.id for r in mutations.remove(old, new.where("id = '1'")).collect()} == {"2"}
    assert Collection("t", old, "id").count() == 2
