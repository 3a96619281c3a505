"""The versioned batch store and the document cache."""

import json
import os

import pytest
from pyspark.sql import functions as F

from mangrove.errors import DocumentNotFoundError, ValidationError
from mangrove.sources.cache import DocumentCache
from mangrove.sources.document_store import DocumentStore, EqualityIndex, SlugPolicy


@pytest.fixture
def batch(spark):
    def make(*docs):
        rows = [(d["type"], d["id"], json.dumps(d)) for d in docs]
        return spark.createDataFrame(rows, "type string, id string, j string").select("type", "id", F.parse_json("j").alias("doc"))

    return make


def city(id_, name, **more):
    return {"type": "city", "id": id_, "name": name, **more}


def test_put_and_remove(spark, batch, tmp_path):
    store = DocumentStore(spark, str(tmp_path), adapters={"city": [EqualityIndex("country")]})
    first = store.put(batch(city("1", "Paris", country="FR"), city("2", "Rome", country="IT"), {"type": "note", "id": "1"}))
    assert (first.written, first.unchanged) == (3, 0) and store.types() == ["city", "note"]
    again = store.put(batch({"id": "1", "country": "FR", "type": "city", "name": "Paris"}, city("2", "Roma", country="IT")))
    assert (again.written, again.unchanged) == (1, 1)
    assert [r.id for r in store.query({"type": "city", "filter": {"name": "Roma"}}).collect()] == ["2"]
    assert [r.id for r in store.find("city", "country", "IT").collect()] == ["2"] and store.find("city", "name", ["Paris"]).count() == 1
    assert store.remove(batch(city("2", "")).select("type", "id").unionByName(spark.createDataFrame([("city", "9")], "type string, id string"))) == 1
    assert store.table("city", "index-country").count() == 1
    with pytest.raises(DocumentNotFoundError):
        store.require("city", "2")
    assert store.require("city", "1").count() == 1 and store.ensure_index("city", "name").count() == 1
    for bad in (batch(city("a b", "x")), batch(city("1", "x"), city("1", "y")), batch(city("1", "x")).withColumn("id", F.lit("2"))):
        with pytest.raises(ValidationError):
            store.put(bad)
    assert len([p for p in os.listdir(tmp_path / "city" / "documents") if len(p) == 32]) <= 2


def test_schema_quarantine(spark, batch, tmp_path):
    store = DocumentStore(spark, str(tmp_path))
    done = store.put(batch(city("1", "Paris"), city("2", 5)), schema={"properties": {"name": {"type": "string"}}})
    assert done.written == 1 and [r.id for r in done.quarantined.collect()] == ["2"]
    assert store.put(batch(city("2", 5)), schema={"properties": {"name": {"type": "string"}}}, mode="lenient").written == 1


def test_numbered_slug_goes_with_its_base(spark, batch, tmp_path):
    store = DocumentStore(spark, str(tmp_path), slugs={"city": SlugPolicy(["name"])})
    slugs = lambda: {r.id: r.slug for r in store.table("city", "slugs").collect()}
    store.put(batch(city("1", "Foo"), city("2", "Foo")))
    store.put(batch(city("2", "Football news")))
    assert slugs() == {"1": "foo", "2": "football-news"}


def test_slugs(spark, batch, tmp_path):
    store = DocumentStore(spark, str(tmp_path), slugs={"city": SlugPolicy(["name"], ["country"])})
    slugs = lambda: {r.id: r.slug for r in store.table("city", "slugs").collect()}
    store.put(batch(city("1", "Portland", country="US"), city("2", "Portland", country="US"), city("3", "Portland", country="UK")))
    assert slugs() == {"1": "portland", "2": "portland-2", "3": "portland"}
    assert store.put(batch(city("2", "Portland", country="US"))).unchanged == 1 and slugs()["2"] == "portland-2"
    store.put(batch(city("1", "Port Land", country="US"), city("4", "Portland", country="US")))
    assert slugs() == {"1": "port-land", "2": "portland-2", "3": "portland", "4": "portland"}
    store.put(batch(city("4", "Salem", country="US")))
    assert [r.id for r in store.by_slug("city", "salem", "US").collect()] == ["4"]
    assert [r.id for r in store.by_slug("city", "portland", "UK").collect()] == ["3"] and store.by_slug("city", "none").isEmpty()
    assert store.remove(spark.createDataFrame([("city", "3")], "type string, id string")) == 1 and "3" not in slugs()
    with pytest.raises(ValidationError):
        store.put(batch(city("9", "!!!", country="US")))


def test_cache(tmp_path):
    path = tmp_path / "a.json"
    path.write_text("1")
    cache = DocumentCache(documents=2)
    assert cache.get(str(path), json.loads) == 1 == cache.get(str(path), json.loads) and cache.stats()["hit_rate"] == 0.5
    path.write_text("22")
    assert cache.get(str(path), json.loads) == 22
    for k in range(3):
        (tmp_path / f"{k}.json").write_text("0")
        cache.get(str(tmp_path / f"{k}.json"), json.loads)
    assert cache.stats()["size"] == 2 and cache.stats()["evictions"] == 2
    small = DocumentCache(megabytes=0)
    small.get(str(path), json.loads)
    assert small.stats()["size"] == 0
    cache.clear()
    assert cache.stats()["size"] == cache.stats()["bytes"] == 0
