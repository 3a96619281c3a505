"""Registered queries of the document engine and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.canonical import compact_json, json_equal
from .functions.names import format_bytes, format_check, is_name, sha256
from .functions.paths import child_path, depth, last_segment, parent_path, shard_key
from .functions.slugs import generate_slug, limit_length, slug_base
from .operators import hierarchy, indexes, mutations, validation
from .operators import stats as statistics
from .operators.collections import Collection
from .operators.unique_slugs import unique_slugs
from .sources.tables import catalog, collection, table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(query: Query) -> Query:
        _QUERIES[name] = query
        if sql is not None:
            _SQL[name] = sql
        return query

    return keep


def _find(name: str, table_name: str, filter: dict[str, Any], columns: list[str], sql: str, **more) -> None:
    """A filter query with an inclusion projection."""

    def query(spark: SparkSession, folder: str) -> DataFrame:
        spec = {"filter": filter, "projection": dict.fromkeys(columns, 1), **more}
        return collection(spark, folder, table_name).query(spec)

    register(name, f"SELECT {', '.join(columns)} FROM {table_name} {sql}")(query)


_ORDER, _LINE, _PART = ["o_orderkey"], ["l_orderkey", "l_linenumber"], ["p_partkey"]
_HIGH = ["1-URGENT", "2-HIGH"]

_find("filter_eq", "orders", {"o_orderstatus": {"$eq": "F"}}, ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"], "WHERE o_orderstatus = 'F'")
_find("filter_literal", "orders", {"o_orderstatus": "O"}, _ORDER, "WHERE o_orderstatus = 'O'")
_find("filter_ne", "orders", {"o_orderstatus": {"$ne": "F"}}, _ORDER, "WHERE o_orderstatus IS DISTINCT FROM 'F'")
_find("filter_in", "orders", {"o_orderpriority": {"$in": _HIGH}}, _ORDER, "WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
_find("filter_nin", "orders", {"o_orderstatus": {"$nin": ["F", "O"]}}, _ORDER, "WHERE o_orderstatus NOT IN ('F', 'O')")
_find("filter_gt", "lineitem", {"l_quantity": {"$gt": 45}}, _LINE, "WHERE l_quantity > 45")
_find("filter_gte", "lineitem", {"l_quantity": {"$gte": 45}}, _LINE, "WHERE l_quantity >= 45")
_find("filter_lt", "lineitem", {"l_discount": {"$lt": 0.02}}, _LINE, "WHERE l_discount < 0.02")
_find("filter_lte", "part", {"p_size": {"$lte": 5}}, _PART, "WHERE p_size <= 5")
_find("filter_range_multi", "part", {"p_size": {"$gte": 10, "$lte": 12}}, _PART, "WHERE p_size BETWEEN 10 AND 12")
_find("filter_and_in_gte", "orders", {"$and": [{"o_orderpriority": {"$in": _HIGH}}, {"o_totalprice": {"$gte": 400000}}]}, _ORDER, "WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice >= 400000")
_find("filter_or_nested", "customer", {"$or": [{"$and": [{"c_mktsegment": "BUILDING"}, {"c_acctbal": {"$gte": 9000}}]}, {"c_acctbal": {"$lt": -500}}]}, ["c_custkey"], "WHERE (c_mktsegment = 'BUILDING' AND c_acctbal >= 9000) OR c_acctbal < -500")
_find("filter_implicit_and", "orders", {"o_orderstatus": "F", "$or": [{"o_totalprice": {"$lt": 2000}}, {"o_orderpriority": "5-LOW"}]}, _ORDER, "WHERE o_orderstatus = 'F' AND (o_totalprice < 2000 OR o_orderpriority = '5-LOW')")
_find("filter_not", "orders", {"$not": {"o_orderstatus": "F"}}, _ORDER, "WHERE NOT o_orderstatus = 'F'")
_find("filter_not_empty", "orders", {"$not": {}}, _ORDER, "WHERE false")
_find("filter_or_empty", "orders", {"$or": []}, _ORDER, "WHERE false")
_find("filter_all", "customer", {}, ["c_custkey"], "")
_find("filter_empty_operators", "customer", {"nothing": {}}, ["c_custkey"], "")
_find("filter_strict_types", "part", {"p_size": {"$in": ["5", 5, True]}}, _PART, "WHERE p_size = 5")
_find("filter_time", "orders", {"o_orderdate": {"$gte": "1997-01-01T00:00:00", "$lt": "1997-02-01"}}, _ORDER, "WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1997-02-01'")
_find("filter_type", "orders", {"o_orderstatus": {"$type": "string"}, "o_totalprice": {"$type": "number"}, "x": {"$type": "undefined"}}, _ORDER, "WHERE o_orderstatus IS NOT NULL AND o_totalprice IS NOT NULL")
_find("filter_text_length", "part", {"p_name.length": {"$gt": 12}}, _PART, "WHERE length(p_name) > 12")
_find("id_lookup", "orders", {"id": {"$in": ["5", "17", "900", "0900", "x"]}}, _ORDER, "WHERE o_orderkey IN (5, 17, 900)")
_find("get_document", "customer", {"id": "42"}, ["c_custkey", "c_name"], "WHERE c_custkey = 42")
_find("project_include", "customer", {}, ["c_custkey", "c_name"], "")
_find("project_absent", "customer", {"c_custkey": {"$lte": 100}}, ["c_name", "c_acctbal"], "WHERE c_custkey <= 100")


@register("project_exclude", "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate FROM orders")
def project_exclude(spark, folder):
    return collection(spark, folder, "orders").query({"filter": {}, "projection": {"o_totalprice": 0, "o_orderpriority": 0, "o_x.y": 0}})


def _events(spark, folder) -> Collection:
    """Events with their parsed properties."""
    df = table(spark, folder, "events").withColumn("props", F.parse_json("props"))
    return Collection("events", df, "event_id")


@register("project_nested", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS "props.k" FROM events WHERE event_type = 'click'""")
def project_nested(spark, folder):
    out = _events(spark, folder).query({"filter": {"event_type": "click"}, "projection": {"event_id": 1, "props.k": 1}})
    return out.withColumn("props.k", F.try_variant_get("`props.k`", "$", "int"))


@register("filter_json_path", "SELECT event_id FROM events WHERE CAST(json_extract_string(props, '$.k') AS INT) >= 95")
def filter_json_path(spark, folder):
    return _events(spark, folder).query({"filter": {"props.k": {"$gte": 95}}, "projection": {"event_id": 1}})


def _labelled(spark, folder) -> Collection:
    documents, labels = table(spark, folder, "documents").select("doc_id"), table(spark, folder, "labels")
    return Collection("documents", documents.join(labels, "doc_id", "left"), "doc_id")


_LABELLED = "SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id)"


def _labelled_query(name: str, filter: dict, sql: str) -> None:
    register(name, f"{_LABELLED} WHERE {sql}")(lambda spark, folder: _labelled(spark, folder).query({"filter": filter, "projection": {"doc_id": 1}}))


_labelled_query("filter_exists_false", {"quality": {"$exists": False}}, "l.quality IS NULL")
_labelled_query("filter_exists_true", {"quality": {"$exists": True}}, "l.quality IS NOT NULL")
_labelled_query("filter_ne_missing", {"quality": {"$ne": 1}}, "l.quality IS DISTINCT FROM 1")
_labelled_query("filter_nin_missing", {"quality": {"$nin": [1, None]}}, "l.quality IS DISTINCT FROM 1")
_labelled_query("filter_not_missing", {"$not": {"quality": {"$gte": 1}}}, "NOT coalesce(l.quality >= 1, false)")


def _tagged(spark, folder) -> Collection:
    df = table(spark, folder, "part").withColumn("tags", F.split("p_name", " "))
    return Collection("part", df, "p_partkey")


def _tag_query(name: str, filter: dict, sql: str) -> None:
    register(name, f"SELECT p_partkey FROM part WHERE {sql}")(lambda spark, folder: _tagged(spark, folder).query({"filter": filter, "projection": {"p_partkey": 1}}))


_tag_query("filter_array_eq", {"tags": "red"}, "list_contains(string_split(p_name, ' '), 'red')")
_tag_query("filter_array_ne", {"tags": {"$ne": "red"}}, "true")
_tag_query("filter_array_in", {"tags": {"$in": ["red"]}}, "false")
_tag_query("filter_array_nin", {"tags": {"$nin": ["red"]}}, "true")
_tag_query("filter_path_index", {"tags.0": "red"}, "string_split(p_name, ' ')[1] = 'red'")
_tag_query("filter_array_length", {"tags.length": 2, "tags": {"$type": "array"}}, "len(string_split(p_name, ' ')) = 2")


@register("filter_coerce", "SELECT p_partkey FROM part WHERE CAST(CAST(p_size AS VARCHAR) AS DOUBLE) > 40")
def filter_coerce(spark, folder):
    df = table(spark, folder, "part").withColumn("p_size_s", F.col("p_size").cast("string"))
    return Collection("part", df, "p_partkey").query({"filter": {"p_size_s": {"$gt": 40}}, "projection": {"p_partkey": 1}})


def _mixed(spark, folder) -> Collection:
    """Events as VARIANT documents whose ``v`` is a number, a string, a boolean, missing or null by id."""
    kind = F.col("event_id") % 5
    value = (
        F.when(kind == 0, F.concat(F.lit(',"v":'), F.col("value").cast("string")))
        .when(kind == 1, F.concat(F.lit(',"v":"'), "event_type", F.lit('"')))
        .when(kind == 2, F.concat(F.lit(',"v":'), (F.col("event_id") % 2 == 1).cast("string")))
        .when(kind == 3, F.lit(""))
        .otherwise(F.lit(',"v":null'))
    )
    text = F.concat(F.lit('{"id":"'), F.col("event_id").cast("string"), F.lit('","type":"events"'), value, F.lit("}"))
    df = table(spark, folder, "events").select(F.lit("events").alias("type"), F.col("event_id").cast("string").alias("id"), F.parse_json(text).alias("doc"))
    return Collection("events", df)


@register("type_of_mixed", "SELECT CAST(event_id AS VARCHAR) AS id, CASE event_id % 5 WHEN 0 THEN 'number' WHEN 1 THEN 'string' WHEN 2 THEN 'boolean' WHEN 3 THEN 'undefined' ELSE 'object' END AS kind FROM events")
def type_of_mixed(spark, folder):
    c = _mixed(spark, folder)
    field, kind = c.resolver.field("v"), F.lit(None).cast("string")
    for name in ("number", "string", "boolean", "undefined", "object", "array"):
        kind = F.when(F.coalesce(field.type_is(name), F.lit(False)), name).otherwise(kind)
    return c.df.select("id", kind.alias("kind"))


_RANK = """CASE event_id % 5 WHEN 2 THEN 1 WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 0 END, CASE WHEN event_id % 5 = 2 THEN event_id % 2 END,
CASE WHEN event_id % 5 = 0 THEN value END, CASE WHEN event_id % 5 = 1 THEN event_type END, CAST(event_id AS VARCHAR)"""


@register("sort_mixed_topk", f"SELECT CAST(event_id AS VARCHAR) AS id FROM events ORDER BY {_RANK} LIMIT 3000")
def sort_mixed_topk(spark, folder):
    return _mixed(spark, folder).query({"filter": {}, "sort": {"v": 1}, "limit": 3000}).select("id")


def _mixed_query(name: str, filter: dict, sql: str) -> None:
    register(name, f"SELECT CAST(event_id AS VARCHAR) AS id FROM events WHERE {sql}")(lambda spark, folder: _mixed(spark, folder).query({"filter": filter}).select("id"))


_mixed_query("variant_eq_null", {"v": None}, "event_id % 5 = 4")
_mixed_query("variant_exists", {"v": {"$exists": False}}, "event_id % 5 = 3")
_mixed_query("variant_gte_zero", {"v": {"$gte": 0}}, "(event_id % 5 = 0 AND value >= 0) OR event_id % 5 IN (2, 4)")
_mixed_query("variant_ne", {"v": {"$ne": "click"}}, "NOT (event_id % 5 = 1 AND event_type = 'click')")
_mixed_query("variant_in", {"v": {"$in": ["click", True, None]}}, "(event_id % 5 = 1 AND event_type = 'click') OR (event_id % 5 = 2 AND event_id % 2 = 1) OR event_id % 5 = 4")
_mixed_query("variant_not", {"$not": {"v": {"$type": "string"}}}, "event_id % 5 <> 1")


def _sorted(name: str, table_name: str, spec: dict, columns: str, sql: str) -> None:
    register(name, f"SELECT {columns} FROM {table_name} {sql}")(lambda spark, folder: collection(spark, folder, table_name).query(spec))


_sorted("sort_limit", "orders", {"filter": {"o_orderstatus": "F"}, "sort": {"o_totalprice": -1}, "limit": 20, "projection": {"o_orderkey": 1, "o_totalprice": 1}}, "o_orderkey, o_totalprice", "WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, CAST(o_orderkey AS VARCHAR) LIMIT 20")
_sorted("sort_skip_limit", "orders", {"filter": {}, "sort": {"o_totalprice": 1}, "skip": 800, "limit": 50, "projection": {"o_orderkey": 1, "o_totalprice": 1}}, "o_orderkey, o_totalprice", "ORDER BY o_totalprice, CAST(o_orderkey AS VARCHAR) LIMIT 50 OFFSET 800")
_sorted("sort_two_keys", "orders", {"filter": {"$and": [{"o_orderpriority": {"$in": _HIGH}}, {"o_totalprice": {"$gte": 200000}}]}, "sort": {"o_orderpriority": -1, "o_orderdate": 1}, "limit": 20, "projection": {"o_orderkey": 1}}, "o_orderkey", "WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice >= 200000 ORDER BY o_orderpriority DESC, o_orderdate, CAST(o_orderkey AS VARCHAR) LIMIT 20")
_sorted("limit_no_sort", "orders", {"filter": {"o_orderstatus": "O"}, "limit": 10, "projection": {"o_orderkey": 1}}, "o_orderkey", "WHERE o_orderstatus = 'O' ORDER BY CAST(o_orderkey AS VARCHAR) LIMIT 10")
_sorted("sort_unprojected", "customer", {"filter": {}, "sort": {"c_acctbal": -1}, "limit": 25, "projection": {"c_name": 1}}, "c_name", "ORDER BY c_acctbal DESC, CAST(c_custkey AS VARCHAR) LIMIT 25")
_sorted("sort_desc_missing_last", "customer", {"filter": {}, "sort": {"nothing": -1}, "limit": 5, "projection": {"c_custkey": 1}}, "c_custkey", "ORDER BY CAST(c_custkey AS VARCHAR) LIMIT 5")


_UNION = "SELECT 'region' AS type, CAST(r_regionkey AS VARCHAR) AS id, r_name AS name FROM region UNION ALL SELECT 'nation', CAST(n_nationkey AS VARCHAR), n_name FROM nation UNION ALL SELECT 'supplier', CAST(s_suppkey AS VARCHAR), s_name FROM supplier"


def _places(spark, folder):
    from .operators.collections import Catalog

    names = {"region": "r_name", "nation": "n_name", "supplier": "s_name"}
    return Catalog([Collection(t, c.df.withColumnRenamed(names[t], "name").select(c.resolver.key[0], "name"), c.resolver.key) for t, c in catalog(spark, folder, list(names)).collections.items()])


@register("multi_type", _UNION)
def multi_type(spark, folder):
    return _places(spark, folder).query({"filter": {}, "projection": {"type": 1, "id": 1, "name": 1}})


@register("multi_type_page", f"SELECT type, id FROM ({_UNION}) ORDER BY type, id LIMIT 20 OFFSET 20")
def multi_type_page(spark, folder):
    return _places(spark, folder).query({"filter": {}, "skip": 20, "limit": 20, "projection": {"type": 1, "id": 1}})


@register("list_ids", "SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders ORDER BY 1 LIMIT 5000")
def list_ids(spark, folder):
    return collection(spark, folder, "orders").ids(limit=5000)


@register("list_types", f"SELECT DISTINCT type FROM ({_UNION})")
def list_types(spark, folder):
    return _places(spark, folder).union().df.select("type").distinct()


# indexes


@register("index_build", "SELECT o_orderpriority AS k, count(*) AS n, min(CAST(o_orderkey AS VARCHAR)) AS first_id FROM orders GROUP BY 1")
def index_build(spark, folder):
    return indexes.key_counts(indexes.build_index(collection(spark, folder, "orders"), "o_orderpriority")).withColumnRenamed("key", "k")


@register("index_multivalue", "SELECT k, count(DISTINCT p_partkey) AS n FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS k FROM part) GROUP BY k")
def index_multivalue(spark, folder):
    return indexes.key_counts(indexes.build_index(_tagged(spark, folder), "tags")).select(F.col("key").alias("k"), "n")


@register("index_lookup", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def index_lookup(spark, folder):
    orders = collection(spark, folder, "orders")
    return indexes.query_with_index(orders, indexes.build_index(orders, "o_orderstatus"), "o_orderstatus", "F").select("o_orderkey", "o_totalprice")


@register("index_lookup_ids", "SELECT CAST(c_custkey AS VARCHAR) AS id FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def index_lookup_ids(spark, folder):
    return indexes.lookup(indexes.build_index(collection(spark, folder, "customer"), "c_mktsegment"), ["BUILDING", "MACHINERY"])


@register("index_key_encoding", """SELECT k, count(*) AS n FROM (SELECT CASE event_id % 5 WHEN 0 THEN CASE WHEN value = floor(value) THEN '__num__' || CAST(CAST(value AS BIGINT) AS VARCHAR) ELSE '__num__' || CAST(value AS VARCHAR) END
WHEN 1 THEN event_type WHEN 2 THEN CASE WHEN event_id % 2 = 1 THEN '__bool__true' ELSE '__bool__false' END ELSE '__null__' END AS k FROM events WHERE event_id % 5 <> 3) WHERE k NOT LIKE '\\_\\_num%' ESCAPE '\\' GROUP BY k""")
def index_key_encoding(spark, folder):
    keys = indexes.key_counts(indexes.build_index(_mixed(spark, folder), "v"))
    return keys.where(~F.col("key").startswith("__num")).select(F.col("key").alias("k"), "n")


@register("index_key_encoding_all", """SELECT k, count(*) AS n FROM (SELECT CASE event_id % 5 WHEN 0 THEN CASE WHEN value = floor(value) THEN '__num__' || CAST(CAST(value AS BIGINT) AS VARCHAR) ELSE '__num__' || CAST(value AS VARCHAR) END
WHEN 1 THEN event_type WHEN 2 THEN CASE WHEN event_id % 2 = 1 THEN '__bool__true' ELSE '__bool__false' END ELSE '__null__' END AS k FROM events WHERE event_id % 5 <> 3) GROUP BY k""")
def index_key_encoding_all(spark, folder):
    return indexes.key_counts(indexes.build_index(_mixed(spark, folder), "v")).select(F.col("key").alias("k"), "n")


@register("index_number_keys", "SELECT '__num__' || CAST(p_size AS VARCHAR) AS k, count(*) AS n FROM part GROUP BY 1")
def index_number_keys(spark, folder):
    return indexes.key_counts(indexes.build_index(collection(spark, folder, "part"), "p_size")).select(F.col("key").alias("k"), "n")


@register("index_stats", "SELECT count(*) AS docs_scanned, count(DISTINCT o_orderpriority) AS keys, count(*) AS entries FROM orders")
def index_stats(spark, folder):
    orders = collection(spark, folder, "orders")
    return indexes.index_stats(orders, indexes.build_index(orders, "o_orderpriority")).drop("bytes")


@register("index_update", "SELECT CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS k, count(*) AS n FROM orders WHERE o_orderkey % 11 <> 0 GROUP BY 1")
def index_update(spark, folder):
    orders = collection(spark, folder, "orders")
    index = indexes.build_index(orders, "o_orderstatus")
    changed = orders.df.where("o_orderkey % 7 = 0 AND o_orderkey % 11 <> 0").withColumn("o_orderstatus", F.lit("X"))
    gone = orders.df.where("o_orderkey % 11 = 0").select(F.col("o_orderkey").cast("string").alias("id"))
    out = indexes.update_index(index, Collection("orders", changed, "o_orderkey"), "o_orderstatus", gone)
    return indexes.key_counts(out).select(F.col("key").alias("k"), "n")


# statistics


@register("stats_by_type", "SELECT 'documents' AS type, count(*) AS count, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents UNION ALL SELECT 'benchmark', count(*), CAST(sum(strlen(text)) AS BIGINT) FROM benchmark")
def stats_by_type(spark, folder):
    rows = [table(spark, folder, t).select(F.lit(t).alias("type"), F.octet_length("text").alias("bytes")) for t in ("documents", "benchmark")]
    both = rows[0].unionByName(rows[1])
    return both.groupBy("type").agg(F.count("*").alias("count"), F.sum("bytes").alias("bytes"))


@register("stats_detailed", "SELECT count(*) AS count, CAST(sum(strlen(text)) AS BIGINT) AS bytes, avg(strlen(text)) AS avg_bytes, min(strlen(text)) AS min_bytes, max(strlen(text)) AS max_bytes FROM documents")
def stats_detailed(spark, folder):
    return statistics.detailed_stats(table(spark, folder, "documents"), F.octet_length("text"), by_type=False)


@register("stats_rollup", "SELECT lang AS type, count(*) AS count, CAST(sum(strlen(text)) AS BIGINT) AS bytes, min(strlen(text)) AS min_bytes, max(strlen(text)) AS max_bytes FROM documents GROUP BY ROLLUP (lang)")
def stats_rollup(spark, folder):
    return statistics.detailed_stats(table(spark, folder, "documents").withColumnRenamed("lang", "type"), F.octet_length("text")).drop("avg_bytes")


@register("percentiles", "SELECT o_orderstatus, quantile_disc(o_totalprice, 0.5) AS p50, quantile_disc(o_totalprice, 0.95) AS p95, quantile_disc(o_totalprice, 0.99) AS p99 FROM orders GROUP BY 1")
def percentiles(spark, folder):
    return statistics.percentiles(table(spark, folder, "orders"), "o_totalprice", by=["o_orderstatus"])


@register("hit_rate", "SELECT event_type, sum(CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END) / count(*) AS hit_rate FROM events GROUP BY 1")
def hit_rate(spark, folder):
    hit = F.when(F.col("event_id") % 3 == 0, 1).otherwise(0)
    rows = table(spark, folder, "events").select("event_type", hit.alias("hits"), (1 - hit).alias("misses"))
    return statistics.hit_rate(rows, by=["event_type"])


@register("counters", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def counters(spark, folder):
    return statistics.counters(table(spark, folder, "events"), ["event_type"])


# slugs and hierarchies

_SLUG = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim({})), '[\\s_]+', '-', 'g'), '[^a-z0-9-]', '', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g')"


@register("slug_basic", f"SELECT p_partkey, {_SLUG.format('p_name')} AS slug FROM part")
def slug_basic(spark, folder):
    return table(spark, folder, "part").select("p_partkey", generate_slug(F.col("p_name"), unicode=False).alias("slug"))


@register("slug_limit", "SELECT p_partkey, CASE WHEN length(s) <= 9 THEN s WHEN instr(substr(s, 1, 9), '-') > 0 AND 9 - instr(reverse(substr(s, 1, 9)), '-') > 5.4 THEN substr(s, 1, 9 - instr(reverse(substr(s, 1, 9)), '-')) ELSE substr(s, 1, 9) END AS slug FROM (SELECT p_partkey, replace(lower(p_name), ' ', '-') AS s FROM part)")
def slug_limit(spark, folder):
    return table(spark, folder, "part").select("p_partkey", limit_length(F.replace(F.lower("p_name"), F.lit(" "), F.lit("-")), 9).alias("slug"))


@register("slug_unique", "SELECT p_partkey, CASE WHEN rn = 1 THEN s ELSE s || '-' || rn END AS slug FROM (SELECT p_partkey, s, row_number() OVER (PARTITION BY p_brand, s ORDER BY CAST(p_partkey AS VARCHAR)) AS rn FROM (SELECT p_partkey, p_brand, replace(lower(p_name), ' ', '-') AS s FROM part))")
def slug_unique(spark, folder):
    rows = table(spark, folder, "part").select("p_partkey", "p_brand", F.col("p_partkey").cast("string").alias("id"), slug_base(F.col("p_name"), unicode=False).alias("base"))
    return unique_slugs(rows, ["p_brand"]).select("p_partkey", "slug")


@register("slug_conflicts", "SELECT 'part' AS type, p_brand AS scope, replace(lower(p_name), ' ', '-') AS slug, count(*) AS claims, min(CAST(p_partkey AS VARCHAR)) AS holder FROM part GROUP BY 2, 3 HAVING count(*) > 1")
def slug_conflicts(spark, folder):
    rows = table(spark, folder, "part").select(F.lit("part").alias("type"), F.col("p_brand").alias("scope"), slug_base(F.col("p_name"), unicode=False).alias("slug"), F.col("p_partkey").cast("string").alias("id"))
    return indexes.slug_conflicts(rows)


def _resolved(spark, people: DataFrame) -> DataFrame:
    own = lambda slug, name: people.select(F.lit("customer").alias("type"), F.lit("").alias("scope"), slug.alias(name), F.col("c_custkey").cast("string").alias("id"))
    slugs, aliases = own(F.lower(F.replace("c_name", F.lit("#"), F.lit("-"))), "slug"), own(F.concat(F.lit("old-"), F.col("c_custkey").cast("string")), "alias")
    nobody = spark.range(1).select(F.lit("customer").alias("type"), F.lit("").alias("scope"), F.lit("nobody").alias("slug"))
    wanted = slugs.drop("id").unionByName(aliases.withColumnRenamed("alias", "slug").drop("id")).unionByName(nobody)
    return indexes.resolve_slugs(wanted, slugs, aliases).select("id", "slug")


@register("slug_resolve", "SELECT CAST(c_custkey AS VARCHAR) AS id, lower(replace(c_name, '#', '-')) AS slug FROM customer WHERE c_custkey <= 50 UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'old-' || c_custkey FROM customer WHERE c_custkey <= 50 UNION ALL SELECT NULL, 'nobody'")
def slug_resolve(spark, folder):
    return _resolved(spark, table(spark, folder, "customer").where("c_custkey <= 50"))


@register("slug_resolve_all", "SELECT CAST(c_custkey AS VARCHAR) AS id, lower(replace(c_name, '#', '-')) AS slug FROM customer UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'old-' || c_custkey FROM customer UNION ALL SELECT NULL, 'nobody'")
def slug_resolve_all(spark, folder):
    return _resolved(spark, table(spark, folder, "customer"))


def _nodes(spark, folder) -> DataFrame:
    """Regions and nations with materialized paths."""
    slug = lambda c: slug_base(F.col(c), unicode=False).alias("slug")
    regions = table(spark, folder, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), slug("r_name"), F.lit(None).cast("string").alias("parent_id"))
    nations = table(spark, folder, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), slug("n_name"), F.concat(F.lit("r"), "n_regionkey").alias("parent_id"))
    return hierarchy.place_tree(regions.unionByName(nations))


_REGION, _NATION = "replace(lower(r_name), ' ', '-')", "replace(lower(n_name), '_', '-')"
_PATHS = f"SELECT 'r' || r_regionkey AS id, '/' || {_REGION} AS path, 1 AS depth FROM region UNION ALL SELECT 'n' || n_nationkey, '/' || {_REGION} || '/' || {_NATION}, 2 FROM nation JOIN region ON n_regionkey = r_regionkey"


@register("path_tree", _PATHS)
def path_tree(spark, folder):
    return _nodes(spark, folder).select("id", "path", "depth")


@register("path_materialized", f"SELECT n_nationkey, '/' || {_REGION} || '/' || {_NATION} AS path FROM nation JOIN region ON n_regionkey = r_regionkey")
def path_materialized(spark, folder):
    slug = lambda c: slug_base(F.col(c), unicode=False)
    parents = table(spark, folder, "region").select(F.col("r_regionkey").alias("id"), child_path(F.lit(None).cast("string"), slug("r_name")).alias("path"))
    children = table(spark, folder, "nation").select("n_nationkey", F.col("n_regionkey").alias("parent_id"), slug("n_name").alias("slug"))
    return hierarchy.place_children(children, parents).select("n_nationkey", "path")


@register("path_depth", f"SELECT n_nationkey, length(p) - length(replace(p, '/', '')) AS depth FROM (SELECT n_nationkey, '/' || {_REGION} || '/' || {_NATION} AS p FROM nation JOIN region ON n_regionkey = r_regionkey)")
def path_depth(spark, folder):
    return path_materialized(spark, folder).select("n_nationkey", depth(F.col("path")).cast("long").alias("depth"))


def _path_index(spark, folder) -> DataFrame:
    return hierarchy.path_index(_nodes(spark, folder).select(F.lit("place").alias("type"), "id", "path"))[0]


@register("find_by_path", f"SELECT id, path FROM ({_PATHS}) WHERE path = '/asia/nation-2'")
def find_by_path(spark, folder):
    return hierarchy.find_by_path(_path_index(spark, folder), "/asia/nation-2").select("id", "path")


@register("list_children", f"SELECT id, path FROM ({_PATHS}) WHERE path LIKE '/africa/%' ORDER BY path LIMIT 3")
def list_children(spark, folder):
    return hierarchy.list_children(_path_index(spark, folder), "/africa", limit=3).select("id", "path")


@register("path_parts", f"SELECT path, CASE WHEN depth = 1 THEN '/' ELSE regexp_replace(path, '/[^/]*$', '') END AS parent, regexp_extract(path, '[^/]*$') AS last FROM ({_PATHS})")
def path_parts(spark, folder):
    path = F.col("path")
    return _nodes(spark, folder).select("path", parent_path(path).alias("parent"), last_segment(path).alias("last"))


@register("shard_key", "SELECT c_custkey, substr(sha256(c_name), 1, 2) AS bucket, substr(sha256(c_name), 3, 8) AS suffix FROM customer")
def shard_keys(spark, folder):
    return table(spark, folder, "customer").select("c_custkey", shard_key(F.col("c_name")).alias("k")).select("c_custkey", "k.bucket", "k.suffix")


# texts


@register("json_canonical", "SELECT c_custkey, json_object('c_mktsegment', c_mktsegment, 'c_name', c_name)::VARCHAR AS doc FROM customer")
def json_canonical(spark, folder):
    rows = table(spark, folder, "customer")
    return rows.select("c_custkey", compact_json(F.to_json(F.struct("c_name", "c_mktsegment"))).alias("doc"))


@register("json_equal", "SELECT c_custkey, true AS same, false AS malformed FROM customer")
def json_equals(spark, folder):
    a, b = F.to_json(F.struct("c_name", "c_mktsegment")), F.to_json(F.struct("c_mktsegment", "c_name"))
    return table(spark, folder, "customer").select("c_custkey", json_equal(a, b).alias("same"), json_equal(a, F.lit("{")).alias("malformed"))


@register("sha256", "SELECT doc_id, sha256(text) AS sha FROM documents")
def digests(spark, folder):
    return table(spark, folder, "documents").select("doc_id", sha256(F.col("text")).alias("sha"))


@register("format_bytes", "SELECT doc_id, CASE WHEN strlen(text) < 1024 THEN strlen(text) || ' Bytes' ELSE regexp_replace(CAST(round(strlen(text) / 1024::DOUBLE, 2) AS VARCHAR), '\\.0$', '') || ' KB' END AS size FROM documents WHERE strlen(text) < 1048576")
def byte_sizes(spark, folder):
    rows = table(spark, folder, "documents").where(F.octet_length("text") < 1 << 20)
    return rows.select("doc_id", format_bytes(F.octet_length("text")).alias("size"))


@register("format_bytes_all", "SELECT doc_id, CASE WHEN strlen(text) < 1024 THEN strlen(text) || ' Bytes' WHEN strlen(text) < 1048576 THEN regexp_replace(CAST(round(strlen(text) / 1024::DOUBLE, 2) AS VARCHAR), '\\.0$', '') || ' KB' WHEN strlen(text) < 1073741824 THEN regexp_replace(CAST(round(strlen(text) / 1048576::DOUBLE, 2) AS VARCHAR), '\\.0$', '') || ' MB' ELSE regexp_replace(CAST(round(strlen(text) / 1073741824::DOUBLE, 2) AS VARCHAR), '\\.0$', '') || ' GB' END AS size FROM documents")
def byte_sizes_all(spark, folder):
    return table(spark, folder, "documents").select("doc_id", format_bytes(F.octet_length("text")).alias("size"))


@register("name_check", "SELECT p_partkey, false AS spaced, true AS dashed FROM part")
def name_check(spark, folder):
    return table(spark, folder, "part").select("p_partkey", is_name(F.col("p_name")).alias("spaced"), is_name(F.replace("p_name", F.lit(" "), F.lit("-"))).alias("dashed"))


@register("format_slug", "SELECT p_partkey, regexp_matches(replace(p_name, ' ', '-'), '^[a-z0-9]+(-[a-z0-9]+)*$') AS ok FROM part")
def format_slug(spark, folder):
    return table(spark, folder, "part").select("p_partkey", format_check("slug", F.replace("p_name", F.lit(" "), F.lit("-"))).alias("ok"))


# validation

_SCHEMA = {"type": "object", "required": ["o_orderkey"], "properties": {"o_totalprice": {"type": "number", "minimum": 5000}, "o_orderstatus": {"enum": ["F", "O"]}}}


@register("validate_errors", "SELECT o_orderkey AS id, 'minimum' AS code, '/o_totalprice' AS pointer FROM orders WHERE o_totalprice < 5000 UNION ALL SELECT o_orderkey, 'enum', '/o_orderstatus' FROM orders WHERE o_orderstatus NOT IN ('F', 'O')")
def validate_errors(spark, folder):
    return validation.validation_errors(collection(spark, folder, "orders"), _SCHEMA).select("id", "code", "pointer")


@register("validate_summary", "SELECT count(*) AS total, CAST(0 AS BIGINT) AS valid, count(*) AS warnings, CAST(0 AS BIGINT) AS errors FROM orders")
def validate_summary(spark, folder):
    return validation.validation_summary(collection(spark, folder, "orders"), _SCHEMA)


@register("validate_required", f"SELECT d.doc_id AS id, 'required' AS code, '/quality' AS pointer FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS NULL")
def validate_required(spark, folder):
    return validation.validation_errors(_labelled(spark, folder), {"required": ["quality"]}).select("id", "code", "pointer")


@register("validate_by_reference", """SELECT o_orderkey AS id, 'minimum' AS code FROM orders WHERE o_orderstatus = 'F' AND o_totalprice < 5000
UNION ALL SELECT o_orderkey, 'enum' FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority NOT IN ('1-URGENT') UNION ALL SELECT o_orderkey, 'ref' FROM orders WHERE o_orderstatus = 'P'""")
def validate_by_reference(spark, folder):
    registry = validation.SchemaRegistry()
    registry.add({"$id": "schema/f@1", "properties": {"o_totalprice": {"minimum": 5000}}})
    registry.add({"$id": "schema/o@1", "properties": {"o_orderpriority": {"enum": ["1-URGENT"]}}})
    defaults = {"F": "schema/f@1", "O": "schema/o@1", "P": "schema/p@1"}
    rows = validation.validate_by_reference(collection(spark, folder, "orders"), registry, defaults, kind_field="o_orderstatus")
    return rows.select(F.col("o_orderkey").alias("id"), F.explode("errors").alias("e")).select("id", "e.code")


@register("sidecars", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'E_MD_MISSING' WHEN doc_id % 3 = 1 THEN 'E_MD_SHA' END AS error FROM documents")
def sidecar_join(spark, folder):
    key = [F.lit("documents").alias("type"), F.col("doc_id").cast("string").alias("id"), F.lit("body.md").alias("path")]
    docs = table(spark, folder, "documents")
    fields = docs.select("doc_id", *key, F.lit("body").alias("field"), F.sha2("text", 256).alias("sha256"))
    changed = F.when(F.col("doc_id") % 3 == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return mutations.sidecars(fields, docs.where("doc_id % 3 <> 0").select(*key, changed.alias("content"))).select("doc_id", "error")


def _claims(people: DataFrame) -> DataFrame:
    own = lambda df: df.select(F.lit("customer").alias("type"), F.lit("").alias("scope"), F.concat(F.lit("c-"), (F.col("c_custkey") - F.col("c_custkey") % 2).cast("string")).alias("slug"), F.col("c_custkey").cast("string").alias("id"))
    return indexes.claim_slugs(own(people.where("c_custkey % 2 = 0")), own(people)).select("id", "ok")


@register("slug_claims", "SELECT CAST(c_custkey AS VARCHAR) AS id, c_custkey % 2 = 0 AS ok FROM customer WHERE c_custkey < 100")
def slug_claims(spark, folder):
    return _claims(table(spark, folder, "customer").where("c_custkey < 100"))


@register("slug_claims_all", "SELECT CAST(c_custkey AS VARCHAR) AS id, c_custkey % 2 = 0 AS ok FROM customer")
def slug_claims_all(spark, folder):
    return _claims(table(spark, folder, "customer"))


# mutations


def _versions(spark, folder):
    old = table(spark, folder, "customer").select(F.lit("customer").alias("type"), F.col("c_custkey").cast("string").alias("id"), "c_custkey", "c_acctbal")
    new = old.where("c_custkey % 3 = 0").withColumn("c_acctbal", F.when(F.col("c_custkey") % 2 == 0, 0.0).otherwise(F.col("c_acctbal")))
    new = new.unionByName(old.where("c_custkey BETWEEN 1 AND 10").withColumns({"c_custkey": -F.col("c_custkey"), "id": F.concat(F.lit("-"), "id")}))
    return old, new


@register("upsert", "SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN 0.0::DOUBLE ELSE c_acctbal END AS c_acctbal FROM customer UNION ALL SELECT -c_custkey, c_acctbal FROM customer WHERE c_custkey BETWEEN 1 AND 10")
def upsert(spark, folder):
    return mutations.upsert(*_versions(spark, folder)).select("c_custkey", "c_acctbal")


@register("remove", "SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0")
def remove(spark, folder):
    return mutations.remove(*_versions(spark, folder)).select("c_custkey")


@register("change_detection", "SELECT status, count(*) AS n FROM (SELECT CASE WHEN c_custkey % 2 = 0 AND c_acctbal <> 0 THEN 'changed' ELSE 'same' END AS status FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT 'added' FROM customer WHERE c_custkey BETWEEN 1 AND 10) GROUP BY 1")
def change_detection(spark, folder):
    old, new = (v.withColumn("raw", F.to_json(F.struct("c_custkey", "c_acctbal"))) for v in _versions(spark, folder))
    return mutations.changes(old, new).groupBy("status").agg(F.count("*").alias("n"))


@register("format_count", "SELECT count(*) AS n FROM customer WHERE c_custkey % 4 = 0")
def format_count(spark, folder):
    tidy = F.to_json(F.struct("c_acctbal", "c_custkey"))
    raw = F.when(F.col("c_custkey") % 4 == 0, F.to_json(F.struct("c_custkey", "c_acctbal"))).otherwise(tidy)
    docs = table(spark, folder, "customer").withColumn("raw", raw)
    return mutations.needs_format(docs, tidy).agg(F.count("*").alias("n"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Complex filter, two sort keys, top 20."""
    return _QUERIES["sort_two_keys"](spark, folder)
