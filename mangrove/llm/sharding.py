"""Sharding by a Feistel permutation with cycle walking over global row numbers (DataFrame operations only).

Rows get global numbers 0..N-1 in the order of a hash of doc_id: counts of 4,096 hash buckets give each bucket
its offset, and rows are numbered inside their bucket, so no task sees all rows.  The number, written as
L * b + R with L < a and R < b (a * b the smallest near-square product not under N), runs through ROUNDS of
alternating modular additions, a permutation of 0..a*b-1; numbers at or over N walk on along their cycle.  The
place p gives shard p mod S and slot p div S: law ``rows``, counts at most one apart, slots gapless, and the
place of a row is computed from its number, N and the seed alone.

Cases: null text has 0 bytes and the checksum of an empty one; rows equal in doc_id and text are
interchangeable; null doc_ids hash like an empty one; fewer rows than shards leave shards empty; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_of, written

SHARDS, ROUNDS, SEED = 40, 4, 20_177
BUCKETS = 4096
#: Rounds mix with two squarings modulo the prime 2^31 - 1; products stay below 2^62.
PRIME = 2_147_483_647


def _mix(x: Column, round_: int) -> Column:
    y = (F.pmod(x, F.lit(PRIME)) * (SEED + 7_919 * round_) + 104_729 * (round_ + 1)) % PRIME
    return ((y * y) % PRIME * 48_271 + y) % PRIME


def _round(k: int, a: Column, b: Column):
    """Round ``k`` on a struct (l, r); each part is named by one lambda, so it is computed once."""
    if k % 2:
        return lambda p: F.struct(p["l"].alias("l"), F.pmod(p["r"] + _mix(p["l"], k), b).alias("r"))
    return lambda p: F.struct(F.pmod(p["l"] + _mix(p["r"], k), a).alias("l"), p["r"].alias("r"))


def _permute(x: Column, a: Column, b: Column) -> Column:
    """One pass of the generalised Feistel network on 0..a*b-1, as one expression."""
    pair = F.struct(F.floor(x / b).cast("long").alias("l"), F.pmod(x, b).alias("r"))
    for k in range(ROUNDS):
        pair = F.transform(F.array(pair), _round(k, a, b))[0]
    return F.transform(F.array(pair), lambda p: p["l"] * b + p["r"])[0]


def numbered(rows: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """Adds row_number (0..N-1) and n_rows: rows ordered by the 32 hex digits of ``key``, then ``order``."""
    rows = rows.withColumn("_h", F.md5(key.cast("binary"))).withColumn("_b", F.conv(F.substring("_h", 1, 3), 16, 10).cast("int"))
    counts = rows.groupBy("_b").agg(F.count("*").alias("_n"))  # at most BUCKETS rows, so its size is proven
    before = F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("_b", F.coalesce(before, F.lit(0)).alias("_from"), F.sum("_n").over(Window.partitionBy()).alias("n_rows"))
    inside = F.row_number().over(Window.partitionBy("_b").orderBy("_h", *order))
    rows = rows.join(F.broadcast(offsets), "_b")
    return rows.withColumn("row_number", (F.col("_from") + inside - 1).cast("long")).drop("_h", "_b", "_from")


def place(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Adds shard and slot to rows with row_number and n_rows."""
    n = F.col("n_rows")
    a = F.greatest(F.ceil(F.sqrt(n.cast("double"))), F.lit(1)).cast("long")
    rows = rows.withColumn("_a", a).withColumn("_b", F.ceil(n / F.col("_a")).cast("long"))
    rows = rows.withColumn("_p", _permute(F.col("row_number"), F.col("_a"), F.col("_b")))
    # at most a*b - N numbers lie outside, so that many further steps always end the walk
    excess = (F.col("_a") * F.col("_b") - n).cast("int")
    walk = F.aggregate(F.sequence(F.lit(0), excess), F.col("_p"), lambda p, _: F.when(p < n, p).otherwise(_permute(p, F.col("_a"), F.col("_b"))))
    rows = rows.withColumn("_p", F.when(F.col("_p") < n, F.col("_p")).otherwise(walk))
    return rows.withColumn("shard", (F.col("_p") % shards).cast("int")).withColumn("slot", F.floor(F.col("_p") / shards).cast("long")).drop("_a", "_b", "_p")


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, row_number, n_rows, shard, slot of every document."""
    text = text_of().cast("binary")
    slim = written(docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32")), "shard-rows")
    slim = numbered(slim, F.coalesce(F.col("doc_id").cast("string"), F.lit("")), [F.col("doc_id"), F.col("size"), F.col("text_crc32")])
    return place(slim, shards)


def op4_query(docs: DataFrame) -> DataFrame:
    out = shard_documents(docs).withColumn("law", F.lit("rows")).withColumn("grown_shard", F.lit(None).cast("int"))
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def sql(shards: int = SHARDS) -> str:
    """The query as DuckDB SQL.  CRC-32 is folded over the text's bytes with a table made by its rule."""
    table = "list_transform(range(256), lambda i: list_reduce(list_prepend(CAST(i AS BIGINT), CAST(range(8) AS BIGINT[])), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"

    def mix(x: str, k: int) -> str:
        y = f"((({x}) % {PRIME}) * {SEED + 7_919 * k} + {104_729 * (k + 1)}) % {PRIME}"
        return f"(((({y}) * ({y})) % {PRIME} * 48271 + ({y})) % {PRIME})"

    def permuted(source: str) -> str:
        inner = f"SELECT *, p // b AS l, p % b AS r FROM {source}"
        for k in range(ROUNDS):
            new = f"l, (r + {mix('l', k)}) % b AS r" if k % 2 else f"(l + {mix('r', k)}) % a AS l, r"
            inner = f"SELECT * EXCLUDE (l, r), {new} FROM ({inner})"
        return f"SELECT * EXCLUDE (l, r, p), l * b + r AS p FROM ({inner})"

    return f"""
WITH RECURSIVE t AS (SELECT {table} AS t),
c AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) + 16 AS BIGINT) AS size, hex(coalesce(text, '')) AS h, coalesce(CAST(doc_id AS VARCHAR), '') AS key FROM documents),
e AS (SELECT doc_id, size, key, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(h), 2), lambda i: CAST('0x' || substr(h, i, 2) AS BIGINT))),
             lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32 FROM c, t),
n AS (SELECT *, row_number() OVER (ORDER BY md5(key), doc_id NULLS FIRST, size, text_crc32) - 1 AS p, count(*) OVER () AS n FROM e),
s AS (SELECT *, CAST(greatest(ceil(sqrt(n)), 1) AS BIGINT) AS a FROM n),
z AS (SELECT *, CAST(ceil(n / a) AS BIGINT) AS b FROM s),
w AS ({permuted("z")} UNION ALL SELECT * FROM ({permuted("(SELECT * FROM w WHERE p >= n)")}))
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(p % {shards} AS INT) AS shard, p // {shards} AS slot, CAST(NULL AS INT) AS grown_shard FROM w WHERE p < n"""
