"""Exact deduplication through an extendible-hash index in the shared folder (DataFrame operations only).

A text's key is its 64-bit xxHash, and the directory maps the first bits of a key to a bucket.  It starts at
MIN_DEPTH bits; the buckets that are over capacity are split by doubling it, one bit a round, until all fit or hold
one key only; buckets that fit keep their shorter prefix (local depth).  A bucket's load is its number of different
(key, length, digest) entries, so a text repeated in a third of all rows does not force splits.

The index files are dealt by ranges of the buckets, so each owner task holds whole buckets, sorted by bucket and
key.  Rows are combined map-side, so a very common text brings an owner one entry a task.  An owner chains the
entries of a key, which differ in length or SHA-256 and so in bytes.  That the rows of one entry are the same bytes
is checked on the texts: only those of entries met more than once, combined map-side into the least and greatest.

Documents find their entry through the directory: first bits, bucket, key, and place in the key's chain.

Cases: null counts as the empty text; the row with the largest doc_id stays; null doc_ids never stay beside a
non-null one, and in a group of null doc_ids only, all are marked kept; rows that repeat doc_id and text cannot be
told apart, and all of them are the row with the largest doc_id, so all are marked kept; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of, written

#: Different entries a bucket holds; the directory's first and greatest number of bits (the key's).
CAPACITY, MIN_DEPTH, MAX_DEPTH = 1 << 16, 4, 64
#: A directory up to this many buckets is broadcast for the lookup, and so are up to as many keys whose texts are to be
#: compared; more are joined by shuffle.
BROADCAST_BUCKETS, BROADCAST_KEYS = 50_000, 500_000


def _prefix(key, depth) -> F.Column:
    """The first ``depth`` bits of a key."""
    return F.expr(f"shiftrightunsigned({key}, 64 - {depth})")


def directory(keys: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``keys`` (key) of all different entries -> (local_depth, prefix, entries), one row a bucket.

    Doubling goes one bit a round and only with what is still over capacity; a bucket of one key cannot be split."""
    counts = written(keys.groupBy("key").agg(F.count("*").alias("n")), "dedup-keys")
    open_, done = counts, None
    for depth in range(MIN_DEPTH, MAX_DEPTH + 1):
        held = open_.groupBy(_prefix("key", depth).alias("prefix")).agg(F.sum("n").alias("entries"), F.count("*").alias("keys"))
        held = written(held.withColumn("fits", (F.col("entries") <= capacity) | (F.col("keys") == 1) | F.lit(depth == MAX_DEPTH)), "dedup-directory")
        fits = held.where("fits").select(F.lit(depth).alias("local_depth"), "prefix", "entries")
        done = fits if done is None else done.unionByName(fits)
        over = held.where("NOT fits")
        n_over = over.count()
        if not n_over:
            break
        over = over.select("prefix")
        over = F.broadcast(over) if n_over <= BROADCAST_BUCKETS else over
        open_ = open_.withColumn("prefix", _prefix("key", depth)).join(over, "prefix", "left_semi").select("key", "n")
    return written(done, "dedup-buckets")


def _bucketed(rows: DataFrame, buckets: DataFrame) -> DataFrame:
    """``rows`` with a key by the directory: its entry is looked up at each local depth in use."""
    depths = sorted(r[0] for r in buckets.select("local_depth").distinct().collect())  # 61 at most
    named = buckets.select(F.col("local_depth").alias("_depth"), F.col("prefix").alias("_prefix"))
    named = F.broadcast(named) if buckets.count() <= BROADCAST_BUCKETS else named
    if len(depths) <= 1:  # none without rows
        depth = depths[0] if depths else MIN_DEPTH
        return rows.withColumn("local_depth", F.lit(depth)).withColumn("prefix", _prefix("key", depth))
    tries = F.array(*[F.struct(F.lit(d).alias("local_depth"), _prefix("key", d).alias("prefix")) for d in depths])
    out = rows.withColumn("_try", F.explode(tries)).select(*rows.columns, "_try.*")
    # of the prefixes of a key one only names a bucket
    return out.join(named, (F.col("local_depth") == F.col("_depth")) & (F.col("prefix") == F.col("_prefix"))).drop("_depth", "_prefix")


def build_index(docs: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, DataFrame]:
    """(buckets, index): the directory, and the index files: local_depth, prefix, key, bytes, sha, chain (place in
    the key's chain), keep_id, group_size."""
    text = text_of()
    rows = docs.select("doc_id", _key(text).alias("key"), F.octet_length(text).cast("long").alias("bytes"), F.sha2(text, 256).alias("sha"))
    entries = rows.groupBy("key", "bytes", "sha").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    entries = written(entries, "dedup-entries")
    buckets = directory(entries.select("key"), capacity)
    # a key's chain: entries of one key in the order of length and digest, so each has a place
    order = F.array_sort(F.collect_list(F.struct("bytes", "sha", "keep_id", "group_size")))
    chained = entries.groupBy("key").agg(order.alias("chain"))
    chained = chained.select("key", F.posexplode("chain").alias("chain", "e")).select("key", "chain", "e.*")
    index = _bucketed(chained, buckets)
    index = index.repartitionByRange(F.expr("shiftleft(prefix, 64 - local_depth)")).sortWithinPartitions("local_depth", "prefix", "key", "chain")
    return buckets, written(index, "dedup-index")


def _key(text) -> F.Column:
    return F.xxhash64(text)


def differing_texts(docs: DataFrame, index: DataFrame) -> DataFrame:
    """Entries (key, bytes, sha) of several rows whose texts are not all the same bytes: none, unless SHA-256 collides.

    The texts of an entry are combined map-side into the least and the greatest, so no group meets in one task."""
    text = text_of()
    met = index.where("group_size > 1").select("key", "bytes", "sha")
    keys = met.select("key").distinct()
    keys = F.broadcast(keys) if met.count() <= BROADCAST_KEYS else keys
    rows = docs.select(_key(text).alias("key"), F.octet_length(text).cast("long").alias("bytes"), F.sha2(text, 256).alias("sha"), text.alias("text"))
    ends = rows.join(keys, "key", "left_semi").groupBy("key", "bytes", "sha").agg(F.min("text").alias("a"), F.max("text").alias("b"))
    return ends.where("a <> b").select("key", "bytes", "sha")


def exact_duplicates(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row."""
    buckets, index = build_index(docs, capacity)
    if not differing_texts(docs, index).isEmpty():
        raise RuntimeError("different texts share hash, length and digest")
    text = text_of()
    rows = docs.select("doc_id", _key(text).alias("key"), F.octet_length(text).cast("long").alias("bytes"), F.sha2(text, 256).alias("sha"))
    out = _bucketed(rows, buckets).join(index, ["local_depth", "prefix", "key", "bytes", "sha"])
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def op5_query(docs: DataFrame) -> DataFrame:
    return exact_duplicates(docs)


SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
