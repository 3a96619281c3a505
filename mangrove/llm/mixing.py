"""Mixing sources to target weights by hash-threshold histograms (DataFrame operations only).

Every document gets a 56-bit hash of its id.  A source whose target is ``full`` whole passes and a rest takes
each document ``full`` times and those below a hash threshold once more.  The threshold comes from histograms:
words are summed by source and hash bucket (256 a level), the bucket in which the running sum passes the rest
is found, and only that bucket is split again by the next eight bits, until it holds one hash.  Documents are
never sorted, and no source's rows meet in one task: a level passes on at most 256 sums a source.

Cases: null or empty text has size 0 and is taken 0 words; a null source is a source of its own, last in
order; a null doc_id hashes like an empty one; rows with equal doc_id in a source share a hash and are taken
together; an empty table gives an empty result; extra columns are ignored by ``plan_mix`` and kept by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import attach, packed, word_count, written

HEX_DIGITS, LEVEL_BITS = 14, 8
HASH_BITS = 4 * HEX_DIGITS


def _hash(doc_id: F.Column) -> F.Column:
    digits = F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, HEX_DIGITS)
    return F.conv(digits, 16, 10).cast("long")


def source_targets(totals: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``totals`` (source, source_size) with ``target``: ``share`` of all words dealt by weight, no target over
    ``cap`` times its source, the excess dealt again by weight.  That rule's fixed point is a common level:
    target = min(cap * size, level * weight).  One row per source passes through the global windows."""
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_w"), "_rank").rowsBetween(Window.unboundedPreceding, -1)
    out = totals.withColumn("_rank", F.row_number().over(by_name))
    out = out.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("_rank") - 1) % len(weights) + 1).cast("int")))
    out = out.withColumn("_cap", F.lit(float(cap)) * F.col("source_size"))
    capped = F.coalesce(F.sum("_cap").over(by_ratio), F.lit(0.0))
    used = F.coalesce(F.sum("_w").over(by_ratio), F.lit(0.0))
    budget = F.lit(float(share)) * F.sum("source_size").over(everything)
    out = out.withColumn("_level", (budget - capped) / (F.sum("_w").over(everything) - used))
    out = out.withColumn("_level", F.max(F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.col("_level"))).over(everything))
    target = F.when(F.col("_level").isNull(), F.col("_cap")).otherwise(F.least("_cap", F.col("_level") * F.col("_w")))
    return out.select("source", "source_size", target.alias("target"))


def _thresholds(slim: DataFrame, quotas: DataFrame, n_sources: int) -> DataFrame:
    """(source, ..., full, limit): documents with hash below ``limit`` are taken once more."""
    state = quotas.withColumn("lo", F.lit(0).cast("long")).withColumn("need", F.col("rest"))
    for level in range(1, HASH_BITS // LEVEL_BITS + 1):
        shift = HASH_BITS - LEVEL_BITS * level
        width = F.shiftleft(F.lit(1).cast("long"), shift + LEVEL_BITS)
        inside = attach(slim, state.select("source", "lo", "need"), "source", F.col("h"), n_sources)
        inside = inside.where((F.col("h") >= F.col("lo")) & (F.col("h") < F.col("lo") + width) & (F.col("need") > 0))
        sums = inside.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(
            F.sum("size").alias("words"), F.min("h").alias("h0"), F.max("h").alias("h1"), F.first("need").alias("need"))
        run = Window.partitionBy("source").orderBy("bucket")
        sums = sums.withColumn("upto", F.sum("words").over(run))
        edge = sums.where(F.col("upto") > F.col("need")).groupBy("source").agg(
            F.min_by(F.struct("bucket", "words", "upto", "h0", "h1"), "bucket").alias("e"))
        edge = edge.select("source", "e.*").withColumnRenamed("source", "_s")
        state = state.drop("words", "h0", "h1").join(edge, state["source"].eqNullSafe(edge["_s"]), "left").drop("_s")
        below = F.col("upto") - F.col("words")
        state = state.select(
            "source", "source_size", "target", "full", "rest",
            F.when(F.col("bucket").isNull(), F.col("lo")).otherwise(F.shiftleft("bucket", shift)).alias("lo"),
            F.when(F.col("bucket").isNull(), F.col("need")).otherwise(F.col("need") - below).alias("need"),
            F.when(F.col("bucket").isNull(), F.lit(0)).otherwise(F.col("words")).alias("words"),
            F.col("h0"), F.col("h1"))
        state = written(state, "mix-state")
        if state.where(F.col("h0") < F.col("h1")).isEmpty():
            break
    # one hash (or equal hashes) is left at the edge: it goes to the side that is nearer
    limit = F.when(F.col("h0").isNull() | (F.col("need") <= 0), F.col("lo")).when(
        F.col("words") - F.col("need") < F.col("need"), F.col("h0") + 1).otherwise(F.col("h0"))
    return state.select("source", "source_size", "target", "full", limit.alias("limit"))


def plan_mix(docs: DataFrame, *, weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken."""
    slim = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _hash(F.col("doc_id")).alias("h")), "mix-sizes")
    totals = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    quotas = source_targets(totals, weights, share, cap)
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    quotas = quotas.withColumn("full", full).withColumn("rest", F.col("target") - F.col("full") * F.col("source_size"))
    quotas = written(quotas, "mix-quotas")
    n_sources = quotas.count()
    limits = _thresholds(slim, quotas, n_sources)
    out = attach(slim, limits, "source", F.col("h"), n_sources)
    copies = (F.col("full") + F.when(F.col("h") < F.col("limit"), 1).otherwise(0)).cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", "h", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "full", "limit")


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mixed corpus: each document as often as the mix takes it, all its columns kept."""
    plan = plan_mix(docs, **how)
    limits = plan.groupBy("source").agg(F.first("full").alias("_full"), F.first("limit").alias("_limit"))
    limits = written(limits, "mix-limits")
    rows = packed(docs, source=F.col("source"), _h=_hash(F.col("doc_id")))
    rows = attach(rows, limits, "source", F.col("_h"), limits.count())
    copies = (F.col("_full") + F.when(F.col("_h") < F.col("_limit"), 1).otherwise(0)).cast("int")
    rows = rows.withColumn("_copies", copies).where(F.col("_copies") > 0)
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_row.*")


def op1_query(docs: DataFrame) -> DataFrame:
    return plan_mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 14) AS h FROM documents),
t AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rk FROM d GROUP BY source),
w AS (SELECT *, CAST([3, 1, 2][CAST((rk - 1) % 3 + 1 AS INT)] AS DOUBLE) AS w, 2.0::DOUBLE * source_size AS cap FROM t),
l AS (SELECT *, (1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER q, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER q, 0)) AS lev
      FROM w WINDOW q AS (ORDER BY cap / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, max(CASE WHEN lev * w <= cap THEN lev END) OVER () AS lv FROM l),
q AS (SELECT source, source_size, CASE WHEN lv IS NULL THEN cap ELSE least(cap, lv * w) END AS target FROM g),
f AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS n FROM q),
c AS (SELECT d.doc_id, d.size, f.source_size, f.target, f.n, f.target - f.n * f.source_size AS rest,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h) AS upto,
             sum(d.size) OVER (PARTITION BY d.source, d.h) AS own
      FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source),
e AS (SELECT *, rest > 0 AND (upto <= rest OR (upto - own <= rest AND own - (rest - (upto - own)) < rest - (upto - own))) AS more FROM c)
SELECT doc_id, size, source_size, target, CAST(size * (n + CASE WHEN more THEN 1 ELSE 0 END) AS BIGINT) AS taken,
       CAST(n + CASE WHEN more THEN 1 ELSE 0 END AS BIGINT) AS copies FROM e
"""
