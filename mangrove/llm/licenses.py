"""License scans by diagonal voting (DataFrame operations only).

All rolling word K-grams of every document are joined by hash to the positions of the same K-grams in the
templates, a fixed table of a few hundred rows that is broadcast.  A hit at document place p and template place
q votes for diagonal p - q.  Votes are counted by document, template and diagonal; diagonals at most ``slack``
apart, which a word put in or left out shifts, are merged; the merged span is verified by the share of the
template's K-grams it covers and by its place and length.  Base phrases are templates of two or three words
without slack that must be covered whole, so their spans are exactly the places of the phrase.

K-grams of stop words only carry no vote, in templates and documents alike.  A hit compares the words
themselves besides their hash.

Cases: null counts as empty; texts without a word give zero counts, null places, empty labels and score 0;
rows repeating doc_id and text get the same result each; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ascii_lower, text_of

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
K = 2
#: Least share of a template's K-grams that a span must cover, and its greatest length over the template's.
COVER, STRETCH, SLACK = 0.75, 1.5, 2

#: Fixed values: (label, phrase); found wherever the words stand consecutively.
BASE = (
    ("mit", "mit license"),
    ("apache", "apache license"),
    ("gpl", "general public license"),
)
#: Fixed values: (label, wording) of public licence notices.
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "released under the mit license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc", "licensed under a creative commons attribution license"),
)
STOP_WORDS = ("a", "and", "any", "are", "at", "by", "for", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "with", "you")


def templates(base=BASE, notices=NOTICES) -> list[tuple[int, str, bool, int, int, str, str, int]]:
    """Rows (template, label, base, words, place, word1, word2, grams) for every voting K-gram."""
    rows = []
    for t, (label, phrase) in enumerate([*base, *notices]):
        words = phrase.split()
        grams = [(i, a, b) for i, (a, b) in enumerate(zip(words, words[1:])) if not (a in STOP_WORDS and b in STOP_WORDS)]
        rows += [(t, label, t < len(base), len(words), i, a, b, len(grams)) for i, a, b in grams]
    return rows


def _template_frame(spark, rows) -> DataFrame:
    values = ", ".join(f"({t}, '{label}', {str(base).lower()}, {n}, {i}, '{a}', '{b}', {g})" for t, label, base, n, i, a, b, g in rows)
    out = spark.sql(f"SELECT * FROM VALUES {values} AS t(template, label, base, n_template, tpos, t1, t2, grams)")
    return out.withColumn("gram", F.xxhash64("t1", "t2"))


def words_of(text) -> F.Column:
    return F.array_remove(F.split(ascii_lower(text), SEPARATORS), "")


def spans(docs: DataFrame, base=BASE, notices=NOTICES) -> DataFrame:
    """Verified spans: doc_id, key (hash of the text), template, label, base, start, cover."""
    known = _template_frame(docs.sparkSession, templates(base, notices))
    rows = docs.select("doc_id", F.xxhash64(text_of()).alias("key"), words_of(text_of()).alias("w"))
    rows = rows.where(F.size("w") >= K)
    pairs = F.arrays_zip(F.col("w"), F.slice("w", 2, F.size("w") - 1).alias("n"))
    rows = rows.select("doc_id", "key", F.posexplode(pairs).alias("pos", "p")).select("doc_id", "key", "pos", F.col("p.w").alias("w1"), F.col("p.n").alias("w2"))
    rows = rows.withColumn("gram", F.xxhash64("w1", "w2"))
    hits = rows.join(F.broadcast(known), "gram").where("w1 = t1 AND w2 = t2")
    about = ["doc_id", "key", "template", "label", "base", "n_template", "grams"]
    votes = hits.groupBy(*about, (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(F.collect_set("tpos").alias("seen"))
    # a base phrase's diagonal with a vote missing is no place of it, and takes no part in merging
    votes = votes.where(~F.col("base") | (F.size("seen") == F.col("grams")))
    along = Window.partitionBy("doc_id", "key", "template").orderBy("diagonal")
    gap = F.col("diagonal") - F.lag("diagonal").over(along)
    fresh = F.when(gap.isNull() | F.col("base") | (gap > SLACK), 1).otherwise(0)
    votes = votes.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(along))
    merged = votes.groupBy(*about, "run").agg(
        F.array_distinct(F.flatten(F.collect_list("seen"))).alias("seen"), F.min("diagonal").alias("d0"), F.max("diagonal").alias("d1"))
    first, last = F.array_min("seen"), F.array_max("seen")
    merged = merged.withColumn("cover", F.size("seen") / F.col("grams"))
    merged = merged.withColumn("start", F.greatest(F.col("d0") + first, F.lit(0)).cast("long"))
    merged = merged.withColumn("length", F.col("d1") + last + K - F.col("start"))
    return merged.where((F.col("cover") >= COVER) & (F.col("length") <= STRETCH * F.col("n_template") + SLACK)).select(
        "doc_id", "key", "template", "label", "base", "start", "cover")


def scan_licenses(docs: DataFrame, base=BASE, notices=NOTICES) -> DataFrame:
    """One row per document: n_words, n_base, first_word, last_word, base_labels, labels, score, n_spans."""
    found = spans(docs, base, notices)
    own = F.when(F.col("base"), F.col("start"))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    found = found.groupBy("doc_id", "key").agg(
        F.count(own).alias("n_base"), F.min(own).alias("first_word"), F.max(own).alias("last_word"),
        joined(F.when(F.col("base"), F.col("label"))).alias("base_labels"), joined(F.col("label")).alias("labels"),
        F.max("cover").alias("score"), F.count("*").alias("n_spans"))
    found = found.withColumnsRenamed({"doc_id": "_d", "key": "_k"})
    rows = docs.select("doc_id", F.xxhash64(text_of()).alias("key"), F.size(words_of(text_of())).cast("long").alias("n_words"))
    out = rows.join(found, rows["doc_id"].eqNullSafe(found["_d"]) & (rows["key"] == found["_k"]), "left")
    zero = lambda c, v: F.coalesce(c, F.lit(v)).alias(c)
    return out.select("doc_id", "n_words", zero("n_base", 0), "first_word", "last_word", zero("base_labels", ""), zero("labels", ""), zero("score", 0.0), zero("n_spans", 0))


def op3_query(docs: DataFrame) -> DataFrame:
    out = scan_licenses(docs)
    return out.withColumn("n_base", F.col("n_base").cast("long")).withColumn("n_spans", F.col("n_spans").cast("long"))


def sql() -> str:
    """The query as DuckDB SQL: the same votes, merged and verified by window functions."""
    values = ", ".join(f"({t}, '{label}', {str(base).lower()}, {n}, {i}, '{a}', '{b}', {g})" for t, label, base, n, i, a, b, g in templates())
    return rf"""
WITH t(template, label, base, n_template, tpos, t1, t2, grams) AS (VALUES {values}),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORDS}') AS w FROM documents),
g AS (SELECT doc_id, i - 1 AS pos, w[i] AS w1, w[i + 1] AS w2 FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM d)),
v AS (SELECT doc_id, template, label, base, n_template, grams, pos - tpos AS diagonal, list(DISTINCT tpos) AS seen
      FROM g JOIN t ON w1 = t1 AND w2 = t2 GROUP BY ALL HAVING NOT base OR count(DISTINCT tpos) = grams),
r AS (SELECT *, CASE WHEN base OR coalesce(diagonal - lag(diagonal) OVER q > {SLACK}, true) THEN 1 ELSE 0 END AS fresh FROM v
      WINDOW q AS (PARTITION BY doc_id, template ORDER BY diagonal)),
u AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS run FROM r),
m AS (SELECT doc_id, template, label, base, n_template, grams, list_distinct(flatten(list(seen))) AS seen, min(diagonal) AS d0, max(diagonal) AS d1
      FROM u GROUP BY doc_id, template, label, base, n_template, grams, run),
c AS (SELECT *, len(seen) / grams AS cover, greatest(d0 + list_min(seen), 0) AS start, d1 + list_max(seen) + {K} AS stop FROM m),
s AS (SELECT doc_id, count(CASE WHEN base THEN 1 END) AS n_base, min(CASE WHEN base THEN start END) AS first_word, max(CASE WHEN base THEN start END) AS last_word,
             array_to_string(list_sort(list(DISTINCT label) FILTER (base)), ',') AS base_labels, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels,
             max(cover) AS score, count(*) AS n_spans
      FROM c WHERE cover >= {COVER} AND stop - start <= {STRETCH} * n_template + {SLACK} GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score, coalesce(n_spans, 0) AS n_spans
FROM d LEFT JOIN s ON d.doc_id = s.doc_id"""
