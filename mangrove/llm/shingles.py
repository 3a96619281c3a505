"""Near-duplicates by word shingles: documents whose sets of five-word shingles have a Jaccard similarity of at
least ``SIMILAR``.

The method is that of ``simhash``: 64-bit fingerprints, here of the sets of shingles, BK-trees in shards, a spanning
forest of each shard's links, components.  Sets at 0.8 differ in about 10 of 64 bits, too many to cut shards from
blocks of bits: a shard is what shares one of ``BANDS`` bands of ``ROWS`` MinHash values each.  A pair at a similarity
of exactly 0.8 shares none with a chance of (1 - 0.8 ** 4) ** 24, about 3 in a million, and is over ``RADIUS`` bits
apart with a chance of about 1 in a million where the sets have 5 shingles, the worst case; a closer one is missed
more rarely.  Links within the radius are then checked exactly on the texts.  Each different set of shingles enters
once; keys that bring the same sets together count once; a shard over GROUP_SETS is cut into blocks, every pair of
which meets in a tree of its own.

Cases: null and empty texts have one and the same shingle; texts of fewer words than a shingle count as one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import packed, tidy, written
from .components import connected_components

SHINGLE, SIMILAR, BANDS, ROWS, RADIUS = 5, 0.8, 24, 4, 28
GROUP_SETS = 512
SLICE = 4096
_rng = np.random.default_rng(20)
_MULTIPLY = _rng.integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """The sorted different shingle hashes of a text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    digest = xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return np.array([digest(b" ".join(words), 7)], dtype=np.uint64)
    grams = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE))))
    return np.unique(np.fromiter((digest(g, 7) for g in grams), dtype=np.uint64))


def minhashes(items: np.ndarray) -> np.ndarray:
    least = None
    for at in range(0, len(items), SLICE):
        part = (items[at : at + SLICE] * _MULTIPLY + _ADD).min(axis=1)
        least = part if least is None else np.minimum(least, part)
    return least


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Jaccard similarity of at least SIMILAR, in whole numbers."""
    small, large = sorted((len(a), len(b)))
    if small * 5 < large * 4:
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared * 5 >= 4 * (small + large - shared)


@tidy
def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, place, text) -> (doc_id, place, digest of the set, its SimHash fingerprint, its band keys)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        digests, prints, keys = [], [], []
        for text in batch.column("text"):
            items = shingles(text.as_py())
            digests.append(xxhash.xxh64_intdigest(items.tobytes()))
            prints.append(simhash.fingerprint_of(items))
            rows = minhashes(items).reshape(BANDS, ROWS)
            keys.append([xxhash.xxh64_intdigest(r.tobytes(), i) for i, r in enumerate(rows)])
        signed = lambda x: np.array(x, dtype=np.uint64).view(np.int64)
        bands = pa.FixedSizeListArray.from_arrays(pa.array(signed(keys).reshape(-1)), BANDS).cast(pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("place"), pa.array(signed(digests)), pa.array(prints, pa.int64()), bands], ["doc_id", "place", "fp", "print", "bands"])


def forest(sets: dict[int, tuple[int, np.ndarray]], radius: int = RADIUS) -> list[tuple[int, int]]:
    """Edges of a spanning forest of all similar sets whose fingerprints are within the radius; ``sets`` holds the
    fingerprint and the shingles of each."""
    tree, names, root, edges = simhash.BKTree(radius), list(sets), [], []

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for own, (value, items) in enumerate(sets.values()):
        root.append(own)
        for k in tree.add(value & (1 << 64) - 1):
            a, b = top(own), top(k)
            if a != b and similar(sets[names[k]][1], items):
                root[max(a, b)] = min(a, b)
                edges.append((names[own], names[k]))
    return edges


@tidy
def _search(batches):
    """Rows (group, part, fp, print, text) sorted by group and part -> forest edges (a, b) of each part's tree."""
    held: dict[int, tuple[int, np.ndarray]] = {}
    at = None

    def out():
        found = forest(held) if len(held) > 1 else []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    for batch in batches:
        for group, part, fp, value, text in zip(*(batch.column(i) for i in range(5))):
            key = group.as_py(), part.as_py()
            if key != at:
                yield from out()
                held, at = {}, key
            held[fp.as_py()] = value.as_py(), shingles(text.as_py())
    yield from out()


def similar_sets(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """Edges (a, b) between set digests; ``sets``: each digest once, with its fingerprint (print), its bands and the
    hash of a text (place)."""
    rows = sets.select(F.posexplode("bands").alias("band", "key"), "fp")
    # a key is told by the number and sum of the sets it brings together, so that equal groups fold into one
    met = rows.groupBy("band", "key").agg(F.count("*").alias("n"), F.sum(F.xxhash64("fp").cast("decimal(38,0)")).alias("total"))
    met = written(met.where("n > 1").withColumn("group", F.xxhash64("n", "total")), "shingle-keys")
    kept = met.groupBy("group").agg(F.min(F.struct("band", "key", "n")).alias("k")).select("k.band", "k.key", "group", F.ceil(2 * F.col("k.n") / F.lit(GROUP_SETS)).cast("int").alias("cuts"))
    pairs = written(rows.join(kept, ["band", "key"]).select("group", "cuts", "fp"), "shingle-groups")
    own = F.pmod(F.xxhash64("fp"), F.col("cuts")).cast("int")
    pair = lambda j: F.greatest(own, j).cast("long") * F.col("cuts") + F.least(own, j)
    parts = F.when(F.col("cuts") <= 2, F.array(F.lit(-1).cast("long"))).otherwise(F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), pair))
    pairs = pairs.select("group", F.explode(parts).alias("part"), "fp")
    wanted = sets.join(pairs.select("fp").distinct(), "fp", "left_semi").select("fp", "print", "place")
    texts = docs.select(F.xxhash64("text").alias("place"), "text").join(wanted, "place")
    texts = written(texts.groupBy("fp", "print", "text").agg(F.count("*")).select("fp", "print", "text"), "shingle-texts")
    rows = pairs.join(texts, "fp").select("group", "part", "fp", "print", "text")
    return rows.repartition("group", "part").sortWithinPartitions("group", "part").mapInArrow(_search, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, place, fp, root, component_id): place is the text's hash, fp the digest of its shingles, root the
    group's name, component_id the smallest doc_id of the group."""
    prints = written(docs.select("doc_id", F.xxhash64("text").alias("place"), "text").mapInArrow(_sets, "doc_id long, place long, fp long, print long, bands array<long>"), "shingle-sets")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.min("place").alias("place"), F.first("print").alias("print"), F.first("bands").alias("bands")), "shingle-distinct")
    groups = connected_components(similar_sets(docs, distinct))
    named = distinct.join(groups, distinct["fp"] == groups["node"], "left")
    named = written(named.select("fp", "least", F.coalesce("component", "fp").alias("root")), "shingle-roots")
    least = written(named.groupBy("root").agg(F.min("least").alias("component_id")), "shingle-roots-least")
    return prints.join(named.join(least, "root").select("fp", "root", "component_id"), "fp").select("doc_id", "place", "fp", "root", "component_id")


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group: of the smallest doc_id (null last), at equal ids of the smallest text hash,
    of rows equal in both any, as their texts are equal.

    The winner is chosen by (doc_id, text hash) in a map-side aggregate, so a doc_id on rows of different texts is
    judged text by text, and rows without doc_id like others."""
    same = near_duplicates(docs).groupBy("root", "doc_id", "place").agg(F.count("*").alias("n"))
    stays = same.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "place", "n")).alias("s"))
    stays = written(stays.select(F.col("s.doc_id").alias("_d"), F.col("s.place").alias("_p"), F.col("s.n").alias("_n")), "near-stays")
    rows = packed(docs, doc_id=F.col("doc_id"), place=F.xxhash64("text"))
    rows = rows.join(stays, rows["doc_id"].eqNullSafe(stays["_d"]) & (rows["place"] == stays["_p"]))
    if stays.where("_n > 1").isEmpty():
        return rows.select("_row.*")
    one = rows.where("_n > 1").groupBy("doc_id", "place").agg(F.first("_row").alias("_row"))
    return rows.where("_n = 1").select("_row.*").unionByName(one.select("_row.*"))
