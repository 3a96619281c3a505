"""SimHash near-duplicates: 64-bit fingerprints linked at few differing bits, found with BK-trees.

Fingerprints are spread over shards so that any two within the radius share at least one shard: 64 bits are cut
into ``radius + picked`` blocks, and ``picked`` blocks together are a shard's key (at most ``radius`` blocks can
differ).  Each shard builds a BK-tree (children keyed by integer distance to the parent) and follows only edges
within the radius; it passes on a spanning forest of its links, never all pairs.  Trees hold at most TREE_NODES
fingerprints: a larger shard is cut into sub-shards, and every pair of them meets in a task of its own.
Trees travel by shuffle rather than by a driver broadcast, as fingerprints of all documents may never pass
through the driver.

Cases: null and empty texts have fingerprint zero and are linked like any other; texts of fewer words than a
shingle count as one shingle; equal texts and repeated rows share a fingerprint; a group whose doc_ids are all
null has a null component; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import tidy, written
from .components import connected_components

SHINGLE, SEED, RADIUS = 4, 42, 4
TREE_NODES = 2048
SLICE = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of one text; bit set where over half of the shingle hashes have it."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII case and white space only
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    ones, n = np.zeros(64, dtype=np.int64), max(1, len(words) - shingle + 1)
    for at in range(0, n, SLICE):
        part = words[at : at + SLICE + shingle - 1] if n > 1 else words
        if n > 1:
            grams = map(b" ".join, zip(*(part[i:] for i in range(shingle))))
        else:
            grams = [b" ".join(part)]
        ones += _ones(np.array([digest(g, SEED) for g in grams], dtype="<u8"))
    return _over_half(ones, n)


def fingerprint_of(hashes: np.ndarray) -> int:
    """Signed 64-bit SimHash of some hashes."""
    parts = (_ones(hashes[at : at + SLICE]) for at in range(0, len(hashes), SLICE))
    return _over_half(sum(parts, np.zeros(64, dtype=np.int64)), len(hashes))


def _ones(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def _over_half(ones: np.ndarray, n: int) -> int:
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


@tidy
def _prints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        yield pa.array([fingerprint(x.as_py()) for x in texts], pa.int64())


_fingerprints = F.arrow_udf(_prints, LongType())


class BKTree:
    """Nodes in parallel lists; ``children[i]`` maps a distance to the child at it."""

    def __init__(self, radius: int):
        self.radius, self.values, self.children = radius, [], []

    def add(self, value: int) -> list[int]:
        """Inserts ``value`` and returns the nodes within the radius that were there before."""
        found, own = [], len(self.values)
        if own:
            at, todo, radius, values, children = 0, [0], self.radius, self.values, self.children
            while todo:
                k = todo.pop()
                d = (values[k] ^ value).bit_count()
                if d <= radius:
                    found.append(k)
                kids = children[k]
                if kids:
                    todo += [c for e, c in kids.items() if d - radius <= e <= d + radius]
            while True:
                d = (values[at] ^ value).bit_count()
                if (following := children[at].get(d)) is None:
                    children[at][d] = own
                    break
                at = following
        self.values.append(value)
        self.children.append({})
        return found


def forest(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Edges (value, value) of a spanning forest of all links within the radius."""
    tree, root, edges = BKTree(radius), [], []

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for own, value in enumerate(values):
        root.append(own)
        for k in tree.add(value):
            a, b = top(own), top(k)
            if a != b:
                root[max(a, b)] = min(a, b)
                edges.append((value, tree.values[k]))
    return edges


def _blocks(radius: int, picked: int) -> list[tuple[int, int]]:
    """(shift, width) of the blocks of 64 bits."""
    n = radius + picked
    ends = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:])]


def _picked(n: int, radius: int) -> int:
    """Blocks in a shard key, so that a shard of evenly spread fingerprints holds a few."""
    for picked in range(1, 5):
        if n * 4 <= 2 ** (64 * picked // (radius + picked)):
            return picked
    return 5


def _search(radius: int):
    """Rows (shard, part, fp) sorted by shard -> forest edges of each shard; only one shard is held at a time."""

    @tidy
    def run(batches):
        kept: list[np.ndarray] = []
        for batch in batches:
            rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
            rows = np.concatenate([*kept, rows], axis=1) if kept else rows
            if not rows.shape[1]:
                continue
            starts = np.flatnonzero(np.r_[True, (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])])
            kept = [rows[:, starts[-1] :]]
            yield from edges(rows, starts, starts[1:])
        if kept:
            yield from edges(kept[0], np.array([0]), np.array([kept[0].shape[1]]))

    def edges(rows, starts, ends):
        starts = starts[: len(ends)]
        several = ends - starts > 1
        found = []
        for i, j in zip(starts[several], ends[several]):
            found += forest([x & (2**64 - 1) for x in np.unique(rows[2, i:j]).tolist()], radius)
        if found:
            ab = np.array(found, dtype=np.uint64).view(np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(ab[:, 0]), pa.array(ab[:, 1])], ["a", "b"])

    return run


def link_fingerprints(distinct: DataFrame, radius: int = RADIUS, picked: int | None = None, tree_nodes: int = TREE_NODES) -> DataFrame:
    """``distinct`` (fp long, each once) -> edges (a, b) whose components are those of all links within ``radius``."""
    picked = picked or _picked(distinct.count(), radius)
    keys = []
    for k, blocks in enumerate(combinations(_blocks(radius, picked), picked)):
        parts = [F.shiftrightunsigned("fp", s).bitwiseAND(F.lit((1 << w) - 1)) for s, w in blocks]
        keys.append(F.xxhash64(F.lit(k), *parts))
    rows = distinct.select(F.explode(F.array(*keys)).alias("shard"), "fp")
    large = rows.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > tree_nodes)
    large = written(large.select("shard", F.ceil(F.col("n") / F.lit(tree_nodes // 2)).cast("int").alias("cuts")), "bk-large")
    if large.isEmpty():
        rows = rows.select("shard", F.lit(0).cast("long").alias("part"), "fp")
    else:
        rows = rows.join(large, "shard", "left")
        own = F.pmod(F.xxhash64("fp"), F.col("cuts")).cast("int")
        # sub-shard i meets every j: its rows go to the part of each unordered pair {i, j}
        pair = lambda j: (F.greatest(own, j).cast("long") * F.col("cuts") + F.least(own, j))
        parts = F.when(F.col("cuts").isNull(), F.array(F.lit(-1).cast("long"))).otherwise(F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), pair))
        rows = rows.select("shard", F.explode(parts).alias("part"), "fp")
    rows = rows.repartition("shard", "part").sortWithinPartitions("shard", "part")
    return rows.mapInArrow(_search(radius), "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable over links, itself included."""
    prints = written(docs.select("doc_id", _fingerprints("text").alias("fp")), "simhash")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    groups = connected_components(link_fingerprints(distinct.select("fp"), radius))
    named = distinct.join(groups, distinct["fp"] == groups["node"], "left")
    named = written(named.select("fp", "least", F.coalesce("component", "fp").alias("root")), "simhash-roots")
    least = written(named.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-groups")
    names = named.join(least, "root").select("fp", "component_id")
    return prints.join(names, "fp").select("doc_id", "fp", "component_id")


def op2_query(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
