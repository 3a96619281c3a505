"""Hierarchies by materialized path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..functions.paths import MAX_DEPTH, child_path, depth, parent_path, path_error
from ..functions.slugs import is_slug
from .lineage import settled


def place_children(children: DataFrame, parents: DataFrame | None = None, parent_id: str = "parent_id", max_depth: int = MAX_DEPTH) -> DataFrame:
    """``children`` (id, slug, parent id) with path, depth and error; ``parents`` has (id, path).

    One level is one left join on the parent key; a parent id without a parent is an error."""
    if parents is None:
        out = children.withColumn("path", child_path(F.lit(None).cast("string"), F.col("slug")))
        return out.withColumn("depth", depth(F.col("path"))).withColumn("error", path_error(F.col("path"), max_depth))
    known = parents.select(F.col("id").alias("_parent"), F.col("path").alias("_above"))
    out = children.join(known, children[parent_id] == F.col("_parent"), "left")
    path = child_path(F.col("_above"), F.col("slug"))
    lost = F.col(parent_id).isNotNull() & F.col("_parent").isNull()
    out = out.withColumn("path", F.when(~lost, path)).withColumn("depth", depth(F.col("path")))
    return out.withColumn("error", F.when(lost, "parent").otherwise(path_error(F.col("path"), max_depth))).drop("_parent", "_above")


def place_tree(nodes: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Paths of a whole tree (id, slug, parent_id): level by level from the roots, one join a level.

    Nodes that no root reaches within ``max_depth`` levels (orphans, cycles) keep a null path."""
    level = nodes.where(F.col("parent_id").isNull()).select("id", F.concat(F.lit("/"), "slug").alias("path"))
    done, rest = level, nodes.where(F.col("parent_id").isNotNull())
    for _ in range(max_depth - 1):
        above = level.select(F.col("id").alias("parent_id"), F.col("path").alias("_above"))
        level = settled(rest.join(above, "parent_id").select("id", F.concat_ws("/", "_above", "slug").alias("path")))
        if level.isEmpty():
            break
        done = done.unionByName(level)
    return nodes.join(done, "id", "left").withColumn("depth", depth(F.col("path")))


def path_index(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(index, errors) from documents (type, id, path): good paths, and bad or repeatedly held ones."""
    rows = docs.where(F.col("path").isNotNull()).select("path", "type", "id", path_error(F.col("path")).alias("error"))
    holder = rows.where(F.col("error").isNull()).groupBy("path").agg(F.min(F.struct("type", "id")).alias("h"))
    index = holder.select("path", "h.type", "h.id")
    twice = rows.where(F.col("error").isNull()).join(index, ["path", "type", "id"], "left_anti").withColumn("error", F.lit("taken"))
    return index, rows.where(F.col("error").isNotNull()).unionByName(twice)


def find_by_path(index: DataFrame, path: str) -> DataFrame:
    return index.where(F.col("path") == path)


def get_by_path(index: DataFrame, scope: str, slug_path: str) -> DataFrame:
    """By scope and path below it; an upper-case scope is no slug and raises."""
    if not index.sparkSession.range(1).select(is_slug(F.lit(scope)).alias("ok")).first().ok:
        raise ValidationError(f"{scope!r} is no slug")
    return find_by_path(index, f"/{scope}/{slug_path.strip('/')}")


def documents_at(index: DataFrame, docs: DataFrame) -> DataFrame:
    """Documents joined to their paths."""
    return docs.join(index, ["type", "id"])


def repair(docs: DataFrame) -> DataFrame:
    """One row: documents scanned, paths rebuilt, errors."""
    index, errors = path_index(docs)
    parts = [docs.where(F.col("path").isNotNull()).select(F.lit("scanned").alias("what")), index.select(F.lit("rebuilt").alias("what")), errors.select(F.lit("errors").alias("what"))]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.agg(*[F.count(F.when(F.col("what") == name, 1)).alias(name) for name in ("scanned", "rebuilt", "errors")])


def list_children(index: DataFrame, parent: str, limit: int | None = None, after: str | None = None) -> DataFrame:
    """Direct children in path order, by pages: ``after`` is the last path of the page before."""
    out = index.where(parent_path(F.col("path")) == parent)
    if after is not None:
        out = out.where(F.col("path") > after)
    out = out.orderBy("path")
    return out if limit is None else out.limit(limit)
