"""Materialized paths: codec, depth, checks, shard and sort keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .slugs import _STRICT

MAX_DEPTH, MAX_PATH = 32, 1024


def encode_path(*segments: Column) -> Column:
    return F.concat(F.lit("/"), F.concat_ws("/", *segments))


def child_path(parent: Column, slug: Column) -> Column:
    """Parent path and slug joined; without a parent (or under the root) the slug alone."""
    return F.concat(F.when(parent.isNull() | (parent == "/"), "").otherwise(parent), F.lit("/"), slug)


def decode_path(path: Column) -> Column:
    """Segments; none for the root."""
    return F.filter(F.split(path, "/"), lambda s: s != "")


def parent_path(path: Column) -> Column:
    """The path above, ``/`` above a single segment, NULL above the root."""
    above = F.array_join(F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(1))), "/")
    return F.when(path == "/", None).when(above == "", "/").otherwise(above)


def last_segment(path: Column) -> Column:
    return F.when(path == "/", None).otherwise(F.substring_index(path, "/", -1))


def depth(path: Column) -> Column:
    return F.when(path == "/", 0).otherwise(F.size(F.split(path, "/")) - 1)


def path_error(path: Column, max_depth: int = MAX_DEPTH) -> Column:
    """NULL for a good path, else what is wrong: start, end, slashes, traversal, segment, length or depth."""
    segments = F.slice(F.split(path, "/"), 2, MAX_PATH + 2)
    return (
        F.when(path.isNull() | (path == "") | ~path.startswith("/"), "start")
        .when((F.length(path) > 1) & path.endswith("/"), "end")
        .when(path.contains("//"), "slashes")
        .when(path.contains("/..") | path.contains("./"), "traversal")
        .when(F.exists(segments, lambda s: ~s.rlike(_STRICT) | (F.length(s) > 255)), "segment")
        .when(F.length(path) > MAX_PATH, "length")
        .when(depth(path) > max_depth, "depth")
    )


def shard_key(key: Column, fanout: int = 256) -> Column:
    """Struct (bucket, suffix) from the SHA-256 of the key."""
    digest = F.sha2(key, 256)
    bucket = F.conv(F.substring(digest, 1, 2), 16, 10).cast("int") % fanout
    return F.struct(F.lpad(F.lower(F.hex(bucket)), 2, "0").alias("bucket"), F.substring(digest, 3, 8).alias("suffix"))


def child_sort_key(type_: Column, slug: Column, id_: Column) -> Column:
    return F.concat_ws("|", type_, F.coalesce(slug, F.lit("")), id_)


def parse_sort_key(key: Column) -> Column:
    """Struct (type, slug, id); NULL unless there are three parts."""
    parts = F.split(key, r"\|", -1)
    return F.when(F.size(parts) == 3, F.struct(parts[0].alias("type"), parts[1].alias("slug"), parts[2].alias("id")))
