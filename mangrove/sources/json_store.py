"""Folders of JSON documents: <root>/<type>/<id>.json, with markdown side files in <type>/<id>/.

Types are listed first and each is read with its own glob, so folders starting with ``_`` or ``.`` and side
files never show up as documents.  Parsing, digests and joins are DataFrame work; only listing is driver work.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import DocumentReadError, MarkdownIntegrityError, MarkdownMissingError
from ..functions.names import validate_name, validate_type_name
from ..operators.collections import Catalog, Collection
from ..operators.mutations import sidecars

RAW = "type string, id string, raw string, path string, bytes long, modified timestamp"


def _listed(folder: str) -> list[tuple[str, bool]]:
    """(name, is a folder) of what a folder holds, in order; links are left out, an absent folder holds nothing.
    Folders with a scheme (``hdfs://...``) are listed by Spark's file systems, others locally."""
    if "://" in folder:
        context = SparkSession.active().sparkContext
        where = context._jvm.org.apache.hadoop.fs.Path(folder)
        files = where.getFileSystem(context._jsc.hadoopConfiguration())
        if not files.exists(where):
            return []
        return sorted((s.getPath().getName(), s.isDirectory()) for s in files.listStatus(where) if not s.isSymlink())
    base = Path(folder)
    if not base.is_dir():
        return []
    return sorted((p.name, p.is_dir()) for p in base.iterdir() if not p.is_symlink())


def list_types(root: str) -> list[str]:
    """Type folders in order; hidden ones, links and names that cannot be types are skipped."""
    out = []
    for name, folder in _listed(root):
        if folder and not name.startswith(("_", ".")):
            try:
                out.append(validate_type_name(name))
            except ValueError:
                continue
    return out


def list_files(folder: str, extension: str | None = None) -> list[str]:
    """Names of regular files in order; links are skipped and an absent folder is empty."""
    return [name for name, is_folder in _listed(folder) if not is_folder and (extension is None or name.endswith(extension))]


def list_ids(root: str, type_: str) -> list[str]:
    return [n.removesuffix(".json") for n in list_files(f"{root}/{type_}", ".json")]


def snapshot(spark: SparkSession, root: str, types: list[str] | None = None) -> DataFrame:
    """(type, id, raw, path, bytes, modified) of all documents of the given types (all by default)."""
    folders = [f"{root}/{t}" for t in (list_types(root) if types is None else types)]
    folders = [f for f in folders if list_files(f, ".json")]
    if not folders:
        return spark.createDataFrame([], RAW)
    rows = spark.read.text([f"{f}/*.json" for f in folders], wholetext=True)
    path = F.col("_metadata.file_path")
    rows = rows.select(F.col("value").alias("raw"), path.alias("path"), F.col("_metadata.file_size").alias("bytes"), F.col("_metadata.file_modification_time").alias("modified"))
    parts = F.split(F.url_decode(F.regexp_replace("path", r"\+", "%2B")), "/")
    return rows.select(F.element_at(parts, -2).alias("type"), F.regexp_replace(F.element_at(parts, -1), r"\.json$", "").alias("id"), F.ltrim("raw").alias("raw"), "path", "bytes", "modified")


def _text() -> Column:
    return F.regexp_replace("raw", "^﻿", "")


def read_documents(spark: SparkSession, root: str, types: list[str] | None = None, malformed: str = "fail") -> DataFrame:
    """(type, id, doc VARIANT).  Malformed documents make the query fail, are dropped (``drop``), or are kept
    with a null doc and an error (``keep``).  In ``fail`` mode type and id inside the document must agree with
    its place."""
    rows = snapshot(spark, root, types)
    if malformed == "fail":
        rows = rows.select("type", "id", F.parse_json(_text()).alias("doc"))
        agree = lambda k: F.try_variant_get("doc", f"$.{k}", "string") == F.col(k)
        wrong = F.concat(F.lit("document does not match its place: "), "type", F.lit("/"), "id")
        checked = F.when(F.coalesce(agree("type") & agree("id"), F.lit(False)), F.col("doc")).otherwise(F.raise_error(wrong).cast("variant"))
        return rows.withColumn("doc", checked)
    rows = rows.withColumn("doc", F.try_parse_json(_text()))
    if malformed == "drop":
        return rows.where(F.col("doc").isNotNull()).select("type", "id", "doc")
    if malformed != "keep":
        raise ValueError("malformed is 'fail', 'drop' or 'keep'")
    return rows.select("type", "id", "doc", F.when(F.col("doc").isNull(), "malformed JSON").alias("error"))


def collection(spark: SparkSession, root: str, type_: str, malformed: str = "fail", **how) -> Collection:
    return Collection(type_, read_documents(spark, root, [validate_name(type_, "type")], malformed), **how)


def catalog(spark: SparkSession, root: str, **how) -> Catalog:
    return Catalog([collection(spark, root, t, **how) for t in list_types(root)])


def read_text(path: str) -> str:
    try:
        return Path(path).read_text(encoding="utf-8")
    except (OSError, UnicodeDecodeError) as bad:
        raise DocumentReadError(f"{path}: {bad}") from bad


def markdown_files(spark: SparkSession, root: str, type_: str) -> DataFrame:
    """(type, id, path, content) of the side files of a type."""
    folders = [f"{root}/{type_}/{name}" for name, is_folder in _listed(f"{root}/{type_}") if is_folder and not name.startswith(("_", "."))]
    folders = [f for f in folders if list_files(f, ".md")]
    if not folders:
        return spark.createDataFrame([], "type string, id string, path string, content string")
    rows = spark.read.text([f"{f}/*.md" for f in folders], wholetext=True)
    parts = F.split(F.url_decode(F.col("_metadata.file_path")), "/")
    return rows.select(F.element_at(parts, -3).alias("type"), F.element_at(parts, -2).alias("id"), F.element_at(parts, -1).alias("path"), F.col("value").alias("content"))


def markdown_fields(documents: DataFrame) -> DataFrame:
    """(type, id, field, path, sha256) from ``md`` of documents (type, id, doc): a path or {path, sha256}."""
    entries = F.try_variant_get("doc", "$.md", "map<string,variant>")
    rows = documents.select("type", "id", F.explode(entries).alias("field", "v"))
    plain = F.schema_of_variant("v") == "STRING"
    path = F.when(plain, F.try_variant_get("v", "$", "string")).otherwise(F.try_variant_get("v", "$.path", "string"))
    return rows.select("type", "id", "field", F.regexp_replace(path, r"^\./", "").alias("path"), F.when(~plain, F.try_variant_get("v", "$.sha256", "string")).alias("sha256"))


def read_markdown(spark: SparkSession, root: str, type_: str, id_: str, field: str | None = None) -> dict[str, str]:
    """Markdown texts of one document by field; missing or altered files raise."""
    at = Path(root) / type_ / id_ / f"{id_}.json"
    raw = read_text(str(at if at.exists() else Path(root) / type_ / f"{id_}.json"))
    docs = spark.createDataFrame([(type_, id_, raw)], "type string, id string, raw string").select("type", "id", F.parse_json("raw").alias("doc"))
    rows = sidecars(markdown_fields(docs), markdown_files(spark, root, type_))
    out = {}
    for row in rows.collect():
        if field is None or row.field == field:
            if row.error == "E_MD_MISSING":
                raise MarkdownMissingError(f"{type_}/{id_} {row.field}: {row.path}")
            if row.error == "E_MD_SHA":
                raise MarkdownIntegrityError(f"{type_}/{id_} {row.field}: {row.path}")
            out[row.field] = row.content
    if field is not None and field not in out:
        raise MarkdownMissingError(f"{type_}/{id_} has no markdown field {field}")
    return out
