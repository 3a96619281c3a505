"""Writers: single documents, markdown side files, batches into document folders or partitioned Parquet.

Files are written beside their place and renamed, so readers see old or new content, never a part.
"""

from __future__ import annotations

import contextlib
import hashlib
import json
import os
import shutil
import subprocess
import tempfile
from collections.abc import Mapping
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import DocumentRemoveError, DocumentWriteError, FormatError, ValidationError
from ..functions.canonical import canonical_json, canonical_text, parse
from ..functions.names import normalize_markdown_path, validate_name
from .json_store import list_files, list_types, snapshot


def atomic_write(path: str | Path, content: str) -> None:
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, temporary = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    try:
        with os.fdopen(handle, "w", encoding="utf-8", newline="") as file:
            file.write(content)
            file.flush()
            os.fsync(file.fileno())
        os.replace(temporary, path)
    except OSError as bad:
        with contextlib.suppress(OSError):
            os.unlink(temporary)
        raise DocumentWriteError(f"{path}: {bad}") from bad


def check_document(type_: str, id_: str, doc: Any) -> dict[str, Any]:
    validate_name(type_, "type")
    validate_name(id_, "id")
    if not isinstance(doc, Mapping):
        raise ValidationError("a document must be an object")
    if doc.get("type") != type_ or doc.get("id") != id_:
        raise ValidationError(f"the document's type and id must be {type_!r} and {id_!r}")
    return dict(doc)


def put(root: str, type_: str, id_: str, doc: Mapping[str, Any], **how) -> bool:
    """Writes a document in canonical form; false if the file held just that."""
    text = canonical_text(check_document(type_, id_, doc), **how)
    path = Path(root) / type_ / f"{id_}.json"
    if path.is_file() and path.read_bytes() == text.encode():
        return False
    atomic_write(path, text)
    return True


def remove(root: str, type_: str, id_: str) -> bool:
    """Deletes a document; false if there was none."""
    validate_name(type_, "type")
    validate_name(id_, "id")
    try:
        (Path(root) / type_ / f"{id_}.json").unlink()
        return True
    except FileNotFoundError:
        return False
    except OSError as bad:
        raise DocumentRemoveError(f"{type_}/{id_}: {bad}") from bad


def put_with_markdown(root: str, type_: str, id_: str, doc: Mapping[str, Any], markdown: Mapping[str, str], integrity: bool = False) -> None:
    """Writes a document and the given markdown fields as one change: the folder is staged and swapped in.
    Side files of other fields stay."""
    doc = check_document(type_, id_, doc)
    folder, fields = Path(root) / type_ / id_, dict(doc.get("md") or {})
    stage = Path(tempfile.mkdtemp(dir=_made(folder.parent), prefix=f".{id_}."))
    try:
        if folder.is_dir():
            shutil.copytree(folder, stage, dirs_exist_ok=True)
        for name, text in markdown.items():
            entry = fields.get(name) or f"{name}.md"
            path = normalize_markdown_path(entry["path"] if isinstance(entry, Mapping) else entry)
            (stage / path).parent.mkdir(parents=True, exist_ok=True)
            (stage / path).write_text(text, encoding="utf-8")
            fields[name] = {"path": path, "sha256": hashlib.sha256(text.encode()).hexdigest()} if integrity or isinstance(entry, Mapping) else path
        (stage / f"{id_}.json").write_text(canonical_text({**doc, "md": fields}), encoding="utf-8")
        backup = folder.with_name(f".{id_}.old")
        if folder.is_dir():
            folder.rename(backup)
        try:
            stage.rename(folder)
        except OSError:
            if backup.is_dir():
                backup.rename(folder)
            raise
        shutil.rmtree(backup, ignore_errors=True)
    except OSError as bad:
        raise DocumentWriteError(f"{type_}/{id_}: {bad}") from bad
    finally:
        shutil.rmtree(stage, ignore_errors=True)


def write_markdown(root: str, type_: str, id_: str, field: str, content: str) -> None:
    """Writes one markdown field of an existing document."""
    at = Path(root) / type_ / id_ / f"{id_}.json"
    at = at if at.is_file() else Path(root) / type_ / f"{id_}.json"
    put_with_markdown(root, type_, id_, parse(at.read_text(encoding="utf-8")), {field: content})


def _made(folder: Path) -> Path:
    folder.mkdir(parents=True, exist_ok=True)
    return folder


def format_store(spark, root: str, type_: str | None = None, id_: str | None = None, dry_run: bool = False, fail_fast: bool = False, **how) -> dict[str, Any]:
    """Rewrites documents that are not canonical: {count, errors}.  Canonical texts are made on executors; a file
    that changed meanwhile is reported and left alone."""
    types = list_types(root) if type_ is None else [validate_name(type_, "type")]
    rows = snapshot(spark, root, types)
    if id_ is not None:
        rows = rows.where(F.col("id") == id_)
    rows = rows.withColumn("c", canonical_json(F.col("raw"), **how))
    bad = [f"{r.type}/{r.id}: {r.error}" for r in rows.where("c.error IS NOT NULL").select("type", "id", F.col("c.error").alias("error")).orderBy("type", "id").collect()]
    if bad and fail_fast:
        raise FormatError(bad[0])
    todo = rows.where("c.error IS NULL AND raw <> c.value").select("type", "id", "raw", F.col("c.value").alias("text"))
    if dry_run:
        return {"count": todo.count(), "errors": bad}
    count = 0
    for row in todo.toLocalIterator():
        path = Path(root) / row.type / f"{row.id}.json"
        if path.read_text(encoding="utf-8").lstrip() != row.raw:
            bad.append(f"{row.type}/{row.id}: changed meanwhile")
            continue
        atomic_write(path, row.text)
        count += 1
    return {"count": count, "errors": bad}


def export_documents(docs: DataFrame, root: str, **how) -> int:
    """Writes (type, id, doc VARIANT) rows as canonical files, one partition at a time; the number written."""
    rows = docs.select("type", "id", canonical_json(F.to_json("doc"), **how)["value"].alias("text"))
    count = 0
    for row in rows.toLocalIterator():
        atomic_write(Path(root) / validate_name(row.type, "type") / f"{validate_name(row.id)}.json", row.text)
        count += 1
    return count


def write_table(docs: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Documents as Parquet partitioned by type; an overwrite replaces only the types that are written."""
    docs.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("type").parquet(path)


def init(root: str) -> None:
    _made(Path(root) / "_meta")


def git_commit(root: str, path: str, message: str) -> bool:
    """Commits one file; false, never an error, if git refuses."""
    done = subprocess.run(["git", "add", "--", path], cwd=root, capture_output=True)
    return done.returncode == 0 and subprocess.run(["git", "commit", "-q", "-m", message, "--only", "--", path], cwd=root, capture_output=True).returncode == 0


def store_size(root: str, type_: str | None = None) -> dict[str, dict[str, int]]:
    """{type: {count, bytes}} from file sizes alone."""
    out = {}
    for t in [type_] if type_ else list_types(root):
        sizes = [(Path(root) / t / n).stat().st_size for n in list_files(f"{root}/{t}", ".json")]
        out[t] = {"count": len(sizes), "bytes": sum(sizes)}
    return out


def load_json(text: str, label: str) -> Any:
    try:
        return parse(text.removeprefix("﻿"))
    except (ValueError, json.JSONDecodeError) as bad:
        raise ValidationError(f"{label}: {bad}") from bad
