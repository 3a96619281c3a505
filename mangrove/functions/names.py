"""Checks and string helpers: names, schema references, paths, formats, digests, sizes."""

from __future__ import annotations

import posixpath
import re
from decimal import ROUND_HALF_UP, Decimal
from pathlib import Path
from urllib.parse import unquote

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..errors import MarkdownIntegrityError, MarkdownPathError, ValidationError

NAME = r"^[A-Za-z0-9_.-]+$"
DEVICES = ("con", "prn", "aux", "nul", *(f"{p}{i}" for p in ("com", "lpt") for i in range(1, 10)))
SCHEMA_REF = r"^schema/[a-zA-Z0-9_-]+@[0-9]+$"
SLUG = r"^[a-z0-9]+(?:-[a-z0-9]+)*$"


def is_name(name: Column) -> Column:
    """A type or id: letters, digits, ``_.-``; no leading ``.`` or ``-``, no ``..``, no final ``.``, no device."""
    device = F.lower(F.substring_index(name, ".", 1)).isin(list(DEVICES))
    good = name.rlike(NAME) & ~name.rlike(r"^[.-]|\.\.|\.$") & ~device
    return F.coalesce(good, F.lit(False))


def validate_name(name: str, label: str = "id") -> str:
    if not isinstance(name, str) or not re.fullmatch(NAME[1:-1], name) or name[0] in ".-" or ".." in name or name.endswith(".") or name.split(".")[0].lower() in DEVICES:
        raise ValidationError(f"invalid {label}: {name!r}")
    return name


def is_type_name(name: Column) -> Column:
    """The other rule, for listing: no leading ``_`` or ``.``, no separator or colon."""
    return F.coalesce((name != "") & ~name.rlike(r"^[_.]|[/\\:]|\.\."), F.lit(False))


def validate_type_name(name: str) -> str:
    if not isinstance(name, str) or not name or name[0] in "_." or re.search(r"[/\\:\0]|\.\.", name):
        raise ValidationError(f"invalid type name: {name!r}")
    return name


def is_schema_ref(ref: Column) -> Column:
    return F.coalesce(ref.rlike(SCHEMA_REF), F.lit(False))


def validate_schema_ref(ref: str) -> str:
    if not re.fullmatch(SCHEMA_REF[1:-1], ref):
        raise ValidationError(f"invalid schema reference: {ref!r}")
    return ref


def sanitize_path(path: str) -> str:
    """A relative path without traversal; raises on absolute paths and ``..``."""
    if "\0" in path or path.startswith("/") or re.match("^[A-Za-z]:", path) or ".." in re.split(r"[/\\]", path):
        raise ValidationError(f"unsafe path: {path!r}")
    return posixpath.normpath(path.replace("\\", "/"))


# formats


def country_codes(spark: SparkSession) -> list[str]:
    """ISO 3166-1 alpha-2 codes, as the Java runtime knows them."""
    return sorted(spark.sparkContext._jvm.java.util.Locale.getISOCountries())


def format_check(name: str, value: Column, spark: SparkSession | None = None) -> Column:
    """Whether a string has the named format; other formats raise."""
    if name == "slug":
        out = value.rlike(SLUG)
    elif name == "iso3166-1-alpha-2":
        out = value.isin(country_codes(spark or SparkSession.active()))
    elif name == "iso3166-2":
        out = value.rlike("^[A-Z]{2}-[A-Z0-9]{1,3}$") & F.substring(value, 1, 2).isin(country_codes(spark or SparkSession.active()))
    elif name == "markdown_path":
        out = value.rlike(r"^[^/].*\.md$|^\.md$") & (value == F.trim(value)) & ~value.rlike(r"^[A-Za-z]:|\\|[\x00-\x1f]|%|(^|/)\.\.(/|$)|^\s|\s$")
    elif name == "date":
        out = value.rlike(r"^\d{4}-\d{2}-\d{2}$") & value.try_cast("date").isNotNull()
    elif name == "date-time":
        out = value.rlike(r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:?\d{2})$") & F.regexp_replace(value, r"[Tt ](.*?)(\.\d+)?([Zz]|[+-]\d{2}:?\d{2})$", " $1").try_cast("timestamp").isNotNull()
    elif name == "email":
        out = value.rlike(r"^(?i)[a-z0-9!#$%&'*+/=?^_`{|}~-]+(\.[a-z0-9!#$%&'*+/=?^_`{|}~-]+)*@([a-z0-9]([a-z0-9-]*[a-z0-9])?\.)+[a-z0-9]([a-z0-9-]*[a-z0-9])?$")
    elif name == "uri":
        out = value.rlike(r"^(?i)[a-z][a-z0-9+.-]*:[^\s<>\"{}|\\^`]+$")
    elif name == "uuid":
        out = value.rlike(r"^(?i)(urn:uuid:)?[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")
    elif name == "ipv4":
        part = "(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
        out = value.rlike(rf"^({part}\.){{3}}{part}$")
    else:
        raise ValidationError(f"unknown format {name!r}")
    return F.coalesce(out, F.lit(False))


# markdown paths


def normalize_markdown_path(path: str) -> str:
    """A safe relative ``.md`` path with forward slashes; raises MarkdownPathError."""
    if not isinstance(path, str) or not path.strip():
        raise MarkdownPathError("the path is empty")
    for _ in range(5):  # repeated encodings
        if (decoded := unquote(path)) == path:
            break
        path = decoded
    if path.startswith(("/", "\\\\")) or re.match("^[a-zA-Z]:", path):
        raise MarkdownPathError(f"{path!r} is absolute")
    if "\0" in path or ":" in path:
        raise MarkdownPathError(f"{path!r} has a letter that paths cannot have")
    path = re.sub(r"[/\\]+", "/", path).removeprefix("./")
    if not path.lower().endswith(".md"):
        raise MarkdownPathError(f"{path!r} does not end in .md")
    parts = [p for p in path.split("/") if p]
    for part in parts:
        bare = part.rstrip(".").rstrip()
        if part in (".", "..") or not bare:
            raise MarkdownPathError(f"{path!r} leaves its folder or has an empty part")
        if bare.split(".")[0].lower() in DEVICES:
            raise MarkdownPathError(f"{path!r} names a device")
    return "/".join(parts)


def is_markdown_path(path: Column) -> Column:
    """``normalize_markdown_path`` as a check on a column, in the JVM: two decodings, then the same rules."""
    decoded = F.coalesce(F.try_url_decode(F.coalesce(F.try_url_decode(path), path)), path)
    posix = F.regexp_replace(F.regexp_replace(decoded, r"[/\\]+", "/"), r"^\./", "")
    bad = decoded.rlike(r"^/|^\\\\|^[a-zA-Z]:|\x00|:") | posix.rlike(r"(^|/)\.{1,2}(/|$)") | posix.rlike(rf"(?i)(^|/)({'|'.join(DEVICES)})[.\s]*(\.[^/]*)?(/|$)")
    return F.coalesce((F.trim(path) != "") & ~bad & posix.rlike(r"(?i)\.md$"), F.lit(False))


def resolve_within(root: str, relative: str) -> Path:
    """The file under ``root``; symbolic and hard links and escapes raise MarkdownPathError."""
    base = Path(root).resolve()
    at = base / normalize_markdown_path(relative)
    for part in [at, *at.parents]:
        if part == base:
            break
        if part.is_symlink():
            raise MarkdownPathError(f"{relative!r} goes through a link")
    if at.exists() and at.stat().st_nlink > 1:
        raise MarkdownPathError(f"{relative!r} is linked twice")
    if base not in at.resolve().parents:
        raise MarkdownPathError(f"{relative!r} leaves {root!r}")
    return at


def render_cache_path(doc_dir: str, key: str) -> str:
    return f"{doc_dir.rstrip('/')}/.cache/{key}.html"


def validate_cache_path(path: str) -> str:
    if not path.startswith(".cache/"):
        raise MarkdownPathError(f"{path!r} is not under .cache/")
    normalize_markdown_path(re.sub(r"\.html$", ".md", path))
    return path


# digests, sizes, pointers


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def verify_integrity(path: str, text: str, expected: str) -> None:
    import hashlib

    actual = hashlib.sha256(text.encode()).hexdigest()
    if actual != expected.lower():
        raise MarkdownIntegrityError(f"{path}: expected {expected}, found {actual}")


def format_bytes(size: Column) -> Column:
    """1024-based size with up to two decimals: 0 Bytes, 1.5 KB ..."""
    units = ("Bytes", "KB", "MB", "GB", "TB", "PB")
    out = F.when(size == 0, "0 Bytes")
    for k, unit in enumerate(units):
        number = F.regexp_replace(F.format_string("%.2f", size.cast("double") / float(1024**k)), r"\.?0+$", "")
        fits = size < 1024 ** (k + 1) if k < len(units) - 1 else F.lit(True)
        out = out.when(fits, F.concat(number, F.lit(f" {unit}")))
    return out


def bytes_text(size: float) -> str:
    """``format_bytes`` of one number."""
    units, k = ("Bytes", "KB", "MB", "GB", "TB", "PB"), 0
    while size >= 1024 and k < len(units) - 1:
        size, k = size / 1024, k + 1
    text = str(Decimal(size).quantize(Decimal("0.01"), ROUND_HALF_UP))
    return text.rstrip("0").rstrip(".") + f" {units[k]}"


def resolve_pointer(document, pointer: str):
    """The value a JSON Pointer names; raises KeyError."""
    if pointer in ("", "#"):
        return document
    for part in pointer.removeprefix("#").removeprefix("/").split("/"):
        part = part.replace("~1", "/").replace("~0", "~")
        document = document[int(part)] if isinstance(document, list) else document[part]
    return document
