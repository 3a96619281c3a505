"""Command line over a JSON store: python -m mangrove.cli --root DIR COMMAND.

Exit codes: 0 done, 1 usage, validation or other errors, 2 document not found, 3 statistics disabled.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
import time
from dataclasses import asdict
from pathlib import Path
from typing import Any

from .errors import DocumentNotFoundError, StoreError, ValidationError
from .functions.canonical import canonical_text
from .functions.names import bytes_text, validate_name
from .operators.indexes import IndexStore, reindex_totals
from .operators.validation import SchemaRegistry, validate_by_reference
from .plans.spec import CLI, QuerySpec
from .sources import json_store, sinks

STDIN_BYTES = 10 << 20


class Exit(Exception):
    def __init__(self, message: str, code: int = 1):
        super().__init__(message)
        self.code = code


def _spark():
    from pyspark.sql import SparkSession

    out = SparkSession.builder.master(os.environ.get("MANGROVE_MASTER", "local[*]")).appName("mangrove").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "8").config("spark.log.level", "ERROR").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    out.sparkContext.setLogLevel("ERROR")
    return out


def _input(args, what: str) -> Any:
    """The JSON given by --file, --data or standard input; exactly one."""
    if args.file and args.data:
        raise ValidationError("use only one of --file and --data")
    if args.file:
        return sinks.load_json(json_store.read_text(args.file), args.file)
    if args.data:
        return sinks.load_json(args.data, "--data")
    if sys.stdin.isatty():
        raise ValidationError(f"no {what}: use --file, --data or standard input")
    text = sys.stdin.read(STDIN_BYTES + 1)
    if len(text) > STDIN_BYTES:
        raise ValidationError(f"standard input is larger than {bytes_text(STDIN_BYTES)}")
    if not text.strip():
        raise ValidationError("standard input is empty")
    return sinks.load_json(text, "standard input")


def _path(root: str, type_: str, id_: str) -> Path:
    return Path(root) / validate_name(type_, "type") / f"{validate_name(id_)}.json"


def _put(args, root, say):
    doc = _input(args, "document")
    if isinstance(doc, dict):
        doc = {"type": args.type, "id": args.id, **doc}
    sinks.put(root, args.type, args.id, doc)
    if args.git_commit:
        sinks.git_commit(root, f"{args.type}/{args.id}.json", args.git_commit)
    say(f"Stored {args.type}/{args.id}")


def _get(args, root, say):
    path = _path(root, args.type, args.id)
    if not path.is_file():
        raise DocumentNotFoundError(f"Document not found: {args.type}/{args.id}")
    doc = sinks.load_json(json_store.read_text(str(path)), str(path))
    print(json.dumps(doc, ensure_ascii=False, separators=(",", ":")) if args.raw else canonical_text(doc), end="\n" if args.raw else "")


def _rm(args, root, say):
    _path(root, args.type, args.id)
    if not args.force:
        if not sys.stdin.isatty():
            raise ValidationError("use --force to confirm removal")
        if input(f"Remove {args.type}/{args.id}? (y/N) ").strip().lower() != "y":
            raise Exit("not confirmed")
    sinks.remove(root, args.type, args.id)
    if args.git_commit:
        sinks.git_commit(root, f"{args.type}/{args.id}.json", args.git_commit)
    say(f"Removed {args.type}/{args.id}")


def _ls(args, root, say):
    ids = json_store.list_ids(root, validate_name(args.type, "type"))
    ids = ids if args.limit is None else ids[: args.limit]
    if args.json:
        print(json.dumps(ids))
    else:
        for i in ids:
            print(i)


def _query(args, root, say):
    from .service import query_store

    spec = _input(args, "query")
    if not isinstance(spec, dict):
        raise ValidationError("a query must be a JSON object")
    spec |= {k: v for k in ("type", "limit", "skip") if (v := getattr(args, k)) is not None}
    query = QuerySpec.of(spec, CLI)
    if query.limit == 0:
        raise ValidationError("limit must be positive")
    print(json.dumps(query_store(_spark(), root, query), ensure_ascii=False, indent=2))


def _format(args, root, say):
    if args.all == bool(args.type):
        raise ValidationError("specify either --all or a type")
    done = sinks.format_store(_spark(), root, args.type, args.id, dry_run=args.check)
    for bad in done["errors"]:
        print(bad, file=sys.stderr)
    n = done["count"]
    if args.check and n:
        say(f"{n} documents are not in canonical form")
        raise Exit("some documents need formatting")
    say(f"{n} documents rewritten" if n else "all documents are in canonical form")
    if done["errors"]:
        raise Exit(f"{len(done['errors'])} document(s) could not be read")


def _stats(args, root, say):
    if os.environ.get("MANGROVE_ENABLE_STATS", "1") == "0":
        raise Exit("statistics are disabled", 3)
    types = sinks.store_size(root, args.type and validate_name(args.type, "type"))
    total = {"count": sum(t["count"] for t in types.values()), "bytes": sum(t["bytes"] for t in types.values())}
    if args.detailed:
        sizes = [(Path(root) / t / n).stat().st_size for t in types for n in json_store.list_files(f"{root}/{t}", ".json")]
        total |= {"avgBytes": total["bytes"] / len(sizes) if sizes else 0, "minBytes": min(sizes, default=0), "maxBytes": max(sizes, default=0), "types": types}
    if args.json:
        print(json.dumps(total))
        return
    print(f"Documents: {total['count']}\nTotal size: {bytes_text(total['bytes'])}")
    if args.detailed:
        print(f"Average size: {bytes_text(total['avgBytes'])}\nMin size: {bytes_text(total['minBytes'])}\nMax size: {bytes_text(total['maxBytes'])}\n\nBy Type:")
        for t, s in types.items():
            print(f"  {t}: {s['count']} docs, {bytes_text(s['bytes'])}")


def _reindex(args, root, say):
    if args.all == bool(args.type):
        raise ValidationError("specify either --all or a type")
    spark, store = _spark(), IndexStore(f"{root}/_indexes")
    types = json_store.list_types(root) if args.all else [args.type]
    done = store.reindex([json_store.collection(spark, root, t, malformed="drop") for t in types], {t: args.fields for t in types}, force=args.force)
    totals = reindex_totals(done)
    if args.json:
        print(json.dumps(totals | {"fields": [asdict(s) for s in done]}))
        return
    say(f"{len(done)} indexes of {len(totals['types'])} types rebuilt" if done else "no indexes to rebuild")
    for s in done:
        say(f"  {s.type}.{s.field}: {s.keys} keys, {s.docs_scanned} documents, {bytes_text(s.bytes)}")


def _schema(args, root, say):
    registry = SchemaRegistry()
    registry.load(root)
    if args.action == "add":
        at = registry.save(root, _input(args, "schema"))
        say(f"Added {at.name}")
    elif args.action == "list":
        print(json.dumps(registry.refs()) if args.json else "\n".join(registry.refs()))
    else:
        _schema_validate(args, root, registry, say)


def _schema_validate(args, root, registry, say):
    """Every document against the schema it names; documents that name none are counted as warnings."""
    spark, total = _spark(), {"total": 0, "valid": 0, "warnings": 0, "errors": 0}
    for type_ in [args.type] if args.type else json_store.list_types(root):
        rows = validate_by_reference(json_store.collection(spark, root, type_), registry, mode="lenient" if args.mode == "lenient" else "strict")
        for row in rows.select("id", "schema", "ok", "errors").toLocalIterator():
            total["total"] += 1
            total["warnings" if row.schema is None else "valid" if row.ok else "errors"] += 1
            for e in row.errors if row.schema is not None else ():
                print(f"{type_}/{row.id} {e.pointer or '/'}: {e.message} ({e.code})", file=sys.stderr)
    print(json.dumps(total) if args.json else "\n".join(f"{k}: {v}" for k, v in total.items()))
    if total["errors"]:
        raise Exit("validation failed")


def _count(text: str) -> int:
    value = int(text)
    if not 0 <= value <= CLI.max_limit:
        raise argparse.ArgumentTypeError(f"must be between 0 and {CLI.max_limit}")
    return value


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="mangrove", description="JSON document stores with declarative queries")
    out.add_argument("--root", help="folder of the store (default: MANGROVE_ROOT or ./data)")
    out.add_argument("--verbose", action="store_true")
    out.add_argument("--quiet", action="store_true")
    commands = out.add_subparsers(dest="command", required=True)

    def command(name, run, *positional, **flags):
        sub = commands.add_parser(name)
        for p in positional:
            sub.add_argument(p.rstrip("?*"), nargs={"?": "?", "*": "*"}.get(p[-1]))
        for flag, how in flags.items():
            sub.add_argument(f"--{flag.replace('_', '-')}", **({"action": "store_true"} if how is bool else how))
        sub.set_defaults(run=run)

    command("init", lambda args, root, say: (sinks.init(root), say(f"Initialized store at {root}")))
    command("put", _put, "type", "id", file={}, data={}, git_commit={})
    command("get", _get, "type", "id", raw=bool)
    command("rm", _rm, "type", "id", force=bool, git_commit={})
    command("ls", _ls, "type", json=bool, limit={"type": _count})
    command("query", _query, file={}, data={}, type={}, limit={"type": _count}, skip={"type": _count})
    command("format", _format, "type?", "id?", all=bool, check=bool)
    command("stats", _stats, type={}, detailed=bool, json=bool)
    command("reindex", _reindex, "type?", "fields*", all=bool, force=bool, json=bool)
    command("schema", _schema, "action", file={}, data={}, type={}, json=bool, mode={"default": "strict", "choices": ["strict", "lenient"]})
    return out


def main(argv: list[str] | None = None) -> int:
    try:
        args = parser().parse_args(argv)
    except SystemExit as stop:
        return 1 if stop.code else 0
    root = str(Path(args.root or os.environ.get("MANGROVE_ROOT") or "data").resolve())
    began = time.perf_counter()
    try:
        args.run(args, root, (lambda text: None) if args.quiet else print)
        code = 0
    except DocumentNotFoundError as bad:
        print(f"Error: {bad}", file=sys.stderr)
        code = 2
    except Exit as bad:
        print(f"Error: {bad}", file=sys.stderr)
        code = bad.code
    except (StoreError, ValueError, OSError) as bad:
        print(f"Error: {bad}" + (f" [{bad.code}]" if args.verbose and isinstance(bad, StoreError) else ""), file=sys.stderr)
        code = 1
    if args.verbose:
        print(f"{args.command}: {(time.perf_counter() - began) * 1000:.0f} ms", file=sys.stderr)
    return code


if __name__ == "__main__":
    sys.exit(main())
