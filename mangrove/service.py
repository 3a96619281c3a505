"""Tool-style service over a JSON store: six tools with checked inputs, time limits and read-only mode."""

from __future__ import annotations

import json
import math
import re
import threading
import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .errors import StoreError, ValidationError
from .operators.indexes import RESERVED, IndexStore
from .plans.spec import LIST_IDS, SERVICE, QuerySpec
from .sources import json_store, sinks
from .sources.cache import DocumentCache

#: Names as the service accepts them, the most bytes of a document, seconds a tool may take.
TYPE, ID = r"[a-z0-9]+(?:[._-][a-z0-9]+)*", r"[A-Za-z0-9]+(?:[._-][A-Za-z0-9]+)*"
MAX_DOCUMENT = 1 << 20
SECONDS = {"get_doc": 2, "list_ids": 2, "put_doc": 5, "rm_doc": 5, "query": 5, "ensure_index": 5}
WRITES = ("put_doc", "rm_doc", "ensure_index")


class ToolTimeout(StoreError):
    code = "TIMEOUT"


class ReadOnly(StoreError):
    code = "READ_ONLY"


def _matching(name: str, value: Any, pattern: str) -> str:
    if not isinstance(value, str) or not re.fullmatch(pattern, value):
        raise ValidationError(f"{name} is not valid: {value!r}")
    return value


@dataclass
class Metrics:
    """Calls and durations by tool, the last thousand of each."""

    calls: dict[tuple[str, str], int] = field(default_factory=dict)
    seconds: dict[str, list[float]] = field(default_factory=dict)

    def add(self, tool: str, outcome: str, seconds: float) -> None:
        self.calls[tool, outcome] = self.calls.get((tool, outcome), 0) + 1
        self.seconds[tool] = [*self.seconds.get(tool, [])[-999:], seconds]

    def percentile(self, tool: str, p: float) -> float:
        """Nearest-rank percentile, 0 without samples."""
        samples = sorted(self.seconds.get(tool, ()))
        return samples[max(0, math.ceil(len(samples) * p) - 1)] if samples else 0.0


class Service:
    def __init__(self, spark: SparkSession, root: str, *, read_only: bool = False, enabled: bool = True, seconds: Mapping[str, float] | None = None):
        self.spark, self.root, self.read_only, self.enabled = spark, root, read_only, enabled
        self.seconds = {**SECONDS, **(seconds or {})}
        self.metrics, self.cache = Metrics(), DocumentCache()
        self.tools: dict[str, Callable[[Mapping[str, Any]], tuple[str, dict]]] = {
            "get_doc": self._get, "put_doc": self._put, "rm_doc": self._remove, "list_ids": self._list, "query": self._query, "ensure_index": self._index,
        }

    def names(self) -> list[str]:
        return [n for n in self.tools if not (self.read_only and n in WRITES)] if self.enabled else []

    def call(self, tool: str, arguments: Mapping[str, Any]) -> dict[str, Any]:
        """{content: [text, json]} or {isError, content: [text with code]}."""
        began = time.perf_counter()
        try:
            if not self.enabled or tool not in self.tools:
                raise ValidationError(f"unknown tool {tool!r}")
            if self.read_only and tool in WRITES:
                raise ReadOnly(f"{tool} is not available in read-only mode")
            text, value = self._timed(tool, arguments)
            out = {"content": [{"type": "text", "text": text}, {"type": "json", "json": value}]}
            outcome = "ok"
        except (StoreError, ValueError) as bad:
            outcome = getattr(bad, "code", "INVALID")
            out = {"isError": True, "content": [{"type": "text", "text": f"{outcome}: {bad}"}]}
        self.metrics.add(tool, outcome, time.perf_counter() - began)
        return out

    def _timed(self, tool: str, arguments: Mapping[str, Any]):
        """The tool's result; beyond its time the Spark jobs it started are cancelled."""
        result: list = []
        context = self.spark.sparkContext
        tag = f"tool-{id(result)}"

        def work() -> None:
            context.addJobTag(tag)
            try:
                result.append((True, self.tools[tool](arguments)))
            except Exception as bad:
                result.append((False, bad))

        thread = threading.Thread(target=work, daemon=True)
        thread.start()
        thread.join(self.seconds[tool])
        if not result:
            context.cancelJobsWithTag(tag)
            raise ToolTimeout(f"{tool} took more than {self.seconds[tool]} s")
        good, value = result[0]
        if not good:
            raise value
        return value

    def _key(self, a: Mapping[str, Any]) -> tuple[str, str]:
        return _matching("type", a.get("type"), TYPE), _matching("id", a.get("id"), ID)

    def _get(self, a):
        type_, id_ = self._key(a)
        path = f"{self.root}/{type_}/{id_}.json"
        found = id_ in json_store.list_ids(self.root, type_)
        doc = self.cache.get(path, lambda text: sinks.load_json(text, path)) if found else None
        return (f"Found document {type_}/{id_}" if found else f"Document {type_}/{id_} not found"), {"doc": doc}

    def _put(self, a):
        type_, id_ = self._key(a)
        doc = a.get("doc")
        if len(json.dumps(doc).encode()) > MAX_DOCUMENT:
            raise ValidationError(f"the document is larger than {MAX_DOCUMENT} bytes")
        sinks.put(self.root, type_, id_, doc)
        self._commit(a, f"{type_}/{id_}.json")
        return f"Stored {type_}/{id_}", {"ok": True}

    def _remove(self, a):
        type_, id_ = self._key(a)
        sinks.remove(self.root, type_, id_)
        self._commit(a, f"{type_}/{id_}.json")
        return f"Removed {type_}/{id_}", {"ok": True}

    def _commit(self, a, path: str) -> None:
        commit = a.get("commit")
        if commit is not None:
            if not isinstance(commit, Mapping) or not commit.get("message"):
                raise ValidationError("a commit needs a message")
            sinks.git_commit(self.root, path, commit["message"])

    def _list(self, a):
        type_ = _matching("type", a.get("type"), TYPE)
        ids = json_store.list_ids(self.root, type_)[:LIST_IDS]
        return f"Found {len(ids)} documents of type {type_}", {"ids": ids, "count": len(ids)}

    def _query(self, a):
        if "type" in a and a["type"] is not None:
            _matching("type", a["type"], TYPE)
        for name, allowed in (("projection", (0, 1)), ("sort", (1, -1))):
            if any(isinstance(v, bool) or v not in allowed for v in (a.get(name) or {}).values()):
                raise ValidationError(f"{name} values must be one of {allowed}")
        spec = QuerySpec.of(dict(a), SERVICE)
        rows = query_store(self.spark, self.root, spec)
        return f"Found {len(rows)} matching documents", {"results": rows, "count": len(rows)}

    def _index(self, a):
        type_ = _matching("type", a.get("type"), TYPE)
        name = a.get("field")
        if not isinstance(name, str) or not name or name in RESERVED:
            raise ValidationError(f"field is not valid: {name!r}")
        IndexStore(f"{self.root}/_indexes").ensure(json_store.collection(self.spark, self.root, type_, malformed="drop"), name)
        return f"Index created on {type_}.{name}", {"ok": True}


def query_store(spark: SparkSession, root: str, spec: QuerySpec) -> list[dict[str, Any]]:
    """Documents of a query over a JSON store, in order, as parsed objects.  The caller bounds the limit."""
    types = json_store.list_types(root)
    if (spec.type is not None and spec.type not in types) or not types:
        return []
    rows = json_store.catalog(spark, root).query(spec, ordered=True)
    return [json.loads(r[0]) for r in rows.select(F.to_json("doc")).toLocalIterator()]
