"""A bounded cache of parsed documents on the driver, checked against file time and size."""

from __future__ import annotations

import os
import sys
from collections import OrderedDict
from collections.abc import Callable
from pathlib import Path
from typing import Any

MAX_DOCUMENTS = 10_000


class DocumentCache:
    """Least recently used documents go first; 0 documents switches the cache off."""

    def __init__(self, documents: int | None = None, megabytes: float | None = None):
        self.most = int(os.environ.get("MANGROVE_CACHE_SIZE", MAX_DOCUMENTS)) if documents is None else documents
        self.most_bytes = None if megabytes is None else int(megabytes * (1 << 20))
        self._held: OrderedDict[str, tuple[tuple[int, int], Any, int]] = OrderedDict()
        self.bytes = self.hits = self.misses = self.evictions = 0

    @staticmethod
    def _mark(path: str) -> tuple[int, int]:
        found = os.stat(path)
        return found.st_mtime_ns, found.st_size

    def get(self, path: str, load: Callable[[str], Any]) -> Any:
        """The document at ``path``; loaded where it is new or changed.  A file that changes while it is read is
        read again, at most three times, and then not kept."""
        mark = self._mark(path)
        held = self._held.get(path)
        if held and held[0] == mark:
            self.hits += 1
            self._held.move_to_end(path)
            return held[1]
        self.misses += 1
        for _ in range(3):
            value, after = load(Path(path).read_text(encoding="utf-8")), self._mark(path)
            if after == mark:
                self._keep(path, mark, value)
                break
            mark = after
        return value

    def _keep(self, path: str, mark: tuple[int, int], value: Any) -> None:
        self.delete(path)
        if self.most <= 0:
            return
        size = mark[1] + sys.getsizeof(path)
        self._held[path] = (mark, value, size)
        self.bytes += size
        while len(self._held) > self.most or (self.most_bytes is not None and self.bytes > self.most_bytes and self._held):
            _, (_, _, gone) = self._held.popitem(last=False)
            self.bytes -= gone
            self.evictions += 1

    def delete(self, path: str) -> None:
        if path in self._held:
            self.bytes -= self._held.pop(path)[2]

    def clear(self) -> None:
        self._held.clear()
        self.bytes = 0

    def stats(self) -> dict[str, float]:
        seen = self.hits + self.misses
        return {"size": len(self._held), "bytes": self.bytes, "hits": self.hits, "misses": self.misses, "evictions": self.evictions, "hit_rate": self.hits / seen if seen else 0.0}
