"""Query specifications and their limits."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from ..errors import QueryError


@dataclass(frozen=True)
class Limits:
    """Bounds a service puts on limit and skip; ``default`` applies where no limit is given."""

    default: int | None = None
    max_limit: int | None = None
    max_skip: int | None = None
    min_limit: int = 1


ENGINE = Limits()
SERVICE = Limits(default=100, max_limit=1000, max_skip=10_000)
CLI = Limits(max_limit=10_000, max_skip=10_000, min_limit=0)
#: Most ids that a service lists.
LIST_IDS = 5000


def whole(name: str, value: Any, low: int, high: int | None) -> int:
    if isinstance(value, bool) or not isinstance(value, int):
        raise QueryError(f"{name} must be an integer, not {value!r}")
    if value < low or (high is not None and value > high):
        raise QueryError(f"{name} must be {low} or more" + (f" and at most {high}" if high is not None else "") + f", not {value}")
    return value


@dataclass
class QuerySpec:
    """filter -> sort -> skip/limit -> projection over one collection, or over all where ``type`` is None."""

    filter: Mapping[str, Any]
    type: str | None = None
    projection: Mapping[str, int] | None = None
    sort: Mapping[str, int] | None = None
    limit: int | None = None
    skip: int | None = None
    limits: Limits = field(default=ENGINE, repr=False)

    def __post_init__(self) -> None:
        if not isinstance(self.filter, Mapping):
            raise QueryError("filter must be an object")
        if self.limit is None:
            self.limit = self.limits.default
        if self.limit is not None:
            whole("limit", self.limit, self.limits.min_limit, self.limits.max_limit)
        if self.skip is not None:
            whole("skip", self.skip, 0, self.limits.max_skip)
        if self.projection:
            kinds = {v for v in self.projection.values() if v in (0, 1)}
            if len(kinds) > 1:
                raise QueryError("projection cannot mix inclusion and exclusion")

    @classmethod
    def of(cls, spec: QuerySpec | Mapping[str, Any], limits: Limits = ENGINE) -> QuerySpec:
        if isinstance(spec, QuerySpec):
            return spec
        known = {"filter", "type", "projection", "sort", "limit", "skip"}
        if extra := set(spec) - known:
            raise QueryError(f"unknown query keys: {', '.join(sorted(map(str, extra)))}")
        if "filter" not in spec:
            raise QueryError("filter is required")
        return cls(**spec, limits=limits)
