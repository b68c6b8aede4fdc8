"""The query object: filters that must all hold, one sort key, a limit and a projection."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

RANGE_OPS = ("gt", "gte", "lt", "lte", "between")
OPS = ("eq", "exists", *RANGE_OPS)


@dataclass(frozen=True)
class Filter:
    """A predicate on one top-level field. between takes a pair and includes both ends; exists takes no value."""

    field: str
    op: str
    value: Any = None

    def __post_init__(self) -> None:
        if self.op not in OPS:
            raise ValueError(f"unknown operator {self.op!r}; known: {', '.join(OPS)}")
        if not self.field:
            raise ValueError("a filter needs a field")
        if self.op == "between":
            if not isinstance(self.value, (tuple, list)) or len(self.value) != 2:
                raise ValueError("between takes a pair (low, high)")
            object.__setattr__(self, "value", tuple(self.value))
        values = self.value if self.op == "between" else (self.value,)
        if self.op in RANGE_OPS and not all(isinstance(v, (int, float)) for v in values):
            raise ValueError(f"{self.op} compares numbers, not {self.value!r}")


@dataclass(frozen=True)
class FindRequest:
    """limit 0 or less: all rows. projection empty: all fields; _id is always kept and unknown fields are ignored."""

    filters: tuple[Filter, ...] = ()
    sort_by: str | None = None
    ascending: bool = True
    limit: int = 0
    projection: tuple[str, ...] = field(default=())

    def strategy(self) -> str:
        """What an index-based store would scan: an index serves a single filter only."""
        if len(self.filters) == 1 and self.filters[0].op == "eq":
            return "index_eq"
        if len(self.filters) == 1 and self.filters[0].op in RANGE_OPS:
            return "index_range"
        return "full_scan"
