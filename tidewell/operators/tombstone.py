"""Standing deletes: rows that match stay hidden, also if they are written later."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import TIME


@dataclass(frozen=True)
class Tombstone:
    """Tag values that must all be equal, and a time range with both ends inside (None: open)."""

    tags: tuple[tuple[str, str], ...] = ()
    start: int | None = None
    end: int | None = None

    def __post_init__(self) -> None:
        if not self.tags and self.start is None and self.end is None:
            raise ValueError("a delete needs a tag or a time range")
        if self.start is not None and self.end is not None and self.start > self.end:
            raise ValueError("the time range is inverted")

    @property
    def id(self) -> str:
        """The same predicate has the same id."""
        return hashlib.sha256(repr((sorted(self.tags), self.start, self.end)).encode()).hexdigest()[:32]

    def matches(self, columns: list[str], time: str = TIME) -> Column | None:
        """The condition, or None if a tag is no column: then nothing matches. Nulls never do."""
        if any(tag not in columns for tag, _ in self.tags):
            return None
        parts = [F.col(f"`{tag}`") == value for tag, value in self.tags]
        if self.start is not None:
            parts.append(F.col(time) >= self.start)
        if self.end is not None:
            parts.append(F.col(time) <= self.end)
        return F.coalesce(reduce(lambda a, b: a & b, parts), F.lit(False))


def hide_deleted(df: DataFrame, tombstones: list[Tombstone], time: str = TIME) -> DataFrame:
    """Rows that no tombstone matches, by one filter."""
    found = [c for t in tombstones if (c := t.matches(df.columns, time)) is not None]
    return df.where(~reduce(lambda a, b: a | b, found)) if found else df
