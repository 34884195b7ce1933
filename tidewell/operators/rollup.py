"""Rollups: tumbling windows, each sealed exactly once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grammar import humanize_seconds
from ..functions.time import date_bin_ns
from ..model import SEQ, TIME, TableDef

FUNCTIONS = ("avg", "min", "max", "sum", "count", "first", "last", "count_distinct", "percentile")
NS = 1_000_000_000


@dataclass(frozen=True)
class RollupAgg:
    """``function`` of ``column`` as ``output``; ``quantile`` for percentiles."""

    function: str
    column: str
    output: str
    quantile: float | None = None

    def __post_init__(self) -> None:
        if self.function not in FUNCTIONS:
            raise ValueError(f"unknown aggregate {self.function!r}")
        if not self.column or not self.output or self.output == TIME:
            raise ValueError("an aggregate needs a column, and an output other than time")
        if (self.function == "percentile") != (self.quantile is not None) or not 0 <= (self.quantile or 0) <= 1:
            raise ValueError("a percentile, and nothing else, needs a quantile from 0 to 1")

    def of(self, order: Column) -> Column:
        col = F.col(f"`{self.column}`")
        plain = {"avg": F.avg, "min": F.min, "max": F.max, "sum": F.sum, "count": F.count, "count_distinct": F.count_distinct}
        if self.function in plain:
            out = plain[self.function](col)
        elif self.function == "percentile":
            out = F.percentile(col, self.quantile)
        else:
            pick = F.min_by if self.function == "first" else F.max_by
            out = pick(col, F.when(col.isNotNull(), order))
        return out.alias(self.output)


@dataclass(frozen=True)
class Rollup:
    """A continuous downsampling of ``source`` into ``target``. Empty ``group_by`` means every tag."""

    name: str
    source: str
    interval: int
    aggregates: tuple[RollupAgg, ...]
    target: str = ""
    group_by: tuple[str, ...] = ()
    lookback: int | None = None
    where: str | None = None

    def __post_init__(self) -> None:
        if not self.name or not self.source:
            raise ValueError("a rollup needs a name and a source")
        if self.interval <= 0 or self.grace < 0:
            raise ValueError("the interval must be positive and the lookback not negative")
        if not self.aggregates:
            raise ValueError("a rollup needs an aggregate")
        if self.into == self.source:
            raise ValueError("a rollup must not feed itself")
        names = [a.output for a in self.aggregates]
        if len(set(names)) < len(names) or set(names) & set(self.group_by):
            raise ValueError("outputs must have names of their own")

    @property
    def into(self) -> str:
        return self.target or f"{self.source}_{humanize_seconds(self.interval)}"

    @property
    def grace(self) -> int:
        return self.interval if self.lookback is None else self.lookback


def sealed_range(rollup: Rollup, now_ns: int, newest_ns: int | None) -> tuple[int | None, int] | None:
    """[lower, high) of the buckets to seal at ``now``; None if there are none.

    ``newest_ns`` is the target's newest bucket, the only state there is: what
    is before it is never written again.
    """
    width = rollup.interval * NS
    high = (now_ns - rollup.grace * NS) // width * width
    lower = None if newest_ns is None else newest_ns + width
    return None if lower is not None and lower >= high else (lower, high)


def rollup_frame(df: DataFrame, table: TableDef, rollup: Rollup, lower: int | None, high: int) -> DataFrame:
    """Buckets of [lower, high): time, tags, outputs.

    ``first`` and ``last`` follow time, then arrival. The filter is SQL and
    applies as a whole. A bucket whose outputs are all null has no row.
    """
    tags = list(rollup.group_by or table.tags)
    unknown = [t for t in tags if t not in table.tags]
    if unknown:
        raise ValueError(f"{unknown[0]!r} is no tag of {table.name!r}")
    rows = df.where(F.col(TIME) < high)
    if lower is not None:
        rows = rows.where(F.col(TIME) >= lower)
    if rollup.where:
        rows = rows.where(F.expr(f"({rollup.where})"))
    order = F.struct(TIME, SEQ) if SEQ in df.columns else F.col(TIME)
    out = rows.groupBy(date_bin_ns(rollup.interval * NS, TIME).alias(TIME), *(F.col(f"`{t}`") for t in tags)).agg(*(a.of(order) for a in rollup.aggregates))
    return out.dropna("all", subset=[a.output for a in rollup.aggregates])
