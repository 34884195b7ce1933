"""Last write wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import SEQ


def last_write_wins(df: DataFrame, key: list[str], order: list[Column | str] | None = None) -> DataFrame:
    """Of the rows with one key, the one that arrived last, whole.

    Null key columns are equal to each other. ``order`` (by default the arrival
    sequence) must tell rows of a key apart, or which of them stays is open.
    The maximum of a struct is combined before the shuffle, so a key that is
    written over and over costs one row for each task, not a sort in one.
    """
    order = order or [SEQ]
    ranks = [F.col(c) if isinstance(c, str) else c for c in order]
    rest = [c for c in df.columns if c not in key]
    best = F.max_by(F.struct(*(F.col(f"`{c}`") for c in rest)), F.struct(*ranks))
    rows = df.groupBy(*(F.col(f"`{k}`") for k in key)).agg(best.alias("__row"))
    return rows.select(*(F.col(f"`{c}`") if c in key else F.col(f"__row.`{c}`").alias(c) for c in df.columns))
