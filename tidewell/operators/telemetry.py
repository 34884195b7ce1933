"""Metrics as tables: exposition text, histograms, quantiles."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Upper bounds, in seconds, of the query time histogram.
BOUNDS = (0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0)

_SAMPLE = re.compile(r"([a-zA-Z_:][a-zA-Z0-9_:]*)(?:\{(.*)\})?\s+(\S+)(?:\s+-?\d+)?\s*")
_LABEL = re.compile(r'([a-zA-Z_][a-zA-Z0-9_]*)="((?:[^"\\]|\\.)*)"\s*,?\s*')


def parse_exposition(text: str) -> list[tuple[dict[str, str], dict[str, float]]]:
    """Samples grouped by label set: (labels, metrics). Comments, broken and non-finite samples are left out."""
    groups: dict[tuple, dict[str, float]] = {}
    for line in text.splitlines():
        m = _SAMPLE.fullmatch(line.strip())
        if not m or line.startswith("#"):
            continue
        try:
            value = float(m[3])
        except ValueError:
            continue
        if value - value == 0:
            labels = tuple(sorted((k, re.sub(r"\\(.)", lambda x: "\n" if x[1] == "n" else x[1], v)) for k, v in _LABEL.findall(m[2] or "")))
            groups.setdefault(labels, {})[m[1]] = value
    return [(dict(k), v) for k, v in groups.items()]


def bucket_of(value: Column, bounds: tuple[float, ...] = BOUNDS) -> Column:
    """The smallest bound that is not below the value; infinity above all."""
    out = F.lit(float("inf"))
    for bound in reversed(bounds):
        out = F.when(value <= bound, F.lit(bound)).otherwise(out)
    return out


def histogram(df: DataFrame, value: str, by: list[str] | None = None, bounds: tuple[float, ...] = BOUNDS) -> DataFrame:
    """(by, le, n): how many values fall into each bucket."""
    return df.where(F.col(value).isNotNull()).groupBy(*(by or []), bucket_of(F.col(value), bounds).alias("le")).agg(F.count("*").alias("n"))


def histogram_quantile(buckets: DataFrame, q: float, by: list[str] | None = None) -> DataFrame:
    """(by, quantile): interpolated within the bucket that holds rank ``q * total``.

    The lowest bucket starts at zero; in the open last one the quantile is the
    largest finite bound. Windows run over buckets, of which there are few.
    """
    if not 0 <= q <= 1:
        raise ValueError("a quantile lies between 0 and 1")
    keys = by or []
    line = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("le")
    upto = F.sum("n").over(line.rowsBetween(Window.unboundedPreceding, 0))
    rows = buckets.withColumn("__upto", upto).withColumn("__low", F.coalesce(F.lag("le").over(line), F.lit(0.0)))
    rows = rows.withColumn("__total", F.sum("n").over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    rank = F.col("__total") * F.lit(float(q))
    inside = F.col("__low") + (F.col("le") - F.col("__low")) * (rank - (F.col("__upto") - F.col("n"))) / F.col("n")
    value = F.when(F.col("le") == float("inf"), F.col("__low")).otherwise(inside)
    held = rows.where((F.col("n") > 0) & (F.col("__upto") >= rank))
    return held.groupBy(*keys).agg(F.min_by(value, "le").alias("quantile"))
