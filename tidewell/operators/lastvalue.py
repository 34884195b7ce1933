"""The latest values of each series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import SEQ, TIME, TableDef


def last_values(df: DataFrame, table: TableDef, cap: int | None = None) -> DataFrame:
    """One row for each series (tag values): the fields of its newest time.

    Of rows with one time the first to arrive counts, as only a strictly newer
    row replaces another. With ``cap`` the series written most recently stay.
    Columns: time, tags and fields, both sorted by name. Maxima are combined
    before the shuffle: a busy series is no hot task.
    """
    fields = sorted(n for n, _ in table.fields)
    tags = sorted(table.tags)
    seq = F.col(SEQ) if SEQ in df.columns else F.lit(0)
    newest = F.max_by(F.struct(TIME, *(F.col(f"`{f}`") for f in fields)), F.struct(F.col(TIME), -seq))
    rows = df.groupBy(*(F.col(f"`{t}`") for t in tags)).agg(newest.alias("__row"), F.max(seq).alias("__touched"))
    if cap is not None:
        rows = rows.orderBy(F.desc("__touched"), *(F.col(f"`{t}`") for t in tags)).limit(cap)
    return rows.select(F.col(f"__row.{TIME}").alias(TIME), *(F.col(f"`{t}`") for t in tags), *(F.col(f"__row.`{f}`").alias(f) for f in fields))
