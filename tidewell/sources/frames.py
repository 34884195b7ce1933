"""DataFrames as a source of rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, TimestampNTZType, TimestampType

from ..functions.time import timestamp_to_ns
from ..model import TIME, SchemaError, TableDef, table_of


def prepare_frame(df: DataFrame, name: str, roles: dict[str, str] | None = None) -> tuple[DataFrame, TableDef]:
    """``df`` with ``time`` in nanoseconds, and the table it is.

    ``time`` is a timestamp or a long of nanoseconds. Strings are tags and
    everything else a field, unless ``roles`` or a column's metadata ``role``
    says otherwise. Null times, non-finite floats, and rows without any field
    raise when the rows are read: a batch is taken whole or not at all.
    """
    if TIME not in df.columns:
        raise SchemaError("a time column is needed")
    kind = df.schema[TIME].dataType
    if isinstance(kind, (TimestampType, TimestampNTZType)):
        df = df.withColumn(TIME, timestamp_to_ns(TIME))
    elif not isinstance(kind, LongType):
        raise SchemaError(f"time is {kind.simpleString()}, not a timestamp or nanoseconds")
    for column, role in (roles or {}).items():
        df = df.withMetadata(column, {"role": role})
    table = table_of(df, name)
    if not table.fields:
        raise SchemaError("a table needs a field")
    bad = F.when(F.col(TIME).isNull(), F.raise_error(F.lit("a row has no time")))
    for f, t in table.fields:
        if isinstance(t, DoubleType):
            bad = bad.when(F.isnan(f"`{f}`") | (F.abs(F.col(f"`{f}`")) == float("inf")), F.raise_error(F.lit(f"field {f!r} is not finite")))
    none = reduce(lambda a, b: a & b, [F.col(f"`{f}`").isNull() for f, _ in table.fields])
    bad = bad.when(none, F.raise_error(F.lit("a row has no field")))
    checked = df.withColumn(TIME, F.coalesce(bad.cast("long"), F.col(TIME)))
    return checked.select(*(checked[f"`{c}`"].cast(StringType()) if c in table.tags else checked[f"`{c}`"] for c in table.columns)), table
