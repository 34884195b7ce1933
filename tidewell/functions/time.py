"""Time as nanoseconds (the stored truth) and as timestamps (microseconds)."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def date_bin_ns(width_ns: int, ns: Column | str) -> Column:
    """Start of the epoch-aligned bucket of a nanosecond time; negative times round down."""
    if width_ns <= 0:
        raise ValueError("a bucket must be longer than nothing")
    col = F.col(ns) if isinstance(ns, str) else ns
    return col - F.pmod(col, F.lit(width_ns).cast("long"))


def date_bin(width_seconds: int, ts: Column | str) -> Column:
    """Start of the epoch-aligned bucket of a timestamp (with or without zone: the UTC clock counts)."""
    col = F.col(ts) if isinstance(ts, str) else ts
    micros = F.unix_micros(col.cast("timestamp"))
    return F.timestamp_micros(micros - F.pmod(micros, F.lit(width_seconds * 1_000_000).cast("long")))


def ns_to_timestamp(ns: Column | str) -> Column:
    """The microsecond that a nanosecond time lies in."""
    col = F.col(ns) if isinstance(ns, str) else ns
    thousand = F.lit(1000).cast("long")
    return F.timestamp_micros(F.call_function("div", col - F.pmod(col, thousand), thousand))


def timestamp_to_ns(ts: Column | str) -> Column:
    col = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(col.cast("timestamp")) * F.lit(1000).cast("long")


def hour_partition(ns: Column | str) -> Column:
    """``YYYYMMDDHH`` in UTC; times before the epoch round down."""
    return F.date_format(ns_to_timestamp(date_bin_ns(3_600_000_000_000, ns)), "yyyyMMddHH")


def rfc3339(ts: Column | str) -> Column:
    """UTC with microseconds and ``Z``: text order is time order."""
    col = F.col(ts) if isinstance(ts, str) else ts
    return F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def severity_rank(level: Column | str) -> Column:
    """ERROR 0, WARN 1, INFO 2, DEBUG 3, anything else 4."""
    col = F.upper(F.col(level) if isinstance(level, str) else level)
    out = F.lit(4)
    for rank, name in reversed(list(enumerate(("ERROR", "WARN", "INFO", "DEBUG")))):
        out = F.when(col == name, rank).otherwise(out)
    return out


def register_sql_functions(spark: SparkSession) -> None:
    """Give the session's SQL ``date_bin(interval, timestamp)``. Temporary functions belong to one session."""
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION date_bin(i INTERVAL DAY TO SECOND, t TIMESTAMP) RETURNS TIMESTAMP "
        "RETURN timestamp_micros(unix_micros(t) - pmod(unix_micros(t), CAST(extract(DAY FROM i) * 86400000000 + extract(HOUR FROM i) * 3600000000 "
        "+ extract(MINUTE FROM i) * 60000000 + extract(SECOND FROM i) * 1000000 AS BIGINT)))"
    )
