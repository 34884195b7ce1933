"""Scalar functions and small text grammars."""

from .grammar import fnv1a, humanize_seconds, parse_duration, parse_retention, parse_size, shard_of
from .time import date_bin, date_bin_ns, hour_partition, ns_to_timestamp, register_sql_functions, rfc3339, severity_rank, timestamp_to_ns

__all__ = [
    "date_bin",
    "date_bin_ns",
    "fnv1a",
    "hour_partition",
    "humanize_seconds",
    "ns_to_timestamp",
    "parse_duration",
    "parse_retention",
    "parse_size",
    "register_sql_functions",
    "rfc3339",
    "severity_rank",
    "shard_of",
    "timestamp_to_ns",
]
