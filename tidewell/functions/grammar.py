"""Durations, sizes, retention specifications and shard numbers."""

from __future__ import annotations

import re

#: Seconds of each duration unit.
_DURATION = {"d": 86_400, "h": 3_600, "m": 60, "s": 1}
#: Bytes of each size unit.
_SIZES = {"GiB": 1 << 30, "MiB": 1 << 20, "KiB": 1 << 10, "GB": 10**9, "MB": 10**6, "KB": 10**3, "B": 1}


def parse_duration(text: str) -> int:
    """Seconds of ``90d``, ``12h``, ``5m``, ``30s`` or bare seconds; more than zero."""
    m = re.fullmatch(r"\s*(\d+)\s*([dhms]?)\s*", text)
    if not m or int(m[1]) == 0:
        raise ValueError(f"invalid duration {text!r}: expected a positive number with d, h, m, s or no unit")
    return int(m[1]) * _DURATION.get(m[2], 1)


def humanize_seconds(seconds: int) -> str:
    """The largest unit that divides evenly, as ``parse_duration`` reads it."""
    for unit, size in _DURATION.items():
        if seconds and seconds % size == 0:
            return f"{seconds // size}{unit}"
    return f"{seconds}s"


def parse_size(text: str) -> int:
    """Bytes of ``2GiB``, ``512MB``, ``10B`` or a bare number."""
    m = re.fullmatch(r"\s*(\d+)\s*([A-Za-z]*)\s*", text)
    if not m or (m[2] and m[2] not in _SIZES):
        raise ValueError(f"invalid size {text!r}")
    return int(m[1]) * _SIZES.get(m[2], 1)


def parse_retention(spec: str) -> dict[tuple[str, str], int]:
    """``db.table=90d,t=72h`` as seconds by (database, table); a bare table is in every database (``*``).

    Only ``d``, ``h`` and bare seconds are units here.
    """
    out: dict[tuple[str, str], int] = {}
    for item in filter(None, (s.strip() for s in spec.split(","))):
        m = re.fullmatch(r"([^=]+)=(\d+)([dh]?)", item)
        if not m or int(m[2]) == 0:
            raise ValueError(f"invalid retention {item!r}")
        db, dot, table = m[1].strip().partition(".")
        out[(db, table) if dot else ("*", db)] = int(m[2]) * _DURATION.get(m[3], 1)
    return out


def fnv1a(data: bytes) -> int:
    """64-bit FNV-1a."""
    value = 0xCBF29CE484222325
    for byte in data:
        value = (value ^ byte) * 0x100000001B3 % (1 << 64)
    return value


def shard_of(db: str, table: str, shards: int) -> int:
    """The shard that owns a table."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    return fnv1a(f"{db}\0{table}".encode()) % shards
