"""Prometheus remote write: a snappy block around a protobuf ``WriteRequest``."""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineproto import POINT_SCHEMA


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise ValueError("truncated or overlong integer")
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def snappy_decompress(data: bytes) -> bytes:
    """A snappy block: literals, and copies from what is already there."""
    size, at = _varint(data, 0)
    out = bytearray()
    while at < len(data):
        tag = data[at]
        kind, at = tag & 3, at + 1
        if kind == 0:
            length = tag >> 2
            if length >= 60:
                extra = length - 59
                length, at = int.from_bytes(data[at : at + extra], "little"), at + extra
            length += 1
            if at + length > len(data):
                raise ValueError("truncated literal")
            out += data[at : at + length]
            at += length
            continue
        if kind == 1:
            length, offset, at = (tag >> 2 & 7) + 4, (tag >> 5) << 8 | data[at], at + 1
        else:
            wide = 2 if kind == 2 else 4
            length, offset, at = (tag >> 2) + 1, int.from_bytes(data[at : at + wide], "little"), at + wide
        if not 0 < offset <= len(out):
            raise ValueError("a copy reaches before the start")
        for _ in range(length):
            out.append(out[-offset])
    if len(out) != size:
        raise ValueError("wrong length")
    return bytes(out)


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 1:
            value, at = data[at : at + 8], at + 8
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
            if len(value) != size:
                raise ValueError("truncated message")
        elif kind == 5:
            value, at = data[at : at + 4], at + 4
        else:
            raise ValueError("unknown wire type")
        yield key >> 3, value


def decode_write_request(data: bytes) -> list[tuple[dict[str, str], list[tuple[int, float]]]]:
    """(labels, [(milliseconds, value)]) of each time series."""
    out = []
    for number, series in _fields(data):
        if number != 1:
            continue
        labels, samples = {}, []
        for n, message in _fields(series):
            if n == 1:
                parts = dict(_fields(message))
                labels[parts.get(1, b"").decode()] = parts.get(2, b"").decode()
            elif n == 2:
                parts = dict(_fields(message))
                stamp = parts.get(2, 0)
                samples.append((stamp - (1 << 64) if stamp >> 63 else stamp, struct.unpack("<d", parts.get(1, bytes(8)))[0]))
        out.append((labels, samples))
    return out


def points_of(series: DataFrame) -> DataFrame:
    """Points from rows of ``labels`` map<string,string> and ``samples`` array<struct<ms long, value double>>.

    ``__name__`` names the table and fails the query if it is missing; other
    labels are tags; the sample is the field ``value``. Non-finite samples,
    which mark stale series, are dropped; times beyond the nanosecond range stop
    at its ends.
    """
    name = F.try_element_at("labels", F.lit("__name__"))
    rows = series.select(F.when(F.coalesce(name, F.lit("")) == "", F.raise_error(F.lit("a series has no __name__"))).otherwise(name).alias("table"), F.map_filter("labels", lambda k, v: (k != "__name__") & (v != "")).alias("tags"), F.explode("samples").alias("s"))
    edge = (1 << 63) // 1_000_000
    ns = F.when(F.col("s.ms") > edge, F.lit((1 << 63) - 1)).when(F.col("s.ms") < -edge, F.lit(-(1 << 63))).otherwise(F.greatest(F.lit(-edge), F.least(F.lit(edge), "s.ms")) * 1_000_000)
    return rows.where(~F.isnan("s.value") & (F.abs("s.value") != math.inf)).select("table", "tags", ns.alias("time"), F.col("s.value").alias("value"))


def read_requests(bodies: DataFrame) -> DataFrame:
    """Points (``POINT_SCHEMA``) of compressed requests (``body`` long, ``data`` binary); a bad one gives one row with ``error``."""
    names = [c.split()[0] for c in POINT_SCHEMA.split(", ")]

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for number, data in zip(batch["body"], batch["data"]):
                rows = []
                try:
                    for labels, samples in decode_write_request(snappy_decompress(bytes(data))):
                        table = labels.pop("__name__", "")
                        if not table:
                            raise ValueError("a series has no __name__")
                        tags = {k: v for k, v in labels.items() if v}
                        for ms, value in samples:
                            if math.isfinite(value):
                                time = max(-(1 << 63), min((1 << 63) - 1, ms * 1_000_000))
                                rows.append((number, len(rows), table, tags, {"value": value}, {}, {}, {}, {}, time, None))
                except (ValueError, IndexError, struct.error) as e:
                    rows = [(number, 0, None, *[None] * 7, f"bad request: {e}")]
                yield pd.DataFrame(rows, columns=names)

    return bodies.mapInPandas(of, POINT_SCHEMA)
