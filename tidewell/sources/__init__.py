"""Where rows come from: line protocol, remote write, DataFrames, Parquet."""

from .frames import prepare_frame
from .lineproto import LineError, Point, parse_lines, read_bodies, split_rejects, to_line, to_lines
from .remote_write import decode_write_request, points_of, read_requests, snappy_decompress

__all__ = ["LineError", "Point", "decode_write_request", "parse_lines", "points_of", "prepare_frame", "read_bodies", "read_requests", "snappy_decompress", "split_rejects", "to_line", "to_lines"]
