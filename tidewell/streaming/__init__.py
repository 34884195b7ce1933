"""Continuous forms of ingest, rollups and last values on Structured Streaming."""

from .continuous import ingest_stream, last_value_stream, rollup_stream

__all__ = ["ingest_stream", "last_value_stream", "rollup_stream"]
