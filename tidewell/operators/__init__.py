"""Operators on tables of time, tags and fields."""

from .audit import audit_query, log_query, seal_chain, verify_chain
from .dedup import last_write_wins
from .lastvalue import last_values
from .rollup import Rollup, RollupAgg, rollup_frame, sealed_range
from .telemetry import histogram_quantile, parse_exposition
from .tombstone import Tombstone, hide_deleted
from .visibility import apply_visibility, parse_label, visible_labels

__all__ = [
    "Rollup",
    "RollupAgg",
    "Tombstone",
    "apply_visibility",
    "audit_query",
    "hide_deleted",
    "histogram_quantile",
    "last_values",
    "last_write_wins",
    "log_query",
    "parse_exposition",
    "parse_label",
    "rollup_frame",
    "seal_chain",
    "sealed_range",
    "verify_chain",
    "visible_labels",
]
