"""SQL before and around Spark: the read-only guard, names, limits, errors."""

from .guard import GuardError, check_read_only, rename_relations
from .runner import QueryError, Runner, Session, narrow, result_json

__all__ = ["GuardError", "QueryError", "Runner", "Session", "check_read_only", "narrow", "rename_relations", "result_json"]
