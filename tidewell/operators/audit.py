"""The audit chain and the searches over logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.time import severity_rank

_BODY = ("seq", "at", "action", "principal", "session", "target", "detail", "prev_hash")
GENESIS = "0" * 64
MOST_AUDIT, MOST_LOGS = 10_000, 5_000


def _hash() -> Column:
    return F.sha2(F.to_json(F.struct(*_BODY), {"ignoreNullFields": "false"}), 256)


def seal_chain(records: list[dict], start: int = 1, prev: str = GENESIS) -> list[dict]:
    """Records with ``seq``, ``prev_hash`` and ``hash``; each hash covers the one before."""
    import hashlib
    import json

    out = []
    for n, r in enumerate(records):
        body = {"seq": start + n, **{k: r.get(k) for k in _BODY[1:-1]}, "prev_hash": prev}
        prev = hashlib.sha256(json.dumps(body, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
        out.append(body | {"hash": prev})
    return out


def verify_chain(chain: DataFrame) -> DataFrame:
    """One row: ``records``, ``ok``, and ``broken_at``, the first ``seq`` at which the chain breaks.

    A record breaks it if its hash is not that of its content, if it does not
    name its predecessor's hash, or if its number does not follow. Each record
    is compared with the one numbered just before by a join, not by a window
    over the whole chain in one task.
    """
    before = chain.select((F.col("seq") + 1).alias("seq"), F.col("hash").alias("__before"))
    first = F.broadcast(chain.agg(F.min("seq").alias("__first")))
    rows = chain.withColumn("__own", _hash()).join(before, "seq", "left").crossJoin(first)
    linked = F.when(F.col("seq") == F.col("__first"), F.when(F.col("seq") == 1, F.col("prev_hash") == GENESIS).otherwise(True)).otherwise(F.coalesce(F.col("__before") == F.col("prev_hash"), F.lit(False)))
    bad = ~(F.coalesce(F.col("__own") == F.col("hash"), F.lit(False)) & F.coalesce(linked, F.lit(False)))
    out = rows.agg(F.count("*").alias("records"), F.min(F.when(bad, F.col("seq"))).alias("broken_at"))
    return out.select("records", F.col("broken_at").isNull().alias("ok"), "broken_at")


def audit_query(chain: DataFrame, action: str | None = None, principal: str | None = None, session: str | None = None, target: str | None = None, since: str | None = None, limit: int = 1000) -> DataFrame:
    """The newest ``limit`` (at most 10,000) records that match, oldest first."""
    rows = chain
    for column, value in (("action", action), ("principal", principal), ("session", session), ("target", target)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    if since is not None:
        rows = rows.where(F.col("at") >= since)
    return rows.orderBy(F.desc("seq")).limit(min(max(1, limit), MOST_AUDIT)).orderBy("seq")


def log_query(logs: DataFrame, level: str = "DEBUG", target: str | None = None, message: str | None = None, limit: int = 1000) -> DataFrame:
    """The newest ``limit`` (at most 5,000) log rows of at least ``level``, newest first."""
    rows = logs.where(severity_rank("level") <= severity_rank(F.lit(level)))
    if target:
        rows = rows.where(F.col("target").contains(target))
    if message:
        rows = rows.where(F.col("message").contains(message))
    return rows.orderBy(F.desc("seq")).limit(min(max(1, limit), MOST_LOGS))
