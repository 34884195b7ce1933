"""Structured Streaming: the file folder as a write-ahead log, sealed windows, latest values."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..database import Database
from ..functions.time import ns_to_timestamp, timestamp_to_ns
from ..model import TIME, TableDef
from ..operators.rollup import Rollup


def ingest_stream(spark: SparkSession, db: Database, folder: str, checkpoint: str, precision: str = "ns", files_at_once: int = 1000) -> StreamingQuery:
    """Write the line protocol bodies (one a file) that appear in ``folder``; each is taken whole or left out.

    The checkpoint is the write-ahead log: after a crash the last batch is
    written again, and last write wins makes that harmless.
    """
    bodies = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", files_at_once).load(folder)

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.orderBy("modificationTime", "path").select(F.monotonically_increasing_id().alias("body"), F.col("content").alias("data"))
        if not rows.isEmpty():
            db.write_bodies(rows, precision)

    return bodies.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rollup_stream(rows: DataFrame, table: TableDef, rollup: Rollup) -> DataFrame:
    """A streaming rollup: buckets leave, once, when the watermark (newest time less the lookback) passes them.

    The batch form ``Database.materialize`` goes by a clock; this one by the
    events, so both agree only on input that keeps flowing. Aggregates that
    need a bucket's distinct or ordered values are for the batch form.
    """
    if any(a.function in ("count_distinct", "percentile") for a in rollup.aggregates):
        raise ValueError("count_distinct and percentile are sealed in batches")
    tags = list(rollup.group_by or table.tags)
    timed = rows.withColumn("__at", ns_to_timestamp(TIME)).withWatermark("__at", f"{rollup.grace} seconds")
    if rollup.where:
        timed = timed.where(F.expr(f"({rollup.where})"))
    out = timed.groupBy(F.window("__at", f"{rollup.interval} seconds"), *(F.col(f"`{t}`") for t in tags)).agg(*(a.of(F.col(TIME)) for a in rollup.aggregates))
    return out.select(timestamp_to_ns("window.start").alias(TIME), *(F.col(f"`{t}`") for t in tags), *(a.output for a in rollup.aggregates))


def last_value_stream(rows: DataFrame, table: TableDef, idle: str | None = None) -> DataFrame:
    """A stream of changes: a series' new latest row whenever a strictly newer one arrives.

    State is one row for each series. ``idle`` (such as ``1 day``) forgets a
    series that nothing has been written to for so long.
    """
    fields = [n for n, _ in table.fields]
    tags = list(table.tags)
    names = [TIME, *tags, *fields]
    schema = table.schema

    def newest(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        known = held.get[0] if held.exists else None
        best = None
        for frame in frames:
            top = frame.sort_values(TIME, kind="stable").drop_duplicates(TIME).iloc[-1:]
            if (known is None or top[TIME].iloc[0] > known) and (best is None or top[TIME].iloc[0] > best[TIME].iloc[0]):
                best = top
        if best is not None:
            held.update((int(best[TIME].iloc[0]),))
        if idle is not None:
            held.setTimeoutDuration(idle)
        if best is not None:
            yield best[names]

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout
    return rows.select(*(F.col(f"`{n}`") for n in names)).groupBy(*(F.col(f"`{t}`") for t in tags)).applyInPandasWithState(newest, schema, "newest long", "update", timeout)
