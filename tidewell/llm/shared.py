"""Helpers that several of the training-data operators use."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one step of an Arrow function holds at once.
STEP_BYTES = 4 << 20

_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Folders written so far, each with the owner it was written for.
_scratch: list[tuple[str | None, str]] = []
_owner: str | None = None


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the session names in ``spark.checkpoint.dir``.

    Only a local session may leave it unset (tests); it then gets a folder of
    its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidewell-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def fresh_name() -> str:
    return uuid.uuid4().hex


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder name below the shared folder."""
    path = f"{scratch_root(spark)}/{label}-{fresh_name()}"
    _scratch.append((_owner, path))
    return path


@contextmanager
def scratch_owner(name: str) -> Iterator[None]:
    """Scratch data written meanwhile is for ``name``, which may release it."""
    global _owner
    before, _owner = _owner, name
    try:
        yield
    finally:
        _owner = before


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here,
    and a lost executor costs no recomputation of what stands before. What the
    write has shuffled is deleted at its end, as it is not read again."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def release_scratch(spark: SparkSession, owner: str) -> None:
    """Delete what ``staged`` has written for ``owner``; results built on it must be stored by now."""
    conf = spark._jsc.hadoopConfiguration()
    for entry in [e for e in _scratch if e[0] == owner]:
        path = spark._jvm.org.apache.hadoop.fs.Path(entry[1])
        path.getFileSystem(conf).delete(path, True)
        _scratch.remove(entry)


def steps(batch: pa.RecordBatch, column: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose ``column`` holds about ``limit`` bytes; a longer value stands alone."""
    if not batch.num_rows:
        return
    col = batch.column(column)
    ends = text_offsets(col)[1:]
    start, base = 0, int(text_offsets(col)[0])
    while start < len(ends):
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        base, start = int(ends[stop - 1]), stop
    tidy()


def tidy() -> None:
    """Give memory that Arrow and the C library keep for reuse back to the system: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def text_offsets(col: pa.Array) -> np.ndarray:
    """Offsets of a string or binary array into its data buffer, as int64."""
    large = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    kind = np.int64 if large else np.int32
    return np.frombuffer(col.buffers()[1], kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array without nulls, and each value's bounds in them."""
    offsets = text_offsets(col)
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values[offsets[i]:offsets[i + 1]]`` for each i; empty runs give 0."""
    out = np.zeros(len(offsets) - 1, np.int64)
    full = offsets[1:] > offsets[:-1]
    if full.any():
        out[full] = np.add.reduceat(values, offsets[:-1][full], dtype=np.int64)
    return out


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the runs ``starts[i] : starts[i] + lengths[i]``, one after another."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()), dtype=np.int64)


def by_lists(lists: DataFrame, walk: Callable[..., Iterator[tuple]], schema: str = "a long, b long") -> DataFrame:
    """What ``walk`` finds in lists: rows of equal first column, which must stand together in a partition.

    ``walk`` gets the columns of many whole lists, sorted by their first two, and yields columns.
    """
    names = [x.split()[0] for x in schema.split(", ")]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            cols = new if held is None else [np.concatenate(x) for x in zip(held, new)]
            change = np.flatnonzero(cols[0][1:] != cols[0][:-1])
            cut = int(change[-1]) + 1 if len(change) else 0
            held = [c[cut:] for c in cols]
            if cut:
                yield from out([c[:cut] for c in cols])
        if held is not None and len(held[0]):
            yield from out(held)

    def out(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((cols[1], cols[0]))
        for found in walk(*(c[order] for c in cols)):
            if len(found[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], names)

    return lists.mapInArrow(of, schema)


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z and nothing else, in the JVM.

    ``lower`` equals that for pure ASCII and wherever it changes nothing; only
    what is left goes through the slower character map.
    """
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).when(F.lower(col) == col, col).otherwise(F.translate(col, upper, upper.lower()))


def connected_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """Connected components of ``edges`` (a long, b long) as (node, root), root being the smallest node.

    Alternates large-star and small-star steps until the edges stop changing;
    every round is staged in the shared folder. Work is joins and minima on
    node ids only, so a hot node is a skewed join that AQE splits. Nodes
    without an edge to another node have no row. Null ends are ignored.
    """
    live = edges.where("a is not null and b is not null and a <> b")
    now = staged(live.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), label)
    before = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if mark == before or not mark[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(now.select("v", "v").distinct()).distinct() if mark[0] else now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = mark
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = staged(small.unionAll(small_least.select("u", F.col("m").alias("v"))).distinct(), label)
