"""The commit log: which files, tables, deletes and policies a database has.

An append-only run of numbered JSON entries in one folder. An entry appears by
a rename that fails if its number is taken, so of two writers one wins and the
other tries again. The state is the fold of all entries; it holds one record
for each live file and is small next to the data.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import TableDef, declare
from ..operators.tombstone import Tombstone


class Conflict(RuntimeError):
    """Another writer took the number, or an input of a rewrite is gone."""


@dataclass(frozen=True)
class FileMeta:
    table: str
    hour: str
    path: str
    rows: int
    size: int
    min_ns: int
    max_ns: int
    level: int
    seq: int = 0


@dataclass
class State:
    """What the log says. ``head`` is the number of its last entry."""

    head: int = 0
    files: dict[str, FileMeta] = field(default_factory=dict)
    tables: dict[str, TableDef] = field(default_factory=dict)
    tombstones: dict[str, dict[str, Tombstone]] = field(default_factory=dict)
    retention: dict[str, int] = field(default_factory=dict)
    rollups: dict[str, dict] = field(default_factory=dict)
    last_cache: dict[str, int] = field(default_factory=dict)
    removed: dict[str, float] = field(default_factory=dict)

    def of(self, table: str) -> list[FileMeta]:
        return sorted((f for f in self.files.values() if f.table == table), key=lambda f: (f.seq, f.path))


def _table(entry: dict) -> TableDef:
    base = declare(entry["name"], [{"name": t, "type": "string", "tag": True} for t in entry["tags"]] + [{"name": n, "type": k} for n, k in entry["fields"]])
    return TableDef(base.name, base.tags, base.fields, entry["declared"])


_TYPES = {"double": "float", "bigint": "int", "decimal(20,0)": "uint", "boolean": "bool", "string": "string"}


def table_entry(t: TableDef) -> dict:
    return {"name": t.name, "tags": list(t.tags), "fields": [[n, _TYPES[k.simpleString()]] for n, k in t.fields], "declared": t.declared}


class Log:
    """The entries below ``folder``, on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        jvm = spark._jvm
        self.spark, self.folder = spark, folder.rstrip("/")
        self.path = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        self.fs = self.path("x").getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.mkdirs(jvm.org.apache.hadoop.fs.Path(self.folder))
        self.known = State()

    def append(self, number: int, entry: dict) -> None:
        """Write entry ``number`` or raise ``Conflict``."""
        draft, final = self.path(f".{uuid.uuid4().hex}.draft"), self.path(f"{number:012d}.json")
        out = self.fs.create(draft, True)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, final, none)
        except Exception as e:
            self.fs.delete(draft, False)
            if self.fs.exists(final):
                raise Conflict(f"entry {number} is taken") from None
            raise RuntimeError(f"entry {number} could not be written") from e

    def state(self) -> State:
        """The fold of all entries; those read before are not read again."""
        s = self.known
        while self.fs.exists(final := self.path(f"{s.head + 1:012d}.json")):
            stream = self.fs.open(final)
            raw = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            stream.close()
            apply(s, json.loads(raw), s.head + 1)
        return s

    def commit(self, make: Callable[[State, int], dict | None], tries: int = 20) -> int | None:
        """Append what ``make(state, number)`` gives, anew whenever another writer was first. None: nothing to do."""
        for _ in range(tries):
            state = self.state()
            entry = make(state, state.head + 1)
            if entry is None:
                return None
            try:
                self.append(state.head + 1, {"at": time.time()} | entry)
            except Conflict:
                continue
            return self.state().head
        raise Conflict("other writers were always first")


def apply(s: State, entry: dict, number: int) -> None:
    """Fold one entry into the state."""
    if "drop" in entry:
        name = entry["drop"]
        for path in [p for p, f in s.files.items() if f.table == name]:
            s.removed[path] = entry["at"]
            del s.files[path]
        for held in (s.tables, s.tombstones, s.last_cache):
            held.pop(name, None)
    for path in entry.get("remove", ()):
        if s.files.pop(path, None):
            s.removed[path] = entry["at"]
    for f in entry.get("add", ()):
        s.files[f["path"]] = FileMeta(**f | {"seq": f.get("seq") or number})
    if "table" in entry:
        s.tables[entry["table"]["name"]] = _table(entry["table"])
    if "tombstone" in entry:
        t = entry["tombstone"]
        stone = Tombstone(tuple(map(tuple, t["tags"])), t["start"], t["end"])
        s.tombstones.setdefault(t["table"], {})[stone.id] = stone
    for held, key in ((s.retention, "retention"), (s.rollups, "rollups"), (s.last_cache, "last_cache")):
        for name, value in entry.get(key, {}).items():
            if value is None:
                held.pop(name, None)
            else:
                held[name] = value
    for path in entry.get("forget", ()):
        s.removed.pop(path, None)
    s.head = number


def files_frame(spark: SparkSession, db: str, files: list[FileMeta]) -> DataFrame:
    """The catalog as a table, for queries over it."""
    rows = [(db, *asdict(f).values()) for f in files]
    return spark.createDataFrame(rows, "db string, table string, hour string, path string, rows long, size long, min_ns long, max_ns long, level int, seq long")


def storage_summary(files: DataFrame) -> DataFrame:
    """(db, table, files, bytes, rows)."""
    return files.groupBy("db", "table").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.sum("rows").alias("rows"))


def level_counts(files: DataFrame) -> DataFrame:
    """(db, table, level, files)."""
    return files.groupBy("db", "table", "level").agg(F.count("*").alias("files"))


def compaction_candidates(files: DataFrame, min_files: int = 4) -> DataFrame:
    """(db, table, hour, files, overlaps): partitions worth compacting, most urgent first.

    A partition qualifies by its number of files, or if two of them overlap in
    time; touching ends do not overlap. Those that overlap come first, then
    those of most files.
    """
    by = Window.partitionBy("db", "table", "hour").orderBy("min_ns", "max_ns", "path").rowsBetween(Window.unboundedPreceding, -1)
    rows = files.withColumn("hit", F.coalesce(F.col("min_ns") < F.max("max_ns").over(by), F.lit(False)))
    out = rows.groupBy("db", "table", "hour").agg(F.count("*").alias("files"), F.max("hit").alias("overlaps"))
    return out.where((F.col("files") >= max(2, min_files)) | F.col("overlaps")).orderBy(F.desc("overlaps"), F.desc("files"), "db", "table", "hour")


def expired(files: DataFrame, policies: DataFrame) -> DataFrame:
    """Files whose hour lies before their policy's first kept hour (``policies``: db, table, first_hour). A policy for a database beats one for ``*``."""
    own = policies.where("db <> '*'").select("db", "table", F.col("first_hour").alias("own"))
    every = policies.where("db = '*'").select("table", F.col("first_hour").alias("every"))
    rows = files.join(own, ["db", "table"], "left").join(every, "table", "left")
    return rows.where(F.col("hour") < F.coalesce("own", "every")).select(*files.columns)
