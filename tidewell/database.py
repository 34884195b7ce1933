"""A database: tables in Parquet under a commit log, written and read through Spark."""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Iterable
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType

from .functions.time import hour_partition
from .model import SEQ, TIME, UINT, VISIBILITY, SchemaError, TableDef, declare
from .operators.dedup import last_write_wins
from .operators.lastvalue import last_values
from .operators.rollup import Rollup, RollupAgg, rollup_frame, sealed_range
from .operators.telemetry import parse_exposition
from .operators.tombstone import Tombstone, hide_deleted
from .operators.visibility import apply_visibility
from .sources import catalog
from .sources.catalog import FileMeta, Log, State
from .sources.frames import prepare_frame
from .sources.lineproto import Point, columns_of, read_bodies, to_line
from .sources.remote_write import decode_write_request, points_of, snappy_decompress

COMMIT = "_commit"
#: Distinct values of a tag from which a Bloom filter pays.
BLOOM_FROM = 1024
GC_GRACE = 900
NS_HOUR = 3_600 * 10**9
#: Rows from which a batch is laid out by rebalancing.
REBALANCE_FROM = 5_000_000
#: Files of an hour from which it is compacted.
MIN_FILES = 4
#: Scans whose file listings are kept; files never change, so a listing stays true.
KEPT_SCANS = 16


class Refused(ValueError):
    """A write or a command that cannot be taken."""


def apart(files: Iterable[FileMeta]) -> tuple[list[FileMeta], list[FileMeta]]:
    """Files that share no time with a file of another write, and the others. One write holds each key once."""
    hours: dict[str, list[FileMeta]] = {}
    for f in files:
        hours.setdefault(f.hour, []).append(f)
    alone, shared = [], []
    for own in hours.values():
        runs: list[list[FileMeta]] = []
        newest = None
        for f in sorted(own, key=lambda f: (f.min_ns, f.max_ns, f.path)):
            if newest is None or f.min_ns > newest:
                runs.append([])
                newest = f.max_ns
            runs[-1].append(f)
            newest = max(newest, f.max_ns)
        for run in runs:
            (alone if len({f.path.rsplit("/hour=", 1)[0] for f in run}) == 1 else shared).extend(run)
    return alone, shared


class Database:
    """One namespace below ``root``. Readers see a commit whole or not at all."""

    def __init__(self, spark: SparkSession, root: str, name: str) -> None:
        self.spark, self.name = spark, name
        self.root = f"{root.rstrip('/')}/{name}"
        self.log = Log(spark, f"{self.root}/manifest")
        self._scans: OrderedDict[tuple, DataFrame] = OrderedDict()

    # -- definitions -------------------------------------------------------

    def state(self) -> State:
        return self.log.state()

    def table(self, name: str) -> TableDef:
        tables = self.state().tables
        if name not in tables:
            raise Refused(f"no such table: {name}")
        return tables[name]

    def create_table(self, name: str, columns: list[dict]) -> TableDef:
        made = declare(name, columns)

        def entry(state: State, _: int) -> dict:
            if name in state.tables:
                raise Refused(f"table {name!r} exists")
            return {"table": catalog.table_entry(made)}

        self.log.commit(entry)
        return made

    def drop_table(self, name: str) -> None:
        """Files, declaration and deletes go at once; later writes start anew."""
        self.table(name)
        self.log.commit(lambda s, n: {"drop": name})

    def list_tables(self) -> DataFrame:
        rows = [(self.name, "public", t) for t in sorted(self.state().tables)]
        return self.spark.createDataFrame(rows, "table_catalog string, table_schema string, table_name string")

    def table_schema(self, name: str) -> DataFrame:
        rows = [(f.name, f.dataType.simpleString(), f.metadata["role"], f.nullable) for f in self.table(name).schema]
        return self.spark.createDataFrame(rows, "column_name string, data_type string, role string, is_nullable boolean")

    # -- writing -----------------------------------------------------------

    def write_lp(self, body: bytes | str, precision: str = "ns", now_ns: int | None = None) -> int:
        """A line protocol body, taken whole or refused; gzip is recognised. Returns the rows written.

        Lines without a time get the one time of this call.
        """
        raw = body.encode() if isinstance(body, str) else bytes(body)
        bodies = self.spark.createDataFrame([(0, bytearray(raw))], "body long, data binary")
        return self.write_bodies(bodies, precision, now_ns)

    def write_bodies(self, bodies: DataFrame, precision: str = "ns", now_ns: int | None = None) -> int:
        """Many bodies (body long, data binary) in one commit for each table; any bad one refuses all."""
        stamp = time.time_ns() if now_ns is None else now_ns
        points = read_bodies(bodies, precision, stamp).persist()
        try:
            if bad := points.where("error is not null").orderBy("body").select("error").first():
                raise Refused(bad.error)
            return self._write_points(points)
        finally:
            points.unpersist()

    def write_remote(self, body: bytes) -> int:
        """A remote write request. Zero rows are a success."""
        try:
            series = decode_write_request(snappy_decompress(body))
        except (ValueError, IndexError) as e:
            raise Refused(f"bad request: {e}") from None
        if any(not labels.get("__name__") for labels, _ in series):
            raise Refused("a series has no __name__")
        frame = self.spark.createDataFrame([(labels, samples) for labels, samples in series], "labels map<string,string>, samples array<struct<ms:long,value:double>>")
        points = points_of(frame).withColumn("body", F.lit(0)).withColumn("line", F.monotonically_increasing_id())
        empty = F.create_map().cast("map<string,string>")
        maps = {n: F.create_map().cast(f"map<string,{t}>") for n, t in (("ints", "bigint"), ("uints", "decimal(20,0)"), ("bools", "boolean"))}
        return self._write_points(points.withColumn("floats", F.create_map(F.lit("value"), "value")).withColumns(maps).withColumn("strings", empty))

    def write_exposition(self, text: str, node: str, now_ns: int) -> int:
        """Metrics in exposition text as rows of the table ``metrics``: a row for each label set, a float field for each metric."""
        lines = [to_line(Point("metrics", {"node": node, **{k: v for k, v in labels.items() if k != TIME}}, values, now_ns)) for labels, values in parse_exposition(text)]
        return self.write_lp("\n".join(filter(None, lines)))

    def _write_points(self, points: DataFrame) -> int:
        """Check every table of a batch, then commit them; nothing is written if one conflicts."""
        kinds = {"floats": DoubleType(), "ints": LongType(), "uints": UINT, "bools": BooleanType(), "strings": StringType()}
        first = F.struct("body", "line")
        seen = [points.select("table", first.alias("at"), F.lit("tags").alias("kind"), F.explode(F.map_keys("tags")).alias("name"))]
        seen += [points.select("table", first.alias("at"), F.lit(k).alias("kind"), F.explode(F.map_keys(k)).alias("name")) for k in kinds]
        union = seen[0]
        for s in seen[1:]:
            union = union.unionAll(s)
        columns = union.groupBy("table", "kind", "name").agg(F.min("at").alias("at")).orderBy("table", "at", "name").collect()
        state, plan = self.state(), {}
        for name in dict.fromkeys(c.table for c in columns):
            table = state.tables.get(name, TableDef(name))
            for c in (c for c in columns if c.table == name):
                tag = c.kind == "tags"
                table = table.merge((c.name,) if tag else (), {} if tag else {c.name: kinds[c.kind]})
            plan[name] = table
        return sum(self._append(columns_of(points, t), t) for t in plan.values())

    def ingest_dataframe(self, df: DataFrame, table: str, roles: dict[str, str] | None = None) -> int:
        """Append a DataFrame; see ``prepare_frame``."""
        rows, shape = prepare_frame(df, table, roles)
        merged = self.state().tables.get(table, TableDef(table)).merge(shape.tags, shape.field_types)
        return self._append(rows.withColumn(SEQ, F.monotonically_increasing_id()), merged)

    def _append(self, rows: DataFrame, table: TableDef, level: int = 0) -> int:
        written = 0

        def entry(state: State, number: int) -> dict | None:
            nonlocal written
            current = state.tables.get(table.name)
            merged = current.merge(table.tags, table.field_types) if current else table
            ready = last_write_wins(merged.conform(rows), merged.key).withColumn(COMMIT, F.lit(number).cast("long"))
            files = self._store(ready, merged, number, level, merged.tags)
            written = sum(f.rows for f in files)
            return {"add": [asdict(f) for f in files], "table": catalog.table_entry(merged)} if files or current is None else None

        self.log.commit(entry)
        return written

    def _store(self, rows: DataFrame, table: TableDef, number: int, level: int, sort: Iterable[str]) -> list[FileMeta]:
        """Files of rows, split by hour, in key order; what the log needs to know of them."""
        folder = f"{self.root}/data/{table.name}/{number:012d}-{level}-{time.time_ns()}"
        hours = rows.withColumn("hour", hour_partition(TIME)).persist()
        try:
            counts = hours.agg(F.count("*"), *(F.approx_count_distinct(f"`{t}`") for t in table.tags)).first()
            # A large batch is rebalanced, so that AQE splits a busy hour; in a small one tasks share the hours.
            tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            laid = hours.hint("rebalance", "hour") if counts[0] >= REBALANCE_FROM else hours.repartition(tasks, "hour")
            laid = laid.sortWithinPartitions("hour", *(F.col(f"`{c}`") for c in ([TIME, *sort] if not level else [*sort])))
            writer = laid.write.partitionBy("hour").option("compression", "snappy")
            for n, t in enumerate(table.tags, 1):
                if counts[n] >= BLOOM_FROM:
                    writer = writer.option(f"parquet.bloom.filter.enabled#{t}", "true").option(f"parquet.bloom.filter.expected.ndv#{t}", str(counts[n]))
            writer.parquet(folder)
        finally:
            hours.unpersist()
        fs = self.log.fs
        if not fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(folder)):
            return []
        stored = self.spark.read.schema(f"{TIME} long").option("recursiveFileLookup", "true").parquet(folder)
        found = stored.groupBy(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size")).agg(F.count("*").alias("rows"), F.min(TIME).alias("lo"), F.max(TIME).alias("hi")).collect()
        return [FileMeta(table.name, r.path.rsplit("hour=", 1)[1].split("/")[0], r.path, r.rows, r.size, r.lo, r.hi, level) for r in sorted(found, key=lambda r: r.path)]

    # -- reading -----------------------------------------------------------

    def _scan(self, table: TableDef, files: list[FileMeta]) -> DataFrame:
        schema = table.schema.add(SEQ, "long").add(COMMIT, "long")
        if not files:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f.path for f in files))

    def _kept_scan(self, table: TableDef, files: list[FileMeta]) -> DataFrame:
        """A scan whose files are listed once. Its columns are new each time, as those of two reads must differ."""
        key = (table.schema.json(), tuple(f.path for f in files))
        scan = self._scans.pop(key, None)
        self._scans[key] = scan = self._scan(table, files) if scan is None else scan
        while len(self._scans) > KEPT_SCANS:
            self._scans.popitem(last=False)
        return scan.select(*(F.col(f"`{c}`").alias(c) for c in scan.columns))

    def read(self, table: str, auths: Iterable[str] = (), start: int | None = None, end: int | None = None, dedup: bool = True, system: bool = False) -> DataFrame:
        """Rows that a reader may see. Labels and deletes are filters below whatever the caller adds.

        ``start`` and ``end`` (inclusive nanoseconds) leave out files by the
        log's times. ``dedup=False`` shows what compaction has not merged yet.
        Files that share no time with a file of another write need no merging.
        """
        state, shape = self.state(), self.table(table)
        files = [f for f in state.of(table) if (start is None or f.max_ns >= start) and (end is None or f.min_ns <= end)]
        stones = list(state.tombstones.get(table, {}).values())

        def seen(some: list[FileMeta]) -> DataFrame:
            rows = self._kept_scan(shape, some)
            if start is not None:
                rows = rows.where(F.col(TIME) >= start)
            if end is not None:
                rows = rows.where(F.col(TIME) <= end)
            rows = hide_deleted(rows, stones)
            return apply_visibility(rows, auths) if VISIBILITY in shape.tags else rows

        alone, shared = apart(files) if dedup else (files, [])
        rows = seen(alone) if alone or not shared else None
        if shared:
            merged = last_write_wins(seen(shared), shape.key, [COMMIT, SEQ])
            rows = merged if rows is None else rows.unionByName(merged)
        return rows if system else rows.select(*(f"`{c}`" for c in shape.columns))

    def probe(self, table: str) -> tuple[DataFrame, str | None]:
        """The table's columns over one of its files, and that file's path: enough to plan a query by."""
        files = self.state().of(table)[:1]
        shape = self.table(table)
        path = str(self.spark._jvm.org.apache.hadoop.fs.Path(files[0].path).toString()) if files else None
        return self._kept_scan(shape, files).select(*(f"`{c}`" for c in shape.columns)), path

    def last_cache(self, table: str, auths: Iterable[str] = ()) -> DataFrame:
        """The newest row of each series; just an empty ``time`` where the cache is off or the table unknown."""
        state = self.state()
        if table not in state.last_cache or table not in state.tables:
            return self.spark.createDataFrame([], f"{TIME} long")
        rows = self.read(table, auths, system=True).withColumn(SEQ, F.col(COMMIT) * (1 << 40) + F.pmod(SEQ, F.lit(1 << 40)))
        return last_values(rows, state.tables[table], state.last_cache[table])

    def enable_last_cache(self, table: str, cap: int = 100_000) -> None:
        self.log.commit(lambda s, n: {"last_cache": {table: cap}})

    def disable_last_cache(self, table: str) -> None:
        self.log.commit(lambda s, n: {"last_cache": {table: None}})

    # -- deletes, retention, compaction -------------------------------------

    def delete_where(self, table: str, tags: dict[str, str] | None = None, start: int | None = None, end: int | None = None) -> str:
        """A standing delete; the same one twice is one. Returns its id."""
        self.table(table)
        stone = Tombstone(tuple(sorted((tags or {}).items())), start, end)
        body = {"tombstone": {"table": table, "tags": [list(t) for t in stone.tags], "start": start, "end": end}}
        self.log.commit(lambda s, n: None if stone.id in s.tombstones.get(table, {}) else body)
        return stone.id

    def _rewrite(self, table: TableDef, files: list[FileMeta], rows: DataFrame, sort: list[str]) -> bool:
        """Replace files by ``rows``, unless one of them is gone meanwhile."""
        paths = [f.path for f in files]

        def entry(state: State, number: int) -> dict | None:
            if any(p not in state.files for p in paths):
                raise catalog.Conflict("an input of the rewrite is gone")
            new = self._store(rows, table, number, 1, sort)
            return {"remove": paths, "add": [asdict(f) for f in new]}

        return self.log.commit(entry) is not None

    def compact(self, min_files: int = MIN_FILES, most: int = 8) -> int:
        """Merge the files of up to ``most`` partitions: last write wins, clustered by the tag of most values."""
        state = self.state()
        listed = catalog.compaction_candidates(self.files(), min_files).limit(most).collect()
        for c in listed:
            table = state.tables[c.table]
            files = [f for f in state.of(c.table) if f.hour == c.hour]
            rows = last_write_wins(self._scan(table, files), table.key, [COMMIT, SEQ])
            self._rewrite(table, files, rows, self.clustering(rows, table))
        return len(listed)

    def clustering(self, rows: DataFrame, table: TableDef) -> list[str]:
        """Sort order of settled files: the tag of most values (of equals the greatest name), time, the other tags."""
        if not table.tags:
            return [TIME]
        counts = rows.agg(*(F.approx_count_distinct(f"`{t}`").alias(f"n{n}") for n, t in enumerate(table.tags))).first()
        _, lead = max((counts[n], t) for n, t in enumerate(table.tags))
        return [lead, TIME, *(t for t in table.tags if t != lead)]

    def purge_deleted(self, most: int = 16) -> int:
        """Rewrite files that hold deleted rows, without them. Deletes keep standing. Returns the files rewritten."""
        state, done = self.state(), 0
        for name, stones in state.tombstones.items():
            table = state.tables[name]
            live = list(stones.values())
            for f in state.of(name):
                if done >= most or not any((t.start is None or t.start <= f.max_ns) and (t.end is None or t.end >= f.min_ns) for t in live):
                    continue
                rows = self._scan(table, [f])
                kept = hide_deleted(rows, live)
                if kept.count() < f.rows:
                    done += self._rewrite(table, [f], kept, self.clustering(rows, table))
        return done

    def set_retention(self, table: str, seconds: int) -> None:
        if seconds <= 0:
            raise Refused("retention must be positive")
        for r in self._rollups():
            if r.source == table and r.grace >= seconds:
                raise Refused(f"rollup {r.name!r} looks back {r.grace} s, further than the retention")
        self.log.commit(lambda s, n: {"retention": {table: seconds}})

    def remove_retention(self, table: str) -> None:
        self.log.commit(lambda s, n: {"retention": {table: None}})

    def retain(self, now_ns: int) -> int:
        """Drop the files of hours before each table's window. Returns how many."""
        state = self.state()
        first = {t: (now_ns - s * 10**9) // NS_HOUR * NS_HOUR for t, s in state.retention.items()}
        gone = [f.path for f in state.files.values() if f.table in first and f.max_ns < first[f.table]]
        if gone:
            self.log.commit(lambda s, n: {"remove": gone})
        return len(gone)

    def gc(self, now: float | None = None, grace: float = GC_GRACE) -> int:
        """Delete files that left the log longer ago than ``grace``, which must exceed the longest query."""
        now = time.time() if now is None else now
        old = [p for p, at in self.state().removed.items() if now - at > grace]
        for p in old:
            self.log.fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(p), False)
        if old:
            self.log.commit(lambda s, n: {"forget": old})
        return len(old)

    def files(self) -> DataFrame:
        return catalog.files_frame(self.spark, self.name, list(self.state().files.values()))

    # -- rollups -------------------------------------------------------------

    def set_rollup(self, rollup: Rollup) -> None:
        kept = self.state().retention.get(rollup.source)
        if kept is not None and kept <= rollup.grace:
            raise Refused("the source is not retained as long as the rollup looks back")
        body = asdict(rollup)
        self.log.commit(lambda s, n: {"rollups": {rollup.name: body}})

    def remove_rollup(self, name: str) -> None:
        self.log.commit(lambda s, n: {"rollups": {name: None}})

    def _rollups(self) -> list[Rollup]:
        made = []
        for body in self.state().rollups.values():
            aggs = tuple(RollupAgg(**a) for a in body["aggregates"])
            made.append(Rollup(**body | {"aggregates": aggs, "group_by": tuple(body["group_by"])}))
        return made

    def materialize(self, now_ns: int) -> dict[str, int | str]:
        """Seal what is due: rows written by rollup, or the error of one that failed. Only public rows count."""
        out: dict[str, int | str] = {}
        for r in self._rollups():
            try:
                out[r.name] = self._materialize(r, now_ns)
            except (ValueError, RuntimeError) as e:
                out[r.name] = str(e)
        return out

    def _materialize(self, r: Rollup, now_ns: int) -> int:
        tables = self.state().tables
        if r.source not in tables:
            return 0
        newest = max((f.max_ns for f in self.state().of(r.into)), default=None)
        due = sealed_range(r, now_ns, newest)
        if due is None:
            return 0
        source = self.read(r.source, (), start=due[0], end=due[1] - 1, system=True)
        table = tables[r.source]
        rows = rollup_frame(source, table, r, *due)
        aggs = {a.output for a in r.aggregates}
        rows = rows.select(*(F.col(c).cast("double").alias(c) if k.startswith("decimal") and c in aggs else F.col(c) for c, k in rows.dtypes))
        # A value that is not finite is left out, and so is a row without any value.
        finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c)).alias(c)
        rows = rows.select(*(finite(c) if k == "double" and c in aggs else F.col(c) for c, k in rows.dtypes)).where(" or ".join(f"`{a}` is not null" for a in sorted(aggs)))
        return self.ingest_dataframe(rows, r.into, {c: "tag" if c not in aggs else "field" for c in rows.columns if c != TIME})


def list_databases(spark: SparkSession, root: str) -> DataFrame:
    """(database): the namespaces below ``root``."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.listStatus(path) if fs.exists(path) else []
    return spark.createDataFrame([(s.getPath().getName(),) for s in sorted(found, key=lambda s: s.getPath().getName()) if s.isDirectory()], "database string")


__all__ = ["Database", "Refused", "SchemaError", "list_databases"]
