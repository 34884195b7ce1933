"""Running SQL under the rules of a shared server."""

from __future__ import annotations

import re
import threading
import time
import uuid
from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from ..functions.time import ns_to_timestamp, register_sql_functions
from ..model import TIME
from .guard import GuardError, Relation, check_read_only, rename_relations

DEADLINE, ROW_CAP, CONCURRENT, PER_CLIENT = 600.0, 1_000_000, 6, 4


class QueryError(RuntimeError):
    """What a client may know of a failure. ``outcome``: refused, timeout or failed."""

    def __init__(self, message: str, outcome: str = "failed") -> None:
        super().__init__(message)
        self.outcome = outcome


@dataclass(frozen=True)
class Session:
    """Who asks: a name (None: anonymous) and what they may see."""

    identity: str | None = None
    auths: frozenset[str] = frozenset()


def narrow(claimed: Iterable[str], *grants: Iterable[str] | None) -> frozenset[str]:
    """Claims within every grant that is given: grants only ever take away."""
    out = frozenset(claimed)
    for g in grants:
        if g is not None:
            out &= frozenset(g)
    return out


def authorize(mode: str, scopes: set[str] | None, databases: set[str] | None, need: str, db: str) -> bool:
    """May a caller do ``need`` (read or write) on ``db``? ``scopes`` is None without credentials.

    Modes: ``off`` lets all through; ``optional`` lets callers without
    credentials through; ``required`` does not. ``databases`` None means all.
    """
    if mode == "off":
        return True
    if scopes is None:
        return mode == "optional"
    return need in scopes and (databases is None or db in databases)


@dataclass
class Runner:
    """``database_of`` finds a database by name, or gives None."""

    spark: SparkSession
    database_of: Callable[[str], object | None]
    row_cap: int = ROW_CAP
    deadline: float = DEADLINE
    concurrent: int = CONCURRENT
    per_client: int = PER_CLIENT
    history: list[dict] = field(default_factory=list)

    def __post_init__(self) -> None:
        self._slots = threading.BoundedSemaphore(self.concurrent)
        self._lock, self._running = threading.Lock(), Counter()

    def run(self, sql: str, db: str = "poc", session: Session = Session()) -> DataFrame:
        """The rows of a query, already computed and no more than the cap: beyond it the query is refused, not cut.

        Each query is accounted once, however it ends.
        """
        who, began, outcome, rows, ref = session.identity, time.monotonic(), "failed", 0, f"q-{uuid.uuid4().hex[:8]}"
        waited = 0.0
        self._enter(who)
        try:
            self._slots.acquire()
            waited = time.monotonic() - began
            try:
                out = self._run(sql, db, session, ref)
                rows, outcome = out.count(), "ok"
                return out
            finally:
                self._slots.release()
        except QueryError as e:
            outcome = e.outcome
            raise
        except GuardError as e:
            outcome = "refused"
            raise QueryError(str(e), outcome) from None
        except (PySparkException, ValueError, RuntimeError) as e:
            if "Py4J" in type(e).__name__ or not isinstance(e, QueryError):
                raise QueryError(f"the query failed, ref: {ref}") from e
            raise
        finally:
            with self._lock:
                if who is not None:
                    self._running[who] -= 1
                self.history.append({"time": time.time_ns(), "db": db, "identity": who, "outcome": outcome, "duration_ms": (time.monotonic() - began) * 1000, "wait_ms": waited * 1000, "rows": rows, "ref": ref})

    def record(self, system, node: str = "local") -> int:
        """Move the accounts into the table ``queries`` of the database ``system``; anonymous ones have no identity."""
        with self._lock:
            done, self.history = self.history, []
        if not done:
            return 0
        schema = "time long, node string, db string, outcome string, identity string, duration_ms double, wait_ms double, rows long, ref string"
        frame = self.spark.createDataFrame([(h["time"], node, h["db"], h["outcome"], h["identity"], h["duration_ms"], h["wait_ms"], h["rows"], h["ref"]) for h in done], schema)
        return system.ingest_dataframe(frame, "queries", {"ref": "field"})

    def _enter(self, who: str | None) -> None:
        with self._lock:
            if who is not None and self.per_client and self._running[who] >= self.per_client:
                raise QueryError("too many queries at once", "refused")
            if who is not None:
                self._running[who] += 1

    def _run(self, sql: str, db: str, session: Session, ref: str) -> DataFrame:
        home = self.database_of(db)
        if home is None:
            raise QueryError(f"no such database: {db}", "refused")
        own = self.spark.newSession()
        for key, value in (("spark.sql.runSQLOnFiles", "false"), ("spark.sql.ansi.doubleQuotedIdentifiers", "true"), ("spark.sql.session.timeZone", "UTC")):
            own.conf.set(key, value)
        register_sql_functions(own)
        sql = _listing(sql)
        relations = check_read_only(own, sql)
        bounds = self._bounds(own, sql, relations, home, db, session) if re.search("time", sql, re.I) else {}
        text = self._named(own, sql, relations, lambda r: self._frame(home, db, r, session, bounds))
        own.sparkContext.addJobTag(ref)
        timer = threading.Timer(self.deadline, lambda: own.sparkContext.cancelJobsWithTag(ref))
        started = time.monotonic()
        timer.start()
        try:
            capped = own.sql(text).limit(self.row_cap + 1)
            table = capped.toArrow()
        except Exception:
            if time.monotonic() - started >= self.deadline:
                raise QueryError(f"the query took more than {self.deadline:g} s", "timeout") from None
            raise
        finally:
            timer.cancel()
            own.sparkContext.removeJobTag(ref)
        if table.num_rows > self.row_cap:
            raise QueryError(f"the result has more than {self.row_cap} rows", "refused")
        return own.createDataFrame(table, capped.schema) if table.num_rows else own.createDataFrame([], capped.schema)

    def _named(self, own: SparkSession, sql: str, relations: list[Relation], frame_of: Callable[[Relation], DataFrame | None]) -> str:
        """The query over views in ``own``, one for each relation that ``frame_of`` knows."""
        views: dict[tuple, str] = {}

        def name_of(r: Relation) -> str | None:
            key = (r.parts, r.literals)
            if key not in views:
                frame = frame_of(r)
                if frame is None:
                    return None
                views[key] = f"t_{uuid.uuid4().hex}" if r.literals is not None or len(r.parts) > 1 else r.parts[-1]
                _in_session(own, frame).createOrReplaceTempView(f"`{views[key]}`")
            return f"`{views[key]}`" if len(r.parts) > 1 or r.literals is not None else None

        return rename_relations(sql, relations, name_of)

    def _bounds(self, own: SparkSession, sql: str, relations: list[Relation], home, db: str, session: Session) -> dict[tuple, tuple]:
        """By relation the nanoseconds that the query can need of it, as the optimizer's filters say over one file of each table."""
        paths: dict[tuple, str] = {}

        def frame_of(r: Relation) -> DataFrame | None:
            if r.literals is not None or (held := self._home_of(home, db, r)) is None:
                return self._frame(home, db, r, session)
            frame, path = held.probe(r.parts[-1])
            if path is not None:
                paths[r.parts] = path
            return with_timestamp(frame)

        text = self._named(own, sql, relations, frame_of)
        try:
            found = time_bounds(own.sql(text)._jdf.queryExecution().optimizedPlan())
        except PySparkException:  # the query itself will say what is wrong
            return {}
        return {parts: found[path] for parts, path in paths.items() if path in found}

    def _home_of(self, home, db: str, r: Relation):
        """The database of a stored table; None for the listings of ``information_schema``."""
        parts = [p.lower() for p in r.parts]
        if parts[-2:] in (["information_schema", "tables"], ["information_schema", "columns"]):
            return None
        if len(parts) == 2 and parts[0] not in ("public", db.lower()) or len(parts) == 3 and parts[1] != "public" or len(parts) > 3:
            home = self.database_of(r.parts[0]) if len(parts) == 2 else None
        elif len(parts) == 3:
            home = self.database_of(r.parts[0])
        if home is None or r.parts[-1] not in home.state().tables:
            raise QueryError(f"no such table: {'.'.join(r.parts)}", "refused")
        return home

    def _frame(self, home, db: str, r: Relation, session: Session, bounds: dict[tuple, tuple] = {}) -> DataFrame | None:
        if r.literals is not None:
            return with_timestamp(home.last_cache(r.literals[0], session.auths))
        held = self._home_of(home, db, r)
        if held is None:
            return home.list_tables() if r.parts[-1].lower() == "tables" else _columns(home)
        start, end = bounds.get(r.parts, (None, None))
        return with_timestamp(held.read(r.parts[-1], session.auths, start=start, end=end))


_SHOW = re.compile(r"\s*SHOW\s+TABLES\s*;?\s*", re.I)
_DESCRIBE = re.compile(r'\s*DESC(?:RIBE)?\s+(?:TABLE\s+)?(?:\w+\.)*"?([\w.-]+?)"?\s*;?\s*', re.I)


def _listing(sql: str) -> str:
    """SHOW TABLES and DESCRIBE as queries over the database's own tables, not over Spark's catalog."""
    if _SHOW.fullmatch(sql):
        return "SELECT * FROM information_schema.tables"
    if m := _DESCRIBE.fullmatch(sql):
        return f"SELECT column_name, data_type FROM information_schema.columns WHERE table_name = '{m[1]}' ORDER BY ordinal_position"
    return sql


def _columns(home) -> DataFrame:
    rows = [(home.name, "public", t, f.name, n, f.dataType.simpleString()) for t, d in sorted(home.state().tables.items()) for n, f in enumerate(d.schema, 1)]
    return home.spark.createDataFrame(rows, "table_catalog string, table_schema string, table_name string, column_name string, ordinal_position int, data_type string")


def _in_session(session: SparkSession, df: DataFrame) -> DataFrame:
    """The same plan in another session of one application."""
    moved = session._jvm.org.apache.spark.sql.classic.Dataset.ofRows(session._jsparkSession, df._jdf.logicalPlan())
    return DataFrame(moved, session)


#: ``time`` of ``with_timestamp`` as the optimizer writes it, without expression ids.
_TIME_AS_TIMESTAMP = f"timestamp_micros((({TIME} - pmod({TIME}, 1000)) div 1000))"
#: What a query's clock may move between two plans of it.
_CLOCK_NS = 600 * 10**9
_FLIPPED = {"GreaterThan": "LessThan", "GreaterThanOrEqual": "LessThanOrEqual", "LessThan": "GreaterThan", "LessThanOrEqual": "GreaterThanOrEqual", "EqualTo": "EqualTo"}


def time_bounds(plan) -> dict[str, tuple[int | None, int | None]]:
    """By path of a scanned file the nanoseconds, both ends included, outside of which no scan of it needs rows.

    ``plan`` is an optimized plan. A scan without a filter right above it needs
    all; of several scans the widest counts. The end has ``_CLOCK_NS`` to spare.
    """
    out: dict[str, tuple[int | None, int | None]] = {}

    def kids(node) -> list:
        return [s.apply(n) for s in (node.children(), node.subqueries(), node.innerChildren()) for n in range(s.size())]

    def widen(path: str, start: int | None, end: int | None) -> None:
        old = out.get(path, (start, end))
        out[path] = (None if None in (start, old[0]) else min(start, old[0]), None if None in (end, old[1]) else max(end, old[1]))

    held = [(plan, (None, None))]
    while held:
        node, bounds = held.pop()
        name = node.nodeName()
        if name == "LogicalRelation":
            paths = node.relation().location().rootPaths()
            widen(paths.apply(0).toString(), *bounds)
        of = _condition_bounds(node.condition()) if name == "Filter" else (None, None)
        held += [(k, of) for k in kids(node)] if name != "Filter" else [(node.child(), of), *((s, (None, None)) for s in kids(node)[1:])]
    return out


def _condition_bounds(condition) -> tuple[int | None, int | None]:
    name = condition.getClass().getSimpleName()
    if name == "And":
        (a, b), (c, d) = (_condition_bounds(x) for x in (condition.left(), condition.right()))
        return max((x for x in (a, c) if x is not None), default=None), min((x for x in (b, d) if x is not None), default=None)
    if name not in _FLIPPED:
        return None, None
    column, literal = condition.left(), condition.right()
    if column.getClass().getSimpleName() == "Literal":
        column, literal, name = literal, column, _FLIPPED[name]
    if literal.getClass().getSimpleName() != "Literal" or not isinstance(value := literal.value(), int):
        return None, None
    shown, kind = re.sub(r"#\d+L?", "", column.toString()), literal.dataType().simpleString()
    if shown == _TIME_AS_TIMESTAMP and kind == "timestamp":
        low, high = value * 1000, value * 1000 + 999
    elif shown == TIME and kind == "bigint":
        low = high = value
    else:
        return None, None
    bound = lambda x: min(max(x, -(1 << 63)), (1 << 63) - 1)
    low, high = bound(low), bound(high + _CLOCK_NS)
    return (None if name.startswith("Less") else low), (None if name.startswith("Greater") else high)


def with_timestamp(df: DataFrame) -> DataFrame:
    """``time`` as a timestamp, for SQL; ``time_ns`` keeps the nanoseconds."""
    if TIME not in df.columns:
        return df
    cols = [ns_to_timestamp(TIME).alias(TIME), *(F.col(f"`{c}`") for c in df.columns if c != TIME)]
    return df.select(*cols, *([F.col(TIME).alias("time_ns")] if len(df.columns) > 1 else []))


def result_json(df: DataFrame) -> DataFrame:
    """(json): nulls and non-finite numbers as null, timestamps as text in UTC."""
    cols = []
    for f in df.schema:
        col = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (DoubleType, FloatType)):
            col = F.when(~F.isnan(col) & (F.abs(col) != float("inf")), col)
        cols.append(col.alias(f.name))
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"}).alias("json"))
