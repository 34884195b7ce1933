"""Registered queries over the engine's own operators, with DuckDB SQL for each.

``events`` stands in for the main time series: ``ts`` is its time, the event
type its step, the user its entity. Clocks are fixed. Where Spark and DuckDB
read one text alike, that text serves both.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import date_bin, hour_partition, timestamp_to_ns
from .model import SEQ, TIME, TableDef
from .operators import Rollup, RollupAgg, Tombstone, apply_visibility, hide_deleted, histogram_quantile, last_values, last_write_wins, rollup_frame, sealed_range
from .operators.telemetry import histogram
from .sources.catalog import compaction_candidates, expired, level_counts, storage_summary
from .sources.frames import prepare_frame
from .sources.lineproto import columns_of, read_bodies, to_lines
from .sources.remote_write import points_of

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def shared(name: str, sql: str, duck: str | None = None) -> None:
    """A query that is SQL text; ``duck`` where DuckDB spells it otherwise."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for t in TABLES:
            if t in sql:
                table(spark, sf_dir, t).createOrReplaceTempView(t)
        return spark.sql(sql)

    QUERIES[name], SQL[name] = run, duck or sql


def series(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, TableDef]:
    """``events`` as a table of time, tags and fields."""
    e = table(spark, sf_dir, "events")
    rows = e.select(F.col("ts").alias(TIME), F.col("event_type").alias("step"), F.col("user_id").cast("string").alias("entity"), "value", F.col("event_id").alias("n"))
    return prepare_frame(rows, "pipeline_events")


NS = "epoch_us(ts) * 1000"
CLOCK_NS = 1_706_659_200_000_000_000  # 2024-01-31 00:00:00 UTC

# -- projections, filters, aggregates, windows, sorts -------------------------

shared("funnel_distinct", "SELECT event_type AS step, COUNT(DISTINCT user_id) AS entities FROM events WHERE value > 0 GROUP BY event_type")
shared("distinct_single", "SELECT COUNT(DISTINCT user_id) AS entities FROM events WHERE event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-15 00:00:00'")
shared("distinct_concat", "SELECT COUNT(DISTINCT event_type || '-' || CAST(user_id AS VARCHAR(20))) AS pairs FROM events")
shared("in_flight_by_step", "SELECT event_type AS step, SUM(CASE WHEN user_id % 2 = 0 THEN 1 ELSE 0 END) - SUM(CASE WHEN user_id % 2 = 1 THEN 1 ELSE 0 END) AS in_flight FROM events GROUP BY event_type", "SELECT event_type AS step, CAST(SUM(CASE WHEN user_id % 2 = 0 THEN 1 ELSE 0 END) - SUM(CASE WHEN user_id % 2 = 1 THEN 1 ELSE 0 END) AS BIGINT) AS in_flight FROM events GROUP BY event_type")
shared("entity_history", "SELECT ts, event_type AS step, value FROM events WHERE user_id = 7 ORDER BY ts")
shared("entity_status", "SELECT CASE WHEN MAX(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) = 1 THEN 'failed' WHEN MAX(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) = 1 THEN 'done' ELSE 'running' END AS status FROM events WHERE user_id = 11")
shared("entity_step_summary", "SELECT event_type AS step, MIN(ts) AS first_at, MAX(ts) AS last_at, COUNT(*) AS n, SUM(value) AS total FROM events WHERE user_id = 3 GROUP BY event_type ORDER BY 2")
shared("events_per_hour_intdiv", "SELECT COUNT(*) div 24 AS per_hour FROM events WHERE ts >= TIMESTAMP '2024-01-30 00:00:00'", "SELECT COUNT(*) // 24 AS per_hour FROM events WHERE ts >= TIMESTAMP '2024-01-30 00:00:00'")
shared("predicates", "SELECT event_id FROM events WHERE (event_type IN ('click', 'view') OR event_type LIKE 'sign%') AND NOT value BETWEEN 10 AND 20 AND user_id > 5")
shared("select_distinct", "SELECT DISTINCT event_type AS step FROM events")
shared("min_max_text_time", "SELECT MIN(event_type) AS lo, MAX(event_type) AS hi, MIN(ts) AS since, MAX(ts) AS until, AVG(value) AS mean FROM events")
shared("ordinals", "SELECT event_type AS step, COUNT(*) AS n FROM events GROUP BY 1 ORDER BY 2 DESC, 1")
shared("topk_latest", "SELECT event_id, ts, value FROM events ORDER BY ts DESC, event_id LIMIT 20")
shared("topk_by_avg", "SELECT user_id, AVG(value) AS mean, MAX(value) AS peak FROM events GROUP BY user_id ORDER BY mean DESC, user_id LIMIT 10")
shared("limit_offset", "SELECT event_id FROM events ORDER BY event_id LIMIT 10 OFFSET 25")
shared("null_order", "SELECT k, ROW_NUMBER() OVER (ORDER BY k ASC NULLS LAST) AS up, ROW_NUMBER() OVER (ORDER BY k DESC NULLS FIRST) AS down FROM (SELECT DISTINCT CASE WHEN user_id % 5 = 0 THEN NULL ELSE user_id % 5 END AS k FROM events) s")
shared("having", "SELECT user_id, COUNT(*) AS n FROM events GROUP BY user_id HAVING COUNT(*) > 60")
shared("filter_clause", "SELECT event_type AS step, COUNT(*) FILTER (WHERE value > 50) AS large FROM events GROUP BY event_type")
shared("cube", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, SUM(l_quantity) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
shared("rollup_groups", "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
shared("grouping_sets", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
shared("statistics", "SELECT event_type AS step, ROUND(STDDEV_SAMP(value), 6) AS sd, ROUND(CORR(value, CAST(user_id AS DOUBLE)), 6) AS r, BIT_XOR(user_id) AS bits FROM events GROUP BY event_type")
shared("latest_per_series", "SELECT user_id, ts, value FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) t WHERE rn = 1")
shared("window_ranks", "SELECT event_id, RANK() OVER w AS r, DENSE_RANK() OVER w AS d, NTILE(4) OVER (ORDER BY value, event_id) AS q, LAG(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev, LEAD(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events WINDOW w AS (PARTITION BY event_type ORDER BY user_id)")
shared("window_distribution", "SELECT event_id, PERCENT_RANK() OVER (PARTITION BY event_type ORDER BY event_id) AS p, CUME_DIST() OVER (PARTITION BY event_type ORDER BY event_id) AS c FROM events")

# -- joins and sets -------------------------------------------------------------

shared("join_inner", "SELECT o.o_orderkey, c.c_name, n.n_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE o.o_totalprice > 200000")
shared("join_left", "SELECT c.c_custkey, COUNT(o.o_orderkey) AS n FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY c.c_custkey")
shared("join_right", "SELECT n.n_name, COUNT(s.s_suppkey) AS n FROM supplier s RIGHT JOIN nation n ON s.s_nationkey = n.n_nationkey GROUP BY n.n_name")
shared("join_full", "SELECT a.k AS a, b.k AS b FROM (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_nationkey < 15) a FULL OUTER JOIN (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_nationkey > 10) b ON a.k = b.k")
shared("join_semi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
shared("join_anti", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
shared("join_exists", "SELECT s_suppkey FROM supplier s WHERE EXISTS (SELECT 1 FROM nation n WHERE n.n_nationkey = s.s_nationkey AND n.n_regionkey = 1)")
shared("join_cross", "SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n")
shared("join_theta", "SELECT a.n_name AS low, b.n_name AS high FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey <> b.n_regionkey")
shared("join_self", "SELECT COUNT(DISTINCT a.n_name || '/' || b.n_name) AS pairs FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
shared("union_all", "SELECT n_name AS name FROM nation UNION ALL SELECT r_name AS name FROM region")
shared("union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey AS k FROM supplier")
shared("intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey AS k FROM supplier")
shared("except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey AS k FROM orders")
shared("cte", "WITH big AS (SELECT o_custkey, SUM(o_totalprice) AS total FROM orders GROUP BY o_custkey) SELECT c_name, total FROM customer JOIN big ON c_custkey = o_custkey WHERE total > 500000")
shared("recursive_cte", "WITH RECURSIVE r(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM r WHERE n < 12) SELECT n, f FROM r")
shared("scalar_subquery", "SELECT event_id FROM events WHERE value > (SELECT AVG(value) FROM events)")
shared("values_rows", "SELECT a + 1 AS b, c FROM (VALUES (1, 'x'), (2, 'y')) AS t(a, c)")
shared("json_field", "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
shared("time_literal", "SELECT COUNT(*) AS n FROM events WHERE ts < '2024-01-08 20:00:00'")
shared("time_interval", "SELECT COUNT(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL '36' HOUR")

# -- the whole of events, where the queries of these names above take an id range ------

shared("projection_arithmetic_whole", "SELECT event_id, 100 - value AS rest, value * 2 + 1 AS twice FROM events WHERE value IS NOT NULL")
shared("window_frames_whole", "SELECT event_id, SUM(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS three, FIRST_VALUE(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS first_id, NTH_VALUE(event_id, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second_id FROM events")
shared("unnest_whole", "SELECT event_id, k FROM events LATERAL VIEW explode(array(user_id, event_id)) x AS k", "SELECT event_id, unnest([user_id, event_id]) AS k FROM events")
shared("scalar_functions_whole", "SELECT event_id, UPPER(event_type) AS u, LENGTH(event_type) AS n, SUBSTRING(event_type, 1, 3) AS s, ABS(value - 50) AS d, COALESCE(NULLIF(event_type, 'view'), 'none') AS c FROM events")

# -- time buckets ------------------------------------------------------------------


def _bucketed(width: int, *keys: str) -> Callable[[DataFrame], DataFrame]:
    return lambda e: e.groupBy(date_bin(width, "ts").cast("timestamp_ntz").alias("bucket"), *keys)


@query("throughput_15m", "SELECT time_bucket(INTERVAL '15 minutes', ts, TIMESTAMP '1970-01-01') AS bucket, COUNT(*) AS n FROM events GROUP BY 1")
def throughput_15m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bucketed(900)(table(spark, sf_dir, "events")).agg(F.count("*").alias("n"))


@query("throughput_1h", "SELECT date_trunc('hour', ts) AS bucket, COUNT(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-29 00:00:00' GROUP BY 1")
def throughput_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bucketed(3600)(table(spark, sf_dir, "events").where("ts >= timestamp '2024-01-29 00:00:00'")).agg(F.count("*").alias("n"))


@query("bucket_by_tag", "SELECT time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS bucket, event_type AS step, COUNT(*) AS n, AVG(value) AS mean FROM events GROUP BY 1, 2")
def bucket_by_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bucketed(21_600, "event_type")(table(spark, sf_dir, "events")).agg(F.count("*").alias("n"), F.avg("value").alias("mean")).withColumnRenamed("event_type", "step")


@query("counter_rate", "SELECT date_trunc('hour', ts) AS bucket, (MAX(event_id) - MIN(event_id)) / 3600.0::DOUBLE AS rate FROM events GROUP BY 1")
def counter_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bucketed(3600)(table(spark, sf_dir, "events")).agg(((F.max("event_id") - F.min("event_id")) / F.lit(3600.0)).alias("rate"))


@query("first_last_by_time", "SELECT user_id, arg_min(value, (ts, event_id)) AS first_value, arg_max(value, (ts, event_id)) AS last_value FROM events GROUP BY user_id")
def first_last_by_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.struct("ts", "event_id")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.min_by("value", at).alias("first_value"), F.max_by("value", at).alias("last_value"))


@query("percentile_by_bucket", "SELECT date_trunc('day', ts) AS bucket, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95 FROM events GROUP BY 1")
def percentile_by_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bucketed(86_400)(table(spark, sf_dir, "events")).agg(F.percentile("value", 0.5).alias("p50"), F.percentile("value", 0.95).alias("p95"))


@query("host_vs_fleet", "WITH h AS (SELECT date_trunc('day', ts) AS bucket, AVG(value) AS own FROM events WHERE user_id = 5 GROUP BY 1), f AS (SELECT date_trunc('day', ts) AS bucket, AVG(value) AS fleet FROM events GROUP BY 1) SELECT f.bucket, own, fleet FROM f LEFT JOIN h ON h.bucket = f.bucket")
def host_vs_fleet(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return _bucketed(86_400)(e).agg(F.avg(F.when(F.col("user_id") == 5, F.col("value"))).alias("own"), F.avg("value").alias("fleet"))


@query("hour_partitions", "SELECT strftime(ts, '%Y%m%d%H') AS hour, COUNT(*) AS n FROM events GROUP BY 1")
def hour_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(hour_partition(timestamp_to_ns("ts")).alias("hour")).agg(F.count("*").alias("n"))


# -- owned operators ---------------------------------------------------------------

_DOUBLED = f"SELECT {NS} AS time, event_type AS step, CAST(user_id AS VARCHAR) AS entity, value, event_id AS n, event_id AS s FROM events UNION ALL SELECT {NS}, event_type, CAST(user_id AS VARCHAR), value + 1, event_id, event_id + 1000000000 FROM events WHERE user_id % 3 = 0"


@query("lww_dedup", f"SELECT time, step, entity, value, n FROM (SELECT *, row_number() OVER (PARTITION BY time, step, entity ORDER BY s DESC) AS rn FROM ({_DOUBLED})) WHERE rn = 1")
def lww_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, t = series(spark, sf_dir)
    first = rows.withColumn(SEQ, F.col("n"))
    again = rows.where("cast(entity as long) % 3 = 0").withColumn("value", F.col("value") + 1).withColumn(SEQ, F.col("n") + 1_000_000_000)
    return last_write_wins(first.unionByName(again), t.key).drop(SEQ)


@query("union_buffer_files", f"SELECT {NS} AS time, event_type AS step, value, NULL AS extra FROM events WHERE event_id % 2 = 0 UNION ALL SELECT {NS}, event_type, value, CAST(event_id AS VARCHAR) FROM events WHERE event_id % 2 = 1")
def union_buffer_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .model import schema_union

    rows, _ = series(spark, sf_dir)
    files = rows.where("n % 2 = 0").select(TIME, "step", "value")
    buffer = rows.where("n % 2 = 1").select(TIME, "step", "value", F.col("n").cast("string").alias("extra"))
    return schema_union([files, buffer])


_LABEL = "CASE user_id % 4 WHEN 0 THEN 'admin' WHEN 1 THEN 'ops&audit' WHEN 2 THEN '(ops&audit)|admin' ELSE NULL END"
for _name, _auths, _seen in (("none", (), "3"), ("admin", ("admin",), "0, 2, 3"), ("ops", ("ops",), "3"), ("ops_audit", ("ops", "audit"), "1, 2, 3"), ("all", ("admin", "ops", "audit"), "0, 1, 2, 3")):

    @query(f"visibility_{_name}", f"SELECT event_type AS step, COUNT(*) AS n FROM events WHERE user_id % 4 IN ({_seen}) GROUP BY 1")
    def visibility(spark: SparkSession, sf_dir: str, auths: tuple[str, ...] = _auths) -> DataFrame:
        rows = table(spark, sf_dir, "events").withColumn("_visibility", F.expr(_LABEL))
        return apply_visibility(rows, auths).groupBy(F.col("event_type").alias("step")).agg(F.count("*").alias("n"))


_EDGE = 1_705_000_000_000_000_000
for _name, _stone, _where in (
    ("tag", Tombstone((("step", "click"),)), "event_type = 'click'"),
    ("window", Tombstone((), None, _EDGE), f"{NS} <= {_EDGE}"),
    ("both", Tombstone((("step", "click"), ("entity", "7")), _EDGE, None), f"event_type = 'click' AND user_id = 7 AND {NS} >= {_EDGE}"),
    ("missing_tag", Tombstone((("region", "eu"),)), "FALSE"),
):

    @query(f"tombstone_{_name}", f"SELECT event_type AS step, COUNT(*) AS n FROM events WHERE NOT ({_where}) GROUP BY 1")
    def tombstone(spark: SparkSession, sf_dir: str, stone: Tombstone = _stone) -> DataFrame:
        rows, _ = series(spark, sf_dir)
        return hide_deleted(rows, [stone]).groupBy("step").agg(F.count("*").alias("n"))


@query("last_value_cache", f"SELECT time, entity, step, n, value FROM (SELECT {NS} AS time, CAST(user_id AS VARCHAR) AS entity, event_type AS step, event_id AS n, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id) AS rn FROM events) WHERE rn = 1")
def last_value_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, t = series(spark, sf_dir)
    return last_values(rows.withColumn(SEQ, F.col("n")), t)


_ALL = ("avg", "min", "max", "sum", "count", "first", "last", "count_distinct")
_AGGS = (*(RollupAgg(f, "value", f"{f}_value") for f in _ALL), RollupAgg("percentile", "value", "p50", 0.5))
_HIGH = CLOCK_NS - 6 * 3_600 * 10**9


def _rollup_sql(where: str, tags: str, bounds: str) -> str:
    return (
        f"SELECT {NS} - ({NS}) % 21600000000000 AS time{tags}, AVG(value) AS avg_value, MIN(value) AS min_value, MAX(value) AS max_value, SUM(value) AS sum_value, COUNT(value) AS count_value, "
        f"arg_min(value, (ts, event_id)) AS first_value, arg_max(value, (ts, event_id)) AS last_value, COUNT(DISTINCT value) AS count_distinct_value, quantile_cont(value, 0.5) AS p50 "
        f"FROM events WHERE {where} AND {bounds} GROUP BY ALL"
    )


_BOUND = f"{NS} < {_HIGH // 21_600_000_000_000 * 21_600_000_000_000}"
for _name, _roll, _sql in (
    ("rollup_all_aggs", Rollup("r", "pipeline_events", 21_600, _AGGS, group_by=("step",)), _rollup_sql("TRUE", ", event_type AS step", _BOUND)),
    ("rollup_filtered", Rollup("r", "pipeline_events", 21_600, _AGGS, group_by=("step",), where="value > 25 or step = 'view'"), _rollup_sql("(value > 25 OR event_type = 'view')", ", event_type AS step", _BOUND)),
    ("rollup_all_tags", Rollup("r", "pipeline_events", 21_600, _AGGS), _rollup_sql("TRUE", ", event_type AS step, CAST(user_id AS VARCHAR) AS entity", _BOUND)),
):

    @query(_name, _sql)
    def rolled(spark: SparkSession, sf_dir: str, roll: Rollup = _roll) -> DataFrame:
        rows, t = series(spark, sf_dir)
        return rollup_frame(rows.withColumn(SEQ, F.col("n")), t, roll, *sealed_range(roll, CLOCK_NS, None))


@query("lp_roundtrip", f"SELECT {NS} AS time, event_type AS step, CAST(user_id AS VARCHAR) AS entity, value, event_id AS n FROM events")
def lp_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out as line protocol, gathered into bodies of some hundred lines, and read back."""
    rows, t = series(spark, sf_dir)
    lines = to_lines(rows, t).select("line", F.pmod(F.xxhash64("line"), F.lit(64)).alias("body"))
    bodies = lines.groupBy("body").agg(F.array_join(F.collect_list("line"), "\n").alias("data"))
    return columns_of(read_bodies(bodies), t).drop(SEQ)


@query("remote_write_rows", f"SELECT 'm_' || event_type AS name, CAST(user_id AS VARCHAR) AS entity, ({NS}) // 1000000 * 1000000 AS time, value FROM events WHERE event_id % 10 <> 0")
def remote_write_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    stale = F.when(F.col("event_id") % 10 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    sample = F.struct(F.call_function("div", F.unix_micros(F.col("ts").cast("timestamp")), F.lit(1000).cast("long")).alias("ms"), stale.alias("value"))
    labels = F.create_map(F.lit("__name__"), F.concat(F.lit("m_"), "event_type"), F.lit("entity"), F.col("user_id").cast("string"))
    return points_of(e.select(labels.alias("labels"), F.array(sample).alias("samples"))).select(F.col("table").alias("name"), F.col("tags")["entity"].alias("entity"), "time", "value")


_FILES = f"SELECT 'poc' AS db, 'events' AS \"table\", strftime(ts, '%Y%m%d%H') AS hour, strftime(ts, '%Y%m%d%H') || '-' || CAST(user_id % 3 AS VARCHAR) AS path, COUNT(*) AS rows, COUNT(*) * 40 AS size, MIN({NS}) AS min_ns, MAX({NS}) AS max_ns, CAST(MIN(user_id % 3) AS INTEGER) AS level FROM events GROUP BY ALL"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog: one file for each hour and a third of the users."""
    third = F.col("user_id") % 3
    hour = hour_partition(timestamp_to_ns("ts"))
    e = table(spark, sf_dir, "events").select(hour.alias("hour"), third.cast("int").alias("level"), timestamp_to_ns("ts").alias("ns"))
    files = e.groupBy("hour", "level").agg(F.count("*").alias("rows"), F.min("ns").alias("min_ns"), F.max("ns").alias("max_ns"))
    return files.select(F.lit("poc").alias("db"), F.lit("events").alias("table"), "hour", F.concat_ws("-", "hour", "level").alias("path"), "rows", (F.col("rows") * 40).alias("size"), "min_ns", "max_ns", "level")


@query("storage_summary", f"WITH f AS ({_FILES}) SELECT db, \"table\", COUNT(*) AS files, CAST(SUM(size) AS BIGINT) AS bytes, CAST(SUM(rows) AS BIGINT) AS rows FROM f GROUP BY db, \"table\"")
def storage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage_summary(_files(spark, sf_dir))


@query("level_counts", f"WITH f AS ({_FILES}) SELECT db, \"table\", level, COUNT(*) AS files FROM f GROUP BY ALL")
def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return level_counts(_files(spark, sf_dir))


@query("compaction_candidates", f"WITH f AS ({_FILES}), o AS (SELECT *, coalesce(min_ns < MAX(max_ns) OVER (PARTITION BY hour ORDER BY min_ns, max_ns, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS hit FROM f) SELECT db, \"table\", hour, COUNT(*) AS files, bool_or(hit) AS overlaps FROM o GROUP BY ALL HAVING COUNT(*) >= 3 OR bool_or(hit)")
def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compaction_candidates(_files(spark, sf_dir), 3)


@query("retention_hours", f"WITH f AS ({_FILES}) SELECT path, rows FROM f WHERE hour < '2024011600'")
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    policies = spark.createDataFrame([("*", "events", "2024012800"), ("poc", "events", "2024011600"), ("*", "other", "2024013000")], "db string, table string, first_hour string")
    return expired(_files(spark, sf_dir), policies).select("path", "rows")


_STEPS = (0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0)
_LE = "CASE " + " ".join(f"WHEN value <= {b} THEN {b}::DOUBLE" for b in _STEPS) + " ELSE 'inf'::DOUBLE END"


@query(
    "histogram_quantile",
    f"WITH h AS (SELECT event_type AS step, {_LE} AS le, COUNT(*) AS n FROM events WHERE value IS NOT NULL GROUP BY ALL), c AS (SELECT *, SUM(n) OVER (PARTITION BY step ORDER BY le) AS upto, coalesce(LAG(le) OVER (PARTITION BY step ORDER BY le), 0) AS low, SUM(n) OVER (PARTITION BY step) AS total FROM h) "
    "SELECT step, arg_min(CASE WHEN isinf(le) THEN low ELSE low + (le - low) * (total * 0.9::DOUBLE - (upto - n)) / n END, le) AS quantile FROM c WHERE upto >= total * 0.9::DOUBLE GROUP BY step",
)
def quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumnRenamed("event_type", "step")
    return histogram_quantile(histogram(e, "value", ["step"], _STEPS), 0.9, ["step"])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The funnel: exact distinct entities by step."""
    return table(spark, sf_dir, "events").where("value > 0").groupBy(F.col("event_type").alias("step")).agg(F.count_distinct("user_id").alias("entities")).orderBy("step")
