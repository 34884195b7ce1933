import time

import pytest
from pyspark.sql import functions as F

from tidewell.database import Database, Refused, apart, list_databases
from tidewell.model import SchemaError
from tidewell.operators import Rollup, RollupAgg
from tidewell.operators.rollup import FUNCTIONS
from tidewell.plans import QueryError, Runner, Session, narrow, result_json
from tidewell.plans.config import Config
from tidewell.plans.runner import authorize
from tidewell.sources import catalog
from tidewell.streaming import ingest_stream, last_value_stream, rollup_stream

HOUR, SECOND = 3_600 * 10**9, 10**9


@pytest.fixture
def db(spark, tmp_path):
    return Database(spark, f"file://{tmp_path}", "poc")


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=str)


def test_write_dedup_evolve_compact(db):
    assert db.write_lp(f"m,tag=a v=1 0\nm,tag=a v=2 0\nm,tag=b v=3 0\nm,tag=a v=4 {HOUR}") == 3
    assert [f.hour for f in db.state().of("m")] == ["1970010100", "1970010101"]
    db.write_lp("m,tag=a v=42 0\nm,tag=c v=7i,w=t 5")
    assert db.read("m", dedup=False).count() == 5
    before = rows(db.read("m"), "time", "tag", "v", "w")
    assert before == [(0, "a", 42.0, None), (0, "b", 3.0, None), (5, "c", 7.0, True), (HOUR, "a", 4.0, None)] or len(before) == 4
    assert db.compact(2) == 1
    assert rows(db.read("m", dedup=False), "time", "tag", "v", "w") == before
    db.write_lp("m,tag=a v=43 0")  # later than the compacted file
    assert (0, "a", 43.0) in rows(db.read("m"), "time", "tag", "v")
    assert db.read("m", start=HOUR).count() == 1


def test_bodies_and_types_are_all_or_nothing(db):
    with pytest.raises(Refused, match="line 2"):
        db.write_lp("good f=1i\nbroken")
    db.write_lp("m v=1.5 1")
    with pytest.raises(SchemaError, match="'v'"):
        db.write_lp('other f=1 1\nm v="text" 2')
    assert list(db.state().tables) == ["m"]
    db.write_lp("m v=2i 2")
    assert rows(db.read("m"), "v") == [(1.5,), (2.0,)]


def test_declared_tables(db):
    db.create_table("cpu", [{"name": "host", "type": "string", "tag": True}, {"name": "usage", "type": "float"}])
    assert db.read("cpu").count() == 0 and db.read("cpu").columns == ["time", "host", "usage"]
    for bad in ("cpu,host=a usage=1i 1", "cpu,zone=a usage=1 1", "cpu,host=a load=1 1"):
        with pytest.raises(SchemaError):
            db.write_lp(bad)
    db.write_lp("cpu,host=a usage=1 1")
    assert db.read("cpu").count() == 1
    with pytest.raises(Refused):
        db.create_table("cpu", [{"name": "x", "type": "int"}])
    db.drop_table("cpu")
    db.write_lp("cpu,zone=z load=1 1")
    assert db.table("cpu").tags == ("zone",)


def test_delete_purge_retention_gc(db):
    db.write_lp("m,host=a v=1 100\nm,host=a v=2 500\nm,host=b v=3 100\nm,host=a v=4 2000")
    first = db.delete_where("m", {"host": "a"}, 0, 1000)
    assert db.delete_where("m", {"host": "a"}, 0, 1000) == first and len(db.state().tombstones["m"]) == 1
    assert db.read("m").count() == 2
    db.write_lp("m,host=a v=9 600")  # deletes stand
    assert db.read("m").count() == 2
    assert db.purge_deleted() == 2 and db.read("m").count() == 2
    assert sum(f.rows for f in db.state().of("m")) == 2
    with pytest.raises(ValueError):
        db.delete_where("m")
    with pytest.raises(Refused):
        db.delete_where("nope", {"a": "b"})
    db.set_retention("m", 86_400)
    assert db.retain(10 * 24 * HOUR) == 1 and db.read("m").count() == 0
    assert db.gc() == 0 and db.gc(time.time() + 1000) == 3


def test_fence_and_overlap(db):
    for n in range(2):
        db.write_lp("\n".join(f"m,h={n} v=1 {t}" for t in (10 + n, 30 + n)))
    found = catalog.compaction_candidates(db.files(), 4).collect()
    assert [(r.files, r.overlaps) for r in found] == [(2, True)]
    files = db.state().of("m")
    db.compact(2)
    with pytest.raises(catalog.Conflict):
        db._rewrite(db.table("m"), files, db.read("m", system=True), ["time"])
    other = Database(db.spark, db.root.rsplit("/", 1)[0], "poc")
    head = db.state().head
    other.log.append(head + 1, {"at": 0.0})
    with pytest.raises(catalog.Conflict):
        db.log.append(head + 1, {"at": 0.0})
    db.write_lp("m v=1 99")  # tries again with the next number
    assert db.state().head == head + 2


def test_rollup_seals_once(db):
    db.write_lp(f"cpu,host=h,r=eu v=10 {SECOND}\ncpu,host=h,r=eu v=20 {2 * SECOND}")
    db.write_lp(f"cpu,host=h,r=eu v=30 {59 * SECOND}\ncpu,host=h,r=us v=999 {3 * SECOND}")
    aggs = tuple(RollupAgg(f, "v", f"{f}_v", 0.5 if f == "percentile" else None) for f in FUNCTIONS)
    db.set_rollup(Rollup("r", "cpu", 60, aggs, group_by=("host",), lookback=300, where="r = 'eu' or false"))
    assert db.materialize(200 * SECOND) == {"r": 0}
    assert db.materialize(1000 * SECOND) == {"r": 1}
    assert rows(db.read("cpu_1m"), *(f"{f}_v" for f in FUNCTIONS)) == [(20.0, 10.0, 30.0, 60.0, 3, 10.0, 30.0, 3, 20.0)]
    db.write_lp(f"cpu,host=h,r=eu v=100 {5 * SECOND}")
    assert db.materialize(1000 * SECOND) == {"r": 0} and db.read("cpu_1m").count() == 1
    db.set_rollup(Rollup("tags", "cpu", 60, (RollupAgg("count", "v", "n"),), target="all_tags"))
    assert db.materialize(1000 * SECOND)["tags"] == 2
    with pytest.raises(Refused):
        db.set_retention("cpu", 100)
    for bad in (dict(interval=0), dict(target="cpu"), dict(aggregates=())):
        with pytest.raises(ValueError):
            Rollup(**{"name": "x", "source": "cpu", "interval": 60, "aggregates": aggs} | bad)
    with pytest.raises(ValueError):
        RollupAgg("percentile", "v", "p")


def test_last_cache(db):
    assert db.last_cache("nope").columns == ["time"]
    db.write_lp("c,h=a v=0.1 10\nc,h=a v=0.5 20\nc,h=b v=0.2 10\nc,h=b v=0.6 20")
    db.write_lp("c,h=a v=99 15")
    assert db.last_cache("c").count() == 0
    db.enable_last_cache("c")
    assert rows(db.last_cache("c"), "h", "v") == [("a", 0.5), ("b", 0.6)]
    db.enable_last_cache("c", cap=1)
    assert rows(db.last_cache("c"), "h") == [("a",)]
    db.disable_last_cache("c")
    assert db.last_cache("c").count() == 0


def test_frames(db, spark):
    good = spark.createDataFrame([(1, "a", 1.0), (2, "b", None)], "time long, host string, v double").withColumn("n", F.lit(1).cast("long"))
    assert db.ingest_dataframe(good, "f") == 2
    assert db.table("f").tags == ("host",)
    for bad in ("select null time, 1.0D v", "select 1L time, double('nan') v", "select 1L time, cast(null as double) v"):
        with pytest.raises(Exception):
            db.ingest_dataframe(spark.sql(bad).withColumn("time", F.col("time").cast("long")), "bad")
    with pytest.raises(SchemaError):
        db.ingest_dataframe(spark.sql("select 1L time, date('2020-01-01') d"), "bad")
    assert "bad" not in db.state().tables


def test_sql(db, spark):
    db.write_lp("ev,step=a,pid=p1 v=1 1000\nev,step=a,pid=p2 v=2 900000000000\nev,step=b,pid=p1,_visibility=admin v=3 3000")
    db.enable_last_cache("ev")
    run = Runner(spark, {"poc": db}.get, row_cap=3)
    ask = lambda q, **k: [tuple(r) for r in run.run(q, **k).collect()]
    assert ask("SELECT step, count(DISTINCT pid) AS n FROM ev GROUP BY 1 ORDER BY 1") == [("a", 2)]
    assert ask('SELECT count(*) FROM poc.public."ev"', session=Session("u", frozenset({"admin"}))) == [(3,)]
    assert ask("SELECT avg(v) FROM ev GROUP BY date_bin(INTERVAL '5 minutes', time) ORDER BY 1") == [(1.0,), (2.0,)]
    assert len(ask("SELECT * FROM last_cache('ev')")) == 2
    assert ask("SELECT table_name FROM information_schema.tables") == [("ev",)]
    assert ask("WITH ev2 AS (SELECT * FROM ev WHERE pid IN (SELECT pid FROM ev WHERE v > 1)) SELECT count(*) FROM ev2") == [(1,)]
    refused = ["INSERT INTO ev VALUES (1)", "DROP TABLE ev", "SET x=1", "CREATE TABLE t AS SELECT 1", "SELECT * FROM parquet.`/tmp`", "SELECT reflect('java.lang.System', 'exit')", "SELECT (SELECT java_method('a', 'b'))", "SELECT TRANSFORM(v) USING 'cat' FROM ev", "EXPLAIN DROP TABLE ev", "SELECT * FROM nope", "SELECT a.v FROM ev a CROSS JOIN ev b", "CACHE TABLE ev"]
    for q in refused:
        with pytest.raises(QueryError) as e:
            run.run(q)
        assert e.value.outcome == "refused", q
    with pytest.raises(QueryError, match="ref: q-"):
        run.run("SELECT 1 / 0 FROM ev")
    with pytest.raises(QueryError, match="no such database"):
        run.run("SELECT 1", db="other")
    assert {h["outcome"] for h in run.history} == {"ok", "refused", "failed"}
    assert result_json(run.run("SELECT time, double('nan') AS z, v FROM ev ORDER BY time LIMIT 1")).first().json == '{"time":"1970-01-01T00:00:00.000001Z","z":null,"v":1.0}'
    slow = Runner(spark, {"poc": db}.get, deadline=1.0)
    with pytest.raises(QueryError) as e:
        slow.run("SELECT count(*) FROM range(100000) a CROSS JOIN range(1000000) b WHERE a.id * b.id % 7 = 3")
    assert e.value.outcome == "timeout"


def test_listings_and_telemetry(db, spark, tmp_path):
    db.write_lp("ev,step=a v=1 1")
    run = Runner(spark, {"poc": db}.get)
    assert [r.table_name for r in run.run("SHOW TABLES").collect()] == ["ev"]
    assert [tuple(r) for r in run.run("DESCRIBE poc.public.ev").collect()] == [("time", "bigint"), ("step", "string"), ("v", "double")]
    system = Database(spark, f"file://{tmp_path}", "_system")
    assert run.record(system, "n1") == 2 and run.record(system) == 0
    assert rows(system.read("queries"), "node", "db", "outcome", "identity") == [("n1", "poc", "ok", None)] * 2
    assert system.write_exposition('up{job="a"} 1\nload{job="a"} 2\nplain 3', "n1", 5) == 2
    assert rows(system.read("metrics"), "node", "job", "up", "load", "plain") == [("n1", "a", 1.0, 2.0, None), ("n1", None, None, None, 3.0)]
    assert [r.database for r in list_databases(spark, f"file://{tmp_path}").collect()] == ["_system", "poc"]


def test_authorization_and_settings():
    assert narrow({"a", "b"}, {"b", "c"}, None) == {"b"}
    assert authorize("off", None, None, "write", "d") and authorize("optional", None, None, "read", "d") and not authorize("required", None, None, "read", "d")
    assert authorize("required", {"read"}, {"d"}, "read", "d") and not authorize("required", {"read"}, {"d"}, "write", "d")
    c = Config({"flush.rows": 10})
    c.set("flush.rows", "20")
    assert c.resolve("flush.rows") == (20, "override")
    c.revert("flush.rows")
    assert c.resolve("flush.rows") == (10, "property") and c.resolve("query.memory") == (1 << 30, "default")
    with pytest.raises(ValueError):
        c.set("nope", 1)


def test_streams(db, spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.lp").write_text("s,h=a v=1 1000000000\ns,h=a v=2 61000000000")
    ingest_stream(spark, db, f"file://{tmp_path}/in", f"file://{tmp_path}/ck").awaitTermination()
    assert db.read("s").count() == 2
    (tmp_path / "in" / "b.lp").write_text("s,h=b v=3 500000000000")
    ingest_stream(spark, db, f"file://{tmp_path}/in", f"file://{tmp_path}/ck").awaitTermination()
    assert db.read("s").count() == 3
    table = db.table("s")
    (tmp_path / "rows").mkdir()
    db.read("s").orderBy("time").coalesce(1).write.mode("overwrite").parquet(f"file://{tmp_path}/rows")
    stream = lambda: spark.readStream.schema(table.schema).parquet(f"file://{tmp_path}/rows")
    roll = Rollup("r", "s", 60, (RollupAgg("sum", "v", "total"), RollupAgg("last", "v", "newest")), lookback=0)
    q = rollup_stream(stream(), table, roll).writeStream.format("memory").queryName("rolled").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.sql("select time, h, total, newest from rolled").collect())) == [(0, "a", 1.0, 1.0), (60 * SECOND, "a", 2.0, 2.0)]
    q = last_value_stream(stream(), table).writeStream.format("memory").queryName("latest").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.sql("select h, v from latest").collect())) == [("a", 2.0), ("b", 3.0)]


def scanned(df):
    """The files that the plan reads."""
    return set(df.inputFiles())


def test_files_that_share_no_time_are_not_merged(db):
    db.write_lp("\n".join(f"m,tag=a v={n} {n * HOUR + 5}" for n in range(4)))
    plan = lambda: db.read("m")._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan()
    db.write_lp(f"m,tag=a v=9 {HOUR + 5}\nm,tag=a v=8 {2 * HOUR + 7}")
    assert "Aggregate" in plan()
    assert rows(db.read("m"), "time", "v") == sorted([(5, 0.0), (HOUR + 5, 9.0), (2 * HOUR + 5, 2.0), (2 * HOUR + 7, 8.0), (3 * HOUR + 5, 3.0)], key=str)
    alone, shared = apart(db.state().of("m"))
    assert sorted(f.min_ns for f in alone) == [5, 2 * HOUR + 5, 2 * HOUR + 7, 3 * HOUR + 5] and [f.min_ns for f in shared] == [HOUR + 5] * 2


def test_two_reads_of_one_table_are_two_relations(db):
    db.write_lp("m,tag=a v=1 1\nm,tag=b v=2 2")
    x, y = db.read("m"), db.read("m")
    assert x.join(y, x["v"] < y["v"]).count() == 1


def test_time_in_sql_prunes_files(spark, db):
    db.write_lp("\n".join(f"m,tag=a v={n} {n * HOUR + 5}" for n in range(24)))
    run = Runner(spark, {"poc": db}.get)
    seen = []
    read = db.read
    db.read = lambda *a, **k: seen.append(len(scanned(out := read(*a, **k)))) or out
    ask = lambda where, more="": run.run(f"SELECT count(*) AS n FROM m WHERE {where} {more}").first().n
    assert ask("time >= '1970-01-01 20:00:00'") == 4 and seen.pop() == 4
    assert ask("time < '1970-01-01 02:00:00'") == 2 and seen.pop() <= 3
    assert ask("TIMESTAMP '1970-01-01 05:30:00' > time AND time BETWEEN '1970-01-01 03:00:00' AND '1970-01-01 09:00:00'") == 3 and seen.pop() == 3
    assert ask(f"time_ns = {3 * HOUR + 5}") == 1 and seen.pop() == 1
    assert ask("time >= '1970-01-01 20:00:00' OR v = 1") == 5 and seen.pop() == 24
    assert ask("time > now()") == 0 and seen.pop() == 0
    assert ask("time >= '1970-01-01 20:00:00' AND v > (SELECT avg(v) FROM m)") == 4 and seen.pop() == 24
    assert ask("time >= '1970-01-01 20:00:00' AND v >= (SELECT max(v) FROM poc.m WHERE time < '1970-01-01 22:00:00')") == 3
    assert run.run("WITH c AS (SELECT * FROM m) SELECT count(*) AS n FROM c a JOIN c b ON a.v = b.v WHERE a.time >= '1970-01-01 20:00:00'").first().n == 4
    assert run.run("SELECT count(*) AS n FROM (SELECT time, row_number() OVER (ORDER BY time) AS r FROM m) WHERE time >= '1970-01-01 20:00:00' AND r > 20").first().n == 4


def test_rollup_leaves_out_values_that_are_not_finite(db):
    minute = 60 * SECOND
    db.write_lp(f"m,tag=a v=1.7e308 1\nm,tag=a v=1.7e308 2\nm,tag=a v=1 {minute}")
    db.set_rollup(Rollup("r", "m", 60, (RollupAgg("sum", "v", "s"),), "m_1m", ("tag",)))
    assert db.materialize(5 * minute)["r"] == 1
    assert rows(db.read("m_1m"), "time", "s") == [(minute, 1.0)]
