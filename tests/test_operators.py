import pytest
from pyspark.sql import functions as F

from tidewell import functions as fn
from tidewell.model import SchemaError, TableDef, declare, schema_union
from tidewell.operators import Tombstone, apply_visibility, audit_query, hide_deleted, last_write_wins, log_query, parse_exposition, seal_chain, verify_chain
from tidewell.operators.visibility import allows


def test_grammars():
    assert [fn.parse_duration(x) for x in ("90d", "12h", "5m", "30s", "7")] == [7_776_000, 43_200, 300, 30, 7]
    assert [fn.humanize_seconds(x) for x in (86_400, 5_400, 61)] == ["1d", "90m", "61s"]
    assert [fn.parse_size(x) for x in ("2GiB", "3MB", "10B", "5")] == [2 << 30, 3_000_000, 10, 5]
    assert fn.parse_retention("db.t=90d, u=72h,v=9") == {("db", "t"): 7_776_000, ("*", "u"): 259_200, ("*", "v"): 9}
    for bad in ("0", "5x", "", "-1d"):
        with pytest.raises(ValueError):
            fn.parse_duration(bad)
    with pytest.raises(ValueError):
        fn.parse_retention("t=5m")
    assert fn.fnv1a(b"") == 0xCBF29CE484222325 and fn.fnv1a(b"a") == 0xAF63DC4C8601EC8C
    assert 0 <= fn.shard_of("db", "m", 7) < 7


def test_time_columns(spark):
    row = spark.createDataFrame([(1_786_179_600_000_000_000, -1)], "a long, b long").select(
        fn.hour_partition("a"), fn.hour_partition(F.lit(0).cast("long")), fn.date_bin_ns(60_000_000_000, "b"), fn.rfc3339(F.timestamp_micros(F.lit(5))), fn.severity_rank(F.lit("warn")), fn.timestamp_to_ns(fn.ns_to_timestamp("b"))
    ).first()
    assert tuple(row) == ("2026080809", "1970010100", -60_000_000_000, "1970-01-01T00:00:00.000005Z", 1, -1000)


@pytest.mark.parametrize("label", ["admin&", "&admin", "admin|", "(admin", "admin)", "a&b|c", '"unclosed', '""', "admin ops", "a$b", "()"])
def test_malformed_labels_are_visible_to_no_one(label):
    assert not allows(label, {"admin", "ops", "a", "b", "c", "unclosed", "a$b", ""})


def test_label_grammar():
    assert allows(None, ()) and allows("", ())
    assert allows('"a b"', {"a b"}) and allows(r'"q\"\\"', {'q"\\'})
    assert allows(" ( ops & audit )|admin", {"ops", "audit"}) and not allows("(ops&audit)|admin", {"ops"})
    assert allows("(a|b)&(c|d)", {"b", "c"}) and not allows("(a|b)&(c|d)", {"a", "b"})


def test_visibility_rows_and_guard_against_leaks(spark):
    rows = spark.createDataFrame([("admin", 0), ("ops&audit", 2), (None, 3), ("", 4), ("broken&", 0)], "_visibility string, v int")
    seen = lambda *a: sorted(r.v for r in apply_visibility(rows, a).collect())
    assert (seen(), seen("admin"), seen("ops"), seen("ops", "audit")) == ([3, 4], [0, 3, 4], [3, 4], [2, 3, 4])
    assert apply_visibility(rows, ()).where("10 / v > 0").count() == 2
    with pytest.raises(ValueError):
        apply_visibility(rows.withColumn("_visibility", F.lit(1)), ())
    assert apply_visibility(rows.drop("_visibility"), ()).count() == 5


def test_many_labels_are_joined(spark, monkeypatch):
    from tidewell.operators import visibility

    rows = spark.range(40).select(F.when(F.col("id") % 4 > 0, F.concat(F.lit("g"), F.col("id") % 4)).alias("_visibility"), "id")
    want = sorted(r.id for r in apply_visibility(rows, {"g1"}).collect())
    monkeypatch.setattr(visibility, "INLINE_LABELS", 1)
    assert sorted(r.id for r in apply_visibility(rows, {"g1"}).collect()) == want and len(want) == 20


def test_tombstones(spark):
    rows = spark.createDataFrame([("web-1", "eu", 100), ("web-1", "us", 500), ("web-2", "eu", 100), ("web-1", None, 2000), (None, "eu", None)], "host string, region string, time long")
    left = lambda *t: hide_deleted(rows, list(t)).count()
    assert left() == 5
    assert left(Tombstone((("host", "web-1"),), 0, 1000)) == 3
    assert left(Tombstone((), 100, 500)) == 2
    assert left(Tombstone((("zone", "x"),))) == 5
    assert left(Tombstone((("region", "eu"),)), Tombstone((), 2000, None)) == 1
    assert Tombstone((("a", "1"), ("b", "2"))).id == Tombstone((("b", "2"), ("a", "1"))).id
    for bad in ((), ((), 5, 4)):
        with pytest.raises(ValueError):
            Tombstone(*bad)


def test_last_write_wins_keeps_whole_rows(spark):
    rows = spark.createDataFrame([(1, None, 1.0, "x", 1), (1, None, None, "y", 2), (1, "a", 3.0, None, 3)], "time long, tag string, v double, w string, _seq long")
    assert sorted(map(tuple, last_write_wins(rows, ["time", "tag"]).drop("_seq").collect()), key=str) == [(1, "a", 3.0, None), (1, None, None, "y")]


def test_schema_rules(spark):
    t = TableDef("m").merge(("host",), {"v": declare("x", [{"name": "v", "type": "float"}]).field_types["v"]})
    from pyspark.sql.types import LongType, StringType

    assert t.merge((), {"v": LongType()}) == t
    for tags, fields in (((), {"v": StringType()}), (("v",), {}), ((), {"host": LongType()})):
        with pytest.raises(SchemaError):
            t.merge(tags, fields)
    d = declare("cpu", [{"name": "host", "type": "string", "tag": True}, {"name": "usage", "type": "f64"}])
    for tags, fields in ((("other",), {}), ((), {"new": LongType()}), ((), {"usage": LongType()})):
        with pytest.raises(SchemaError):
            d.merge(tags, fields)
    for bad in ([], [{"name": "time", "type": "int"}], [{"name": "a", "type": "int"}] * 2, [{"name": "a", "type": "blob"}], [{"name": "a", "type": "int", "tag": True}]):
        with pytest.raises(SchemaError):
            declare("t", bad)
    a, b = spark.sql("select 1L t, 2L v"), spark.sql("select 1L t, 'x' w")
    assert schema_union([a, b]).columns == ["t", "v", "w"]
    with pytest.raises(SchemaError, match="'v'"):
        schema_union([a, spark.sql("select 1L t, 'x' v")])


def test_audit_chain(spark):
    records = seal_chain([{"at": f"2026-01-0{n}T00:00:00Z", "action": "login" if n % 2 else "drop", "principal": "é", "session": None, "target": None, "detail": '{"a":1}'} for n in range(1, 7)])
    schema = "seq int, at string, action string, principal string, session string, target string, detail string, prev_hash string, hash string"
    frame = lambda rs: spark.createDataFrame(rs, schema)
    assert tuple(verify_chain(frame(records)).first()) == (6, True, None)
    assert verify_chain(frame([r | {"detail": "x"} if r["seq"] == 4 else r for r in records])).first().broken_at == 4
    assert verify_chain(frame([r for r in records if r["seq"] != 3])).first().broken_at == 4
    assert [r.seq for r in audit_query(frame(records), action="login", since="2026-01-02", limit=1).collect()] == [5]
    logs = spark.createDataFrame([(1, "INFO", "a.b", "hello"), (2, "ERROR", "a.c", "oops"), (3, "DEBUG", "a.b", "hello")], "seq int, level string, target string, message string")
    assert [r.seq for r in log_query(logs, "INFO", target="a.").collect()] == [2, 1]


def test_exposition():
    text = '# HELP x\nup{job="a",q="x\\"y"} 1\nload{job="a",q="x\\"y"} 2.5 1700\nbad line\nnan NaN\nplain 3\n'
    assert parse_exposition(text) == [({"job": "a", "q": 'x"y'}, {"up": 1.0, "load": 2.5}), ({}, {"plain": 3.0})]
