from decimal import Decimal

import gzip
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewell.sources import lineproto as lp
from tidewell.sources import remote_write as rw


def test_escapes_types_and_precision():
    p = lp.parse_lines(r'weird\ table,k\==v\,x msg="say \"hi\"",ok=true,n=7u 1700000000', "s")[0]
    assert (p.table, p.tags, p.time) == ("weird table", {"k=": "v,x"}, 1_700_000_000 * 10**9)
    assert p.fields == {"msg": 'say "hi"', "ok": True, "n": Decimal(7)}
    p = lp.parse_lines('m,city=Köln\\,\\ Deutschland s="ü\\"ü" 100')[0]
    assert (p.tags, p.fields) == ({"city": "Köln, Deutschland"}, {"s": 'ü"ü'})
    assert lp.parse_lines("m f=1.5", default=9)[0].time == 9
    assert lp.parse_lines("time,h=time time_ms=1,uptime=2i 100")[0].fields == {"time_ms": 1.0, "uptime": 2}
    assert lp.parse_lines("# c\n\nm a=1,a=2 5\r\n")[0].fields == {"a": 2.0}


@pytest.mark.parametrize("line", ["m, f=1", "m f=notanumber", 'm f="unterminated', "tt,h=a time=1,v=1 100", "tt,time=x v=1 100", "m", "m f=1 12x", "m f=9223372036854775808i", "m f=-1u", "m f=1 9223372036854775808", "m f=nan"])
def test_bad_lines(line):
    with pytest.raises(lp.LineError, match="line 2"):
        lp.parse_lines(f"ok f=1\n{line}")
    good, bad = lp.split_rejects(f"ok f=1\n{line}\nok f=2")
    assert len(good) == 2 and [b[0] for b in bad] == [2]


def test_unknown_precision():
    with pytest.raises(ValueError):
        lp.parse_lines("m f=1", "fortnight")


names = st.text(st.characters(blacklist_categories=("Cs", "Cc"), blacklist_characters="\\\n\r#"), min_size=1, max_size=6).filter(lambda s: s.strip() == s and s != "time")
values = st.one_of(st.floats(allow_nan=False, allow_infinity=False), st.integers(-(2**63), 2**63 - 1), st.integers(0, 2**64 - 1).map(Decimal), st.booleans(), st.text(st.characters(blacklist_categories=("Cs",), blacklist_characters="\n\r"), max_size=8))


@settings(max_examples=200, deadline=None)
@given(names, st.dictionaries(names, names, max_size=3), st.dictionaries(names, values, min_size=1, max_size=3), st.integers(-(2**62), 2**62))
def test_lines_round_trip(table, tags, fields, time):
    point = lp.Point(table, tags, fields, time, 1)
    assert lp.parse_lines(lp.to_line(point)) == [point]


def test_bodies_are_atomic(spark):
    rows = [(1, b"a f=1 1\na f=2 2"), (2, b"a f=3 3\nbroken"), (3, gzip.compress(b"b,t=x g=1i 4")), (4, b"\xff\xfe"), (5, None)]
    bodies = spark.createDataFrame(rows, "body long, data binary")
    out = lp.read_bodies(bodies).collect()
    assert sorted((r.body, r.table) for r in out if r.error is None) == [(1, "a"), (1, "a"), (3, "b")]
    assert sorted(r.body for r in out if r.error) == [2, 4]
    loose = lp.read_bodies(bodies, strict=False).collect()
    assert sum(r.body == 2 for r in loose) == 2


def _varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _field(number, data):
    return _varint(number << 3 | 2) + _varint(len(data)) + data


def request(series):
    body = b""
    for labels, samples in series:
        one = b"".join(_field(1, _field(1, k.encode()) + _field(2, v.encode())) for k, v in labels.items())
        one += b"".join(_field(2, b"\x09" + struct.pack("<d", v) + b"\x10" + _varint(ms % (1 << 64))) for ms, v in samples)
        body += _field(1, one)
    literal = b"".join(bytes([61 << 2]) + struct.pack("<H", len(c) - 1) + c for c in (body[n : n + 60_000] for n in range(0, len(body), 60_000)))
    return _varint(len(body)) + literal


def test_remote_write_wire():
    series = [({"__name__": "up", "job": "a"}, [(1, 1.0), (-5, 0.5)])]
    assert rw.decode_write_request(rw.snappy_decompress(request(series))) == series
    # a copy that overlaps itself
    assert rw.snappy_decompress(bytes([6, 0, ord("a"), (5 - 4) << 2 | 1, 1])) == b"aaaaaa"
    with pytest.raises(ValueError):
        rw.snappy_decompress(bytes([6, 1 << 2 | 1, 9]))


def test_remote_write_rows(spark):
    good = request([({"__name__": "up", "job": "a"}, [(1, 1.0), (2, float("nan"))])])
    bad = request([({"job": "a"}, [(1, 1.0)])])
    out = rw.read_requests(spark.createDataFrame([(1, good), (2, bad), (3, b"\x05junk")], "body long, data binary")).collect()
    assert [(r.table, r.tags, r.floats, r.time) for r in out if r.error is None] == [("up", {"job": "a"}, {"value": 1.0}, 1_000_000)]
    assert sorted(r.body for r in out if r.error) == [2, 3]
