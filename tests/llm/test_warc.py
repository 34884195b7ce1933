import random

import pytest

from tidewell.llm import warc

SCHEMA = "record_id long, url string, ts long, status int, headers map<string,string>, kind string"


def brute(rows):
    out = {}
    for r in rows:
        rid, url, ts, status, headers = r[:5]
        if status != 304:
            out[rid] = ("full", None)
            continue
        before = [b for b in rows if b[3] == 200 and None not in (b[1], b[2], ts, url) and warc.canonical_url(b[1]) == warc.canonical_url(url) and (b[2], b[0]) < (ts, rid)]
        if not before:
            out[rid] = ("missing", None)
            continue
        base = max(before, key=lambda b: (b[2], b[0]))
        h, g = ({k.lower(): v for k, v in (x or {}).items()} for x in (headers, base[4]))
        weak = lambda t: t.removeprefix("W/")
        if "etag" in h and "etag" in g:
            state = "resolved" if weak(h["etag"]) == weak(g["etag"]) else "mismatch"
        elif "last-modified" in h and "last-modified" in g:
            state = "resolved" if h["last-modified"] == g["last-modified"] else "mismatch"
        else:
            state = "unvalidated"
        out[rid] = (state, base[0] if state in ("resolved", "unvalidated") else None)
    return out


def test_equals_brute_force_with_a_hot_url_over_many_partitions(spark):
    rnd = random.Random(8)
    rows = []
    for rid in range(400):
        url = rnd.choice(["http://hot.com/a", "https://www.HOT.com/a/?utm_source=x#f", "http://b.org/x?b=2&a=1", "http://b.org/x?a=1&b=2", None, f"http://c{rid % 5}.net"])
        headers = rnd.choice([None, {}, {"ETag": '"1"'}, {"etag": 'W/"1"'}, {"ETag": '"2"'}, {"Last-Modified": "mon"}, {"Last-Modified": "tue", "Content-Length": "9"}])
        rows.append((rid, url, rnd.choice([None, *range(60)]), rnd.choice([200, 304, 304, 404, None]), headers, "clash"))
    got = warc.resolve_revisits(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.record_id: (r.outcome, r.base_id) for r in got} == brute(rows) and len(got) == 400


def test_merged_headers(spark):
    rows = [(1, "http://a/", 1, 200, {"ETag": '"x"', "Content-Length": "10", "Expires": "old"}, ""), (2, "http://a", 2, 304, {"etag": '"x"', "expires": "new", "content-length": "0", "x-other": "1"}, "")]
    got = {r.record_id: r for r in warc.resolve_revisits(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[2].headers == {"etag": '"x"', "content-length": "10", "expires": "new"} and got[2].base_id == 1


def test_empty_and_canonical(spark):
    assert warc.resolve_revisits(spark.createDataFrame([], SCHEMA)).count() == 0
    assert warc.canonical_url("HTTPS://www.A.com:443/x//y/?ref=1&b=2&a=%41#f") == "a.com/x/y?a=%41&b=2"
    assert warc.canonical_url(None) is None and warc.canonical_url("not a url") == "not a url"
    assert warc.canonical_url("http://[bad") == "http://[bad"


@pytest.mark.parametrize("text", ["http://x.com", "http://x.com/", "https://www.x.com:443"])
def test_same_page(text):
    assert warc.canonical_url(text) == "x.com/"


def test_escapes_that_tell_pages_apart_stay():
    same = lambda a, b: warc.canonical_url(f"http://a.com{a}") == warc.canonical_url(f"http://a.com{b}")
    assert same("/%7euser", "/~user") and same("/%c3%a9", "/%C3%A9")
    assert not same("/x%3Fb=1", "/x?b=1") and not same("/p%2Fq", "/p/q") and not same("/%FF", "/%FE")
    assert warc.canonical_url("http://u:p@a.com/") != warc.canonical_url("http://a.com/")
