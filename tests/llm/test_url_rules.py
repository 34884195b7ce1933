import random

import pytest

from tidewell.llm import url_rules as ur
from tidewell.llm.queries import URL_RULES


def brute(rules, host, path):
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: (r.host.count("."), len(r.path), r.action == "block"), default=None)


def test_parts():
    assert ur.split_url(None) == ur.split_url("no scheme") == ("", "")
    assert ur.split_url("http://A.Éxample.com:80/P?q=/x#/y") == ("a.Éxample.com:80", "/P")
    assert ur.split_url("x://h?://z/y") == ("h", "") and ur.split_url("x://") == ("", "") and ur.split_url("a#://h/p") == ("h", "/p")


def test_trie_and_join_equal_brute_force(spark, monkeypatch):
    rnd = random.Random(1)
    hosts = ["com", "example.com", "www.example.com", "net", "b.net", "ample.com", ""]
    paths = ["/", "/en/", "/en", "/en/a", "/e", "", "/fr/", "/en/a/b", "//"]
    rules = [ur.UrlRule(rnd.choice(("allow", "block")), rnd.choice(hosts[:-1]), rnd.choice(paths)) for _ in range(18)]
    trie = ur.HostPathTrie(rules)
    for _ in range(3000):
        host, path = rnd.choice(["", "x.", "www."]) + rnd.choice(hosts), rnd.choice(paths) + rnd.choice(["", "a", "/b"])
        want, got = brute(rules, host, path), trie.find(host, path)
        if host:
            assert (got and (got.text, got.action)) == (want and (want.text, want.action)), (host, path)
    urls = [(n, f"http://{rnd.choice(['', 'x.', 'WWW.'])}{rnd.choice(hosts)}{rnd.choice(paths)}?q#f", "h") for n in range(200)] + [(200, None, "h"), (201, "", "h"), (201, "", "h")]
    pages = spark.createDataFrame(urls, "page_id long, url string, host string")
    first = sorted(map(str, ur.judge_urls(pages, rules).collect()))
    monkeypatch.setattr(ur, "MAX_BROADCAST_RULES", 0)
    assert sorted(map(str, ur.judge_urls(pages, rules).collect())) == first and len(first) == 203


def test_fixed_rules_default_and_empty(spark):
    pages = spark.createDataFrame([(1, "https://a.example.com/en/x"), (2, "https://www.example.com/en/x"), (3, "http://a.org/"), (4, "http://x.com")], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in ur.judge_urls(pages, URL_RULES, default="block").collect()}
    assert got == {1: ("example.com/en/", "block"), 2: ("www.example.com/en/", "allow"), 3: (None, "block"), 4: (None, "block")}
    assert ur.judge_urls(pages.limit(0), URL_RULES).count() == 0
    assert {r.verdict for r in ur.judge_urls(pages, []).collect()} == {"allow"}
    with pytest.raises(ValueError):
        ur.UrlRule("maybe", "a")
