import numpy as np
import pytest

from tidewell.llm import simhash


def groups_by_brute_force(values, distance):
    parent = list(range(len(values)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if bin(values[i] ^ values[j]).count("1") <= distance:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


@pytest.mark.parametrize("distance", [1, 2, 3])
def test_links_connect_exactly_what_brute_force_connects(spark, distance):
    rng = np.random.default_rng(distance)
    values = set()
    for base in rng.integers(0, 2**63, 12).tolist():
        now = base
        for step in range(40):
            for bit in rng.integers(0, 64, rng.integers(1, 5)).tolist():
                now ^= 1 << bit
            values.add(now)
    for low in range(40):  # one list with many members
        values.add(0x1234567800000000 + low * 3)
    values = sorted(values)
    want = groups_by_brute_force(values, distance)
    rows = [(v - (1 << 64) if v >> 63 else v, n) for n, v in enumerate(values)]
    links = simhash.near_links(spark.createDataFrame(rows, "fp long, rep long"), distance)
    for a, b in links.collect():
        assert bin(values[a] ^ values[b]).count("1") <= distance or want[a] == want[b]
    roots = {r.node: r.root for r in simhash.connected_components(links).collect()}
    assert [roots.get(n, n) for n in range(len(values))] == want


def test_nulls_empty_ties_and_clashing_columns(spark):
    rows = [(1, "a b c d", "x"), (2, "A b  c d", "y"), (3, None, "z"), (4, " \n", "z"), (None, "a b c d", "n"), (None, "only here", "n"), (1, "a b c d", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    out = sorted(map(tuple, simhash.near_duplicates(docs).select("doc_id", "component_id").collect()), key=str)
    assert out == sorted([(1, 1), (1, 1), (2, 1), (3, 3), (4, 3), (None, 1), (None, None)], key=str)
    kept = simhash.drop_near_duplicates(docs, shingle=3, distance=2)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == [(1, "a b c d"), (3, None), (None, "only here")]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0
    assert simhash.drop_near_duplicates(docs).count() == 0


def test_long_text_equals_its_pieces():
    text = "word " * 200_000 + "end"
    hashes = simhash.shingle_hashes(text, 3)
    assert len(hashes) == 199_999
    ones = sum(((hashes >> np.uint64(b)) & np.uint64(1)).sum() * 2 > len(hashes) and 1 << b for b in range(64))
    assert simhash.fingerprint(hashes) == ones


def test_fewer_words_than_a_shingle():
    assert len(simhash.shingle_hashes("one two", 3)) == 1
    assert simhash.fingerprint(simhash.shingle_hashes("", 3)) == 0
