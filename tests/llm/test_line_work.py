"""What line dedup moves and compares: places in byte columns, pairs of lines with few words in their lists."""

import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from tidewell.llm import line_dedup


@pytest.mark.parametrize("held", [7, 1 << 18])
def test_places_that_go_equal_brute_force(spark, monkeypatch, held):
    monkeypatch.setattr(line_dedup, "HELD_PLACES", held)
    rnd = random.Random(6)
    lines = [rnd.randbytes(16) for _ in range(60)]
    lines += [x[:8] + rnd.randbytes(8) for x in lines[:5]]  # the first 64 bits alone do not tell these apart
    lid = lambda x: int.from_bytes(x[:8], "little", signed=True)
    places = [(bytearray(rnd.choice(lines)), rnd.choice([-(1 << 63), *range(40)]), rnd.randrange(-2, 2), n) for n in range(300)]
    places += places[:20]  # documents that come twice
    linked = sorted(map(lid, rnd.sample(lines[10:60], 20)))
    roots = [(x, linked[k // 5 * 5]) for k, x in enumerate(linked)]
    groups = {}
    for lk, *place in places:
        groups.setdefault(dict(roots).get(lid(lk), bytes(lk)), set()).add(tuple(place))
    want = {p for g in groups.values() for p in g if p != min(g)}
    found = spark.createDataFrame(places, "lk binary, d long, th long, no int").repartition(3)
    frame = spark.createDataFrame(roots, "node long, root long")
    assert {tuple(r) for r in line_dedup._gone(found, frame).collect()} == want
    alone = {p for lk in lines for g in [{tuple(x[1:]) for x in places if bytes(x[0]) == lk}] for p in g if p != min(g)}
    assert {tuple(r) for r in line_dedup._gone(found, frame.limit(0)).collect()} == alone
    assert not line_dedup._gone(found.limit(0), frame.limit(0)).collect()


def test_pairs_of_few_words_are_compared_in_their_lists(spark, monkeypatch):
    plans, rows, plain = {}, {}, line_dedup.staged

    def seen(df, label):
        out = plain(df, label)
        plans.setdefault(label, df._jdf.queryExecution().optimizedPlan().toString())
        rows.setdefault(label, out.count())
        return out

    monkeypatch.setattr(line_dedup, "staged", seen)
    rnd = random.Random(2)
    base = "alpha bravo charlie delta echo foxtrot golf hotel india"
    texts = [base.replace(rnd.choice(base.split()), f"other{n}") for n in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = line_dedup.dedup_lines(docs, wide=True).collect()
    assert sum(r.n_removed for r in got) == 29 and rows["line-forest"] and not rows["line-pairs"]
    assert "pid" in plans["line-classes"] and "Join" not in plans["line-classes"]


def test_lists_beyond_a_few_lines_equal_all_pairs():
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choices("abcdef", k=rnd.randint(2, 7)))
    keys, lines = [], []
    for key in range(12):
        heads = [[word() for _ in range(7)] for _ in range(4)]
        for _ in range(rnd.choice([2, 5, 8, 9, 30, 90])):
            line = list(rnd.choice(heads))
            line[rnd.randrange(7)] = word()
            keys.append(key)
            lines.append(" ".join(line))
    sketch = line_dedup.line_sketches(pa.array(lines)).view(np.int64)
    lid = np.array([lines.index(x) for x in lines])
    order = np.lexsort((lid, keys))
    columns = (np.array(keys), lid, np.array([len(x) for x in lines]), np.ones(len(lines), bool), sketch[:, 0], sketch[:, 1], np.array(lines, object))
    links = [(a, b) for x in line_dedup._forest(0.8)(*(c[order] for c in columns)) for a, b, ok in zip(x[0], x[1], x[3]) if ok]

    def parts(pairs):
        up = {}
        find = lambda x: x if up.get(x, x) == x else find(up[x])
        for a, b in pairs:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
        return {x: find(x) for x in set(lid.tolist())}

    near = [(lid[i], lid[j]) for i in range(len(lines)) for j in range(i) if keys[i] == keys[j] and line_dedup.similar(lines[i], lines[j], 0.8)]
    assert parts(links) == parts(near) and len(set(parts(near).values())) < len(set(lines)) / 2


def test_normal_lines_equal_their_expressions(monkeypatch):
    monkeypatch.setattr(line_dedup, "_MAPPED", 5)
    rnd = random.Random(4)
    for _ in range(500):
        texts = pa.array(["".join(rnd.choices("aZ09 .,\n\t\r\x00é́–漢٢²İKẞΣ×÷ſ　😀½ ", k=rnd.randint(0, 14))) for _ in range(rnd.randint(1, 5))]).slice(rnd.randint(0, 1))
        flat = pc.replace_substring_regex(pc.replace_substring_regex(pc.utf8_lower(texts), line_dedup._OTHER, " "), r"\p{Nd}+", "0")
        lists = pc.split_pattern(flat, "\n")
        lines, counts = line_dedup.normal_lines(texts)
        assert lines.equals(pc.utf8_trim(lists.flatten(), " ")) and counts.tolist() == pc.list_value_length(lists).to_pylist()
