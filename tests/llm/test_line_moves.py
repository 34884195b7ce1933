import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tidewell.llm import line_dedup, shared


@pytest.mark.parametrize("held", [50, 2_000_000])
def test_members_equal_brute_force(spark, monkeypatch, held):
    monkeypatch.setattr(line_dedup, "HELD_KEYS", held)
    rnd = random.Random(4)
    top = (1 << line_dedup.KEY_BITS) - 1
    pool = [0, top, top - 1, *(rnd.randrange(top) for _ in range(300)), *range(7000, 7100)]
    rows, lines_of = [], defaultdict(set)
    for n in range(900):
        lid = rnd.choice([n, n - 1, -n, (1 << 63) - 1 - n])
        keys = rnd.choices(pool, k=rnd.randint(0, 6)) + [rnd.randrange(top) for _ in range(3)] + [5] * (n % 2)
        for k in keys:
            lines_of[k].add(lid)
        rows.append((lid, bytearray(b"".join(k.to_bytes(line_dedup.KEY_BITS // 8, "little") for k in keys))))
    rows.append((1, None))
    found = spark.createDataFrame(rows, "lid long, keys binary").repartition(5)
    got = line_dedup._members(found).collect()
    want = {(k, lid) for k, lids in lines_of.items() if len(lids) > 1 for lid in lids}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_filter_passes_every_wanted_line(spark, monkeypatch):
    lids = np.random.default_rng(3).integers(-(1 << 63), 1 << 63, 3000)
    frame = spark.createDataFrame([(int(x),) for x in lids], "lid long").repartition(4)
    other = np.random.default_rng(8).integers(-(1 << 63), 1 << 63, 3000)
    for lines, most in ((1 << 18, 1 << 30), (100, 1 << 30), (100, 64)):
        monkeypatch.setattr(line_dedup, "FILTER_LINES", lines)
        monkeypatch.setattr(line_dedup, "FILTER_BITS", most)
        segments, bits = line_dedup._filter(frame)
        table = np.unpackbits(np.frombuffer(b"".join(segments), np.uint8))
        passed = []
        for x in (lids, other):
            own, places = line_dedup._places(x, len(segments), bits)
            passed.append(table[own * bits + places].all(axis=0).mean())
        assert passed[0] == 1 and (most == 64 or passed[1] < 0.1)


def test_neither_documents_nor_single_keys_are_moved(spark, monkeypatch):
    """Whatever the number of lines wanted: documents stay, and a row that is dealt out holds many keys."""
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", 0)
    plans, plain = {}, line_dedup.staged

    def seen(df, label):
        plans.setdefault(label, df._jdf.queryExecution().optimizedPlan().toString())
        return plain(df, label)

    monkeypatch.setattr(line_dedup, "staged", seen)
    words = [f"word{n}" for n in range(12)]
    docs = spark.createDataFrame([(n, " ".join([*words[:-1], f"other{n % 40}"])) for n in range(80)], "doc_id long, text string")
    assert line_dedup.dedup_lines(docs, wide=True).agg(F.sum("n_removed")).first()[0] == 79
    assert "Join" not in plans["line-texts"] and "line-places" not in plans
    assert "explode" not in plans["line-lists"] and "pid" in plans["line-lists"]


def test_staged_deletes_what_it_shuffled(spark):
    tracker = spark.sparkContext._jsc.sc().env().blockManager()
    shuffles = lambda: sum(b.isShuffle() for b in _blocks(spark, tracker))
    frame = shared.staged(spark.range(20_000).repartition(3, "id"), "moved")
    before = spark.conf.get(shared._CLEANUP)
    assert frame.count() == 20_000 and before == spark.conf.get(shared._CLEANUP)
    first = shuffles()
    for _ in range(3):
        shared.staged(spark.range(20_000).repartition(3, "id"), "moved")
    assert shuffles() <= first


def _blocks(spark, manager):
    blocks = manager.diskBlockManager().getAllBlocks()
    return [blocks.apply(n) for n in range(blocks.size())]


def test_only_lines_of_lists_are_sketched(spark):
    docs = spark.createDataFrame([(1, 2, "one two three four five six\nseven")], "d long, th long, t string")
    assert line_dedup._occurrences(docs, 1, 5, True).columns == ["d", "th", "no", "lk", "lid", "keys"]
    line = "one two three four five six"
    lid = int.from_bytes(xxhash.xxh3_128_digest(line.encode())[:8], "little", signed=True)
    (row,) = line_dedup._texts(spark.createDataFrame([(lid,)], "lid long"), docs, 5).where(F.col("lid") == lid).collect()
    sketch = line_dedup.block_keys(pa.array([line]))[2].view(np.int64)[0].tolist()
    assert tuple(row) == (lid, len(line), True, *sketch, line)


def test_links_found_later_join_the_roots(spark):
    rnd = random.Random(5)
    first, later = ([(rnd.randrange(m), rnd.randrange(m)) for _ in range(n)] for m, n in ((300, 90), (400, 60)))
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
    got = line_dedup._merged(shared.connected_components(frame(first)), frame(later)).collect()
    want = shared.connected_components(frame(first + later)).collect()
    assert {tuple(r) for r in got if r.node != r.root} == {tuple(r) for r in want if r.node != r.root}
    assert len({r.node for r in got}) == len(got)
