import random

from tidewell.llm import decontaminate as dc


def brute(docs, items, width):
    words = lambda t: [w for w in __import__("re").split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) if w]
    out = []
    for doc_id, text in docs:
        w, hit, ids = words(text), set(), set()
        for item_id, phrase in items:
            p = words(phrase)
            k = min(width, len(p))
            grams = {tuple(p[n : n + k]) for n in range(len(p) - k + 1)} if k else set()
            found = [n for n in range(len(w) - k + 1) if k and tuple(w[n : n + k]) in grams]
            for n in found:
                hit.update(range(n, n + k))
            if found and item_id is not None:
                ids.add(str(item_id))
        out.append((doc_id, len(w), len(hit), len(ids), bool(hit)))
    return sorted(out, key=str)


def test_equals_brute_force(spark):
    rnd = random.Random(4)
    vocabulary = ["the", "of", "and", "é", "Äx", "n1", "Rare", "word", "zu"]
    text = lambda n: " ".join(rnd.choices(vocabulary, k=n))
    items = [(n, text(rnd.choice([1, 2, 3, 6, 9]))) for n in range(12)] + [(12, None), (13, "--"), (None, "rare rare rare"), (3, "of the Of"), (14, "absent words")]
    docs = [(n, text(rnd.randint(0, 40))) for n in range(40)] + [(40, None), (41, ""), (None, "Rare! rare, RARE"), (7, "the of"), (7, "the of"), (42, "x " + "the of and " * 3000)]
    docs += [(100 + n, f"{text(3)}, {items[n][1]}. {text(3)}") for n in range(12)]
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, d string")
    i = spark.createDataFrame(items, "item_id long, text string")
    got = dc.contamination(d, i, width=4)
    rows = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in got.collect()), key=str)
    assert rows == brute(docs, items, 4)
    kept = dc.drop_contaminated(d, i, width=4)
    assert kept.columns == d.columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(r[0]) for r in rows if not r[4])


def test_repeated_rows_and_null_ids_with_a_window(spark):
    phrase = "one two three four five"
    docs = [(1, f"x {phrase} y")] * 3 + [(None, f"{phrase} z")] * 2 + [(2, phrase), (2, "other words"), (0, f"{phrase} z"), (3, "clean"), (3, "clean"), (None, None), (None, None)]
    items = [(7, phrase), (8, "clean and more of it")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in dc.contamination(d, i, width=4).collect()), key=str)
    assert got == brute(docs, items, 4) and sum(r[4] for r in got) == 7
    kept = sorted(map(tuple, dc.drop_contaminated(d, i, width=4).collect()), key=str)
    assert kept == sorted([(2, "other words"), (3, "clean"), (3, "clean"), (None, None), (None, None)], key=str)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert dc.contamination(none, items).count() == 0
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert [r.n_hit for r in dc.contamination(docs, items.limit(0)).collect()] == [0]


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x beta y gamma"), (2, "gamma beta alpha"), (3, "alpha beta"), (4, "alpha b b b b b b b beta gamma")], "doc_id long, text string")
    items = dc.item_words(spark.createDataFrame([(9, "alpha beta gamma")], "item_id long, text string"))
    index = dc.build_index(docs, items.select("term"))
    found = dc.proximity_matches(index, items, within=4)
    assert sorted({r.d for r in found.collect()}) == [1, 2]


def test_main_path_is_native(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    plan = dc.contamination(docs, items)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
