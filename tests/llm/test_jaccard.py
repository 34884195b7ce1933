import random

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from tidewell.llm import jaccard, simhash


def grams(text):
    words = (text or "").lower().split()
    return {tuple(words[n : n + 5]) for n in range(max(1, len(words) - 4))} if words else set()


def groups_by_brute_force(docs):
    sets, parent = [grams(t) for _, t in docs], list(range(len(docs)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(docs)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {docs[k][0]: docs[find(k)][0] for k in range(len(docs))}


def corpus():
    """Originals, copies with a few changed words (about the limit), chains of such, and a passage that many share."""
    rnd = random.Random(8)
    words = [f"w{n}" for n in range(3000)]
    passage = " ".join(rnd.choices(words, k=60))
    texts = ["", None, " ", "one", "One", "two words", "a b c d e", "a b c d e f"]
    for _ in range(30):
        own = rnd.choices(words, k=rnd.choice([12, 60, 250]))
        if rnd.random() < 0.4:
            own = own[: len(own) // 2] + passage.split() + own[len(own) // 2 :]
        for _ in range(rnd.randint(1, 8)):
            texts.append(" ".join(own))
            new = list(own)
            for _ in range(rnd.randint(0, max(1, len(own) // 40))):
                new[rnd.randrange(len(own))] = rnd.choice(words)
            if rnd.random() < 0.5:
                own = new
            texts.append(" ".join(new))
    rnd.shuffle(texts)
    return list(enumerate(texts))


def test_links_equal_brute_force_on_shingles(spark):
    docs = corpus()
    want = groups_by_brute_force(docs)
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard.near_duplicates(rows).collect()} == want
    kept = corpus_pipeline.dedup_documents(spark, rows, "")
    assert kept.columns == rows.columns and {r.doc_id for r in kept.collect()} == set(want.values())


def test_nulls_and_empty_table(spark):
    rows = [(1, "a b c d e f", "x"), (2, "A b  c d e f", "y"), (None, "a b c d e f", "n"), (None, "only here", "n"), (None, "only  HERE", "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    assert sorted(((r.doc_id, r.text.lower().split()[0]) for r in jaccard.drop_near_duplicates(docs).collect()), key=str) == [(1, "a"), (None, "only")]
    assert jaccard.drop_near_duplicates(docs.limit(0)).count() == 0


def test_candidates_are_all_pairs_within_the_simhash_distance_once():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 30).astype(np.uint64)
    sh = np.concatenate([base ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 8), replace=False))) for _ in range(12)])
    n = rng.integers(80, 130, len(sh))
    rows = []
    for k, choice in enumerate(jaccard._CHOICES):
        mask = np.uint64(sum(int(jaccard._MASKS[b]) for b in choice))
        place = np.unique(sh & mask, return_inverse=True)[1]
        rows += [(k << jaccard._KEY_BITS | int(p), int(size), node) for node, (p, size) in enumerate(zip(place, n))]
    key, size, node = (np.array(c) for c in zip(*sorted(rows)))
    got = [tuple(sorted(p)) for i, j in jaccard._candidates(key, size, sh[node], jaccard.DISTANCE) for p in zip(node[i].tolist(), node[j].tolist())]
    want = {(a, b) for b in range(len(sh)) for a in range(b) if int(sh[a] ^ sh[b]).bit_count() <= jaccard.DISTANCE and 5 * min(n[a], n[b]) >= 4 * max(n[a], n[b])}
    assert len(want) > 500 and len(got) == len(set(got)) and set(got) == want


def test_near_duplicates_carry_simhash_fingerprints_of_distinct_words(spark):
    rows = spark.createDataFrame([(1, "a b A c"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r.sh & (1 << 64) - 1 for r in jaccard.set_keys(rows).collect()}
    assert got == {1: simhash.fingerprint(np.unique(simhash.shingle_hashes("a b c", 1))), 2: 0}
    keys = rows.select(F.lit(-1).cast("long").alias("sh")).select(jaccard._keys("sh")).distinct().collect()
    assert len(keys) == len(jaccard._CHOICES) and all(r.key.bit_length() <= jaccard._KEY_BITS + 6 for r in keys)


def test_bound_on_shared_shingles_loses_no_pair():
    rng = np.random.default_rng(6)
    lost = passed = pairs = 0
    for size in (5, 60, 400, 3000):
        sets = []
        for part in rng.random(40) * 0.4:
            own = np.random.default_rng(size).integers(0, 2**63, size).astype(np.uint64)
            new = rng.random(size) < part
            sets.append(np.unique(np.where(new, rng.integers(0, 2**63, size).astype(np.uint64), own)))
        odd, n = np.frombuffer(b"".join(map(jaccard._odd, sets)), np.uint64).reshape(len(sets), -1), np.array(list(map(len, sets)))
        i, j = np.triu_indices(len(sets), 1)
        for a, b, may in zip(i, j, jaccard._may_link(odd, n, i, j)):
            both = len(np.intersect1d(sets[a], sets[b]))
            near = 9 * both >= 4 * (n[a] + n[b])
            pairs, passed, lost = pairs + 1, passed + may, lost + (near and not may)
    assert lost == 0 and passed < pairs
