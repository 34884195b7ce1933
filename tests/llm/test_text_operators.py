import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tidewell.llm import license_scan, line_dedup, ordinal, quality_rules


def test_license_base_places_labels_and_spans(spark):
    mit = license_scan.TEMPLATES["mit"]
    broken = mit.replace("free of charge, to any person", "gratis to each and every person")
    rows = [(1, "x CC-BY cc by 4.0. All rights\nreserved"), (2, None), (3, ""), (4, f"intro {mit} outro"), (5, f"intro {broken} outro"), (None, "general public license"), (6, "Released under the MIT License."), (6, "Released under the MIT License."), (7, "licensed under nothing " * 2000)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, labels string")
    got = collections.defaultdict(list)
    for r in license_scan.scan_licenses(docs).collect():
        got[r.doc_id].append(r)
    assert tuple(got[1][0])[1:6] == (10, 3, 1, 7, "cc-by,reserved")
    assert tuple(got[2][0])[1:8] == (0, 0, None, None, "", "", 0.0) == tuple(got[3][0])[1:8]
    assert got[4][0].labels == "mit" and got[4][0].score == 1.0 and got[4][0].spans[0]["first"] == 1
    assert got[5][0].labels == "mit" and 0.75 <= got[5][0].score < 1
    assert got[None][0].base_labels == "gpl" and len(got[6]) == 2 and got[6][0].labels == "mit" and got[7][0].labels == ""
    assert license_scan.scan_licenses(docs.limit(0)).count() == 0


def test_edit_distance_and_normal_form():
    rnd = random.Random(2)
    for _ in range(500):
        a, b, most = "".join(rnd.choices("abc", k=rnd.randint(0, 12))), "".join(rnd.choices("abc", k=rnd.randint(0, 12))), rnd.randint(0, 12)
        row = list(range(len(b) + 1))
        for n, x in enumerate(a, 1):
            new = [n]
            for m, y in enumerate(b, 1):
                new.append(min(row[m] + 1, new[-1] + 1, row[m - 1] + (x != y)))
            row = new
        got = line_dedup.edit_distance(a, b, most)
        assert got == row[-1] if row[-1] <= most else got > most
    assert line_dedup.normalised("  Hello, WORLD_12 34!é ") == "hello world 0 0 é"


def test_line_dedup_equals_brute_force(spark):
    rnd = random.Random(6)
    words = [f"w{n}x" for n in range(60)]
    base = [" ".join(rnd.choices(words, k=rnd.randint(5, 30))) for _ in range(25)]
    texts = []
    for n in range(60):
        lines = []
        for line in rnd.choices(base, k=4):
            own = line.split()
            if rnd.random() < 0.5:
                own[rnd.randrange(len(own))] += rnd.choice(["s", "!", "y"])
            lines.append(rnd.choice([" ".join(own), " ".join(own).upper() + "."]))
        texts.append("\n".join([*lines, "", "short one"]))
    rows = [(n, t, 7) for n, t in enumerate(texts)] + [(90, None, 1), (91, "", 1), (92, base[0], 1), (92, base[0], 1), (None, "a b c d e unique line here", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_lines int")
    occurrences = {}
    for i, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        for n, line in enumerate((t or "").split("\n")):
            z = line_dedup.normalised(line)
            if z.count(" ") >= 4:
                occurrences.setdefault(z, (i, n))
    known = list(occurrences)
    keys = collections.defaultdict(set)
    number, key, sketch = line_dedup.block_keys(pa.array(known))
    for n, k in zip(number, key):
        keys[n].add(int(k))
    bits = lambda a, b: sum((int(x) ^ int(y)).bit_count() for x, y in zip(sketch[a], sketch[b]))
    short = [x.count(" ") + 1 < line_dedup.BAND_WORDS for x in known]
    parent = list(range(len(known)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(known)):
        for b in range(a):
            if keys[a] & keys[b] and (short[a] or short[b] or bits(a, b) <= line_dedup.DISTANCE) and line_dedup.similar(known[a], known[b], 0.8):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    got = {}
    for r in line_dedup.dedup_lines(docs).collect():
        got[r.doc_id] = (r.text, r.n_lines, r.n_removed)
    for i, t, _ in rows:
        lines = t.split("\n") if t is not None else []
        keep = [x for n, x in enumerate(lines) if (z := line_dedup.normalised(x)) not in occurrences or occurrences[known[find(known.index(z))]] == (i, n)]
        assert got[i] == (None if t is None else "\n".join(keep), len(lines), len(lines) - len(keep)), i
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0
    assert line_dedup.dedup_lines(docs).columns == ["doc_id", "text", "n_lines", "n_removed"]


def test_statistics_equal_brute_force(spark):
    rnd = random.Random(9)
    texts = ["", None, "a", "a b c d e f g h " * 3, "x\nx\n\n \n y\n y", "# $é < \x1c \x0b q"] + ["".join(rnd.choices(["a", "b ", "\n", "é ", "#", "c d "], k=60)) for _ in range(60)]
    docs = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n_words long, text string").withColumnRenamed("n_words", "doc_id")
    for r in quality_rules.text_stats(docs).collect():
        t = texts[r.doc_id] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = collections.Counter(tuple(words[n : n + 8]) for n in range(len(words) - 7))
        covered = {m for n in range(len(words) - 7) if grams[tuple(words[n : n + 8])] > 1 for m in range(n, n + 8)}
        lines = [x for x in t.split("\n") if x.strip(" \t\n\v\f\r")]
        assert tuple(r)[1:] == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)), t


def test_bounds_and_certified_cutoffs(spark):
    assert quality_rules.binomial_upper(0, 100, 0.05) == pytest.approx(1 - 0.05 ** (1 / 100), abs=1e-9)
    assert quality_rules.binomial_upper(5, 5, 0.05) == 1.0 == quality_rules.binomial_upper(0, 0, 0.05)
    good = [(n, "en", "plain words " + str(n)) for n in range(2000)]
    bad = [(3000 + n, "en", "#*$% " * 30) for n in range(20)] + [(4000, "xx", "#*$% " * 30), (None, None, None)]
    docs = spark.createDataFrame(good + bad, "doc_id long, lang string, text string")
    labels = docs.where("doc_id < 2000").select("doc_id")
    out = {r.doc_id: r for r in quality_rules.judge(docs, labels).collect()}
    assert all(out[n].kept for n in range(2000)) and not out[3000].kept and out[4000].kept and out[None].kept
    assert quality_rules.judge(docs.limit(0), labels).count() == 0
    assert all(r.kept for r in quality_rules.judge(docs, labels.limit(0)).collect())


def test_ordinal_model_on_held_out_rows(spark):
    rnd = random.Random(3)
    words = [f"w{n}" for n in range(300)]
    make = lambda g: " ".join(rnd.choices(words, k=40) + (["awful"] if g == 1 else ["***junk"] * 6 if g == 0 else []))
    rows = [(n, make(n % 3), n % 3) for n in range(900)]
    docs = spark.createDataFrame([(n, t, 0.5) for n, t, _ in rows] + [(901, None, 0.5), (902, "", 0.5)], "doc_id long, text string, tail_probability double")
    graded = spark.createDataFrame([(n, g) for n, _, g in rows if n < 600] + [(0, None), (None, 1), (5, 9)], "doc_id long, grade int")
    model = ordinal.fit_grades(docs, graded, 3)
    assert list(model.thresholds) == sorted(model.thresholds)
    out = {r.doc_id: r for r in ordinal.score_grades(docs, model, tail=2).collect()}
    held = [(g, out[n]) for n, _, g in rows if n >= 600]
    assert np.mean([(r.tail_probability >= 0.5) == (g == 2) for g, r in held]) > 0.95
    means = [np.mean([r.expected_grade for g, r in held if g == k]) for k in range(3)]
    assert means == sorted(means) and out[901].expected_grade == out[902].expected_grade
    flat = ordinal.fit_grades(docs, graded.limit(0), 3)
    assert len({r.tail_probability for r in ordinal.score_grades(docs, flat, tail=1).collect()}) == 1
    assert ordinal.score_grades(docs.limit(0), model, tail=1).count() == 0


def test_copies_in_the_holdout_are_one_trial(spark):
    docs = spark.createDataFrame([(n, "en", "plain words here") for n in range(2000)] + [(5000, "en", "#*$% " * 30)], "doc_id long, lang string, text string")
    out = {r.doc_id: r.kept for r in quality_rules.judge(docs, docs.where("doc_id < 2000").select("doc_id")).collect()}
    assert all(out.values())  # one distinct text certifies nothing


def test_line_lists_beyond_a_chunk_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "CHUNK", 16)
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choices("abcdefgh", k=7))
    shared, lines = [word() for _ in range(6)], []
    for own in range(6):  # families that share a third of their words
        base = shared + [word() for _ in range(12)]
        for _ in range(12):
            line = list(base)
            for n in rnd.sample(range(18), rnd.randint(0, 2)):
                line[n] = word()
            lines.append(" ".join(line))
    long = " ".join(word() for _ in range(2000))
    lines += [long, long + " more", "x " + long[: len(long) // 2]]
    docs = spark.createDataFrame([(n, line, "a", "b", 1) for n, line in enumerate(lines)], "doc_id long, text string, gone string, lk string, __c0 int")
    keys = collections.defaultdict(set)
    number, key, sketch = line_dedup.block_keys(pa.array(lines))
    for n, k in zip(number, key):
        keys[n].add(int(k))
    root = list(range(len(lines)))
    for a in range(len(lines)):
        for b in range(a):
            apart = sum((int(x) ^ int(y)).bit_count() for x, y in zip(sketch[a], sketch[b]))
            bound = max(len(lines[a]), len(lines[b])) > line_dedup.LONG_LINE or apart <= line_dedup.DISTANCE
            if keys[a] & keys[b] and bound and line_dedup.similar(lines[a], lines[b], 0.8):
                x, y = root[a], root[b]
                root = [min(x, y) if r in (x, y) else r for r in root]
    got = {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(docs).collect()}
    assert got == {n: int(root[n] != n) for n in range(len(lines))}
    assert len(set(root)) < 20
