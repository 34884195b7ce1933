import random

import numpy as np

from tidewell.llm import line_dedup


def edited(rnd, line, kind):
    """One replaced word, or one changed character in every tenth place."""
    words = line.split()
    if kind == "word":
        words[rnd.randrange(len(words))] = "".join(rnd.choices("abcdefghij", k=rnd.randint(2, 8)))
        return " ".join(words)
    chars = list(line)
    for at in rnd.sample(range(len(chars)), len(chars) // 10):
        chars[at] = rnd.choice("klmnop")
    return "".join(chars)


def test_recall_against_edit_similarity_alone(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choices("abcdefghij", k=rnd.randint(2, 8)))
    pairs = []
    for words in (5, 10, 15, 20, 30, 50):
        for _ in range(100):
            line = " ".join(word() for _ in range(words))
            for kind in ("word", "chars"):
                other = edited(rnd, line, kind)
                if other != line and line_dedup.similar(line_dedup.normalised(line), line_dedup.normalised(other), 0.8) and other.count(" ") == words - 1:
                    pairs.append((words, kind, line, other))
                    line = " ".join(word() for _ in range(words))
    docs = spark.createDataFrame([(2 * n + k, p[2 + k]) for n, p in enumerate(pairs) for k in (0, 1)], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(docs, wide=True).collect()}
    assert not any(got[2 * n] for n in range(len(pairs)))
    found = {}
    for n, (words, kind, _, _) in enumerate(pairs):
        found.setdefault((kind, words), []).append(got[2 * n + 1])
    print({k: (sum(v), len(v)) for k, v in sorted(found.items())})
    assert sum(sum(v) for v in found.values()) >= 0.95 * len(pairs)
    assert all(sum(v) >= 0.85 * len(v) for (kind, words), v in found.items() if kind == "word")


def test_short_lines_link_only_if_equal(spark):
    docs = spark.createDataFrame([(1, "All rights reserved\n\n--\nHome page"), (2, "all rights  RESERVED.\n\n--\nHome pages"), (3, "x\nX\n你好世界"), (4, "你好世界"), (5, None)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs, wide=True, short=True).collect()}
    assert got == {1: "All rights reserved\n\n--\nHome page", 2: "\n--\nHome pages", 3: "x\n你好世界", 4: "", 5: None}
    assert {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(docs, wide=True).collect()} == dict.fromkeys(range(1, 6), 0)


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a):
        new = [i + 1]
        for j, d in enumerate(b):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[-1] + 1))
        row = new
    return row[-1]


def test_distance_bounds_lose_no_pair():
    rnd = random.Random(3)
    lost = passed = pairs = 0
    for _ in range(60):
        lines = []
        for _ in range(4):
            base = rnd.choices("abcdeé漢 ", k=rnd.choice([0, 1, 5, 30, 63, 64, 65, 90, 140]))
            for _ in range(2):
                line = list(base)
                for _ in range(rnd.randint(0, max(1, len(line) // 4))):
                    at, do = rnd.randrange(len(line) + 1), rnd.random()
                    line[at : at + (do > 0.3)] = [] if do > 0.7 else [rnd.choice("abxy漢")]
                lines.append("".join(line))
        lines.append("x" * (line_dedup.ALIGNED + 1))
        i, j = np.nonzero(~np.eye(len(lines), dtype=bool))
        for a, b, may in zip(i.tolist(), j.tolist(), line_dedup.distance_bounds(lines, i, j, 0.8).tolist()):
            if max(len(lines[a]), len(lines[b])) > line_dedup.ALIGNED:
                assert may
                continue
            near = plain_distance(lines[a], lines[b]) <= int(0.2 * max(len(lines[a]), len(lines[b])) + 1e-9)
            pairs, passed, lost = pairs + 1, passed + may, lost + (near and not may)
    assert lost == 0 and passed < pairs / 3
    assert line_dedup.distance_bounds([], np.zeros(0, int), np.zeros(0, int), 0.8).shape == (0,)


def test_lines_of_any_length_link_by_edit_similarity(monkeypatch):
    rnd = random.Random(9)
    words = ["".join(rnd.choices("abcdefghij", k=9)) for _ in range(1100)]
    # A changed character in a third of the words: few trigrams stay, and 97 of 100 characters.
    near = [w[:4] + "x" + w[5:] if n % 3 == 0 else w for n, w in enumerate(words)]
    far = ["".join(rnd.choices("klmnop", k=9)) if n % 4 == 0 else w for n, w in enumerate(words)]
    one, two, three = (" ".join(w) for w in (words, near, far))
    assert min(map(len, (one, two, three))) > line_dedup.LONG_LINE
    assert line_dedup.similar(one, two, 0.8) and not line_dedup.similar(one, three, 0.8)
    # Bands give what the plain distance gives.
    monkeypatch.setattr(line_dedup, "LONG_LINE", 4)
    monkeypatch.setattr(line_dedup, "FIRST_BAND", 1)
    for _ in range(1500):
        a = "".join(rnd.choices("abé", k=rnd.randint(6, 40)))
        b = list(a)
        for _ in range(rnd.randint(0, 9)):
            at, do = rnd.randrange(len(b) + 1), rnd.random()
            b[at : at + (do > 0.3)] = [] if do > 0.6 else [rnd.choice("abx")]
        b, most = "".join(b), rnd.randint(0, 12)
        want = plain_distance(a, b)
        assert min(line_dedup.edit_distance(a, b, most), most + 1) == min(want, most + 1)
        if most < len(a):
            assert line_dedup._banded(a, b, most) == min(want, most + 1)


def test_many_edit_distances_equal_single_ones(monkeypatch):
    rnd, lines = random.Random(11), ["", "x"]
    for _ in range(150):
        x = rnd.choices("abcdeé漢 \U0001f600", k=max(1, rnd.choice([1, 5, 64, 65, 128, 300, 1200]) - rnd.randrange(3)))
        y = list(x)
        for _ in range(rnd.randint(0, len(x) // 4 + 1)):
            at = rnd.randrange(len(y) + 1)
            y[at : at + rnd.randrange(2)] = rnd.choices("abz ", k=rnd.randrange(2))
        lines += ["".join(x), "".join(y)]
    i = np.array([*range(0, len(lines), 2), *(rnd.randrange(len(lines)) for _ in range(100))])
    j = np.array([*range(1, len(lines), 2), *(rnd.randrange(len(lines)) for _ in range(100))])
    long = np.array([max(len(lines[a]), len(lines[b])) for a, b in zip(i, j)])
    want = np.array([line_dedup.edit_distance(lines[a], lines[b], 10_000) for a, b in zip(i, j)])
    for table, longest in ((line_dedup.TABLE_BYTES, line_dedup.BATCHED), (1 << 16, 500)):
        monkeypatch.setattr(line_dedup, "TABLE_BYTES", table)
        monkeypatch.setattr(line_dedup, "BATCHED", longest)
        for least in (0.0, 0.6, 0.8, 0.95):
            most = ((1 - least) * long + 1e-9).astype(int)
            assert (np.minimum(line_dedup.edit_distances(lines, i, j, most), most + 1) == np.minimum(want, most + 1)).all()
        pairs = [line_dedup.similar(lines[a], lines[b], 0.8) for a, b in zip(i, j)]
        assert line_dedup.similar_pairs(lines, i, j, 0.8).tolist() == pairs
