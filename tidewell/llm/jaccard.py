"""Near-duplicate documents: SimHash fingerprints, then the Jaccard similarity of word shingles.

Each distinct word of a text votes in a 64-bit SimHash. Two texts that share
4/5 of their shingles of five words share nearly all words, so their
fingerprints differ in few bits (shingles themselves would move about ten).
Candidates are all pairs within ``DISTANCE`` bits. They come from an inverted
index on positions, cut finer than bytes: of ``BLOCKS`` blocks of bits at least
``AGREE`` are equal in such a pair (pigeonhole), so there is a list for each
choice of that many blocks and their bits, and no pair is lost. A pair is taken
in the first list where it meets only. Set sizes that rule 4/5 out end a list's
comparison early, as its members are in the order of size.

Of each list only a spanning forest of the candidates leaves the task, the
closest ones first. Its edges are verified on whole shingle sets; lists in
which an edge fails are walked again for candidates between parts that are not
connected yet, without those that a bound on shared shingles rules out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import by_lists, connected_components, staged, steps
from .simhash import fingerprint, keep_one, shingle_hashes

#: Bits in which the SimHashes of two candidates may differ, blocks of bits, and blocks that must agree.
DISTANCE, BLOCKS = 8, 10
AGREE = BLOCKS - DISTANCE
#: Candidates this close go into a list's forest before all others.
CLOSE = 3
#: Classes that a set's shingles are dealt to, for the bound of ``_may_link``.
CLASSES = 512
#: Up to so many ids are broadcast; more are joined.
BROADCAST_IDS = 200_000


def _set(text: str | None, shingle: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, shingle))


def _set_key(hashes: np.ndarray) -> int:
    """A hash of a set; 0 for the empty one."""
    return xxhash.xxh3_64_intdigest(hashes.tobytes()) if len(hashes) else 0


def _odd(hashes: np.ndarray) -> bytes:
    """A bit for each of ``CLASSES``: whether the set holds an odd number of its shingles."""
    return np.packbits(np.bincount((hashes & np.uint64(CLASSES - 1)).astype(np.int64), minlength=CLASSES) & 1).tobytes()


def _may_link(odd: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """False only for sets that cannot be similar: a class that differs in its bit holds a shingle that one set lacks, and
    similarity of 4/5 allows a ninth of both sizes of those."""
    return 9 * np.bitwise_count(odd[i] ^ odd[j]).sum(axis=1, dtype=np.int64) <= n[i] + n[j]


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[f"`{id_col}`"].cast("long").alias("doc_id"), F.coalesce(docs[f"`{text_col}`"], F.lit("")).alias("t"))


def set_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """(doc_id, fp, n, sh, odd) for each row: its id, a hash of its shingle set, the set's size, the SimHash of its distinct words and ``_odd``."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "t"):
                texts = part.column("t").to_pylist()
                sets = [_set(t, shingle) for t in texts]
                keys, prints = [_set_key(s) for s in sets], [fingerprint(_set(t, 1)) for t in texts]
                arrays = [part.column("doc_id"), pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(list(map(len, sets)), pa.int64()), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(map(_odd, sets), pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "fp", "n", "sh", "odd"])

    return _rows(docs, id_col, text_col).mapInArrow(of, "doc_id long, fp long, n long, sh long, odd binary")


# -- the index ---------------------------------------------------------------

_EDGES = [64 * k // BLOCKS for k in range(BLOCKS + 1)]
_MASKS = np.array([(1 << b) - (1 << a) for a, b in zip(_EDGES, _EDGES[1:])], np.uint64)
_CHOICES = list(combinations(range(BLOCKS), AGREE))
#: Bits of a key below the number of its choice.
_KEY_BITS = AGREE * -(-64 // BLOCKS)


def _keys(sh: str) -> Column:
    """The key of each choice of blocks: the choice's number and the blocks' bits."""
    out = []
    for n, choice in enumerate(_CHOICES):
        key, at = F.lit(n << _KEY_BITS), 0
        for b in choice:
            bits = F.shiftrightunsigned(sh, _EDGES[b]).bitwiseAND(F.lit((1 << (_EDGES[b + 1] - _EDGES[b])) - 1).cast("long"))
            key, at = key.cast("long").bitwiseOR(F.shiftleft(bits, at)), at + _EDGES[b + 1] - _EDGES[b]
        out.append(key)
    return F.explode(F.array(*out)).alias("key")


def _candidates(key: np.ndarray, n: np.ndarray, sh: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of each list within ``most`` bits whose sizes allow a similarity of 4/5; rows are sorted by list and size.

    A pair comes only in the list of the first blocks in which it agrees.
    """
    i, choices = np.arange(len(key)), np.array(_CHOICES)
    for step in range(1, len(key)):
        i = i[: np.searchsorted(i, len(key) - step)]
        i = i[(key[i] == key[i + step]) & (5 * n[i] >= 4 * n[i + step])]
        if not len(i):
            return
        near = i[np.bitwise_count(sh[i] ^ sh[i + step]) <= most]
        if len(near):
            same = ((sh[near] ^ sh[near + step])[:, None] & _MASKS) == 0
            first = np.argsort(~same, axis=1, kind="stable")[:, :AGREE]
            near = near[(first == choices[key[near] >> _KEY_BITS]).all(axis=1)]
            yield near, near + step


def _forest(key, n, node, sh) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges (a < b) that span the graph of each list's candidates, and the list's key."""
    up, left, right = np.arange(len(key)), [], []

    def find(x: int) -> int:
        while (y := int(up[x])) != x:
            up[x] = up[y]
            x = y
        return x

    def roots(x: np.ndarray) -> np.ndarray:
        x = up[x]
        while (up[x] != x).any():
            x = up[x]
        return x

    for most in (CLOSE, DISTANCE):
        for i, j in _candidates(key, n, sh.view(np.uint64), most):
            apart = roots(i) != roots(j)
            for a, b in zip(i[apart].tolist(), j[apart].tolist()):
                x, y = find(a), find(b)
                if x != y:
                    up[max(x, y)] = min(x, y)
                    left.append(a)
                    right.append(b)
    a, b = node[left], node[right]
    return np.minimum(a, b), np.maximum(a, b), key[left]


def _between(key, n, node, sh, odd, part) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidates (a < b) of a list whose parts differ and that ``_may_link``."""
    odd = np.frombuffer(b"".join(odd), np.uint64).reshape(len(key), -1)
    for i, j in _candidates(key, n, sh.view(np.uint64), DISTANCE):
        apart = part[i] != part[j]
        i, j = i[apart], j[apart]
        may = _may_link(odd, n, i, j)
        a, b = node[i[may]], node[j[may]]
        yield np.minimum(a, b), np.maximum(a, b)


def _lists(sets: DataFrame, *more: str, keys: DataFrame | None = None) -> DataFrame:
    """The lists of ``sets`` that have shingles, each whole in one partition; only those of ``keys`` (key) if given."""
    rows = sets.where("n > 0").select(_keys("sh"), "n", F.col("fp").alias("node"), "sh", *more)
    if keys is not None:
        rows = rows.join(F.broadcast(keys) if keys.count() <= BROADCAST_IDS else keys, "key", "left_semi")
    return rows.repartition("key").sortWithinPartitions("key")


def _verified(pairs: DataFrame, docs: DataFrame, prints: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """``pairs`` (a, b) with ``ok``: whether their sets have similarity 4/5. Sets are made again, from one row each."""
    wanted = pairs.select(F.col("a").alias("fp")).unionAll(pairs.select("b")).distinct()
    wanted = staged(prints.join(wanted, "fp").groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "wanted-sets")
    few = wanted.count() <= BROADCAST_IDS
    small = lambda df: F.broadcast(df) if few else df

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "t"):
                sets = [_set(t.as_py(), shingle) for t in part.column("t")]
                keys = np.array([_set_key(s) for s in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([s.tobytes() for s in sets], pa.binary())], ["fp", "s"])

    rows = _rows(docs, id_col, text_col).join(small(wanted.select("doc_id").distinct()), "doc_id", "left_semi").select("t")
    sets = rows.mapInArrow(of, "fp long, s binary").join(small(wanted.select("fp")), "fp", "left_semi")
    sets = staged(sets.groupBy("fp").agg(F.first("s").alias("s")), "wanted-shingles")

    @F.udf("boolean", useArrow=True)
    def close(x: bytes, y: bytes) -> bool:
        x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        both = len(np.intersect1d(x, y, assume_unique=True))
        return bool(9 * both >= 4 * (len(x) + len(y)))

    both = pairs.join(sets.select(F.col("fp").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("fp").alias("b"), F.col("s").alias("y")), "b")
    return both.select("a", "b", close("x", "y").alias("ok"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """(doc_id long, fp long, component_id long) for each row of ``docs``.

    Rows link if the SimHashes of their distinct lower-cased words differ in at
    most ``DISTANCE`` bits and the sets of their word shingles have a Jaccard
    similarity of 0.8 or more; no such link is missed. Fewer words than a shingle
    make one; texts without words, null ones too, link to each other.
    component_id is the smallest doc_id reachable over links. Rows with a null
    doc_id get the component of their set but do not connect others.
    """
    prints = staged(set_keys(docs, id_col, text_col, shingle), "shingle-sets")
    named = prints.where("doc_id is not null")
    sets = staged(named.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"), F.min("sh").alias("sh"), F.min("odd").alias("odd")), "distinct-sets")
    roots = _groups(sets, docs.where(F.col(f"`{id_col}`").isNotNull()), named.select("fp", "doc_id"), id_col, text_col, shingle)
    reps = sets.join(roots, sets["fp"] == roots["node"], "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    reps = staged(reps, "set-groups")
    least = reps.groupBy("root").agg(F.min("rep").alias("component_id"))
    return prints.select("doc_id", "fp").join(reps.join(least, "root").select("fp", "component_id"), "fp", "left").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """``docs`` with one row of each group of ``near_duplicates``; which one, see ``simhash.keep_one``."""
    groups = near_duplicates(docs, id_col, text_col, shingle)
    return keep_one(docs, groups, lambda rows, i, t: set_keys(rows, i, t, shingle).select("doc_id", "fp"), id_col, text_col)


def _groups(sets: DataFrame, docs: DataFrame, named: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(node, root) for each set that is linked to another."""
    forest = staged(by_lists(_lists(sets), lambda *cols: [_forest(*cols)], "a long, b long, key long"), "set-forest")
    if forest.isEmpty():
        return forest.select(F.col("a").alias("node"), F.col("b").alias("root"))
    checked = staged(_verified(staged(forest.select("a", "b").distinct(), "set-pairs"), docs, named, id_col, text_col, shingle), "set-edges")
    good = checked.where("ok").select("a", "b")
    roots = connected_components(good, "set-links")
    failed = checked.where("not ok").select("a", "b")
    if failed.isEmpty():
        return roots
    # A list whose edges all hold connects all its candidates; in the others unconnected parts are compared in full.
    keys = staged(forest.join(failed, ["a", "b"]).select("key").distinct(), "broken-lists")
    parts = sets.select("fp", "n", "sh", "odd").join(roots, F.col("fp") == F.col("node"), "left").select("fp", "n", "sh", "odd", F.coalesce("root", "fp").alias("part"))
    rest = staged(by_lists(_lists(parts, "odd", "part", keys=keys), _between).join(checked.select("a", "b"), ["a", "b"], "left_anti"), "set-rest")
    if rest.isEmpty():
        return roots
    more = staged(_verified(rest, docs, named, id_col, text_col, shingle).where("ok").select("a", "b"), "set-more")
    return connected_components(good.unionAll(more), "set-links")
