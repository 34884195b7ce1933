"""SimHash fingerprints and near-duplicate groups.

Candidates come from an inverted index on byte positions. A fingerprint of
eight bytes that differs from another in at most ``d`` bits differs in at most
``d`` bytes, so the pair shares at least ``8 - d`` positional bytes. Tallying
single bytes would walk lists that hold a 256th of the corpus each, so the
index holds what such a tally must reach: one posting list for each choice of
``8 - d`` positions and their bytes. A pair meets in a list exactly if its
tally reaches the guaranteed minimum, and only there it is verified.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import connected_components, staged, steps

#: Up to this size a posting list is compared pair by pair; larger ones look up their neighbours.
SMALL_LIST = 8
#: Up to so many ids are broadcast; more are joined.
BROADCAST_IDS = 500_000


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 (seed 42) of the lower-cased word shingles; fewer words make one shingle, none give none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(b" ".join(words), 42)], np.uint64)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    starts = np.cumsum(lengths) - lengths
    ends = (starts + lengths - 1)[size - 1 :].tolist()
    hashes = [digest(joined[a:b], 42) for a, b in zip(starts[: len(ends)].tolist(), ends)]
    return np.array(hashes, np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """The bits set in over half the hashes; 0 for none."""
    if not len(hashes):
        return 0
    tally = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[at : at + (1 << 16)].astype(">u8"))
        tally += np.unpackbits(part.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * tally > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id long, fp long) for each row; null or wordless text has fingerprint zero."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "t"):
                values = [fingerprint(shingle_hashes(t.as_py(), shingle)) for t in part.column("t")]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.array(values, np.uint64).view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(docs[f"`{id_col}`"].cast("long").alias("doc_id"), F.coalesce(docs[f"`{text_col}`"], F.lit("")).alias("t"))
    return rows.mapInArrow(of, "doc_id long, fp long")


def posting_keys(fp: str, distance: int) -> list:
    """One (list number, bytes) struct for each choice of the positions that must agree."""
    out = []
    for n, gone in enumerate(combinations(range(8), distance)):
        mask = (1 << 64) - 1
        for byte in gone:
            mask &= ~(0xFF << (8 * byte))
        signed = mask - (1 << 64) if mask >> 63 else mask
        out.append(F.struct(F.lit(n).cast("byte").alias("part"), F.expr(f"{fp} & {signed}L").alias("bytes")))
    return out


def _flips(positions: list[int], distance: int) -> np.ndarray:
    bits = [8 * p + b for p in positions for b in range(8)]
    return np.array([sum(1 << b for b in c) for n in range(1, distance + 1) for c in combinations(bits, n)], np.uint64)


def _large_list(values: np.ndarray, flips: np.ndarray) -> np.ndarray:
    """For sorted distinct fingerprints of one list, the index of the smallest member each is linked to."""
    label = np.arange(len(values))
    links = []
    for flip in flips:
        to = np.searchsorted(values, values ^ flip)
        to[to == len(values)] = 0
        hit = np.flatnonzero(values[to] == values ^ flip)
        links.append((hit, to[hit]))
    a, b = (np.concatenate(x) for x in zip(*links))
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def _list_edges(part: np.ndarray, key: np.ndarray, fp: np.ndarray, rep: np.ndarray, distance: int, flips: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Verified links within posting lists. Rows are sorted by list and fingerprint; each list is whole."""
    first = np.ones(len(key), bool)
    first[1:] = (part[1:] != part[:-1]) | (key[1:] != key[:-1])
    start = np.flatnonzero(first)
    size = np.diff(np.append(start, len(key)))
    number = np.repeat(np.arange(len(start)), size)
    a, b = [], []
    small = np.repeat(size <= SMALL_LIST, size)
    for step in range(1, SMALL_LIST):
        i = np.flatnonzero(small[:-step] & (number[:-step] == number[step:])) if step < len(key) else np.zeros(0, int)
        if not len(i):
            break
        i = i[np.bitwise_count(fp[i] ^ fp[i + step]) <= distance]
        a.append(rep[i])
        b.append(rep[i + step])
    for n in np.flatnonzero(size > SMALL_LIST):
        run = slice(start[n], start[n] + size[n])
        label = _large_list(fp[run], flips[part[start[n]]])
        moved = np.flatnonzero(label != np.arange(len(label)))
        a.append(rep[run][moved])
        b.append(rep[run][label[moved]])
    none = np.zeros(0, np.int64)
    return (np.concatenate(a) if a else none), (np.concatenate(b) if b else none)


def near_links(reps: DataFrame, distance: int) -> DataFrame:
    """Links (a, b) between the representatives ``rep`` of distinct fingerprints ``fp``.

    Any two fingerprints within ``distance`` bits are connected by the links
    returned. A list holds distinct fingerprints that differ only in
    ``distance`` bytes, so at most 256 ** distance of them whatever the size
    of the corpus; it yields fewer links than it has members (once it holds
    over ``SMALL_LIST``).
    """
    flips = [_flips(list(gone), distance) for gone in combinations(range(8), distance)]

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64), batch.column(3).to_numpy()]
            cols = new if held is None else [np.concatenate(x) for x in zip(held, new)]
            part, key = cols[0], cols[1]
            differs = np.flatnonzero((part[1:] != part[:-1]) | (key[1:] != key[:-1]))
            cut = int(differs[-1]) + 1 if len(differs) else 0
            held = [c[cut:] for c in cols]
            if cut:
                yield out(*(c[:cut] for c in cols))
        if held is not None:
            yield out(*held)

    def out(part: np.ndarray, key: np.ndarray, fp: np.ndarray, rep: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((fp, key, part))
        a, b = _list_edges(part[order], key[order], fp[order], rep[order], distance, flips)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    keys = reps.select(F.explode(F.array(*posting_keys("fp", distance))).alias("k"), "fp", "rep")
    lists = keys.select("k.part", "k.bytes", "fp", "rep").repartition("part", "bytes").sortWithinPartitions("part", "bytes")
    return lists.mapInArrow(link, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 2) -> DataFrame:
    """(doc_id long, fp long, component_id long) for each row of ``docs``.

    Rows link if their fingerprints differ in at most ``distance`` (0 to 3)
    bits; component_id is the smallest doc_id reachable over links, the row's
    own included. Equal texts have equal fingerprints and meet in one
    representative, so copies never make pairs. Null text counts as empty;
    texts without words have fingerprint zero and link like any other. Rows
    with a null doc_id get the component of their fingerprint but do not
    connect others (null if only such rows have it). Repeated ids are rows of
    their own. Other columns of ``docs`` are not read.
    """
    if not 0 <= distance <= 3:
        raise ValueError("distance must be 0 to 3")
    prints = staged(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    reps = prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"))
    if distance:
        roots = connected_components(near_links(staged(reps, "fingerprint-reps"), distance), "near-groups")
        reps = reps.join(roots, reps["rep"] == roots["node"], "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    else:
        reps = reps.withColumnRenamed("rep", "component_id")
    return prints.join(reps, "fp", "left").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, distance: int = 3) -> DataFrame:
    """``docs`` with one row of each near-duplicate group; which one, see ``keep_one``."""
    groups = near_duplicates(docs, id_col, text_col, shingle, distance)
    return keep_one(docs, groups, lambda rows, i, t: fingerprints(rows, i, t, shingle), id_col, text_col)


def keep_one(docs: DataFrame, groups: DataFrame, keys: Callable[[DataFrame, str, str], DataFrame], id_col: str, text_col: str) -> DataFrame:
    """One row of each of ``groups`` (doc_id, fp, component_id), the one with the smallest id.

    Of rows that repeat that id one is kept, the one whose text comes first.
    Rows with a null id stay only if no other row has their group; of several
    such rows with one fingerprint, one stays. All columns come through.
    ``keys`` gives (doc_id, fp) for a frame and the names of its id and text.
    """
    id_, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    groups = staged(groups, "near-members")
    gone = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    few = gone.count() <= BROADCAST_IDS
    kept = docs.where(id_.isNotNull()).join(F.broadcast(gone) if few else gone, id_.cast("long") == F.col("__gone"), "left_anti")
    twice = groups.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__twice"))
    if not twice.isEmpty():
        own = id_.cast("long") == F.col("__twice")
        one = Window.partitionBy(id_).orderBy(text.asc_nulls_last())
        first = kept.join(twice, own, "left_semi").withColumn("__n", F.row_number().over(one)).where("__n = 1").drop("__n")
        kept = kept.join(twice, own, "left_anti").unionAll(first)
    alone = groups.where("doc_id is null and component_id is null").select(F.col("fp").alias("__fp")).distinct()
    if not alone.isEmpty():
        nameless = docs.where(id_.isNull()).withColumn("__th", F.xxhash64(text))
        prints = keys(nameless.select("__th", text.alias("__text")), "__th", "__text")
        firsts = prints.join(alone, F.col("fp") == F.col("__fp")).groupBy("fp").agg(F.min("doc_id").alias("__first"))
        one = Window.partitionBy("__th").orderBy(text.asc_nulls_last())
        kept = kept.unionAll(nameless.join(firsts, F.col("__th") == F.col("__first"), "left_semi").withColumn("__n", F.row_number().over(one)).where("__n = 1").drop("__n", "__th"))
    return kept
