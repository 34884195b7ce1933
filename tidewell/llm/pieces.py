"""Vectorised encoding of texts whose parts between spaces encode on their own.

Words recur, so each Arrow batch is cut at spaces, its distinct parts are
encoded once, and the ids are gathered back. A bounded cache carries parts
from one batch of a task to the next and goes when the task ends.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .shared import ragged

#: Parts that each of a cache's two generations holds, of about 150 bytes each.
CACHE_PARTS = 100_000
#: Parts that a cache of columns holds, of about 40 bytes each.
COLUMN_PARTS = 400_000
#: Longer parts are encoded each time they occur.
CACHE_PART_CHARS = 64


class PartCache:
    """Ids of parts as little-endian uint32 bytes; ``encode`` gets the parts it lacks.

    Two generations bound the memory: when the young one is full it becomes
    the old one, and what is still in use moves back.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], limit: int = CACHE_PARTS) -> None:
        self.encode, self.limit, self.young, self.old = encode, limit, {}, {}

    def ids(self, parts: list[str]) -> list[bytes]:
        found = list(map(self.young.get, parts))
        lacking = []
        for n, v in enumerate(found):
            if v is None:
                v = found[n] = self.old.get(parts[n])
                if v is None:
                    lacking.append(n)
                else:
                    self._keep(parts[n], v)
        if lacking:
            for n, v in zip(lacking, self.encode([parts[n] for n in lacking])):
                found[n] = v
                if len(parts[n]) <= CACHE_PART_CHARS:
                    self._keep(parts[n], v)
        return found

    def runs(self, parts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all parts, and where each part's begin and how many they are."""
        values = self.ids(parts if isinstance(parts, list) else parts.to_pylist())
        lengths = np.fromiter(map(len, values), np.int64, len(values)) >> 2
        return np.frombuffer(b"".join(values), np.uint32), np.cumsum(lengths) - lengths, lengths

    def _keep(self, part: str, ids: bytes) -> None:
        if len(self.young) >= self.limit:
            self.old, self.young = self.young, {}
        self.young[part] = ids


class ColumnCache:
    """Ids of parts, kept as columns; ``encode`` gets the distinct parts it lacks, as ``runs`` does.

    The parts of the last call come first, then older ones up to ``limit``.
    """

    def __init__(self, encode: Callable[[pa.Array], tuple[np.ndarray, np.ndarray, np.ndarray]], limit: int = COLUMN_PARTS) -> None:
        self.encode, self.limit = encode, limit
        self.parts, self.flat = pa.array([], pa.string()), np.zeros(0, np.uint32)
        self.starts = self.lengths = np.zeros(0, np.int64)

    def runs(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all parts (distinct ones), and where each part's begin and how many they are."""
        at = pc.fill_null(pc.index_in(parts, value_set=self.parts), -1).to_numpy().astype(np.int64)
        lacking = np.flatnonzero(at < 0)
        more, begin, size = self.encode(parts.take(pa.array(lacking)))
        flat = np.concatenate([self.flat, more])
        starts, lengths = np.empty(len(parts), np.int64), np.empty(len(parts), np.int64)
        known = np.flatnonzero(at >= 0)
        starts[known], lengths[known] = self.starts[at[known]], self.lengths[at[known]]
        starts[lacking], lengths[lacking] = begin + len(self.flat), size
        self._keep(parts, flat, starts, lengths, at[known])
        return flat, starts, lengths

    def _keep(self, parts: pa.Array, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, used: np.ndarray) -> None:
        new = np.flatnonzero(pc.less_equal(pc.binary_length(parts), CACHE_PART_CHARS).to_numpy(zero_copy_only=False))[: self.limit]
        rest = np.ones(len(self.parts), bool)
        rest[used] = False
        old = np.flatnonzero(rest)[: self.limit - len(new)]
        self.parts = pa.concat_arrays([parts.take(pa.array(new)), self.parts.take(pa.array(old))])
        starts, self.lengths = np.concatenate([starts[new], self.starts[old]]), np.concatenate([lengths[new], self.lengths[old]])
        self.flat = flat[ragged(starts, self.lengths)]
        self.starts = np.cumsum(self.lengths) - self.lengths


def encode_texts(texts: pa.Array, cache: PartCache | ColumnCache, leading_space: bool) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another, and each text's bounds in them.

    Parts are cut at single spaces. With ``leading_space`` a part other than
    a text's first keeps the space before it; otherwise spaces are dropped.
    """
    lists = pc.split_pattern(texts, " ")
    bounds = np.frombuffer(lists.buffers()[1], np.int32)[lists.offset : lists.offset + len(lists) + 1].astype(np.int64)
    parts = lists.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
    bounds = bounds - bounds[0]
    codes, distinct = parts.indices.to_numpy().astype(np.int64), parts.dictionary
    if leading_space:
        n = len(distinct)
        codes += n
        firsts = bounds[:-1][bounds[1:] > bounds[:-1]]
        codes[firsts] -= n
        used = np.zeros(2 * n, bool)
        used[codes] = True
        place = np.cumsum(used) - 1
        codes = place[codes]
        spaced = pc.binary_join_element_wise("", distinct.take(pa.array(np.flatnonzero(used[n:]))), " ")
        distinct = pa.concat_arrays([distinct.take(pa.array(np.flatnonzero(used[:n]))), spaced])
    flat, starts, lengths = cache.runs(distinct)
    each = lengths[codes]
    ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(each)])
    return flat[ragged(starts[codes], each)], ends[bounds]
