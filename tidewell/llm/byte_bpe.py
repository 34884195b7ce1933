"""Byte-level BPE as a monoid: encode halves, join neighbours, decode up the tree.

An element is the exact encoding of a byte string. Two elements join by
re-encoding a window around their border. Which tokens may stand side by side
is a property of each neighbouring pair alone: a sequence of tokens, each of
which is its own encoding, is the encoding of its bytes exactly if encoding
each pair of neighbours gives that pair. (A merge across a border would, by
rank order, already happen between the two tokens next to it.) So a join is
proved as soon as the window's two outer borders pass that test; until then
the window grows. Joining is associative, and the empty string is its unit.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
from array import array
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import ColumnCache, encode_texts
from .shared import steps

#: Encodings of pieces and windows up to this length are remembered, and so many of each kind at most.
MEMO_BYTES, MEMO = 24, 120_000
#: Halves of a piece up to this length are.
HALF_BYTES = 8
#: Parts between spaces whose ids a worker keeps.
PARTS = 150_000
#: A space that follows other white space; cutting there could change how the pattern matches.
_UNSAFE = regex.compile(r"[\s\x1c-\x1f\x85] ")


#: Above all ranks.
_NEVER = 1 << 62


class ByteBpe:
    """Encoder and decoder for a rank file's text and a split pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf_bytes: int = 1) -> None:
        self.ranks, self.leaf_bytes = ranks, max(1, leaf_bytes)
        self.pattern = regex.compile(pattern)
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for value, rank in ranks.items():
            self.bytes_of[rank] = value
        # The two tokens that merge into each; a single byte is both.
        self.first_of, self.last_of = list(range(len(self.bytes_of))), list(range(len(self.bytes_of)))
        for value, rank in ranks.items():
            if len(value) > 1:
                parts = self._merge(value, 2)
                self.first_of[rank], self.last_of[rank] = parts[0], parts[-1]
        # Tuples of numbers, which the garbage collector does not walk again and again.
        self.leaves = {bytes([n]): (ranks[bytes([n])],) for n in range(256) if bytes([n]) in ranks}
        self.nodes: dict[bytes, tuple[int, ...]] = dict(self.leaves)
        self.pieces: dict[bytes, tuple[int, ...]] = {}
        self.older: dict[bytes, tuple[int, ...]] = {}
        self.windows: dict[bytes, tuple[int, ...]] = {}
        self.pairs: dict[int, tuple[int, ...]] = {}
        self.joins = 0

    def stable(self, left: int, right: int) -> bool:
        """May these tokens stand side by side in an encoding?

        Undo their merges from the last one back: they may not if at some time
        the two parts at the border would have merged before the next undone
        merge was made. Each token is its own encoding.
        """
        bytes_of, ranks, undone = self.bytes_of, self.ranks, _NEVER
        while True:
            if ranks.get(bytes_of[left] + bytes_of[right], _NEVER) < undone:
                return False
            a, b = self.last_of[left], self.first_of[right]
            if left > right and a != left or b == right:
                if a == left:
                    return True
                undone, left = left, a
            else:
                undone, right = right + 1, b

    def _merge(self, data: bytes, least: int = 1) -> list[int]:
        """Merge the lowest rank, leftmost first, while there are more than ``least`` parts; for a few tokens' bytes."""
        parts, ranks = [data[n : n + 1] for n in range(len(data))], self.ranks
        pairs = [ranks.get(data[n : n + 2], _NEVER) for n in range(len(data) - 1)]
        while len(pairs) >= least and (lowest := min(pairs)) != _NEVER:
            n = pairs.index(lowest)
            parts[n : n + 2] = [parts[n] + parts[n + 1]]
            del pairs[n]
            if n:
                pairs[n - 1] = ranks.get(parts[n - 1] + parts[n], _NEVER)
            if n < len(pairs):
                pairs[n] = ranks.get(parts[n] + parts[n + 1], _NEVER)
        return [ranks[p] for p in parts]

    def _merged(self, data: bytes) -> list[int]:
        """Encoding of a window by merges alone, without looking up ``data`` as a whole."""
        return list(self._window(data))

    def _window(self, data: bytes) -> tuple[int, ...]:
        known = self.windows.get(data)
        if known is None:
            known = tuple(self._merge(data))
            if len(data) <= MEMO_BYTES:
                if len(self.windows) >= MEMO:
                    self.windows.clear()
                self.windows[data] = known
        return known

    def _pair(self, left: int, right: int) -> tuple[int, ...]:
        """What two tokens side by side encode to: nothing if they stay, else the encoding of their bytes."""
        known = self.pairs.get(left << 32 | right)
        if known is None:
            known = () if self.stable(left, right) else tuple(self._merge(self.bytes_of[left] + self.bytes_of[right]))
            if len(self.pairs) >= MEMO:
                self.pairs.clear()
            self.pairs[left << 32 | right] = known
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the joined bytes, from the encodings of both sides."""
        return list(self._join(tuple(left), tuple(right)))

    def _join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        if not left or not right:
            return left or right
        self.joins += 1
        window = self.pairs.get(left[-1] << 32 | right[0])
        if window is None:
            window = self._pair(left[-1], right[0])
        if not window:
            return left + right
        a = b = 1
        while True:
            grow_left = a < len(left) and self._pair(left[len(left) - a - 1], window[0])
            grow_right = b < len(right) and self._pair(window[-1], right[b])
            if not grow_left and not grow_right:
                return left[: len(left) - a] + window + right[b:]
            a, b = min(len(left), 2 * a if grow_left else a), min(len(right), 2 * b if grow_right else b)
            window = self._window(b"".join(self.bytes_of[t] for t in (*left[len(left) - a :], *right[:b])))

    def tree(self, data: bytes) -> list[int]:
        """Encode by halves, down to leaves. What a lookup of the whole would give is for ``piece``."""
        return list(self._tree(data))

    def _tree(self, data: bytes) -> tuple[int, ...]:
        if len(data) <= self.leaf_bytes:
            return self._window(data) if len(data) > 1 else (self.ranks[data],) if data else ()
        get, half = self.nodes.get, len(data) // 2
        left, right = data[:half], data[half:]
        return self._join(get(left) or self._half(left), get(right) or self._half(right))

    def _half(self, data: bytes) -> tuple[int, ...]:
        """The tree of a half, which is remembered: there are fewer of them than of whole pieces."""
        out = self._tree(data)
        if len(data) <= HALF_BYTES:
            if len(self.nodes) >= MEMO:
                self.nodes = dict(self.leaves)
            self.nodes[data] = out
        return out

    def piece(self, data: bytes) -> list[int]:
        """One match of the pattern: the vocabulary's own token if it has one, else the tree."""
        rank = self.ranks.get(data)
        return list(self._whole(data)) if rank is None else [rank]

    def _whole(self, data: bytes) -> tuple[int, ...]:
        """The tree of a piece that is no token; two generations of pieces are remembered, and what is in use stays."""
        known = self.pieces.get(data)
        if known is None:
            known = self.older.get(data) or self._tree(data)
            if len(data) <= MEMO_BYTES:
                if len(self.pieces) >= MEMO // 2:
                    self.older, self.pieces = self.pieces, {}
                self.pieces[data] = known
        return known

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        ranks, get = self.ranks, self.pieces.get
        for match in self.pattern.findall(text) if not self.pattern.groups else [m[0] for m in self.pattern.finditer(text)]:
            data = match.encode("utf-8", "surrogatepass")
            if (rank := ranks.get(data)) is not None:
                out.append(rank)
            else:
                out += get(data) or self._whole(data)
        return out

    def runs(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all parts, and where each part's begin and how many they are."""
        flat, ends = array("I"), array("q")
        for part in parts.to_pylist():
            flat.extend(self.encode(part))
            ends.append(len(flat))
        bounds = np.concatenate([np.zeros(1, np.int64), np.frombuffer(ends, np.int64)])
        return np.frombuffer(flat, np.uint32), bounds[:-1], np.diff(bounds)

    def decode(self, ids: list[int]) -> bytes:
        """Concatenate level by level up the tree."""
        level = list(map(self.bytes_of.__getitem__, ids))
        while len(level) > 1:
            level = [b"".join(level[n : n + 64]) for n in range(0, len(level), 64)]
        return level[0] if level else b""


def load_ranks(lines: bytes) -> dict[bytes, int]:
    """Ranks from a file of base64 tokens and numbers."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines()) if a}


_models: dict[tuple, tuple[ByteBpe, ColumnCache]] = {}


def _model(lines: bytes, pattern: str) -> tuple[ByteBpe, ColumnCache]:
    """The worker's encoder and its cache, which stay for the tasks to come."""
    key = (binascii.crc32(lines), len(lines), pattern)
    if key not in _models:
        _models.clear()
        model = ByteBpe(load_ranks(lines), pattern)
        _models[key] = model, ColumnCache(model.runs, PARTS)
    return _models[key]


def _batch_ids(texts: pa.Array, model: ByteBpe, cache: ColumnCache) -> Iterator[np.ndarray]:
    """Ids of each text. A text is cut at spaces where the pattern cuts as well, which holds
    wherever no white space stands before a space; other texts are matched whole."""
    values = texts.to_pylist()
    odd = [bool(_UNSAFE.search(v)) for v in values]
    plain = pa.array([v for v, o in zip(values, odd) if not o], pa.string())
    ids, bounds = encode_texts(plain, cache, leading_space=True)
    n = 0
    for value, o in zip(values, odd):
        if o:
            yield np.array(model.encode(value), np.uint32)
        else:
            yield ids[bounds[n] : bounds[n + 1]]
            n += 1


def encode_texts_column(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", ids: bool = True, digests: bool = True) -> DataFrame:
    """``docs`` with what its texts encode to.

    New columns: ``n_tokens`` long; with ``ids`` also ``token_ids`` binary
    (little-endian unsigned 32-bit integers); with ``digests`` also
    ``ids_sha256`` and ``decoded_sha256``, the latter over the bytes that the
    ids decode to. Each match of ``pattern`` is encoded separately and no
    special tokens are used. Null text counts as empty: no tokens. Every row
    comes back once; ids may be null or repeat. Input columns named like a
    new one are replaced. Very long texts are cut at the pattern's matches,
    and a match of any length is encoded by halves.
    """
    with open(ranks_path, "rb") as f:
        lines = docs.sparkSession.sparkContext.broadcast(f.read())
    names = ["n_tokens", *["token_ids"] * ids, *["ids_sha256", "decoded_sha256"] * digests]
    kept = [c for c in docs.columns if c.lower() not in names]
    base = docs.select(*(docs[f"`{c}`"] for c in kept), F.coalesce(docs[f"`{text_col}`"], F.lit("")).alias("__text"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, cache = _model(lines.value, pattern)
        for batch in batches:
            for part in steps(batch, "__text"):
                sizes, packed, id_digest, text_digest = [], [], [], []
                for one in _batch_ids(part.column("__text"), model, cache):
                    sizes.append(len(one))
                    raw = one.tobytes()
                    if ids:
                        packed.append(raw)
                    if digests:
                        id_digest.append(hashlib.sha256(raw).hexdigest())
                        text_digest.append(hashlib.sha256(model.decode(one.tolist())).hexdigest())
                new = [pa.array(sizes, pa.int64()), *[pa.array(packed, pa.binary())] * ids, *[pa.array(id_digest, pa.string()), pa.array(text_digest, pa.string())] * digests]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *new], [*kept, *names])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields[:-1]]
    types = {"n_tokens": "long", "token_ids": "binary", "ids_sha256": "string", "decoded_sha256": "string"}
    return base.mapInArrow(of, ", ".join([*fields, *(f"{n} {types[n]}" for n in names)]))


def decode_ids_column(encoded: DataFrame, ranks_path: str, pattern: str, ids_col: str = "token_ids", out_col: str = "decoded") -> DataFrame:
    """``encoded`` with ``out_col``: the text of its ids. Null ids give null; none give an empty text.
    An id outside the vocabulary fails the query. Bytes that are no UTF-8 become replacement characters."""
    with open(ranks_path, "rb") as f:
        lines = encoded.sparkSession.sparkContext.broadcast(f.read())

    @F.udf("string", useArrow=True)
    def decoded(raw: bytes | None) -> str | None:
        if raw is None:
            return None
        model, _ = _model(lines.value, pattern)
        return model.decode(np.frombuffer(raw, np.uint32).tolist()).decode("utf-8", "replace")

    return encoded.withColumn(out_col, decoded(F.col(f"`{ids_col}`")))


def join_all(model: ByteBpe, elements: list[list[int]]) -> list[int]:
    """Reduce encodings of consecutive byte strings (of one match) to that of the whole."""
    return reduce(model.join, elements, [])
