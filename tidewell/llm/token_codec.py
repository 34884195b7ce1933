"""Token ids in binary files: static range asymmetric numeral system (rANS).

One frequency table, counted over the whole corpus, is shared by all files.
Each file is a run of independent blocks. A block interleaves ``lanes`` coder
states over its tokens, so numpy codes a whole row of lanes, over many blocks,
at a time. The file's footer is a list of checkpoints (offset, first token and
two checksums for each block) and of documents, so any run of blocks or
documents can be decoded alone and in parallel.

File layout, integers little-endian::

    magic 8 | table crc32 u4 | scale bits u4 | lanes u4 | tokens in a block u4
    block*:  states u8[lanes] | words u4[*]
    footer (zlib): counts, block index, document index
    footer offset u8 | footer length u4 | footer crc32 u4 | magic 8
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from .pieces import ColumnCache, encode_texts
from .shared import scratch_path, staged, steps

MAGIC = b"TWRANS01"
LOW = np.uint64(1 << 31)
LANES, BLOCK_TOKENS, BLOCKS_AT_ONCE = 32, 16_384, 64
#: Tokens of one file, and of one unit of parallel decoding, at least (documents are not cut).
FILE_TOKENS, UNIT_TOKENS = 16_000_000, 2_000_000


# -- the coder ---------------------------------------------------------------


class FrequencyTable:
    """Symbol frequencies that sum to ``1 << bits``; a symbol counted at least once has at least 1."""

    def __init__(self, freqs: np.ndarray, bits: int) -> None:
        if int(freqs.sum()) != 1 << bits:
            raise ValueError("frequencies must fill the scale")
        self.bits, self.freqs = bits, freqs.astype(np.uint64)
        self.cum = (np.cumsum(self.freqs) - self.freqs).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freqs), dtype=np.uint32), freqs.astype(np.int64))
        self.crc = zlib.crc32(struct.pack("<I", bits) + freqs.astype("<u4").tobytes())

    @classmethod
    def from_counts(cls, counts: np.ndarray) -> FrequencyTable:
        """Scale counts (exact integers, any size) to a power of two of at least eight slots a symbol."""
        counts = [int(c) for c in counts]
        total, present = sum(counts), sum(c > 0 for c in counts)
        if not total:
            return cls(np.array([1 << 12, *[0] * (max(1, len(counts)) - 1)], np.int64), 12)
        bits = max(12, present.bit_length() + 3)
        freqs = np.array([max(1, (c << bits) // total) if c else 0 for c in counts], np.int64)
        while over := int(freqs.sum()) - (1 << bits):
            top = int(freqs.argmax())
            freqs[top] -= min(over, int(freqs[top]) // 2) if over > 0 else over
        return cls(freqs, bits)


def encode_blocks(tokens: np.ndarray, table: FrequencyTable, lanes: int) -> list[bytes]:
    """Payloads of equally long blocks; ``tokens`` is (blocks, tokens in a block), the latter a multiple of ``lanes``."""
    blocks, steps_n = tokens.shape[0], tokens.shape[1] // lanes
    symbols = tokens.reshape(blocks, steps_n, lanes).transpose(1, 0, 2).reshape(steps_n, blocks * lanes)
    state = np.full(blocks * lanes, LOW, np.uint64)
    words, out = np.empty(symbols.shape, np.uint32), np.empty(symbols.shape, bool)
    bits, room = np.uint64(table.bits), np.uint64(63 - table.bits)
    for t in range(steps_n - 1, -1, -1):
        freq, cum = table.freqs[symbols[t]], table.cum[symbols[t]]
        full = state >= freq << room
        words[t], out[t] = state.astype(np.uint32), full
        state = np.where(full, state >> np.uint64(32), state)
        whole = state // freq
        state = (whole << bits) + (state - whole * freq) + cum
    payloads = []
    for b in range(blocks):
        own = slice(b * lanes, (b + 1) * lanes)
        payloads.append(state[own].astype("<u8").tobytes() + words[:, own][out[:, own]].astype("<u4").tobytes())
    return payloads


def decode_blocks(payloads: list[bytes], length: int, table: FrequencyTable, lanes: int) -> np.ndarray:
    """(blocks, length) tokens of blocks that ``encode_blocks`` made; ``length`` is a multiple of ``lanes``."""
    blocks, steps_n = len(payloads), length // lanes
    state = np.concatenate([np.frombuffer(p, "<u8", lanes) for p in payloads]).astype(np.uint64)
    streams = [np.frombuffer(p, "<u4", offset=8 * lanes) for p in payloads]
    words = np.concatenate([*streams, np.zeros(1, np.uint32)]).astype(np.uint64)
    sizes = np.array([len(s) for s in streams], np.int64)
    at = np.cumsum(sizes) - sizes
    ends = at + sizes
    found = np.empty((steps_n, blocks * lanes), np.uint32)
    bits, mask = np.uint64(table.bits), np.uint64((1 << table.bits) - 1)
    for t in range(steps_n):
        slot = state & mask
        symbol = found[t] = table.symbol[slot]
        state = table.freqs[symbol] * (state >> bits) + slot - table.cum[symbol]
        low = (state < LOW).reshape(blocks, lanes)
        places = (at[:, None] + np.cumsum(low, axis=1) - 1)[low]
        at = at + low.sum(axis=1)
        if (at > ends).any():
            raise ValueError("a block ends too early")
        flat = low.reshape(-1)
        state[flat] = (state[flat] << np.uint64(32)) | words[places]
    return found.reshape(steps_n, blocks, lanes).transpose(1, 0, 2).reshape(blocks, length)


# -- files -------------------------------------------------------------------


def _filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri) if not uri.startswith("file:/") or uri.startswith("file:///") else fs.FileSystem.from_uri("file://" + uri[5:])


class FileWriter:
    """Writes one file; it appears under its name only when it is complete."""

    def __init__(self, uri: str, table: FrequencyTable, lanes: int = LANES, block: int = BLOCK_TOKENS) -> None:
        if block % lanes:
            raise ValueError("a block must hold whole rows of lanes")
        self.fs, self.path = _filesystem(uri)
        self.table, self.lanes, self.block = table, lanes, block
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.draft = f"{self.path}.{uuid.uuid4().hex}.draft"
        self.out = self.fs.open_output_stream(self.draft)
        head = MAGIC + struct.pack("<IIII", table.crc, table.bits, lanes, block)
        self.out.write(head)
        self.at, self.held, self.n_held = len(head), [], 0
        self.blocks: list[tuple[int, int, int, int]] = []
        self.ids: list[int | None] = []
        self.sizes: list[int] = []

    def add(self, doc_id: int | None, tokens: np.ndarray) -> None:
        self.ids.append(doc_id)
        self.sizes.append(len(tokens))
        step = self.block * BLOCKS_AT_ONCE
        for start in range(0, len(tokens), step):
            part = tokens[start : start + step]
            self.held.append(part)
            self.n_held += len(part)
            if self.n_held >= step:
                self._flush(False)

    def _flush(self, last: bool) -> None:
        tokens = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        whole = len(tokens) // self.block * self.block
        for start in range(0, whole, self.block * BLOCKS_AT_ONCE):
            part = tokens[start : min(whole, start + self.block * BLOCKS_AT_ONCE)].reshape(-1, self.block)
            for row, payload in zip(part, encode_blocks(part, self.table, self.lanes)):
                self._put(row, payload)
        rest = tokens[whole:]
        if last and len(rest):
            fill = np.full(-len(rest) % self.lanes, int(self.table.freqs.argmax()), rest.dtype)
            self._put(rest, encode_blocks(np.concatenate([rest, fill])[None], self.table, self.lanes)[0])
            rest = rest[:0]
        self.held, self.n_held = [rest], len(rest)

    def _put(self, tokens: np.ndarray, payload: bytes) -> None:
        self.blocks.append((self.at, len(tokens), zlib.crc32(payload), zlib.crc32(tokens.astype("<u4").tobytes())))
        self.out.write(payload)
        self.at += len(payload)

    def close(self) -> None:
        self._flush(True)
        index = np.array(self.blocks, "<i8").reshape(-1, 4)
        known = np.array([i is not None for i in self.ids], np.uint8)
        ids = np.array([0 if i is None else i for i in self.ids], "<i8")
        body = struct.pack("<QQ", len(index), len(ids)) + index.tobytes() + known.tobytes() + ids.tobytes() + np.array(self.sizes, "<i8").tobytes()
        footer = zlib.compress(body, 6)
        self.out.write(footer + struct.pack("<QII", self.at, len(footer), zlib.crc32(footer)) + MAGIC)
        self.out.close()
        self.fs.move(self.draft, self.path)


class FileReader:
    """Random access to the documents and blocks of a file."""

    def __init__(self, uri: str, table: FrequencyTable) -> None:
        system, path = _filesystem(uri)
        self.file, self.table = system.open_input_file(path), table
        size = self.file.size()
        at, length, crc = struct.unpack("<QII", self.file.read_at(16, size - 24))
        head, tail = self.file.read_at(24, 0), self.file.read_at(8, size - 8)
        footer = self.file.read_at(length, at)
        table_crc, bits, self.lanes, self.block = struct.unpack("<IIII", head[8:])
        if head[:8] != MAGIC or tail != MAGIC or zlib.crc32(footer) != crc:
            raise ValueError(f"{uri} is damaged")
        if (table_crc, bits) != (table.crc, table.bits):
            raise ValueError(f"{uri} was written with another frequency table")
        body = zlib.decompress(footer)
        n, d = struct.unpack_from("<QQ", body)
        self.index = np.frombuffer(body, "<i8", 4 * n, 16).reshape(n, 4)
        known = np.frombuffer(body, np.uint8, d, 16 + 32 * n)
        ids = np.frombuffer(body, "<i8", d, 16 + 32 * n + d)
        self.ids = [int(i) if k else None for i, k in zip(ids, known)]
        self.sizes = np.frombuffer(body, "<i8", d, 16 + 32 * n + 9 * d)
        self.offsets = np.append(self.index[:, 0], at)

    def tokens(self, start: int, stop: int) -> Iterator[np.ndarray]:
        """Tokens ``start`` to ``stop`` of the file, in runs of a few blocks, both checksums verified."""
        first, last = start // self.block, -(-stop // self.block) if stop > start else start // self.block
        for b in range(first, last, BLOCKS_AT_ONCE):
            group = range(b, min(last, b + BLOCKS_AT_ONCE))
            raw = self.file.read_at(int(self.offsets[group[-1] + 1] - self.offsets[b]), int(self.offsets[b]))
            payloads = [raw[self.offsets[k] - self.offsets[b] : self.offsets[k + 1] - self.offsets[b]] for k in group]
            if any(zlib.crc32(p) != self.index[k, 2] for k, p in zip(group, payloads)):
                raise ValueError("a block is damaged")
            whole = [k for k in group if self.index[k, 1] == self.block]
            rows = list(decode_blocks(payloads[: len(whole)], self.block, self.table, self.lanes)) if whole else []
            for k in group[len(whole) :]:
                n = int(self.index[k, 1])
                rows.append(decode_blocks([payloads[k - b]], n + -n % self.lanes, self.table, self.lanes)[0][:n])
            if any(zlib.crc32(r.astype("<u4").tobytes()) != self.index[k, 3] for k, r in zip(group, rows)):
                raise ValueError("a block decodes to other tokens")
            run = np.concatenate(rows)
            yield run[max(0, start - b * self.block) : stop - b * self.block]


# -- the tokenizer -----------------------------------------------------------

_LETTERS = "[A-Za-zÀ-ÖØ-öø-ÿ]+"
#: Words that go to the model as one text.
GROUP = 256


class WordTokenizer:
    """A tokenizer file of the tokenizers library, for parts between spaces.

    Words of ASCII and Latin-1 letters, which its normalizer only lower-cases
    and its splitter leaves whole, go to the library's model in bulk, without
    the normalizer's alignments; the end-of-word marks say where each word's
    ids end. Everything else takes the library's full path. Parts stay in Arrow
    columns, so only what the library takes becomes Python text.
    """

    def __init__(self, spec: str) -> None:
        self.full = Tokenizer.from_str(spec)
        self.full.encode_special_tokens = True
        self.bare = Tokenizer(self.full.model)
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        size = self.full.get_vocab_size()
        self.ends = np.array([(self.full.id_to_token(n) or "").endswith("</w>") for n in range(size)])
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that the byte-level alphabet writes as themselves
        names = {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in shown)}
        self.moved = [(chr(b), names[b]) for b in sorted(set("".join(map(chr, range(0xC0, 0x100))).lower().encode())) if b in names]
        # Letters with one of these signs behind them are a word and the sign's only id.
        self.marks = {m: int(ids[0]) for m in ",." for ids, n in [self._full([m])] if len(n) == 1 and n[0] == 1}

    def _full(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts, one after another, and how many each has."""
        found = [e.ids for e in self.full.encode_batch_fast(parts, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found))

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of letters, one after another, and how many each has; many words at a time."""
        n = len(words)
        edges = np.append(np.arange(0, n, GROUP), n).astype(np.int32)
        flat, lengths = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for text, size in zip(pc.binary_join(pa.ListArray.from_arrays(pa.array(edges), words), " ").to_pylist(), np.diff(edges).tolist()):
            text = text.lower()
            if not text.isascii():
                text = text.encode().decode("latin-1")
                for byte, name in self.moved:
                    text = text.replace(byte, name)
            ids = np.array(self.bare.encode(text, add_special_tokens=False).ids, np.uint32)
            each = np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)
            if len(each) != size or each.sum() != len(ids):
                found = [self.bare.encode(w, add_special_tokens=False).ids for w in text.split(" ")]
                ids, each = np.fromiter(chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int64, size)
            flat.append(ids)
            lengths.append(each)
        return np.concatenate(flat), np.concatenate(lengths)

    def runs(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all parts, and where each part's begin and how many they are."""
        short = pc.less(pc.binary_length(parts), 100)
        places, flats, sizes = [], [], []
        left = np.ones(len(parts), bool)
        for mark in ("", *self.marks):
            own = pc.and_(short, pc.match_substring_regex(parts, rf"\A{_LETTERS}{re.escape(mark)}\z")).to_numpy(zero_copy_only=False)
            at = np.flatnonzero(own & left)
            if not len(at):
                continue
            left[at] = False
            words = parts.take(pa.array(at))
            flat, each = self._words(pc.utf8_slice_codeunits(words, 0, -1) if mark else words)
            if mark:
                flat, each = np.insert(flat, np.cumsum(each), self.marks[mark]), each + 1
            places.append(at)
            flats.append(flat)
            sizes.append(each)
        at = np.flatnonzero(left)
        flat, each = self._full(parts.take(pa.array(at)).to_pylist())
        order, each = np.concatenate([*places, at]), np.concatenate([*sizes, each])
        starts, lengths = np.empty(len(parts), np.int64), np.empty(len(parts), np.int64)
        starts[order], lengths[order] = np.cumsum(each) - each, each
        return np.concatenate([*flats, flat]), starts, lengths

    def encode(self, parts: list[str]) -> list[bytes]:
        flat, starts, lengths = self.runs(pa.array(parts, pa.string()))
        return [flat[a : a + n].tobytes() for a, n in zip(starts.tolist(), lengths.tolist())]


#: A comma or full stop that may belong to a longer run of signs.
_SIGN_RUN = "[^0-9A-Za-zÀ-ÖØ-öø-ÿ ][,.] |^[,.] "


def simplified(texts: pa.Array) -> pa.Array:
    """Texts with the same ids but fewer distinct parts between spaces.

    White space only parts words and pure ASCII is lower-cased in any case.
    A comma or full stop between a letter and a space is a run of signs of its
    own, so a space before it changes nothing.
    """
    texts = pc.replace_substring(texts, "\n", " ")
    texts = pc.if_else(pc.string_is_ascii(texts), pc.ascii_lower(texts), texts)
    apart = pc.replace_substring(pc.replace_substring(texts, ", ", " , "), ". ", " . ")
    return pc.if_else(pc.match_substring_regex(texts, _SIGN_RUN), texts, apart)


_tokenizers: dict[tuple[int, int], WordTokenizer] = {}


def _tokenizer(spec: bytes) -> ColumnCache:
    """The worker's tokenizer, with a cache for one task."""
    key = (zlib.crc32(spec), len(spec))
    if key not in _tokenizers:
        _tokenizers.clear()
        _tokenizers[key] = WordTokenizer(spec.decode())
    return ColumnCache(_tokenizers[key].runs)


def id_type(vocabulary: int) -> str:
    """The narrowest unsigned little-endian type that holds the ids."""
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def tokenized(docs: DataFrame, tokenizer_path: str, end_id: int, kind: str = "<u4", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, ids binary of integers of ``kind``, n_tokens long), ``end_id`` last in each."""
    with open(tokenizer_path, "rb") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _tokenizer(spec.value)
        for batch in batches:
            for part in steps(batch, "t"):
                ids, bounds = encode_texts(simplified(part.column("t")), cache, leading_space=False)
                ended = np.insert(ids.astype(kind), bounds[1:], end_id)
                bounds = bounds + np.arange(len(bounds))
                raw = pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((ended.itemsize * bounds).astype(np.int32)), pa.py_buffer(ended)])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), raw, pa.array(np.diff(bounds))], ["doc_id", "ids", "n_tokens"])

    rows = docs.select(docs[f"`{id_col}`"].cast("long").alias("doc_id"), F.coalesce(docs[f"`{text_col}`"], F.lit("")).alias("t"))
    return rows.mapInArrow(of, "doc_id long, ids binary, n_tokens long")


# -- the operator ------------------------------------------------------------


@dataclass
class TokenFiles:
    """Files written for a corpus: one row for each unit of parallel decoding.

    ``units``: file, path, first_doc, n_docs, first_token, n_tokens, and base,
    the number of tokens in all files before this one.
    """

    units: DataFrame
    table: FrequencyTable

    def _read(self, schema: str, row) -> DataFrame:
        table = self.units.sparkSession.sparkContext.broadcast((self.table.freqs.astype(np.int64), self.table.bits))

        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = FrequencyTable(*table.value)
            for batch in batches:
                for unit in batch.to_pylist():
                    reader = FileReader(unit["path"], known)
                    docs = range(unit["first_doc"], unit["first_doc"] + unit["n_docs"])
                    runs = reader.tokens(unit["first_token"], unit["first_token"] + unit["n_tokens"])
                    yield from row(unit, reader, docs, runs)

        spread = self.units.repartition(self.units.sparkSession.sparkContext.defaultParallelism * 4, "file", "first_doc")
        return spread.mapInArrow(of, schema)

    def digests(self) -> DataFrame:
        """(doc_id, start, n_tokens, ids_crc32) of every document, from the decoded files."""

        def rows(unit, reader, docs, runs):
            run, at, start, out = np.zeros(0, np.uint32), 0, unit["base"] + unit["first_token"], []
            for d in docs:
                left, crc = int(reader.sizes[d]), 0
                while left:
                    if at == len(run):
                        run, at = next(runs), 0
                    part = run[at : at + left]
                    crc, at, left = zlib.crc32(part.astype("<u4").tobytes(), crc), at + len(part), left - len(part)
                out.append((reader.ids[d], start, int(reader.sizes[d]), crc))
                start += int(reader.sizes[d])
            types = (("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out), types)], [n for n, _ in types])

        return self._read("doc_id long, start long, n_tokens long, ids_crc32 long", rows)

    def documents(self) -> DataFrame:
        """(doc_id, start, token_ids): the decoded ids as little-endian unsigned 32-bit integers."""

        def rows(unit, reader, docs, runs):
            run, at, start = np.zeros(0, np.uint32), 0, unit["base"] + unit["first_token"]
            for d in docs:
                left, parts = int(reader.sizes[d]), []
                while left:
                    if at == len(run):
                        run, at = next(runs), 0
                    parts.append(run[at : at + left])
                    at, left = at + len(parts[-1]), left - len(parts[-1])
                raw = b"".join(p.astype("<u4").tobytes() for p in parts)
                yield pa.RecordBatch.from_arrays([pa.array([reader.ids[d]], pa.int64()), pa.array([start], pa.int64()), pa.array([raw], pa.binary())], ["doc_id", "start", "token_ids"])
                start += int(reader.sizes[d])

        return self._read("doc_id long, start long, token_ids binary", rows)


def _counts(tokens: DataFrame, vocabulary: int, kind: str) -> np.ndarray:
    """How often each id occurs; what reaches the driver is bounded by the vocabulary."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for raw in batch.column(0):
                total += np.bincount(np.frombuffer(raw.as_buffer(), kind), minlength=vocabulary)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])

    out = np.zeros(vocabulary, object)
    for r in tokens.select("ids").mapInArrow(of, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r.id] = r.n
    return out


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int, out_uri: str | None = None, id_col: str = "doc_id", text_col: str = "text", file_tokens: int = FILE_TOKENS) -> TokenFiles:
    """Tokenize whole texts and write them, in ascending order of id, as rANS files.

    Null text counts as empty and holds ``end_id`` alone. Null ids come first;
    rows that repeat an id all stay, ordered by their ids' bytes. An empty
    table makes no files. Columns other than id and text are not read. Files
    go to ``out_uri``, a folder that all executors share (by default below
    ``spark.checkpoint.dir``); a task that runs again writes the same bytes
    and moves them into place at the end.
    """
    spark: SparkSession = docs.sparkSession
    size = max(Tokenizer.from_file(tokenizer_path).get_vocab_size(), end_id + 1)
    kind = id_type(size)
    tokens = staged(tokenized(docs, tokenizer_path, end_id, kind, id_col, text_col), "tokens")
    counts = _counts(tokens, size, kind)
    table = FrequencyTable.from_counts(counts)
    shared = spark.sparkContext.broadcast((table.freqs.astype(np.int64), table.bits))
    folder = (out_uri or scratch_path(spark, "token-files")).rstrip("/")
    files = max(1, -(-int(sum(counts)) // file_tokens))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, known = TaskContext.get().partitionId(), FrequencyTable(*shared.value)
        path, writer, units = f"{folder}/part-{number:06d}.rans", None, []
        first_doc = n_docs = first_token = n_tokens = 0
        for batch in batches:
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                writer = writer or FileWriter(path, known)
                ids = np.frombuffer(raw.as_buffer(), kind).astype(np.uint32)
                writer.add(doc_id, ids)
                n_docs, n_tokens = n_docs + 1, n_tokens + len(ids)
                if n_tokens >= UNIT_TOKENS:
                    units.append((number, path, first_doc, n_docs, first_token, n_tokens))
                    first_doc, first_token, n_docs, n_tokens = first_doc + n_docs, first_token + n_tokens, 0, 0
        if n_docs:
            units.append((number, path, first_doc, n_docs, first_token, n_tokens))
        if writer is not None:
            writer.close()
        names = ["file", "path", "first_doc", "n_docs", "first_token", "n_tokens"]
        kinds = [pa.int64(), pa.string(), *[pa.int64()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array([u[k] for u in units], t) for k, t in enumerate(kinds)], names)

    keys = [F.col("doc_id").asc_nulls_first(), F.col("n_tokens"), F.xxhash64("ids")]
    ordered = tokens.repartitionByRange(files, *keys).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "n_tokens", F.xxhash64("ids"), "ids").select("doc_id", "ids")
    units = staged(ordered.mapInArrow(write, "file long, path string, first_doc long, n_docs long, first_token long, n_tokens long"), "token-units")
    sizes = units.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    bases = sizes.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("base"))
    return TokenFiles(units.join(bases, "file"), table)
