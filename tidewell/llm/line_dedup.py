"""Fuzzy line deduplication.

Lines are normalised and SimHashed by blocks: each distinct word votes in one
block alone, which its hash names. A word that is replaced therefore disturbs
two blocks at most, and by the pigeonhole principle the others stay equal
whatever their width. Short lines must agree in several blocks at once, long
ones in one block of a few words; ``LAYOUTS`` says which. With ``wide`` lines
of few words, whose blocks hold little, also meet by bands of MinHashes over
runs of seven bytes. Lines that meet and pass ``_compatible`` (a SimHash of
the whole line, or for few words a bound on the edit distance) link if their
edit similarity is high enough; one occurrence of each connected group stays.

Keys move as columns of bytes, and most lists end where these meet, as they
hold one line. Of a list of up to ``CHUNK``
lines a task finds a spanning forest of the compatible pairs; of a longer one
each line is first paired with one that leads it. Only pairs whose texts were
compared by edit distance count. Where a pair failed, the lines of the list are
compared again across the parts that are not connected yet, in chunks of
bounded size, so that no link is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import by_lists, connected_components, ragged, staged, steps, text_bytes

#: Lines with fewer words link only to equal ones, if at all.
MIN_WORDS = 5
SIMILARITY = 0.8
#: Distinct words, from and to, blocks that they are dealt to, and blocks that must agree; longer lines go on by ``layouts``.
LAYOUTS = ((5, 12, 6, 4), (10, 30, 5, 2), (25, 66, 8, 1), (60, 158, 16, 1))
#: Blocks that agree must hold so many words.
KEY_WORDS = 3
#: Shorter words (in bytes) do not vote in lines with enough others.
VOTE_BYTES = 4
#: Lines of ``BAND_WORDS`` words or more must not differ in more of 128 SimHash bits.
DISTANCE = 32
#: MinHash bands of ``wide``, hashes in a band, bytes in a run, and words from which lines have none.
BANDS, BAND_ROWS, RUN, BAND_WORDS = 24, 2, 7, 16
#: The edit distance of lines with more characters is sought in growing bands, with the same result.
LONG_LINE = 10_000
#: The first band; each next one is four times as wide.
FIRST_BAND = 256
#: Up to so many rows of a few dozen bytes are broadcast; more are joined.
BROADCAST_ROWS = 200_000
#: Lists up to this are compared pair by pair.
SHORT_LIST = 8
#: Lines of a list that one task compares at a time.
CHUNK = 256
#: Bits that are kept of a key, and keys that a task holds before it sends them on.
KEY_BITS, HELD_KEYS = 48, 2_000_000
#: Bits of the filter that finds the lines of lists in documents, at most, and lines in a segment of it.
FILTER_BITS, FILTER_LINES = 1 << 30, 1 << 18
#: Text bytes that one step holds at once, and bytes hashed at once.
STEP_BYTES, PIECE = 2 << 20, 1 << 20

#: What parts words, other than a line's end; a single space needs no replacing.
_OTHER = r" *[^\pL\pM\pN \n][^\pL\pM\pN\n]*|  +"


#: Lower case of ASCII letters, 0 for digits, a space for what else is ASCII; line ends and other bytes stay.
_ASCII = bytes(n if n > 127 or n == 10 else ord("0") if chr(n).isdigit() else ord(chr(n).lower()) if chr(n).isalpha() else 32 for n in range(256))
#: Bytes that are mapped at once, which stay in the processor's cache, and what is no ASCII and no Latin letter.
_MAPPED, _HARD = 1 << 16, r"[^\x{0}-\x{7F}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{17F}]"


def normal_lines(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The lines of all texts one after another, in normal form, and how many each text has.

    Lower case, words (letters, marks and numbers) apart by one space, runs of digits as 0. ASCII is mapped by bytes; lines
    with other characters than Latin letters go through expressions after that.
    """
    data, bounds = text_bytes(texts)
    found, runs, last = [np.zeros(0, np.uint8)], [np.zeros(0, np.int64)], 0
    for at in range(0, len(data), _MAPPED):
        own = np.frombuffer(data[at : at + _MAPPED].tobytes().translate(_ASCII), np.uint8)
        run = np.append(own[0] == last, own[1:] == own[:-1])  # of spaces and digits one is kept
        run &= (own == 32) | (own == 48)
        run[bounds[slice(*np.searchsorted(bounds, (at, at + len(own))))] - at] = False
        run, last = np.flatnonzero(run), own[-1]
        found.append(np.delete(own, run))
        runs.append(run + at)
    ends = bounds - np.searchsorted(np.concatenate(runs), bounds)
    lists = pc.split_pattern(_binary(ends, np.concatenate(found)).view(pa.string()), "\n")
    lines = lists.flatten()
    wide = pc.not_equal(pc.binary_length(lines), pc.utf8_length(lines))
    some = pc.utf8_lower(lines.filter(wide))
    hard = pc.match_substring_regex(some, _HARD)
    rest = some.filter(hard)
    if len(rest):
        rest = pc.replace_substring_regex(pc.replace_substring_regex(rest, _OTHER, " "), r"\p{Nd}+", "0")
        some = pc.replace_with_mask(some, hard, rest)
    if len(some):
        lines = pc.replace_with_mask(lines, wide, some)
    return pc.utf8_trim(lines, " "), pc.list_value_length(lists).to_numpy()


def normalised(line: str) -> str:
    """The normal form of one line."""
    return normal_lines(pa.array([line.replace("\n", " ")]))[0][0].as_py()


# -- blocks ------------------------------------------------------------------

_U = np.uint64
_PLACE = np.random.default_rng(7).integers(0, 1 << 63, 1024, _U) * _U(2) + _U(1)
_ODD = np.random.default_rng(12).integers(0, 1 << 63, BANDS * BAND_ROWS, _U) * _U(2) + _U(1)
_HASH_BITS = 40


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(32))


def _unique(sorted_: np.ndarray) -> np.ndarray:
    return sorted_[np.concatenate([[True], sorted_[1:] != sorted_[:-1]])] if len(sorted_) else sorted_


def _words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Line, hash and bytes of each word of normal lines; ``bounds`` are the lines' places in ``data``."""
    first = np.zeros(len(data) + 1, bool)
    first[bounds[:-1][bounds[1:] > bounds[:-1]]] = True
    first[1:] |= data == 32
    starts = np.flatnonzero(first[:-1])
    stops = np.append(starts[1:], len(data))[: len(starts)]
    line = np.repeat(np.arange(len(bounds) - 1), np.diff(np.searchsorted(starts, bounds)))
    size = stops - starts - (data[stops - 1] == 32)
    # A byte of every word at a time, the longest words first.
    order = np.argsort(-np.minimum(size, len(_PLACE)).astype(np.int16), kind="stable")
    live = len(order) - np.cumsum(np.bincount(size[size <= len(_PLACE)], minlength=len(_PLACE) + 1))[: len(_PLACE)]
    at, sums = starts[order], np.zeros(len(order), _U)
    for n, words in enumerate(live.tolist()):
        if not words:
            break
        sums[:words] += data[at[:words] + n] * _PLACE[n]
    hashes = np.empty(len(starts), _U)
    hashes[order] = sums
    for n in np.flatnonzero(stops - starts > len(_PLACE)):  # a place recurs in longer words, so these are hashed alone
        hashes[n] = xxhash.xxh64_intdigest(data[starts[n] : stops[n]].tobytes().rstrip(b" "), 5)
    return line, _mixed(hashes), size


def _majority(votes: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """SimHash of each run of ``votes``: the bits set in over half. Bit counters are kept in planes, one vote of every run
    at a time; three values of a plane add up to one of it and one of the next."""
    order = np.argsort(-counts, kind="stable")
    counts, starts = counts[order], starts[order]
    planes = [np.zeros(len(counts), _U) for _ in range(int(counts[0]).bit_length())]
    waiting: list[list[np.ndarray]] = [[] for _ in range(len(planes) + 1)]
    live = np.searchsorted(-counts, -np.arange(1, counts[0] + 1), side="right")

    def add(values: list[np.ndarray]) -> np.ndarray:
        """The carry of values that come by falling length; what stays goes into the first."""
        carry = values[0][: len(values[1])] & values[1]
        values[0][: len(values[1])] ^= values[1]
        for more in values[2:]:
            carry[: len(more)] |= values[0][: len(more)] & more
            values[0][: len(more)] ^= more
        return carry

    for n, runs in enumerate(live.tolist()):
        waiting[0].append(votes[starts[:runs] + n])
        k = 0
        while len(waiting[k]) == 3:
            waiting[k + 1].append(add(waiting[k]))
            waiting[k][1:] = []
            k += 1
    for k, plane in enumerate(planes):
        values = sorted(waiting[k], key=len, reverse=True)
        if len(values) > 1:
            waiting[k + 1].append(add(values))
        if values:
            plane[: len(values[0])] = values[0]
    half = counts // 2
    over, same = np.zeros(len(counts), _U), np.full(len(counts), ~_U(0))
    for k in reversed(range(len(planes))):
        limit = np.where(half >> k & 1, ~_U(0), _U(0))
        over |= same & planes[k] & ~limit
        same &= ~(planes[k] ^ limit)
    out = np.empty(len(counts), _U)
    out[order] = over
    return out


def layouts(most: int) -> Iterator[tuple[int, int, int, int]]:
    """``LAYOUTS`` and, for more words, the last one stretched again and again, up to lines of ``most`` distinct words."""
    low, high, blocks, agree = LAYOUTS[-1]
    yield from (x for x in LAYOUTS if x[0] <= most)
    while (low := low * 5 // 2) <= most:
        high, blocks = high * 5 // 2, blocks * 5 // 2
        yield low, high, blocks, agree


def _voters(line: np.ndarray, hashes: np.ndarray, size: np.ndarray, n: int, min_words: int) -> np.ndarray:
    """Sorted (line, hash) of each distinct word that votes, in one integer."""
    every = (line.astype(_U) << _U(_HASH_BITS)) | (hashes >> _U(64 - _HASH_BITS))
    long = _unique(np.sort(every[size >= VOTE_BYTES]))
    few = np.bincount((long >> _U(_HASH_BITS)).astype(np.int64), minlength=n) < min_words
    if not few.any():
        return long
    return _unique(np.sort(np.concatenate([long[~few[(long >> _U(_HASH_BITS)).astype(np.int64)]], every[few[line]]])))


def block_keys(lines: pa.Array, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, key) pairs: lines share a key if they agree in enough blocks of a layout. Then each line's sketch for
    ``_compatible``. Lines are in normal form."""
    return *_only_keys(lines, min_words), line_sketches(lines, min_words)


def _only_keys(lines: pa.Array, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    found = [(np.zeros(0, np.int64), np.zeros(0, _U))]
    for at, data, bounds in _pieces(lines):
        number, key = _piece_keys(*_piece_votes(_words(data, bounds), len(bounds) - 1, min_words))
        found.append((number + at, key))
    return tuple(np.concatenate(x) for x in zip(*found))


def line_sketches(lines: pa.Array, min_words: int = MIN_WORDS) -> np.ndarray:
    """A row for each line in normal form: what ``_compatible`` compares."""
    found = [np.zeros((0, 2), _U)]
    for _, data, bounds in _pieces(lines):
        words, n = _words(data, bounds), len(bounds) - 1
        _, _, votes, size = _piece_votes(words, n, min_words)
        found.append(_sketches(data, bounds, np.bincount(words[0], minlength=n) < BAND_WORDS, votes, size))
    return np.concatenate(found)


def _pieces(lines: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of lines of about ``PIECE`` bytes: number of the first, bytes and bounds."""
    bounds = text_bytes(lines)[1] if len(lines) else np.zeros(1, np.int64)
    at = 0
    while at < len(lines):
        to = max(at + 1, int(np.searchsorted(bounds[1:], bounds[at] + PIECE, side="right")))
        yield at, *text_bytes(lines.slice(at, to - at))
        at = to


def _piece_votes(words: tuple[np.ndarray, np.ndarray, np.ndarray], n: int, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Line, hash and vote of each voter of ``n`` lines, and how many voters each line has."""
    voters = _voters(*words, n, min_words)
    line, hashes = (voters >> _U(_HASH_BITS)).astype(np.int64), voters & _U((1 << _HASH_BITS) - 1)
    return line, hashes, _mixed(hashes), np.bincount(line, minlength=n)


def _piece_keys(line: np.ndarray, hashes: np.ndarray, votes: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    numbers, keys = [np.zeros(0, np.int64)], [np.zeros(0, _U)]
    for low, high, blocks, agree in layouts(int(size.max(initial=0))):
        own = (size >= low) & (size <= high)
        chosen = np.flatnonzero(own[line])
        if not len(chosen):
            continue
        # Voters are sorted by line and hash, and the block is the hash's leading part, so blocks are runs.
        block = ((hashes[chosen] * _U(blocks)) >> _U(_HASH_BITS)).astype(np.int64)
        cell = (np.cumsum(own) - 1)[line[chosen]] * blocks + block
        starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        counts = np.diff(np.append(starts, len(cell)))
        prints = _majority(votes[chosen], starts, counts)
        lines, cell = np.flatnonzero(own), cell[starts]
        if agree == 1:
            full = counts >= KEY_WORDS
            numbers.append(lines[cell[full] // blocks])
            keys.append(_mixed(prints[full] ^ _mixed((cell[full] % blocks + 1000 * blocks).astype(_U))))
            continue
        grid, words = np.zeros(len(lines) * blocks, _U), np.zeros(len(lines) * blocks, np.int64)
        grid[cell], words[cell] = prints, counts
        grid, words = grid.reshape(-1, blocks), words.reshape(-1, blocks)
        for k, choice in enumerate(combinations(range(blocks), agree)):
            full = words[:, choice].sum(axis=1) >= KEY_WORDS
            key = np.full(int(full.sum()), 1000 * blocks + 100 * agree + k, _U)
            for b in choice:
                key = _mixed(key ^ grid[full, b]) + key * _U(31)
            numbers.append(lines[full])
            keys.append(_mixed(key))
    return np.concatenate(numbers), np.concatenate(keys)


def _sketches(data: np.ndarray, bounds: np.ndarray, few: np.ndarray, votes: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Two integers a line: a 128-bit SimHash of its voters, or for few words 32 counts of characters, up to 15 each."""
    out = np.zeros((len(few), 2), _U)
    own, starts = np.flatnonzero(~few & (size > 0)), np.cumsum(size) - size
    if len(own):
        out[own, 0] = _majority(votes, starts[own], size[own])
        out[own, 1] = _majority(_mixed(votes ^ _U(0xA5A5A5A5)), starts[own], size[own])
    own = np.flatnonzero(few)
    lengths = (bounds[1:] - bounds[:-1])[own]
    raw = data[ragged(bounds[:-1][own], lengths)]
    row = np.repeat(np.arange(len(own)), lengths)[(raw & 0xC0) != 0x80]
    counts = np.bincount(32 * row + (raw[(raw & 0xC0) != 0x80] & 31), minlength=32 * len(own)).reshape(-1, 2, 16)
    out[own] = (np.minimum(counts, 15).astype(_U) << _U(4) * np.arange(16, dtype=_U)).sum(axis=2, dtype=_U)
    return out


def _nibbles(sketch: np.ndarray) -> np.ndarray:
    raw = np.ascontiguousarray(sketch).view(np.uint8)
    return np.concatenate([raw & 15, raw >> 4], axis=-1).view(np.int8)


def _compatible(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Whether lines may link: rows of (size, few, two sketch integers), as unsigned integers; ``a`` and ``b`` broadcast.

    Lengths bound the edit distance below. So do the counts of characters of two lines with few words: an edit
    changes two of them by one at most. Lines with more words must not differ in over ``DISTANCE`` SimHash bits.
    """
    longest = np.maximum(a[..., 0], b[..., 0]).astype(np.float64)
    out = np.minimum(a[..., 0], b[..., 0]) >= least * longest - 1e-6
    few = (a[..., 1] & b[..., 1]).astype(bool)
    apart = np.bitwise_count(a[..., 2:] ^ b[..., 2:]).sum(axis=-1, dtype=np.int64)
    out &= few | (a[..., 1] != b[..., 1]) | (apart <= DISTANCE)
    if (out & few).any():
        moved = np.abs(_nibbles(a[..., 2:]) - _nibbles(b[..., 2:])).sum(axis=-1, dtype=np.int16)
        out &= ~few | (moved <= 2 * ((1 - least) * longest + 1e-6))
    return out


def band_keys(lines: list[bytes]) -> np.ndarray:
    """A row of ``BANDS`` keys for each line in normal form: lines agree in a key if they agree in its MinHashes."""
    coded = [x.ljust(RUN, b"\0") for x in lines]
    sizes = np.array([len(x) for x in coded], np.int64)
    ends = np.cumsum(sizes)
    out = np.zeros((len(lines), BANDS), _U)
    start = 0
    while start < len(lines):  # some thousand bytes at a time
        base = ends[start] - sizes[start]
        stop = max(start + 1, int(np.searchsorted(ends, base + 32_768, side="right")))
        data = np.frombuffer(b"".join(coded[start:stop]), np.uint8).astype(_U)
        runs = sum(data[k : len(data) - RUN + 1 + k] << _U(8 * k) for k in range(RUN))
        counts = sizes[start:stop] - RUN + 1
        at = np.cumsum(counts) - counts
        runs = _mixed(runs[ragged(ends[start:stop] - sizes[start:stop] - base, counts)])
        for band in range(BANDS):
            key = np.full(stop - start, band + 1, _U)
            for odd in _ODD[band * BAND_ROWS : (band + 1) * BAND_ROWS]:
                key = _mixed(key ^ np.minimum.reduceat(runs * odd, at)) + key * _U(31)
            out[start:stop, band] = key
        start = stop
    return out


# -- edit similarity ---------------------------------------------------------


def edit_distance(a: str, b: str, most: int) -> int:
    """Levenshtein distance; anything above ``most`` may come back as ``most + 1``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    n = 0
    end = min(len(a), len(b))
    while n < end and a[n] == b[n]:
        n += 1
    a, b = a[n:], b[n:]
    n, end = 0, min(len(a), len(b))
    while n < end and a[-1 - n] == b[-1 - n]:
        n += 1
    a, b = a[: len(a) - n], b[: len(b) - n]
    if not a or not b:
        return max(len(a), len(b))
    if min(len(a), len(b)) > LONG_LINE:
        width = FIRST_BAND
        while width < most and 2 * width < len(a):
            if (found := _banded(a, b, width)) <= width:
                return found
            width *= 4
        if 2 * most < len(a):
            return _banded(a, b, most)
    # Bit-parallel columns (Myers 1999, Hyyro 2003), a bit for each character of a.
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    match: dict[str, int] = {}
    for k, c in enumerate(a):
        match[c] = match.get(c, 0) | 1 << k
    plus, minus, score = full, 0, len(a)
    for k, c in enumerate(b):
        eq = match.get(c, 0)
        zero = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = minus | (full & ~(zero | plus)), plus & zero
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = (up << 1 | 1) & full, (down << 1) & full
        plus, minus = down | (full & ~(zero | up)), up & zero
        if score - (len(b) - 1 - k) > most:
            return most + 1
    return score


def _banded(a: str, b: str, most: int) -> int:
    """``edit_distance`` from the cells within ``most`` of the diagonal alone; ``a`` is longer than ``most``."""
    m, n = len(a), len(b)
    if abs(m - n) > most:
        return most + 1
    match: dict[str, int] = {}
    codes = np.frombuffer(a.encode("utf-32-le", "surrogatepass"), np.uint32)
    for c in set(a):
        match[c] = int.from_bytes(np.packbits(codes == ord(c), bitorder="little").tobytes(), "little")
    # Columns of the band (Hyyro 2003): bit t of column j stands for row j - most + t. The distance is followed along the
    # band's last diagonal until that meets the last row, and then along the row.
    full, top = (1 << 2 * most + 1) - 1, 1 << 2 * most
    plus, minus, score = full & ~((1 << most) - 1), 0, most
    for j, c in enumerate(b, 1):
        eq, shift = match.get(c, 0), most + 1 - j
        eq = (eq << shift if shift >= 0 else eq >> -shift) & full
        zero = ((((eq & plus) + plus) ^ plus) | eq | minus) & full
        up, down = minus | (full & ~(zero | plus)), plus & zero
        if j + most <= m:
            score += not zero & top
            left = n - m + most
        else:
            at = m - j + most
            score += (up >> at & 1) - (down >> at & 1)
            left = n - j
        if score - left > most:
            return most + 1
        plus, minus = down | (full & ~(zero >> 1 | up)), (zero >> 1) & up
    return min(score, most + 1)


def _resynced(a: list[str], b: list[str], most: int) -> bool:
    """Whether a cheap script of replaced words, an upper bound of the edit distance, stays within ``most``."""
    if len(a) == len(b) and sum([max(len(x), len(y)) for x, y in zip(a, b) if x != y]) <= most:
        return True
    i = j = cost = 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            i, j = i + 1, j + 1
            continue
        found = next(((x, s - x) for s in range(1, 8) for x in range(s + 1) if i + x < len(a) and j + s - x < len(b) and a[i + x] == b[j + s - x]), None)
        if found is None:
            return False
        x, y = found
        cost += max(sum(map(len, a[i : i + x])) + x, sum(map(len, b[j : j + y])) + y)
        if cost > most:
            return False
        i, j = i + x, j + y
    return cost + max(sum(map(len, a[i:])) + len(a) - i, sum(map(len, b[j:])) + len(b) - j) <= most


def similar(a: str, b: str, least: float) -> bool:
    """Whether two lines in normal form are similar enough to link."""
    most = int((1 - least) * max(len(a), len(b)) + 1e-9)
    return _resynced(a.split(" "), b.split(" "), most) or edit_distance(a, b, most) <= most


#: Characters of a line that ``distance_bounds`` aligns, and the most that a line may have to be aligned at all.
HEAD, ALIGNED = 64, 512
#: Pairs that are aligned at a time, pairs of a list that are compared before others are looked at, and bytes of pairs
#: that are compared at once.
PAIRS, LINKED, PAIR_BYTES = 4096, 4096, 16 << 20


def distance_bounds(lines: list[str], i: np.ndarray, j: np.ndarray, least: float) -> np.ndarray:
    """For each pair of ``lines`` whether its edit distance may allow a similarity of ``least``; False only if it cannot.

    The first ``HEAD`` characters of one line are aligned with every beginning of the other, in bit-parallel columns of
    many pairs at once; what is left costs at least its difference in length. Characters are told apart by seven bits,
    which can only lower the distance, so a pair that passes has to be compared in full. Lines longer than ``ALIGNED`` pass,
    and pairs that may differ in about as many characters as a head has, since next to none of them would be rejected.
    """
    out = np.ones(len(i), bool)
    size = np.array([len(x) for x in lines], np.int64)
    most = ((1 - least) * np.maximum(size[i], size[j]) + 1e-9).astype(np.int64)
    own = np.flatnonzero((np.maximum(size[i], size[j]) <= ALIGNED) & (np.minimum(size[i], size[j]) > 0) & (most < HEAD - HEAD // 8))
    own = own[np.argsort(size[j[own]], kind="stable")]
    for at in range(0, len(own), PAIRS):
        some = own[at : at + PAIRS]
        used, place = np.unique(np.concatenate([i[some], j[some]]), return_inverse=True)
        x, y = place[: len(some)], place[len(some) :]
        width = int(size[used].max())
        coded = "".join(lines[k].ljust(width) for k in used.tolist()).encode("utf-32-le", "surrogatepass")
        wide = np.frombuffer(coded, np.uint32).reshape(len(used), width)
        codes = (wide ^ (wide >> 7)) & 127
        present = np.bincount(codes.reshape(-1), minlength=128) > 0  # a small table stays in the processor's cache
        codes = (np.cumsum(present) - 1)[codes]
        chars = int(present.sum())
        match = np.zeros(len(used) * chars, _U)
        heads, rows = np.minimum(size[used], HEAD), np.arange(len(used))
        for k in range(min(width, HEAD)):  # the last row of each head is the highest bit
            has = rows[heads > k]
            match[has * chars + codes[has, k]] |= _U(1) << (64 - heads[has] + k).astype(_U)
        m, lx, ly = heads[x], size[used][x], size[used][y]
        plus, minus, score = ~_U(0) << (64 - m).astype(_U), np.zeros(len(some), _U), m.copy()
        best, rest, first = m + np.abs(lx - m - ly), lx - m - ly + 1, x * chars
        columns = np.ascontiguousarray(codes.T)
        for k in range(int(np.minimum(ly, m + most[some]).max())):
            eq = match.take(first + columns[k].take(y))
            zero = eq & plus
            zero += plus
            zero ^= plus
            zero |= eq
            zero |= minus
            up = zero | plus
            np.invert(up, out=up)
            up |= minus
            plus &= zero
            score += (up >> _U(63)).view(np.int64)
            score -= (plus >> _U(63)).view(np.int64)
            up <<= _U(1)
            up |= _U(1)
            plus <<= _U(1)
            np.bitwise_and(up, zero, out=minus)
            up |= zero
            np.invert(up, out=up)
            plus |= up
            left = np.abs(rest + k)
            left += score
            np.minimum(best, left, out=best, where=ly > k)
        out[some] = best <= most[some]
    return out


#: Longer lines are compared one pair at a time, as are fewer pairs; bytes that the tables of a batch of pairs may take.
BATCHED, FEW_PAIRS, TABLE_BYTES = 4096, 16, 24 << 20


def edit_distances(lines: list[str], i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
    """``edit_distance`` of many pairs of ``lines`` at once; anything above ``most`` may come back as more than it."""
    out = np.empty(len(i), np.int64)
    size = np.array([len(x) for x in lines], np.int64)
    swap = size[i] > size[j]  # the shorter line is cut into words of 64 rows
    i, j = np.where(swap, j, i), np.where(swap, i, j)
    alone = size[j] > BATCHED
    for n in np.flatnonzero(alone).tolist():
        out[n] = edit_distance(lines[i[n]], lines[j[n]], int(most[n]))
    own = np.flatnonzero(~alone)
    a, b = [], []
    for n in own.tolist():
        x, y = _cored(lines[i[n]], lines[j[n]])
        a.append(x)
        b.append(y)
    short, long = (np.array([len(x) for x in y], np.int64) for y in (a, b))
    out[own] = np.where(short > 0, most[own] + 1, long)
    near = long - short <= most[own]
    left = np.flatnonzero((short > 0) & near)
    left = left[np.argsort(-(long[left] + (short[left] - 1) // 64), kind="stable")]
    while len(left):
        # As many pairs as one table holds, of lengths that do not differ much.
        size = long[left]
        n = min(int(np.searchsorted(-size, -(size[0] // 2), side="right")), max(1, TABLE_BYTES // int((size[0] // 64 + 1) * 8 * 64)))
        some, left = left[:n], left[n:]
        if n < FEW_PAIRS:
            out[own[some]] = [edit_distance(b[k], a[k], int(most[own[k]])) for k in some.tolist()]
            continue
        out[own[some]] = _aligned([a[k] for k in some.tolist()], [b[k] for k in some.tolist()], int(most[own[some]].max()))
    return out


def _cored(a: str, b: str) -> tuple[str, str]:
    """Both strings without the beginning and the end that they share, which changes no edit distance; ``a`` is not longer."""

    def shared(x: str, y: str) -> int:
        low, high = 0, len(x)
        while low < high:
            middle = (low + high + 1) // 2
            if x[low:middle] == y[low:middle]:
                low = middle
            else:
                high = middle - 1
        return low

    n = shared(a, b)
    a, b = a[n:], b[n:]
    n = shared(a[::-1], b[::-1])
    return a[: len(a) - n], b[: len(b) - n]


def _aligned(a: list[str], b: list[str], most: int) -> np.ndarray:
    """Levenshtein distances of pairs in bit-parallel columns (Hyyro 2003). Word w of a column is a step behind word w - 1,
    so all words of all pairs advance at a time, as far as they hold cells within ``most`` of the diagonal; pairs come by
    the step at which they end, the last one first. Distances over ``most`` may come back too large."""
    n = len(a)
    la, lb = (np.array([len(x) for x in y], np.int64) for y in (a, b))
    words, height = int((la.max() - 1) // 64 + 1), int(lb.max())
    chars = np.frombuffer("".join([*a, *b]).encode("utf-32-le", "surrogatepass"), np.uint32)
    alphabet, codes = np.unique(chars, return_inverse=True)
    if n > 1 and n * words * (len(alphabet) + 1) * 8 > 2 * TABLE_BYTES:
        return np.concatenate([_aligned(a[: n // 2], b[: n // 2], most), _aligned(a[n // 2 :], b[n // 2 :], most)])
    none, split = len(alphabet), int(la.sum())
    match = np.zeros((words * n, none + 1), _U)
    pair, place = np.repeat(np.arange(n), la), ragged(np.zeros(n, np.int64), la)
    cell = ((place >> 6) * n + pair) * (none + 1) + codes[:split]
    order = np.argsort(cell, kind="stable")
    cell, bits = cell[order], (_U(1) << (place & 63).astype(_U))[order]
    starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    match = match.reshape(-1)
    match[cell[starts]] = np.bitwise_or.reduceat(bits, starts)
    # Characters of b, a row for each step; none before the first and after the last.
    text = np.full((height + 2 * words, n), none, np.int64)
    text[words + ragged(np.zeros(n, np.int64), lb), np.repeat(np.arange(n), lb)] = codes[split:]
    base = np.arange(words * n, dtype=np.int64).reshape(words, n) * (none + 1)
    last = (la - 1) >> 6
    ends = lb + last  # the step after which the last word of a pair has seen all of b
    out = np.empty(n, np.int64)
    plus, minus = np.full((words, n), ~_U(0)), np.zeros((words, n), _U)
    into_plus, into_minus = np.zeros((words + 1, n), _U), np.zeros((words + 1, n), _U)
    score = np.repeat(64 * np.arange(1, words + 1), n).reshape(words, n)
    beyond = np.where(la & 63, ~_U(0) << (la & 63).astype(_U), _U(0))
    one, top = _U(1), _U(63)
    live, columns, tall, seen = n, np.arange(n), words, min(words, most // 65 + 1)
    for step in range(int(ends.max())):
        low, high = max(0, (step - 64 - most) // 65), min(tall, (step + most) // 65 + 1)
        if high > seen:  # a word begins with the distance of the last row above, a column before
            score[seen] = score[seen - 1] - into_plus[seen].view(np.int64) + into_minus[seen].view(np.int64) + 64
            seen = high
        into_plus[low], into_minus[low] = one, 0
        eq = match.take(base[low:high] + text[step + words - low : step + words - high : -1])
        own_plus, own_minus, in_plus, in_minus = plus[low:high], minus[low:high], into_plus[low:high], into_minus[low:high]
        either = eq | own_minus
        eq |= in_minus
        zero = eq & own_plus
        zero += own_plus
        zero ^= own_plus
        zero |= eq
        up = zero | own_plus
        np.invert(up, out=up)
        up |= own_minus
        down = own_plus & zero
        out_plus, out_minus = up >> top, down >> top
        up <<= one
        up |= in_plus
        down <<= one
        down |= in_minus
        np.bitwise_or(either, up, out=own_plus)
        np.invert(own_plus, out=own_plus)
        own_plus |= down
        np.bitwise_and(up, either, out=own_minus)
        own_score = score[low:high]
        own_score += out_plus.view(np.int64)
        own_score -= out_minus.view(np.int64)
        into_plus[low + 1 : high + 1], into_minus[low + 1 : high + 1] = out_plus, out_minus
        left = int(np.searchsorted(-ends, -(step + 1), side="left"))
        if left < live:
            at = last[left:live], columns[left:live]
            over = beyond[left:live]
            out[left:live] = score[at] - np.bitwise_count(plus[at] & over) + np.bitwise_count(minus[at] & over).astype(np.int64)
            if not left:
                break
            live, tall = left, int(last[:left].max()) + 1
            plus, minus, score, base = (np.ascontiguousarray(x[:tall, :left]) for x in (plus, minus, score, base))
            into_plus, into_minus = (np.ascontiguousarray(x[: tall + 1, :left]) for x in (into_plus, into_minus))
            text, seen = text[:, :left], min(seen, tall)
    return out


def similar_pairs(lines: list[str], i: np.ndarray, j: np.ndarray, least: float) -> np.ndarray:
    """``similar`` for each pair of ``lines``."""
    out = distance_bounds(lines, i, j, least)
    unsure = _not_resynced(lines, i, j, np.flatnonzero(out), least)
    out[unsure] = _within(lines, i[unsure], j[unsure], least)
    return out


def _not_resynced(lines: list[str], i: np.ndarray, j: np.ndarray, some: np.ndarray, least: float) -> np.ndarray:
    """Those of the pairs ``some`` that a cheap script of replaced words does not prove to be similar."""
    pairs = ((n, lines[x], lines[y]) for n, x, y in zip(some.tolist(), i[some].tolist(), j[some].tolist()))
    return np.array([n for n, x, y in pairs if not _resynced(x.split(" "), y.split(" "), int((1 - least) * max(len(x), len(y)) + 1e-9))], np.int64)


def _within(lines: list[str], i: np.ndarray, j: np.ndarray, least: float) -> np.ndarray:
    """Whether the edit distance of each pair allows a similarity of ``least``."""
    size = np.array([len(x) for x in lines], np.int64)
    most = ((1 - least) * np.maximum(size[i], size[j]) + 1e-9).astype(np.int64)
    return edit_distances(lines, i, j, most) <= most


# -- the steps ---------------------------------------------------------------


def _occurrences(docs: DataFrame, least_words: int, min_words: int, wide: bool) -> DataFrame:
    """(d, th, no, lk, lid) of each line with ``least_words`` words; with its keys at a line's first place in a step."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "t", STEP_BYTES):
                lines, counts = normal_lines(part.column("t"))
                doc = np.repeat(np.arange(len(counts)), counts)
                no = ragged(np.zeros(len(counts), np.int64), counts.astype(np.int64))
                words = pc.add(pc.count_substring(lines, " "), 1)
                full = pc.and_(pc.not_equal(lines, ""), pc.greater_equal(words, least_words))
                chosen = full.to_numpy(zero_copy_only=False)
                doc, no = pa.array(doc[chosen]), no[chosen]
                coded = lines.filter(full).dictionary_encode()
                code, distinct = coded.indices.to_numpy(), coded.dictionary
                digests = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, distinct.cast(pa.binary()).to_pylist())), np.uint8).reshape(-1, 16)
                lk, lid = digests[code], digests[:, :8].copy().view(np.int64).reshape(-1)[code]
                offsets, keys = _line_keys(distinct, min_words, wide)
                first = np.zeros(len(code), bool)
                first[np.unique(code, return_index=True)[1]] = True
                first &= np.diff(offsets)[code] > 0
                size = np.where(first, np.diff(offsets)[code], 0)
                packed = _low_bytes(keys[ragged(offsets[:-1][code], size)] >> _U(64 - KEY_BITS), KEY_BITS // 8)
                lists = _binary(KEY_BITS // 8 * np.concatenate([[0], np.cumsum(size)]), packed)
                binary = _binary(16 * np.arange(len(code) + 1), lk)
                yield pa.RecordBatch.from_arrays([part.column("d").take(doc), part.column("th").take(doc), pa.array(no.astype(np.int32)), binary, pa.array(lid), lists], ["d", "th", "no", "lk", "lid", "keys"])

    return docs.select("d", "th", F.coalesce("t", F.lit("")).alias("t")).mapInArrow(of, "d long, th long, no int, lk binary, lid long, keys binary")


def _line_keys(lines: pa.Array, min_words: int, wide: bool) -> tuple[np.ndarray, np.ndarray]:
    """The bounds of each line's keys (lines of too few words have none), and the keys, one after another."""
    words = pc.add(pc.count_substring(lines, " "), 1).to_numpy()
    chosen = np.flatnonzero(words >= min_words)
    number, keys = _only_keys(lines.take(pa.array(chosen)), min_words)
    number = chosen[number]
    if wide:
        own = np.flatnonzero((words >= min_words) & (words < BAND_WORDS))
        number = np.concatenate([number, np.repeat(own, BANDS)])
        keys = np.concatenate([keys, band_keys(lines.take(pa.array(own)).cast(pa.binary()).to_pylist()).reshape(-1)])
    order = np.argsort(number, kind="stable")
    return np.concatenate([[0], np.cumsum(np.bincount(number, minlength=len(lines)))]), keys[order]


def _low_bytes(values: np.ndarray, width: int) -> np.ndarray:
    """The ``width`` lowest bytes of each of ``values``, a row each, lowest first."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width])


def _from_low_bytes(raw: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = raw.reshape(-1, width)
    return out.view("<u8").reshape(-1)


def _binary(ends: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _packed(pids: int):
    """(pid, base, deltas, lids) of each share of the keys: keys in ascending order as differences of as few bytes as
    hold them, beginning with ``base``, and the lines that have them."""

    def rows(keys: np.ndarray, lids: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(keys)
        keys, lids = keys[order], lids[order]
        pid = (keys * _U(pids)) >> _U(KEY_BITS)
        starts = np.flatnonzero(np.concatenate([[True], pid[1:] != pid[:-1]]))
        bounds = np.append(starts, len(keys))
        steps_ = np.diff(keys, prepend=keys[:1])
        steps_[starts] = 0
        width = (int(steps_.max()).bit_length() + 7) // 8 or 1
        for at in range(0, len(starts), 1024):
            some = bounds[at : at + 1025]
            raw, own = _low_bytes(steps_[some[0] : some[-1]], width), lids[some[0] : some[-1]]
            columns = [pa.array(pid[some[:-1]].astype(np.int32)), pa.array(keys[some[:-1]].astype(np.int64)), _binary(width * (some - some[0]), raw), _binary(8 * (some - some[0]), own)]
            yield pa.RecordBatch.from_arrays(columns, ["pid", "base", "deltas", "lids"])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            lid, lists = (batch.column(k) for k in (0, 1))
            data, bounds = text_bytes(lists)
            held.append((_from_low_bytes(data, KEY_BITS // 8), np.repeat(lid.to_numpy(), np.diff(bounds) // (KEY_BITS // 8))))
            n += len(held[-1][0])
            if n >= HELD_KEYS:
                yield from rows(*(np.concatenate(x) for x in zip(*held)))
                held, n = [], 0
        if n:
            yield from rows(*(np.concatenate(x) for x in zip(*held)))

    return of


def _shared(key: np.ndarray, lid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (key, lid) of keys that more than one line has."""

    def twice(sorted_: np.ndarray) -> np.ndarray:
        same = sorted_[1:] == sorted_[:-1]
        return np.append(False, same) | np.append(same, False)

    order = np.argsort(key)
    order = order[twice(key[order])]
    key, lid = key[order], lid[order]
    order = np.lexsort((lid, key))
    key, lid = key[order], lid[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (lid[1:] != lid[:-1])
    key, lid = key[new], lid[new]
    if len(key):
        more = twice(key)
        key, lid = key[more], lid[more]
    return key, lid


def _members(found: DataFrame) -> DataFrame:
    """The rows (key, lid) of lists that hold more than one line.

    Keys move as columns of bytes, a row for each task and share of the keys, and each share is sorted in a task.
    """
    pids = min(1 << 15, 4 * int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []

        def out() -> Iterator[pa.RecordBatch]:
            key, lid = _shared(*(np.concatenate(x) for x in zip(*held)))
            if len(key):
                yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(lid)], ["key", "lid"])

        for batch in batches:
            (deltas, at), (lids, to) = (text_bytes(batch.column(k)) for k in (2, 3))
            for n, (pid, base) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_numpy().astype(_U))):
                if pid != last and held:
                    yield from out()
                    held = []
                own = lids[to[n] : to[n + 1]].view(np.int64)
                held.append((base + np.cumsum(_from_low_bytes(deltas[at[n] : at[n + 1]], int(at[n + 1] - at[n]) // len(own)), dtype=_U), own))
                last = pid
        if held:
            yield from out()

    rows = found.where("octet_length(keys) > 0").select("lid", "keys").mapInArrow(_packed(pids), "pid int, base long, deltas binary, lids binary")
    return rows.repartition("pid").sortWithinPartitions("pid").mapInArrow(of, "key long, lid long")


def _attributes(size: np.ndarray, few: np.ndarray, s1: np.ndarray, s2: np.ndarray) -> np.ndarray:
    return np.stack([size.astype(_U), few.astype(_U), s1.view(_U), s2.view(_U)], axis=1)


def _forest(similarity: float):
    """(a, b, key, ok): pairs that connect the graph of compatible pairs of each list; lists come sorted.

    Pairs of lines with few words, whose texts come along, are compared at once: links (ok 1) connect those that are
    similar. Of all others (ok 0) the texts have to be compared yet.
    """

    def walk(key: np.ndarray, lid: np.ndarray, size: np.ndarray, few: np.ndarray, s1: np.ndarray, s2: np.ndarray, line: np.ndarray) -> Iterator[tuple]:
        lines, few = _attributes(size, few, s1, s2), few.astype(bool)
        linked = _linker(lid, lid, line, similarity)
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        counts = np.diff(np.append(starts, len(key)))
        short = np.repeat(counts <= SHORT_LIST, counts)
        held, size_ = [], 0

        def out() -> Iterator[tuple]:
            i, j = linked(held)
            yield lid[i], lid[j], key[i], np.ones(len(i), np.int64)

        for step in range(1, min(SHORT_LIST, len(key))):  # all pairs of many short lists at a time
            i = np.flatnonzero(short[:-step] & (key[:-step] == key[step:]))
            i = i[_compatible(lines[i], lines[i + step], similarity)]
            both = few[i] & few[i + step]
            held.append((i[both], i[both] + step))
            size_ += len(held[-1][0])
            i = i[~both]
            yield lid[i], lid[i + step], key[i], np.zeros(len(i), np.int64)
        for at, n in zip(starts[counts > SHORT_LIST].tolist(), counts[counts > SHORT_LIST].tolist()):
            own = lines[at : at + n]
            near = _compatible(own[:, None], own[None, :], similarity) if n <= 64 else np.stack([_compatible(own, x, similarity) for x in own])
            both = few[at : at + n, None] & few[None, at : at + n]
            if both.any():
                i, j = np.nonzero(np.triu(near & both, 1))
                held.append((at + i, at + j))
                size_ += len(i)
                near &= ~both
            if size_ >= 32 * PAIRS:
                yield from out()
                held, size_ = [], 0
            label, a, b = np.arange(n), [], []
            for k in np.flatnonzero(np.triu(near, 1).any(axis=1)).tolist():
                to = np.flatnonzero(near[k] & (label != label[k]))
                if len(to):
                    old, one = np.unique(label[to], return_index=True)
                    a += to[one].tolist()
                    b += [k] * len(one)
                    label[np.isin(label, old)] = label[k]
            yield lid[at + np.array(a, np.int64)], lid[at + np.array(b, np.int64)], np.full(len(a), key[at]), np.zeros(len(a), np.int64)
        if size_:
            yield from out()

    return walk


def _linker(lid: np.ndarray, part: np.ndarray, line: np.ndarray, similarity: float):
    """A function that takes pairs of rows in some arrays, and gives rows of similar pairs that connect what is similar among
    them and not connected yet. Rows of one ``part`` are connected from the start."""
    up: dict[int, int] = {}
    cell = np.unique(part, return_inverse=True)[1]
    same = np.unique(lid, return_index=True, return_inverse=True)
    text = same[1][same[2]]  # a row with the same line

    def find(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def linked(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        i, j = (np.concatenate(x) for x in zip(*held))
        roots = np.arange(int(cell.max()) + 1)
        for x in up:
            roots[x] = find(x)
        open_ = roots[cell[i]] != roots[cell[j]]
        i, j = i[open_], j[open_]
        code = np.minimum(text[i], text[j]) * len(text) + np.maximum(text[i], text[j])
        once = np.sort(np.unique(code, return_index=True)[1])
        i, j = i[once], j[once]
        used, place = np.unique(np.concatenate([text[i], text[j]]), return_inverse=True)
        lines, a, b = [line[k] for k in used.tolist()], place[: len(i)], place[len(i) :]
        hold = np.flatnonzero(distance_bounds(lines, a, b, similarity))
        good: list[int] = []

        words: dict[int, list[str]] = {}

        def resynced(x: int, y: int) -> bool:
            for k in (x, y):
                if k not in words:
                    words[k] = lines[k].split(" ")
            return _resynced(words[x], words[y], int((1 - similarity) * max(len(lines[x]), len(lines[y])) + 1e-9))

        def checked(pairs: np.ndarray, near: Callable[[int, int, int], bool]) -> np.ndarray:
            """Links the pairs that are ``near``; those that are neither this nor connected are left."""
            left = []
            for n, x, y, p, q in zip(*(c[pairs].tolist() for c in (np.arange(len(i)), a, b, cell[i], cell[j]))):
                if (p := find(p)) == (q := find(q)):
                    continue
                if near(n, x, y):
                    up[max(p, q)] = min(p, q)
                    good.append(n)
                else:
                    left.append(n)
            return np.array(left, np.int64)

        # Some pairs at a time, because others need no comparison once these are linked.
        for at in range(0, len(hold), LINKED):
            unsure = checked(hold[at : at + LINKED], lambda _, x, y: resynced(x, y))
            within = dict(zip(unsure.tolist(), _within(lines, a[unsure], b[unsure], similarity).tolist()))
            checked(unsure, lambda n, x, y: within[n])
        return i[good], j[good]

    return linked


def _places(lid: np.ndarray, segments: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Segment of each line in the filter, and its two bits there."""
    mixed = _mixed(lid.view(_U))
    at = np.stack([mixed >> _U(32), _mixed(mixed) >> _U(32)])
    return ((mixed & _U(0xFFFFFFFF)) * _U(segments) >> _U(32)).astype(np.int64), (at * _U(bits) >> _U(32)).astype(np.int64)


def _filter(lids: DataFrame) -> tuple[list[bytes], int]:
    """A Bloom filter of ``lids`` in segments, made in a task each, and the bits of a segment.

    It has 10 bits for each line; over ``FILTER_BITS`` it lets more other lines pass.
    """
    n = lids.count()
    segments = n // FILTER_LINES + 1
    bits = max(64, min(10 * n, FILTER_BITS) // segments + 7 & ~7)

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lid = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_places(lid, segments, bits)[0])], ["lid", "segment"])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps: dict[int, np.ndarray] = {}
        for batch in batches:
            own, places = _places(batch.column(0).to_numpy(), segments, bits)
            for k in np.unique(own).tolist():
                maps.setdefault(k, np.zeros(bits, bool))[places[:, own == k]] = True
        if maps:
            yield pa.RecordBatch.from_arrays([pa.array(list(maps)), pa.array([np.packbits(x).tobytes() for x in maps.values()], pa.binary())], ["segment", "bits"])

    rows = lids.mapInArrow(segment, "lid long, segment long").repartition("segment").mapInArrow(of, "segment long, bits binary").collect()
    found = [bytes(bits // 8)] * segments
    for row in rows:
        found[row.segment] = bytes(row.bits)
    return found, bits


def _texts(lids: DataFrame, docs: DataFrame, least_words: int) -> DataFrame:
    """(lid, size, few, s1, s2, line) of each of ``lids`` (lid), and of some other lines. Documents are read again where
    they lie: a filter of the wanted lines goes to them, and lines alone are moved. Most lines are in no list and have
    no sketch made."""
    segments, bits = _filter(lids)
    sent = docs.sparkSession.sparkContext.broadcast((segments, bits))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments, bits = sent.value
        table = np.frombuffer(b"".join(segments), np.uint8)
        for batch in batches:
            for part in steps(batch, "t", STEP_BYTES):
                lines, _ = normal_lines(part.column("t"))
                words = pc.add(pc.count_substring(lines, " "), 1)
                lines = lines.filter(pc.and_(pc.not_equal(lines, ""), pc.greater_equal(words, least_words))).dictionary_encode().dictionary
                lid = np.frombuffer(b"".join(x[:8] for x in map(xxhash.xxh3_128_digest, lines.cast(pa.binary()).to_pylist())), np.int64)
                own, places = _places(lid, len(segments), bits)
                at = own * bits + places
                wanted = np.flatnonzero((table[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).all(axis=0))
                lines = lines.take(pa.array(wanted))
                sketch = line_sketches(lines, least_words).view(np.int64)
                few = pc.less(pc.add(pc.count_substring(lines, " "), 1), BAND_WORDS)
                size = pc.utf8_length(lines).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(lid[wanted]), size, few, pa.array(sketch[:, 0].copy()), pa.array(sketch[:, 1].copy()), lines], [*_LINE, "line"])

    texts = docs.select(F.coalesce("t", F.lit("")).alias("t")).mapInArrow(of, "lid long, size long, few boolean, s1 long, s2 long, line string")

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            new = []
            for n, x in enumerate(batch.column(0).to_pylist()):
                if x not in seen:
                    seen.add(x)
                    new.append(n)
            yield batch.take(pa.array(new, pa.int64()))

    return staged(texts.repartition("lid").mapInArrow(once, texts.schema), "line-texts")


def _walk(similarity: float):
    """(a, b): links between unconnected parts of a task's lines; lines of side 1 are compared with those of side 0, those
    of side 2 with each other except for pairs of lines with few words, which ``_forest`` has compared. Many tasks come at
    a time, sorted."""

    def candidates(task, side, part, lines) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        starts = np.flatnonzero(np.concatenate([[True], task[1:] != task[:-1]]))
        counts = np.diff(np.append(starts, len(task)))
        short = np.repeat(counts <= SHORT_LIST, counts) & (side == 2)
        for step in range(1, min(SHORT_LIST, len(task))):  # all pairs of many short lists at a time
            i = np.flatnonzero(short[:-step] & (task[:-step] == task[step:]) & (part[:-step] != part[step:]))
            i = i[(lines[i, 1] & lines[i + step, 1]) == 0]
            i = i[_compatible(lines[i], lines[i + step], similarity)]
            yield i, i + step
        for start, n in zip(starts.tolist(), counts.tolist()):
            if short[start]:
                continue
            rows = np.arange(start, start + n)
            left = rows[side[rows] != 0]
            right = rows[side[rows] == 0] if (side[rows] == 1).any() else left
            for at in range(0, len(left), 64):
                own = left[at : at + 64]
                near = _compatible(lines[own][:, None], lines[right][None, :], similarity) & (part[own][:, None] != part[right][None, :])
                if right is left:
                    near &= own[:, None] < right[None, :]
                if side[start] == 2:
                    near &= (lines[own][:, None, 1] & lines[right][None, :, 1]) == 0
                i, j = np.nonzero(near)
                yield own[i], right[j]

    def walk(task, side, part, lid, size, few, s1, s2, line) -> Iterator[tuple]:
        link = _linker(lid, part, line, similarity)

        def linked(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            i, j = link(held)
            return lid[i], lid[j]

        held, n = [], 0
        for i, j in candidates(task, side, part, _attributes(size, few, s1, s2)):
            held.append((i, j))
            n += len(i)
            if n >= 32 * PAIRS:
                yield linked(held)
                held, n = [], 0
        if n:
            yield linked(held)

    return walk


def _rest(members: DataFrame, keys: DataFrame, long: DataFrame, roots: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links within lists of ``keys`` or ``long`` between lines that are not connected yet; enough of them to connect those.

    Of ``long`` (key, lead) only lines outside the lead's part are compared with all others.
    """
    parted = lambda rows: rows.join(roots.hint("merge"), F.col("lid") == F.col("node"), "left").withColumn("part", F.coalesce("root", "lid")).drop("node", "root")
    rows = staged(parted(members.join(keys, "key")), "line-rest")
    # Lists of two have been compared, and of lists with the same lines one is enough.
    lists = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("part").alias("low"), F.max("part").alias("high"), F.sum(F.xxhash64("lid").cast("decimal(20,0)")).alias("mark"))
    lists = lists.where("n > 2 and low <> high").groupBy("n", "mark").agg(F.min("key").alias("key")).select("key")
    short = rows.join(lists, "key").select(F.col("key").alias("task"), F.lit(2).alias("side"), *_LINE, "part")
    heads = parted(long.withColumnRenamed("lead", "lid")).select("key", F.col("part").alias("main"))
    rows = staged(parted(members.join(long.select("key"), "key")).join(heads, "key").withColumn("out", F.col("part") != F.col("main")), "line-rest")
    sizes = rows.groupBy("key").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"), F.ceil(F.sum(F.col("out").cast("int")) / CHUNK).cast("int").alias("outs")).where("outs > 0")
    rows = rows.join(sizes, "key")
    chunk = lambda n: F.pmod(F.xxhash64("lid"), n)
    task = lambda i, j: F.xxhash64("key", i, j).alias("task")
    outer = rows.where("out").select("*", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("j")).select(task(chunk(F.col("outs")), F.col("j").cast("long")), F.lit(1).alias("side"), *_LINE, "part")
    inner = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("outs") - 1)).alias("i")).select(task(F.col("i").cast("long"), chunk(F.col("chunks"))), F.lit(0).alias("side"), *_LINE, "part")
    rows = staged(short.unionAll(outer).unionAll(inner), "line-tasks")
    rows = rows.join(texts.select("lid", "line").hint("merge"), "lid").select("task", "side", "part", *_LINE, "line").repartition("task").sortWithinPartitions("task")
    return by_lists(rows, _walk(similarity))


_LINE = ("lid", "size", "few", "s1", "s2")


def _links(found: DataFrame, docs: DataFrame, min_words: int, similarity: float) -> DataFrame:
    """(node, root) for each line that is linked to another."""
    members = staged(_members(found), "line-lists")
    # All lines of lists at once: documents are read again a single time.
    texts = _texts(staged(members.select("lid").distinct(), "line-ids"), docs, min_words)
    lines = texts.select(*_LINE)
    # Sides that grow with the corpus are merged at any size, so that what a small input moves tells what a large one will.
    with_few = texts.select(*_LINE, F.when(F.col("few"), F.col("line")).alias("line"))
    members = staged(members.join(with_few.hint("merge"), "lid").select("key", *_LINE, "line"), "line-members")
    long = members.groupBy("key").agg(F.count("*").alias("n"), F.min("lid").alias("lead")).where(F.col("n") > CHUNK)
    long = staged(long.join(lines.select(*(F.col(c).alias(f"l_{c}") for c in _LINE)), F.col("lead") == F.col("l_lid")).drop("n", "l_lid"), "long-lists")
    n_long = long.count()
    small = F.broadcast(long) if n_long <= BROADCAST_ROWS else long
    short = members.join(small.select("key"), "key", "left_anti").repartition("key").sortWithinPartitions("key")
    forest = by_lists(short, _forest(similarity), "a long, b long, key long, ok long")
    # What ``_compatible`` asks of two lines with many words; its other conditions only save work.
    bits = f"few or l_few or bit_count(s1 ^ l_s1) + bit_count(s2 ^ l_s2) <= {DISTANCE}"
    stars = members.drop("line").join(small, "key").where("lid <> lead").where(bits).select(F.col("lid").alias("a"), F.col("lead").alias("b"), F.lit(None).cast("long").alias("key"), F.lit(0).cast("long").alias("ok"))
    forest = staged(forest.unionAll(stars), "line-forest")
    pairs = staged(forest.where("ok = 0").select("a", "b").distinct(), "line-pairs")
    both = pairs.join(texts.select(F.col("lid").alias("a"), F.col("line").alias("x")).hint("merge"), "a").join(texts.select(F.col("lid").alias("b"), F.col("line").alias("y")).hint("merge"), "b")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            a, b, x, y = (pa.concat_arrays([part.column(k) for part in held]) for k in range(4))
            lines = [*x.to_pylist(), *y.to_pylist()]
            ok = similar_pairs(lines, np.arange(len(x)), np.arange(len(x), 2 * len(x)), similarity)
            return pa.RecordBatch.from_arrays([a, b, pa.array(ok)], ["a", "b", "ok"])

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= PAIR_BYTES:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    checked = staged(both.select("a", "b", "x", "y").mapInArrow(close, "a long, b long, ok boolean"), "line-edges")
    good = checked.where("ok").select("a", "b").unionAll(forest.where("ok = 1").select("a", "b"))
    roots = connected_components(good, "line-groups")
    failed = checked.where("not ok").select("a", "b")
    if failed.isEmpty() and not n_long:
        return roots
    keys = forest.where("ok = 0 and key is not null").join(failed, ["a", "b"]).select("key").distinct()
    more = staged(_rest(members.drop("line"), keys, long.select("key", "lead"), roots, texts, similarity), "line-more")
    return roots if more.isEmpty() else _merged(roots, more)


def _merged(roots: DataFrame, more: DataFrame) -> DataFrame:
    """(node, root) of the graph that gave ``roots`` with the links (a, b) of ``more``: the roots alone are linked anew."""
    known = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"r_{c}")).hint("merge")
    ends = more.join(known("a"), "a", "left").join(known("b"), "b", "left")
    ends = ends.select("a", "b", F.coalesce("r_a", "a").alias("ra"), F.coalesce("r_b", "b").alias("rb"))
    ends = staged(ends, "line-ends")
    parts = connected_components(ends.select(F.col("ra").alias("a"), F.col("rb").alias("b")), "line-groups")
    # Ends without a link before are parts of their own.
    alone = ends.select(F.col("ra").alias("node")).unionAll(ends.select("rb")).distinct().select("node", F.col("node").alias("root"))
    every = roots.unionAll(alone).dropDuplicates(["node"])
    parts = parts.select(F.col("node").alias("old"), F.col("root").alias("new")).hint("merge")
    return staged(every.join(parts, F.col("root") == F.col("old"), "left").select("node", F.coalesce("new", "root").alias("root")), "line-groups")


#: A place of a line, the line told by all bits of its hash; a line that has links, and its group; places that a task holds.
_PLACED = np.dtype([("lid", "<i8"), ("rest", "<i8"), ("d", "<i8"), ("th", "<i8"), ("no", "<i4")])
_ROOTED = np.dtype([("node", "<i8"), ("root", "<i8")])
HELD_PLACES = 1 << 18


def _placed(rows: np.ndarray, *groups: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows sorted by group and place, and which of them are the first of their group, and which stand later than it."""
    d, th, no = (np.ascontiguousarray(rows[c]) for c in ("d", "th", "no"))
    order = np.lexsort((no, th, d, *groups))
    new = np.arange(len(rows)) == 0
    for group in groups:
        new[1:] |= group[order][1:] != group[order][:-1]
    first = order[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(rows) else order
    return rows[order], new, (d[order] != d[first]) | (th[order] != th[first]) | (no[order] != no[first])


def _repeated(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each line, and all later places of lines that stand in several."""
    lid = np.ascontiguousarray(rows["lid"])
    order = np.argsort(lid)
    same = np.zeros(len(lid), bool)
    same[1:] = lid[order][1:] == lid[order][:-1]
    same[:-1] |= same[1:]
    several = rows[order[same]]
    several, new, later = _placed(several, several["rest"], several["lid"])
    return np.concatenate([rows[order[~same]], several[new]]), several[later]


def _gone(found: DataFrame, roots: DataFrame) -> DataFrame:
    """The places (d, th, no) of lines that go: all but the first of each group, or of equal lines without links.

    Places move as columns of bytes, dealt by the line's hash. What a task knows to stand later than another place of
    its group is settled there, so a group sends on one place from each task at most, whatever its size.
    """
    pids = min(1 << 15, 4 * int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def dealt(kind: int, rows: np.ndarray, by: str) -> Iterator[pa.RecordBatch]:
        """Kinds: 0 places, 1 lines with links, 2 places that go."""
        spread = np.ascontiguousarray(rows[by]).view(_U)
        pid = ((_mixed(spread) if kind == 2 else spread) >> _U(32)) * _U(pids) >> _U(32)
        order = np.argsort(pid, kind="stable")
        pid, rows = pid[order], rows[order]
        starts = np.flatnonzero(np.append(True, pid[1:] != pid[:-1])[: len(pid)])
        bounds = rows.itemsize * np.append(starts, len(pid))
        for at in range(0, len(starts), 1024):
            some = bounds[at : at + 1025]
            own = rows[some[0] // rows.itemsize : some[-1] // rows.itemsize].view(np.uint8)
            columns = [pa.array(pid[starts[at : at + 1024]].astype(np.int32)), pa.array(np.full(len(some) - 1, kind, np.int32)), _binary(some - some[0], own)]
            yield pa.RecordBatch.from_arrays(columns, ["pid", "kind", "rows"])

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[pa.RecordBatch]:
            first, later = _repeated(np.concatenate(held))
            yield from dealt(0, first, "lid")
            yield from dealt(2, later, "d")

        held, n = [], 0
        for batch in batches:
            rows = np.empty(batch.num_rows, _PLACED)
            hashes = text_bytes(batch.column(0))[0].view("<i8").reshape(-1, 2)
            rows["lid"], rows["rest"] = hashes[:, 0], hashes[:, 1]
            for k, c in enumerate(("d", "th", "no"), 1):
                rows[c] = batch.column(k).to_numpy()
            held.append(rows)
            n += len(rows)
            if n >= HELD_PLACES:
                yield from out()
                held, n = [], 0
        if n:
            yield from out()

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.empty(batch.num_rows, _ROOTED)
            rows["node"], rows["root"] = (batch.column(k).to_numpy() for k in (0, 1))
            yield from dealt(1, rows, "node")

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, ([], [], [])

        def out() -> Iterator[pa.RecordBatch]:
            rows, known, over = (np.concatenate([np.frombuffer(x, t) for x in own]) if own else np.empty(0, t) for own, t in zip(held, (_PLACED, _ROOTED, _PLACED)))
            rows, later = _repeated(rows)
            known = known[np.argsort(known["node"])]
            at = np.minimum(np.searchsorted(known["node"], rows["lid"]), max(0, len(known) - 1))
            linked = known["node"][at] == rows["lid"] if len(known) else np.zeros(len(rows), bool)
            rows, root = rows[linked], known["root"][at[linked]]
            rows["lid"] = root
            rows, new, behind = _placed(rows, rows["lid"])
            for some, group in ((np.concatenate([over, later, rows[behind]]), False), (rows[new], True)):
                if len(some):
                    columns = [pa.array(some["lid"], pa.int64()) if group else pa.nulls(len(some), pa.int64())]
                    yield pa.RecordBatch.from_arrays([*columns, *(pa.array(some[c]) for c in ("d", "th", "no"))], ["root", "d", "th", "no"])

        for batch in batches:
            for pid, kind, rows in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if pid != last and last is not None:
                    yield from out()
                    held = ([], [], [])
                held[kind].append(rows)
                last = pid
        if last is not None:
            yield from out()

    def first(root: np.ndarray, d: np.ndarray, th: np.ndarray, no: np.ndarray) -> Iterator[tuple]:
        rows = np.empty(len(root), _PLACED)
        rows["lid"], rows["d"], rows["th"], rows["no"] = root, d, th, no
        rows, _, later = _placed(rows, rows["lid"])
        yield rows["d"][later], rows["th"][later], rows["no"][later]

    schema = "pid int, kind int, rows binary"
    rows = found.select("lk", "d", "th", "no").mapInArrow(places, schema).unionAll(roots.select("node", "root").mapInArrow(links, schema))
    rows = staged(rows.repartition("pid").sortWithinPartitions("pid").mapInArrow(judged, "root long, d long, th long, no int"), "line-classes")
    heads = rows.where("root is not null").repartition("root").sortWithinPartitions("root")
    beaten = by_lists(heads, first, "d long, th long, no long").select("d", "th", F.col("no").cast("int"))
    return rows.where("root is null").select("d", "th", "no").unionAll(beaten)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, similarity: float = SIMILARITY, wide: bool = False, short: bool = False) -> DataFrame:
    """``docs`` with ``text_col`` rid of lines that occur before, and ``n_lines`` and ``n_removed`` longs.

    Lines end at ``\\n``. Of each connected group of lines the first occurrence
    stays, by document id, hash of the text and line number (null ids first).
    Two lines link if their normal forms are equal, or if they share a key of
    ``block_keys`` (or of ``band_keys`` if ``wide``), differ in no more than
    ``DISTANCE`` SimHash bits (lines of ``BAND_WORDS`` words or more) and have
    an edit similarity (1 - distance / longer length) of ``similarity`` or more,
    whatever their length. Lines with fewer than ``min_words`` words
    stay or, if ``short``, link to lines of the same normal form; lines without
    any word always stay. Lines are told apart by 128-bit hashes, and links are
    kept by 64 bits of them. Null text stays null and has no lines; a text that
    loses all its lines becomes empty and its row stays; an empty table gives
    an empty one. Rows that repeat both id and text are one document and come
    back alike. All other columns come through under any name; input columns
    named like the two new ones are replaced.
    """
    id_, text = docs[f"`{id_col}`"], docs[f"`{text_col}`"]
    d, th = F.coalesce(id_.cast("long"), F.lit(-(1 << 63))), F.xxhash64(id_.isNull(), text)
    keyed = docs.select(d.alias("d"), th.alias("th"), text.alias("t"))
    found = staged(_occurrences(keyed, 1 if short else min_words, min_words, wide), "line-occurrences")
    roots = _links(found, keyed, min_words, similarity)
    gone = _gone(found, roots).groupBy("d", "th").agg(F.collect_set("no").alias("__gone"))
    gone = staged(gone.select(F.col("d").alias("__d"), F.col("th").alias("__th"), "__gone"), "lines-gone")
    few = gone.count() <= BROADCAST_ROWS
    names = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    inner = [f"__c{n}" for n in range(len(names))]  # names of our own: those of the input may be like any other
    rows = docs.select(*(docs[f"`{c}`"].alias(i) for c, i in zip(names, inner)), d.alias("__rd"), th.alias("__rth"))
    rows = rows.join(F.broadcast(gone) if few else gone, (F.col("__rd") == F.col("__d")) & (F.col("__rth") == F.col("__th")), "left")
    body = F.col(inner[names.index(text_col)])
    lines_ = F.split(body, "\n")
    left = F.filter(lines_, lambda _, n: ~F.array_contains("__gone", n))
    slim = F.when(F.col("__gone").isNull(), body).otherwise(F.array_join(left, "\n"))
    # Only documents that lose lines are split.
    n_lines = F.when(body.isNull(), 0).otherwise(F.octet_length(body) - F.octet_length(F.replace(body, F.lit("\n"), F.lit(""))) + 1).cast("long")
    n_removed = F.when(F.col("__gone").isNull(), 0).otherwise(F.size("__gone")).cast("long")
    return rows.select(*((slim if c == text_col else F.col(i)).alias(c) for c, i in zip(names, inner)), n_lines.alias("n_lines"), n_removed.alias("n_removed"))
