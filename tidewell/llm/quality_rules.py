"""Quality rules whose cutoffs carry a guarantee on false rejections.

Each rule rejects documents whose statistic exceeds a cutoff. Labelled good
documents are the holdout: in each stratum, cutoffs are tested from the most
lenient to the strictest, each by the exact binomial test of "at least
``alpha`` / rules of the good documents would be rejected", and testing stops
at the first cutoff that fails (fixed sequence, so one level per sequence).
Levels are divided by the number of sequences (Bonferroni over rules and
strata). Together the certified rules falsely reject at most ``alpha`` of the
good documents of every stratum, with probability ``1 - delta``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import staged, steps, sums, text_bytes

SYMBOLS = "#*$%&|<>"
#: Thresholds of more strata than this are joined, not broadcast.
BROADCAST_STRATA = 10_000
WINDOW = 8

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True


def _repeat_words(codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Per text, words inside 8-word windows that occur twice or more in it.

    Windows meet by a 64-bit hash of their word codes; windows that meet are
    then compared word by word.
    """
    n = len(codes) - WINDOW + 1
    if n <= 0:
        return np.zeros(len(bounds) - 1, np.int64)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    start = np.flatnonzero(owner[:n] == owner[WINDOW - 1 :])
    if not len(start):
        return np.zeros(len(bounds) - 1, np.int64)
    mixed = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    key = owner.astype(np.uint64)[start] * np.uint64(0xD6E8FEB86659FD93)
    for k in range(WINDOW):
        key = (key ^ mixed[start + k]) * np.uint64(0xBF58476D1CE4E5B9)
        key ^= key >> np.uint64(31)
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    same = np.concatenate([[False], ranked[1:] == ranked[:-1], [False]])
    again = start[order[same[1:] | same[:-1]]]
    if not len(again):
        return np.zeros(len(bounds) - 1, np.int64)
    grams = np.concatenate([owner[again, None], codes[again[:, None] + np.arange(WINDOW)]], axis=1)
    _, inverse, count = np.unique(grams, axis=0, return_inverse=True, return_counts=True)
    twice = again[count[inverse.reshape(-1)] > 1]
    size = len(codes) + 1
    covered = np.bincount(twice, minlength=size) - np.bincount(twice + WINDOW, minlength=size)
    return sums((np.cumsum(covered[:-1]) > 0).astype(np.int8), bounds)


def _stats(texts: pa.Array) -> list[np.ndarray]:
    data, bounds = text_bytes(texts)
    space = _SPACE[data]
    head = (data & 0xC0) != 0x80
    first = ~space
    first[1:] &= space[:-1]
    inner = bounds[:-1][bounds[1:] > bounds[:-1]]
    first[inner] = ~space[inner]
    n_words = sums(first, bounds)
    chars = sums(head & ~space, bounds)
    symbols = sums(_SYMBOL[data], bounds)
    words = pc.ascii_split_whitespace(texts)
    flat = words.flatten()
    flat = flat.filter(pc.not_equal(flat, ""))
    codes = flat.dictionary_encode().indices.to_numpy().astype(np.int64)
    repeats = _repeat_words(codes, np.concatenate([np.zeros(1, np.int64), np.cumsum(n_words)]))
    dups = []
    for text in texts.to_pylist():
        lines = [line for line in text.split("\n") if line.strip(" \t\n\v\f\r")]
        dups.append(len(lines) - len(set(lines)))
    return [n_words, chars, symbols, np.array(dups, np.int64), repeats]


STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def text_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with the five statistics as longs. Null text has no words.

    Every row comes back once; whole texts are read, however long. Input
    columns named like a statistic are replaced.
    """
    kept = [c for c in docs.columns if c.lower() not in STATS and c != text_col]
    base = docs.select(*(docs[f"`{c}`"] for c in kept), F.coalesce(docs[f"`{text_col}`"], F.lit("")).alias("__text"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "__text"):
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *map(pa.array, _stats(part.column("__text")))], [*kept, *STATS])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields[:-1]]
    return base.mapInArrow(of, ", ".join([*fields, *(f"{n} long" for n in STATS)]))


@dataclass(frozen=True)
class Rule:
    """Reject if ``statistic`` (SQL) exceeds a cutoff; ``cutoffs`` go from lenient to strict."""

    name: str
    statistic: str
    cutoffs: tuple[float, ...]


#: Candidate cutoffs are fixed beforehand, so that no data chooses what is tested.
RULES = (
    Rule("symbols", "n_symbols / greatest(1, word_chars)", (0.6, 0.4, 0.3, 0.2, 0.15, 0.1, 0.05)),
    Rule("dup_lines", "n_dup_lines / greatest(1, n_words)", (0.3, 0.2, 0.1, 0.05, 0.03)),
    Rule("repeats", "n_repeat_words / greatest(1, n_words)", (0.3, 0.25, 0.2, 0.15, 0.1, 0.05)),
    Rule("long_words", "word_chars / greatest(1, n_words)", (60.0, 40.0, 30.0, 20.0, 15.0, 12.0)),
)


def binomial_upper(errors: int, trials: int, level: float) -> float:
    """Exact (Clopper-Pearson) upper bound of a rate at confidence ``1 - level``."""
    if trials == 0 or errors >= trials:
        return 1.0
    low, high = errors / trials, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        if _at_most(errors, trials, mid) > level:
            low = mid
        else:
            high = mid
    return high


def _at_most(errors: int, trials: int, rate: float) -> float:
    """P(X <= errors) of a binomial, summed from its largest term down."""
    if rate <= 0:
        return 1.0
    if rate >= 1:
        return float(errors >= trials)
    log = lambda k: math.lgamma(trials + 1) - math.lgamma(k + 1) - math.lgamma(trials - k + 1) + k * math.log(rate) + (trials - k) * math.log1p(-rate)
    total, peak = 0.0, min(errors, int((trials + 1) * rate))
    top = log(peak)
    for run in (range(peak, -1, -1), range(peak + 1, errors + 1)):
        for k in run:
            term = math.exp(log(k) - top)
            total += term
            if term < total * 1e-17:
                break
    return min(1.0, total * math.exp(top))


@dataclass(frozen=True)
class RiskControl:
    alpha: float = 0.05
    delta: float = 0.05
    rules: tuple[Rule, ...] = field(default=RULES)


def calibrate(stats: DataFrame, good: DataFrame, stratum: str, control: RiskControl, id_col: str = "doc_id", unit: str | None = None) -> DataFrame:
    """(stratum, one column for each rule): the strictest certified cutoffs, null where none is.

    The bounds hold for independent trials, so rows of a stratum that agree in
    ``unit`` (a hash of the text) are one trial; near copies still count apart.
    ``good`` has the ids of labelled good documents; repeated ids count once,
    null ids never match. Null strata are a stratum of their own. Only counts
    per stratum leave the executors' join, however many rows are labelled.
    """
    held = stats.join(good.select(F.col(id_col).alias("__good")).where("__good is not null").distinct(), stats[id_col] == F.col("__good"), "left_semi")
    if unit is not None:
        held = held.dropDuplicates([stratum, unit])
    tests = [F.count(F.when(F.expr(r.statistic) > c, 1)).alias(f"{r.name}_{k}") for r in control.rules for k, c in enumerate(r.cutoffs)]
    counts = held.groupBy(F.col(stratum).alias("stratum")).agg(F.count("*").alias("trials"), *tests)
    n_strata = counts.count()
    level = control.delta / max(1, len(control.rules) * n_strata)
    share = control.alpha / max(1, len(control.rules))

    def chosen(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            out = []
            for row in batch.to_pylist():
                best = {"stratum": row["stratum"]}
                for r in control.rules:
                    best[r.name] = None
                    for k, c in enumerate(r.cutoffs):
                        if binomial_upper(row[f"{r.name}_{k}"], row["trials"], level) > share:
                            break
                        best[r.name] = c
                out.append(best)
            yield pa.RecordBatch.from_pylist(out, pa.schema([("stratum", batch.schema.field("stratum").type), *((r.name, pa.float64()) for r in control.rules)]))

    kind = stats.schema[stratum].dataType.simpleString()
    return counts.mapInArrow(chosen, ", ".join([f"stratum {kind}", *(f"{r.name} double" for r in control.rules)]))


def judge(docs: DataFrame, good: DataFrame, stratum: str = "lang", control: RiskControl = RiskControl(), base: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, stratum, statistics, base_failed, kept) for each row of ``docs``.

    ``base`` is a condition on the statistics that fails a document whatever
    is certified; null counts as false. A stratum without enough labelled good
    documents has no certified cutoff and loses nothing but to ``base``.
    Empty texts have zero statistics. Empty tables give empty results.
    """
    rows = docs.select(id_col, stratum, text_col, F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("__unit"))
    stats = staged(text_stats(rows, text_col), "text-stats")
    found = staged(calibrate(stats, good, stratum, control, id_col, "__unit"), "cutoffs")
    few = found.count() <= BROADCAST_STRATA
    names = {r.name: f"__{r.name}" for r in control.rules}
    cuts = found.select(F.col("stratum").alias("__stratum"), *(F.col(a).alias(b) for a, b in names.items()))
    rows = stats.join(F.broadcast(cuts) if few else cuts, stats[stratum].eqNullSafe(F.col("__stratum")), "left")
    failed = F.coalesce(base if base is not None else F.lit(False), F.lit(False))
    rejected = F.lit(False)
    for r in control.rules:
        rejected = rejected | F.coalesce(F.expr(r.statistic) > F.col(names[r.name]), F.lit(False))
    return rows.select(id_col, stratum, *STATS, failed.alias("base_failed"), (~failed & ~rejected).alias("kept"))
