"""Quality grades by ordinal cumulative-link regression on hashed text.

``P(grade <= k) = sigmoid(threshold[k] - w . x)``: one weight vector, shared by
all grades, and ordered thresholds. ``x`` marks the hashed features of a whole
text: its words, their beginnings, and a few coarse measures of its shape. Selection uses the
expected grade and the tail probability of reaching a wanted grade.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import steps

BITS = 20
#: Letters of a word's beginning that are a feature of their own.
STEM = 4
#: Standard errors by which a feature must depart from chance.
SCREEN = 6.0
#: Labelled rows that the model is fitted on, at most: those with the smallest hash of their id.
FIT_ROWS = 12_000

_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_LINE_SPACE = " \t\n\v\f\r"


def _bucket(name: str, share: float) -> str:
    """A coarse logarithmic step of a share between 0 and 1."""
    return f"\x00{name}{0 if share <= 0 else 1 + max(-8, min(0, math.floor(2 * math.log2(share))))}"


_known: dict[str, int] = {}


def _place(feature: str) -> int:
    place = _known.get(feature)
    if place is None:
        if len(_known) > 150_000:
            _known.clear()
        place = _known[feature] = xxhash.xxh32_intdigest(feature.encode("utf-8", "surrogatepass"), 11) & ((1 << BITS) - 1)
    return place


def features(text: str) -> np.ndarray:
    """Sorted distinct feature numbers of a whole text."""
    words = text.split()
    n = max(1, len(words))
    distinct = set(words)
    counts_upper = sum(w.isupper() and len(w) > 1 for w in words)
    symbols = sum(map(text.count, "#*$%&|<>{}[]\\^~_=+@"))
    marks = sum(map(text.count, "!?"))
    lines = [line for line in text.split("\n") if line.strip(_LINE_SPACE)]
    names = {
        _bucket("upper", counts_upper / n),
        _bucket("symbol", symbols / max(1, len(text))),
        _bucket("mark", marks / n),
        _bucket("digit", sum(c.isdigit() for c in text) / max(1, len(text))),
        _bucket("distinct", len(distinct) / n),
        _bucket("lines", 1 - len(set(lines)) / max(1, len(lines))),
        f"\x00length{int(math.log2(len(words) + 1))}",
        f"\x00mean{min(20, int(len(text) / n))}",
    }
    stems = {w for w in (_EDGE.sub("", x.lower()) for x in distinct) if w}
    names.update(stems)
    names.update("\x01" + w[:STEM] for w in stems if len(w) > STEM)
    return np.unique(np.fromiter(map(_place, names), np.int32, len(names)))


def feature_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, x): the features of each text as little-endian 32-bit numbers."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "t"):
                x = [features(t).astype("<i4").tobytes() for t in part.column("t").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(x, pa.binary())], ["doc_id", "x"])

    rows = docs.select(docs[f"`{id_col}`"].cast("long").alias("doc_id"), F.coalesce(docs[f"`{text_col}`"], F.lit("")).alias("t"))
    return rows.mapInArrow(of, "doc_id long, x binary")


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass(frozen=True)
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray

    @property
    def grades(self) -> int:
        return len(self.thresholds) + 1

    def at_least(self, scores: np.ndarray) -> np.ndarray:
        """(texts, grades - 1): the probability of each grade above the lowest, or higher."""
        return _sigmoid(scores[:, None] - self.thresholds[None, :])

    @classmethod
    def fit(cls, rows: list[np.ndarray], grades: np.ndarray, n_grades: int, l2: float = 1.0, rounds: int = 200) -> OrdinalModel:
        """Maximum likelihood with an L2 penalty, by Adam on all rows at once. Deterministic.

        Only features that some cut between grades shifts by ``SCREEN`` standard
        errors get a weight; thousands of words by chance would else blur the
        scores of long texts. With a single grade among the rows, thresholds
        follow the grades' shares alone; without rows nothing speaks against any
        text, and the highest grade is all but certain.
        """
        n = len(grades)
        share = np.array([(np.sum(grades < k) + 0.5) / (n + 1.0) for k in range(1, n_grades)])
        theta = np.log(share / (1 - share))
        weights = np.zeros(1 << BITS)
        if not n:
            return cls(weights, np.arange(len(theta)) - 20.0)
        if len(np.unique(grades)) < 2:
            return cls(weights, np.maximum.accumulate(theta + 1e-6 * np.arange(len(theta))))
        sizes = np.array([len(r) for r in rows])
        cols = np.concatenate(rows)
        owner = np.repeat(np.arange(n), sizes)
        seen = np.bincount(cols, minlength=1 << BITS)
        z = np.zeros(1 << BITS)
        for k in range(1, n_grades):
            low = grades < k
            p = low.mean()
            shift = np.bincount(cols, low[owner], 1 << BITS) - p * seen
            z = np.maximum(z, np.abs(shift) / np.sqrt(np.maximum(p * (1 - p) * seen, 0.25)))
        useful = (seen[cols] >= 3) & (z[cols] >= SCREEN)
        cols, owner = cols[useful], owner[useful]
        places, cols = np.unique(cols, return_inverse=True)
        full, weights = weights, np.zeros(len(places))
        # Gaps between thresholds are kept positive as exponentials.
        free = np.concatenate([theta[:1], np.log(np.maximum(np.diff(theta), 1e-3))])
        first, second = [np.zeros(len(weights) + len(free)) for _ in range(2)]
        upper_of, lower_of = np.append(np.arange(n_grades - 1), -1), np.arange(-1, n_grades - 1)
        for t in range(1, rounds + 1):
            gaps = np.exp(free[1:])
            theta = free[0] + np.concatenate([[0.0], np.cumsum(gaps)])
            score = np.bincount(owner, weights[cols], n)
            below = _sigmoid(theta[None, :] - score[:, None])
            wide = np.concatenate([below, np.ones((n, 1)), np.zeros((n, 1))], axis=1)
            up, low = upper_of[grades], lower_of[grades]
            hi = np.where(up >= 0, wide[np.arange(n), up], 1.0)
            lo = np.where(low >= 0, wide[np.arange(n), low], 0.0)
            p = np.maximum(hi - lo, 1e-12)
            d_hi, d_lo = hi * (1 - hi) / p, lo * (1 - lo) / p
            slope = np.bincount(cols, (d_hi - d_lo)[owner], len(weights)) + l2 * weights
            d_theta = np.array([np.sum(d_lo[low == k]) - np.sum(d_hi[up == k]) for k in range(n_grades - 1)])
            d_free = np.concatenate([[d_theta.sum()], [d_theta[k + 1 :].sum() * gaps[k] for k in range(len(gaps))]])
            grad = np.concatenate([slope, d_free])
            first = 0.9 * first + 0.1 * grad
            second = 0.99 * second + 0.01 * grad**2
            step = 0.1 * (1 - 0.9 * t / rounds) * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-6)
            weights = weights - step[: len(weights)]
            free = free - step[len(weights) :]
        full[places] = weights
        return cls(full, free[0] + np.concatenate([[0.0], np.cumsum(np.exp(free[1:]))]))


def fit_grades(docs: DataFrame, graded: DataFrame, n_grades: int, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade", max_rows: int = FIT_ROWS) -> OrdinalModel:
    """Fit on at most ``max_rows`` labelled texts, a fixed sample by hash of the id.

    ``graded`` holds ids and grades 0 to ``n_grades - 1``; rows with a null or
    other grade or a null id are left out, of repeated ids the lowest grade
    counts. What reaches the driver is bounded: ``max_rows`` lists of at most
    ``2 ** BITS`` distinct features.
    """
    valid = graded.where(F.col(grade_col).between(0, n_grades - 1)).groupBy(F.col(id_col).cast("long").alias("__id")).agg(F.min(grade_col).cast("int").alias("__grade")).where("__id is not null")
    picked = valid.orderBy(F.xxhash64("__id"), "__id").limit(max_rows)
    texts = docs.join(F.broadcast(picked), docs[id_col].cast("long") == F.col("__id")).select("__id", text_col)
    rows = feature_rows(texts, "__id", text_col).join(F.broadcast(picked), F.col("doc_id") == F.col("__id")).select("doc_id", "__grade", "x").collect()
    rows.sort(key=lambda r: (r.doc_id, r.x))
    return OrdinalModel.fit([np.frombuffer(r.x, "<i4") for r in rows], np.array([r["__grade"] for r in rows], np.int64), n_grades)


def score_grades(docs: DataFrame, model: OrdinalModel, tail: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``expected_grade`` and ``tail_probability`` (of grade ``tail`` or higher), doubles.

    Every row comes back once. Null text counts as empty and is scored like any
    other. Input columns named like a new one are replaced.
    """
    if not 1 <= tail < model.grades:
        raise ValueError("tail must be a grade above the lowest")
    names = ("expected_grade", "tail_probability")
    kept = [c for c in docs.columns if c.lower() not in names]
    base = docs.select(*(docs[f"`{c}`"] for c in kept), F.coalesce(docs[f"`{text_col}`"], F.lit("")).alias("__text"))
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = OrdinalModel(*shared.value)
        for batch in batches:
            for part in steps(batch, "__text"):
                scores = np.array([own.weights[features(t)].sum() for t in part.column("__text").to_pylist()])
                above = own.at_least(scores)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(above.sum(axis=1)), pa.array(above[:, tail - 1])], [*kept, *names])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields[:-1]]
    return base.mapInArrow(of, ", ".join([*fields, *(f"{n} double" for n in names)]))


def quality_grades(labels: DataFrame) -> DataFrame:
    """Grades of the ``labels`` table: 0 of low quality, 1 toxic but else good, 2 good. Null quality has no grade."""
    return labels.where("quality is not null").select("doc_id", F.expr("case when quality = 0 then 0 when coalesce(toxic, 0) = 1 then 1 else 2 end").alias("grade"))
