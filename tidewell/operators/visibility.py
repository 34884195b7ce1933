"""Row visibility labels: ``admin``, ``ops&audit``, ``(ops&audit)|admin``.

Labels are few, so each distinct one is judged once on the driver and rows are
kept by an ``IN`` filter below everything that a user asks. An empty or null
label is public; one that cannot be read is visible to no one.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..model import VISIBILITY

_TOKEN = re.compile(r'[ \t\n\r\f]*(?:([A-Za-z0-9_.:/-]+)|"((?:[^"\\]|\\["\\])*)"|([&|()]))')
#: More distinct labels than this are joined with their verdicts.
INLINE_LABELS = 2_000

Judge = Callable[[frozenset[str]], bool]


class LabelError(ValueError):
    """A label that does not follow the grammar."""


def _tokens(label: str) -> list[tuple[str, str]]:
    out, at = [], 0
    end = len(label.rstrip(" \t\n\r\f"))
    while at < end:
        m = _TOKEN.match(label, at)
        if not m:
            raise LabelError(f"unexpected {label[at:]!r}")
        if m[1] is not None:
            out.append(("name", m[1]))
        elif m[2] is not None:
            if not m[2]:
                raise LabelError("empty name")
            out.append(("name", re.sub(r"\\(.)", r"\1", m[2])))
        else:
            out.append(("mark", m[3]))
        at = m.end()
    return out


def parse_label(label: str) -> Judge:
    """A function of the reader's authorizations. ``&`` and ``|`` do not mix at one level."""
    tokens = _tokens(label)
    if not tokens:
        return lambda auths: True
    at = 0

    def group() -> Judge:
        nonlocal at
        parts, mark = [operand()], None
        while at < len(tokens) and tokens[at] in (("mark", "&"), ("mark", "|")):
            if mark not in (None, tokens[at][1]):
                raise LabelError("& and | need parentheses between them")
            mark = tokens[at][1]
            at += 1
            parts.append(operand())
        every = all if mark == "&" else any
        return lambda auths: every(p(auths) for p in parts)

    def operand() -> Judge:
        nonlocal at
        if at == len(tokens):
            raise LabelError("a name is missing")
        kind, text = tokens[at]
        at += 1
        if kind == "name":
            return lambda auths: text in auths
        if text != "(":
            raise LabelError(f"unexpected {text!r}")
        inner = group()
        if at == len(tokens) or tokens[at] != ("mark", ")"):
            raise LabelError("a parenthesis is not closed")
        at += 1
        return inner

    judge = group()
    if at != len(tokens):
        raise LabelError("text after the label")
    return judge


def allows(label: str | None, auths: Iterable[str]) -> bool:
    if not label:
        return True
    try:
        return parse_label(label)(frozenset(auths))
    except LabelError:
        return False


def visible_labels(df: DataFrame, auths: Iterable[str], column: str = VISIBILITY) -> list[str]:
    """Those distinct labels of ``df`` that ``auths`` may see."""
    known = frozenset(auths)
    return sorted(r[0] for r in df.select(F.col(f"`{column}`")).where(F.col(f"`{column}`").isNotNull()).distinct().collect() if allows(r[0], known))


def apply_visibility(df: DataFrame, auths: Iterable[str], column: str = VISIBILITY) -> DataFrame:
    """Rows that a reader with ``auths`` may see; a table without the column is public.

    A label column of another type fails the query. Labels are judged from the
    table itself, so one that nobody judged stays hidden.
    """
    if column not in df.columns:
        return df
    if df.schema[column].dataType != StringType():
        raise ValueError(f"{column} must be a string")
    label, known = F.col(f"`{column}`"), frozenset(auths)
    if df.select(label).distinct().limit(INLINE_LABELS + 1).count() <= INLINE_LABELS:
        return df.where(label.isNull() | (label == "") | label.isin(visible_labels(df, known, column)))

    @F.udf("boolean", useArrow=True)
    def seen(text: str) -> bool:
        return allows(text, known)

    judged = df.select(label.alias("__label")).where("__label is not null and __label <> ''").distinct().where(seen("__label"))
    public = df.where(label.isNull() | (label == ""))
    return public.unionAll(df.join(judged, label == F.col("__label"), "left_semi"))
