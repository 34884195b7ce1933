"""URL allow and block lists: a trie over reversed host labels and path segments."""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Above so many rules the trie is not shipped to executors; a join takes its place.
MAX_BROADCAST_RULES = 200_000


@dataclass(frozen=True)
class UrlRule:
    """``action`` is ``allow`` or ``block``; ``path`` starts with ``/`` or is empty."""

    action: str
    host: str
    path: str = "/"

    def __post_init__(self) -> None:
        if self.action not in ("allow", "block"):
            raise ValueError(f"unknown action {self.action!r}")
        if not self.host or (self.path and not self.path.startswith("/")):
            raise ValueError(f"malformed rule {self.host!r} {self.path!r}")

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass
class _Node:
    children: dict[str, "_Node"] = field(default_factory=dict)
    #: Rules whose last, possibly partial, path segment hangs here, by that segment; and the segments' lengths, longest first.
    ends: dict[str, UrlRule] = field(default_factory=dict)
    lengths: list[int] = field(default_factory=list)
    #: Root of the path trie of a host; only on host nodes.
    paths: "_Node | None" = None
    #: A rule with an empty path, which fits every path.
    whole: UrlRule | None = None


def _stronger(old: UrlRule | None, new: UrlRule) -> UrlRule:
    """Of two rules with the same host and path, block wins."""
    return new if old is None or new.action == "block" else old


class HostPathTrie:
    """Longest match: the most host labels first, then the longest path."""

    def __init__(self, rules: list[UrlRule]) -> None:
        self.root = _Node()
        best: dict[tuple[str, str], UrlRule] = {}
        for r in rules:
            key = (ascii_lowered(r.host), r.path)
            best[key] = _stronger(best.get(key), UrlRule(r.action, *key))
        for r in best.values():
            node = self.root
            for label in reversed(r.host.split(".")):
                node = node.children.setdefault(label, _Node())
            node.paths = node.paths or _Node()
            if not r.path:
                node.paths.whole = r
                continue
            at, segments = node.paths, r.path.split("/")
            for segment in segments[:-1]:
                at = at.children.setdefault(segment, _Node())
            at.ends[segments[-1]] = r
        self._measure(self.root)

    def _measure(self, root: "_Node") -> None:
        held = [root]
        while held:
            node = held.pop()
            node.lengths = sorted({len(x) for x in node.ends}, reverse=True)
            held += [*node.children.values(), *([node.paths] if node.paths else [])]

    def find(self, host: str, path: str) -> UrlRule | None:
        node, found = self.root, []
        for label in reversed(host.split(".")):
            node = node.children.get(label)
            if node is None:
                break
            if node.paths is not None:
                found.append(node.paths)
        for paths in reversed(found):
            if (rule := self._path(paths, path)) is not None:
                return rule
        return None

    @staticmethod
    def _path(node: _Node, path: str) -> UrlRule | None:
        best, segments = node.whole, path.split("/") if path else []
        for segment in segments:
            # A rule that ends here is longer than any that ended before, and the longest one counts.
            for length in node.lengths:
                if length <= len(segment) and (rule := node.ends.get(segment[:length])) is not None:
                    best = rule
                    break
            node = node.children.get(segment)
            if node is None:
                break
        return best


_LOWER = {c: c + 32 for c in range(65, 91)}


def ascii_lowered(text: str) -> str:
    return text.translate(_LOWER)


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path by position alone: both empty for null or without ``://``."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    for mark in "?#":
        if (cut := rest.find(mark)) >= 0:
            rest = rest[:cut]
    slash = rest.find("/")
    host, path = (rest, "") if slash < 0 else (rest[:slash], rest[slash:])
    return ascii_lowered(host), path


def judge_urls(pages: DataFrame, rules: list[UrlRule], default: str = "allow", url: str = "url") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``.

    Every row comes back once, repeated rows too. A null URL or one without
    ``://`` has an empty host and path, fits no rule and gets ``default``.
    Columns of the input named like the four new ones are replaced. An empty
    table gives an empty result; no rules give ``default`` everywhere.

    The trie is broadcast while there are no more than
    ``MAX_BROADCAST_RULES``; beyond that a join on host suffix and complete
    path segments finds the same rule.
    """
    if default not in ("allow", "block"):
        raise ValueError(f"unknown verdict {default!r}")
    if len(rules) > MAX_BROADCAST_RULES:
        return _judge_by_join(pages, rules, default, url)
    trie = pages.sparkSession.sparkContext.broadcast(HostPathTrie(rules))

    @F.pandas_udf("host string, path string, rule string, verdict string")
    def judged(urls: pd.Series) -> pd.DataFrame:
        rows = []
        for value in urls:
            host, path = split_url(value)
            rule = trie.value.find(host, path) if host else None
            rows.append((host, path, rule.text if rule else None, rule.action if rule else default))
        return pd.DataFrame(rows, columns=["host", "path", "rule", "verdict"])

    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    wanted = pages.select(*(pages[f"`{c}`"] for c in kept), judged(pages[f"`{url}`"]).alias("__judged"))
    return wanted.select(*(f"`{c}`" for c in kept), "__judged.*")


def _judge_by_join(pages: DataFrame, rules: list[UrlRule], default: str, url: str) -> DataFrame:
    """The same verdicts from a join, for rule lists too large to ship."""
    spark = pages.sparkSession
    best: dict[tuple[str, str], UrlRule] = {}
    for r in rules:
        key = (ascii_lowered(r.host), r.path)
        best[key] = _stronger(best.get(key), UrlRule(r.action, *key))
    listed = spark.createDataFrame([(r.host, r.path, r.path[: r.path.rfind("/") + 1], r.text, r.action) for r in best.values()], "r_host string, r_path string, r_whole string, r_text string, r_action string")
    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]

    @F.pandas_udf("host string, path string")
    def parts(urls: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([split_url(u) for u in urls], columns=["host", "path"])

    rows = pages.select(*(pages[f"`{c}`"] for c in kept), parts(pages[f"`{url}`"]).alias("__p"))
    urls = rows.select("__p.*").where("host <> ''").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))
    pieces = F.split("path", "/")
    wholes = F.transform(F.sequence(F.lit(0), F.size(pieces) - 1), lambda i: F.when(i == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(pieces, 1, i), "/"), F.lit("/"))))
    keys = urls.select("host", "path", F.explode(suffixes).alias("r_host"), F.array_distinct(wholes).alias("w")).select("host", "path", "r_host", F.explode("w").alias("r_whole"))
    hits = keys.join(listed, ["r_host", "r_whole"]).where(F.col("path").startswith(F.col("r_path")))
    top = hits.groupBy("host", "path").agg(F.max(F.struct(F.size(F.split("r_host", r"\.")).alias("n"), F.length("r_path").alias("l"), "r_text", "r_action")).alias("t"))
    joined = rows.select(*(f"`{c}`" for c in kept), F.col("__p.host").alias("host"), F.col("__p.path").alias("path")).join(top, ["host", "path"], "left")
    return joined.select(*(f"`{c}`" for c in kept), "host", "path", F.col("t.r_text").alias("rule"), F.coalesce("t.r_action", F.lit(default)).alias("verdict"))
