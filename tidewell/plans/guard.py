"""Read-only SQL: the parsed plan is walked before Spark may run anything.

``spark.sql`` executes commands at once, so the text is parsed first. Only
listed plan nodes pass; what is not known is denied.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession


class GuardError(ValueError):
    """The statement is not a read."""


#: Plan nodes of reading queries.
ALLOWED = frozenset(
    "Aggregate AsOfJoin CTERelationDef CTERelationRef Deduplicate DescribeRelation Distinct Except Expand Filter Generate GlobalLimit InlineTable Intersect Join LateralJoin Limit LocalLimit LocalRelation "
    "LogicalQueryStage OneRowRelation Offset ParallelizedLocalRelation PivotAggregate Pivot Project Range Repartition RepartitionByExpression Sample ShowTables Sort SubqueryAlias Tail Union UnionLoop UnionLoopRef UnresolvedHaving "
    "UnresolvedHint UnresolvedInlineTable UnresolvedOrdinal UnresolvedRelation UnresolvedSubqueryColumnAliases UnresolvedTableValuedFunction UnresolvedWith Unpivot Values Window WithCTE WithWindowDefinition "
    "UnresolvedNamespace UnresolvedTableOrView CurrentNamespace".split()
)
#: Functions that reach outside the query.
DENIED_FUNCTIONS = frozenset("reflect java_method try_reflect read_files input_file_name input_file_block_start input_file_block_length".split())


@dataclass(frozen=True)
class Relation:
    """A table name in the text: its parts and the characters it spans, both ends included."""

    parts: tuple[str, ...]
    start: int
    stop: int
    literals: tuple[str, ...] | None = None


def _seq(scala) -> list:
    return [scala.apply(n) for n in range(scala.size())]


def _parse(spark: SparkSession, sql: str):
    return spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)


def _class(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def _subplans(expression) -> Iterator:
    """Plans within an expression, at any depth."""
    if _class(expression) in ("ScalarSubquery", "Exists", "ListQuery", "InSubquery", "LateralSubquery", "UnresolvedScalarSubquery"):
        if _class(expression) == "InSubquery":
            yield from _subplans(expression.query())
        else:
            yield expression.plan()
    if _class(expression) == "UnresolvedFunction":
        name = _seq(expression.nameParts())[-1].lower()
        if name in DENIED_FUNCTIONS:
            raise GuardError(f"function {name} is not allowed")
    for child in _seq(expression.children().toIndexedSeq()):
        yield from _subplans(child)


def _nodes(plan, hidden: frozenset[str] = frozenset()) -> Iterator[tuple[object, frozenset[str]]]:
    """Each node with the CTE names that hide tables there."""
    if _class(plan) == "UnresolvedWith":
        for pair in _seq(plan.cteRelations().toIndexedSeq()):
            name = pair._1().lower()
            yield from _nodes(pair._2(), hidden | {name} if plan.allowRecursion() else hidden)
            hidden = hidden | {name}
    yield plan, hidden
    for e in _seq(plan.expressions().toIndexedSeq()):
        for sub in _subplans(e):
            yield from _nodes(sub, hidden)
    for child in _seq(plan.children().toIndexedSeq()):
        yield from _nodes(child, hidden)


def check_read_only(spark: SparkSession, sql: str) -> list[Relation]:
    """The relations a statement reads, or ``GuardError``. EXPLAIN is judged by what it explains."""
    plan = _parse(spark, sql)
    if _class(plan) == "ExplainCommand":
        plan = plan.logicalPlan()
    found = []
    for node, hidden in _nodes(plan):
        kind = _class(node)
        if kind not in ALLOWED:
            raise GuardError(f"only queries are allowed, not {kind}")
        if kind == "UnresolvedRelation":
            parts = tuple(_seq(node.multipartIdentifier()))
            if parts[0].lower() in ("parquet", "csv", "json", "orc", "text", "binaryfile", "avro", "delta", "xml") and len(parts) > 1:
                raise GuardError("files cannot be named in a query")
            if len(parts) == 1 and parts[0].lower() in hidden:
                continue
            origin = node.origin()
            found.append(Relation(parts, origin.startIndex().get(), origin.stopIndex().get()))
        if kind == "UnresolvedTableValuedFunction":
            name = _seq(node.name())[-1].lower()
            args = _seq(node.functionArgs().toIndexedSeq())
            if name == "last_cache":
                if len(args) != 1 or _class(args[0]) != "Literal" or args[0].dataType().simpleString() != "string":
                    raise GuardError("last_cache takes one table name as a string")
                origin = node.origin()
                found.append(Relation(("last_cache",), origin.startIndex().get(), origin.stopIndex().get(), (args[0].toString(),)))
            elif name not in ("range", "explode", "posexplode", "explode_outer", "inline", "stack", "sequence", "json_tuple"):
                raise GuardError(f"table function {name} is not allowed")
    return found


def rename_relations(sql: str, relations: list[Relation], name_of: Callable[[Relation], str | None]) -> str:
    """``sql`` with the relations under other names; None leaves one as it is."""
    for r in sorted({(r.start, r.stop): r for r in relations}.values(), key=lambda r: -r.start):
        if (new := name_of(r)) is not None:
            sql = sql[: r.start] + new + sql[r.stop + 1 :]
    return sql
