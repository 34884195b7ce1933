"""Tables of a time, tags and fields: roles, types, and how schemas grow."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, DecimalType, DoubleType, LongType, StringType, StructField, StructType

#: Name of the one reserved column: nanoseconds since the epoch.
TIME = "time"
#: Order of arrival: commit number and row number within it. Not part of a table's own columns.
SEQ = "_seq"
#: The tag that row visibility reads.
VISIBILITY = "_visibility"
UINT = DecimalType(20, 0)


class SchemaError(ValueError):
    """A write or a definition contradicts a table's schema."""


#: Names of declared types.
ALIASES: dict[str, DataType] = {
    **dict.fromkeys(("float", "f64", "double"), DoubleType()),
    **dict.fromkeys(("int", "integer", "i64", "long"), LongType()),
    **dict.fromkeys(("uint", "u64", "unsigned"), UINT),
    **dict.fromkeys(("bool", "boolean"), BooleanType()),
    **dict.fromkeys(("string", "str", "text", "utf8"), StringType()),
}
FIELD_TYPES = (DoubleType(), LongType(), UINT, BooleanType(), StringType())


@dataclass(frozen=True)
class TableDef:
    """Column names by role, in the order they were first seen. ``declared`` tables take no others."""

    name: str
    tags: tuple[str, ...] = ()
    fields: tuple[tuple[str, DataType], ...] = ()
    declared: bool = False

    @property
    def key(self) -> list[str]:
        """Primary key: time and every tag."""
        return [TIME, *self.tags]

    @property
    def columns(self) -> list[str]:
        return [TIME, *self.tags, *(n for n, _ in self.fields)]

    @property
    def schema(self) -> StructType:
        return StructType(
            [
                StructField(TIME, LongType(), False, {"role": "time"}),
                *(StructField(t, StringType(), True, {"role": "tag"}) for t in self.tags),
                *(StructField(n, t, True, {"role": "field"}) for n, t in self.fields),
            ]
        )

    @property
    def field_types(self) -> dict[str, DataType]:
        return dict(self.fields)

    def merge(self, tags: tuple[str, ...], fields: dict[str, DataType]) -> TableDef:
        """This table after a write with these columns.

        New columns are added. Integers written to a float field become
        floats; any other difference is an error that names the field. A
        declared table takes no new column and no other type at all.
        """
        known = self.field_types
        for tag in tags:
            if tag in known:
                raise SchemaError(f"{tag!r} is a field of {self.name!r}, not a tag")
            if self.declared and tag not in self.tags:
                raise SchemaError(f"table {self.name!r} has no tag {tag!r}")
        for name, kind in fields.items():
            if name in self.tags:
                raise SchemaError(f"{name!r} is a tag of {self.name!r}, not a field")
            if name not in known:
                if self.declared:
                    raise SchemaError(f"table {self.name!r} has no field {name!r}")
            elif kind != known[name] and (self.declared or not widens(kind, known[name])):
                raise SchemaError(f"field {name!r} of {self.name!r} is {known[name].simpleString()}, not {kind.simpleString()}")
        return replace(self, tags=(*self.tags, *(t for t in tags if t not in self.tags)), fields=(*self.fields, *((n, t) for n, t in fields.items() if n not in known)))

    def conform(self, df: DataFrame) -> DataFrame:
        """``df`` with exactly this table's columns: missing ones null, integers cast to float fields."""
        have = set(df.columns)
        extra = [c for c in (SEQ,) if c in have]
        cols = [F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema]
        return df.select(*cols, *extra)

    def empty(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([], self.schema)


def widens(written: DataType, stored: DataType) -> bool:
    return isinstance(stored, DoubleType) and written in (LongType(), UINT)


def declare(name: str, columns: list[dict]) -> TableDef:
    """A declared table from ``{"name", "type", "tag"}`` entries; time is implied."""
    seen, tags, fields = set(), [], []
    for c in columns:
        column, kind = c["name"], c.get("type", "string")
        if not column or column == TIME:
            raise SchemaError("time is implied and names must not be empty")
        if column in seen:
            raise SchemaError(f"column {column!r} is declared twice")
        if kind not in ALIASES:
            raise SchemaError(f"unknown type {kind!r} of {column!r}")
        seen.add(column)
        if c.get("tag"):
            if ALIASES[kind] != StringType():
                raise SchemaError(f"tag {column!r} must be a string")
            tags.append(column)
        else:
            fields.append((column, ALIASES[kind]))
    if not fields:
        raise SchemaError("a table needs a field")
    return TableDef(name, tuple(tags), tuple(fields), True)


def schema_union(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames under one schema: columns in the order first seen, missing ones null.

    A column with two types is an error that names it, rather than a failure
    inside a file reader.
    """
    if not frames:
        raise SchemaError("nothing to unite")
    kinds: dict[str, DataType] = {}
    for df in frames:
        for f in df.schema:
            if kinds.setdefault(f.name, f.dataType) != f.dataType:
                raise SchemaError(f"column {f.name!r} is {kinds[f.name].simpleString()} in one part and {f.dataType.simpleString()} in another")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def table_of(df: DataFrame, name: str) -> TableDef:
    """The table that a DataFrame's roles describe: strings are tags and others fields, unless metadata ``role`` says otherwise."""
    tags, fields = [], []
    for f in df.schema:
        if f.name == TIME:
            continue
        role = (f.metadata or {}).get("role", "tag" if f.dataType == StringType() else "field")
        if role == "tag":
            if f.dataType != StringType():
                raise SchemaError(f"tag {f.name!r} must be a string")
            tags.append(f.name)
        elif role == "field":
            if f.dataType not in FIELD_TYPES:
                raise SchemaError(f"field {f.name!r} has the unsupported type {f.dataType.simpleString()}")
            fields.append((f.name, f.dataType))
        else:
            raise SchemaError(f"unknown role {role!r} of {f.name!r}")
    return TableDef(name, tuple(tags), tuple(fields))


@dataclass
class Schemas:
    """Tables of one database by name."""

    tables: dict[str, TableDef] = field(default_factory=dict)

    def after(self, name: str, tags: tuple[str, ...], fields: dict[str, DataType]) -> TableDef:
        return self.tables.get(name, TableDef(name)).merge(tags, fields)
