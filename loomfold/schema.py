"""Declared tables: columns, checks, physical layout."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

#: The four column types, their tags and how Spark holds them.
TAGS = {"bytes": 0, "text": 1, "i64": 2, "uuid": 3}
SPARK = {"bytes": T.BinaryType(), "text": T.StringType(), "i64": T.LongType(), "uuid": T.BinaryType()}


class SchemaError(ValueError):
    """A declaration, or a table that was found, doesn't fit."""


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    index: int = 0

    @property
    def spark(self) -> T.DataType:
        return SPARK[self.kind]

    @property
    def column_id(self) -> int:
        return TAGS[self.kind] << 6 | self.index


@dataclass(frozen=True)
class Table:
    """A declared table: name, index, one to four key columns, up to 64 value columns of each type."""

    name: str
    index: int
    key: tuple[Field, ...]
    values: tuple[Field, ...] = ()

    def __post_init__(self) -> None:
        if not self.name or any(not f.name for f in self.key + self.values):
            raise SchemaError("names must not be empty")
        if not 1 <= len(self.key) <= 4:
            raise SchemaError("a key has one to four columns")
        for f in self.key + self.values:
            if f.kind not in TAGS:
                raise SchemaError(f"unknown type {f.kind}")
        names = [f.name for f in self.key + self.values]
        if len(set(names)) < len(names):
            raise SchemaError("column names repeat")
        if any(not 0 <= f.index < 64 for f in self.values):
            raise SchemaError("a column index lies between 0 and 63")
        ids = [f.column_id for f in self.values]
        if len(set(ids)) < len(ids):
            raise SchemaError("column ids repeat")
        if not 0 <= self.index < 1 << 14 - 2 * len(self.key):
            raise SchemaError("the table index is too large")

    @property
    def table_id(self) -> int:
        out = len(self.key) - 1 << 14 | self.index
        for i, f in enumerate(self.key):
            out |= TAGS[f.kind] << 12 - 2 * i
        return out

    @property
    def keys(self) -> list[str]:
        return [f.name for f in self.key]

    @property
    def struct(self) -> T.StructType:
        """What readers see: keys without nulls, values that may be null."""
        return T.StructType([T.StructField(f.name, f.spark, False) for f in self.key] + [T.StructField(f.name, f.spark) for f in self.values])

    @property
    def physical(self) -> T.StructType:
        """Keys, the two row stamps, and for each value column its stamp."""
        out = [T.StructField(f.name, f.spark, False) for f in self.key] + [T.StructField(c, T.LongType(), False) for c in ("upsert_ts", "deleted_ts")]
        for f in self.values:
            out += [T.StructField(f.name, f.spark), T.StructField(f"{f.name}_lww", T.LongType(), False)]
        return T.StructType(out)


def table(name: str, index: int, key: dict[str, str], values: dict[str, str] | None = None) -> Table:
    """A declaration from dicts of name to type; value columns of a type are numbered in order."""
    count: dict[str, int] = {}
    fields = []
    for n, kind in (values or {}).items():
        fields.append(Field(n, kind, count.get(kind, 0)))
        count[kind] = count.get(kind, 0) + 1
    return Table(name, index, tuple(Field(n, kind) for n, kind in key.items()), tuple(fields))


class Catalog:
    """The tables of a domain; neither ids nor names may repeat."""

    def __init__(self, tables: list[Table]):
        self.by_name = {t.name: t for t in tables}
        self.by_id = {t.table_id: t for t in tables}
        if len(self.by_name) < len(tables):
            raise SchemaError("table names repeat")
        if len(self.by_id) < len(tables):
            raise SchemaError("table ids repeat")


def reconcile(declared: Table, found: T.StructType) -> list[str]:
    """What keeps a stored physical table from being used as ``declared``; empty if nothing does.

    Columns that aren't declared are ignored; declared value columns that are missing can be
    added and are no defect, but half a pair of value and stamp is.
    """
    have = {f.name: f for f in found}
    out = []
    for f in declared.physical.fields:
        pair = f.name.endswith("_lww") or any(f.name == v.name for v in declared.values)
        if f.name not in have:
            partner = f.name[:-4] if f.name.endswith("_lww") else f"{f.name}_lww"
            if not pair or partner in have:
                out.append(f"{f.name} is missing")
        elif have[f.name].dataType != f.dataType:
            out.append(f"{f.name} is {have[f.name].dataType.simpleString()}, not {f.dataType.simpleString()}")
        elif have[f.name].nullable and not f.nullable:
            out.append(f"{f.name} may be null")
    order = [f.name for f in found if f.name in declared.keys]
    if order != [k for k in declared.keys if k in have]:
        out.append("the key columns are in another order")
    return out
