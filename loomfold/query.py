"""Typed reads and writes over declared tables, and raw SQL over their views."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomfold.operators import feed, fold
from loomfold.schema import Catalog, SchemaError, Table, reconcile
from loomfold.schema import table as declare

#: Parsed commands that only describe, by the name of their plan, and kinds of plans that aren't plain queries.
DESCRIBING = ("DescribeRelation", "DescribeRelationJson", "DescribeColumn", "DescribeTableCommand", "DescribeQueryCommand", "DescribeFunction", "DescribeFunctionCommand", "DescribeNamespace", "ShowTables", "ShowTablesCommand", "ShowColumns", "ShowColumnsCommand", "ShowFunctions", "ShowFunctionsCommand", "ShowViews", "ShowNamespaces", "ShowTableProperties", "ShowPartitions", "ShowCreateTable")
NO_QUERY = ("Command", "ParsedStatement", "CompoundPlanStatement", "InsertIntoDir", "Call")


class CardinalityError(LookupError):
    """Another number of rows than asked for."""


def bind(value: Any) -> Any:
    """A value that can be bound: integers that fit, text, bytes, uuids, booleans as integers, null. Floats aren't."""
    if value is None or isinstance(value, (str, bytes)):
        return value
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, int):
        if not -(2**63) <= value < 2**63:
            raise ValueError("an integer that doesn't fit in 64 bits")
        return value
    if isinstance(value, bytearray):
        return bytes(value)
    if isinstance(value, uuid.UUID):
        return value.bytes
    raise TypeError(f"{type(value).__name__} can't be bound")


def reads(spark: SparkSession, text: str) -> bool:
    """Whether a statement only reads, by its parsed plan: nowhere in it a command, a write or a script, but for descriptions.

    Text that can't be parsed raises the parser's error; nothing is run either way.
    """
    load = spark._jvm.org.apache.spark.util.Utils.classForName
    kind = lambda name: load(f"org.apache.spark.sql.catalyst.plans.logical.{name}", True, False)
    logical, others = kind("LogicalPlan"), [kind(n) for n in NO_QUERY]

    def sound(plan) -> bool:
        name = plan.getClass().getSimpleName()
        if name == "ExplainCommand":
            return sound(plan.logicalPlan())
        if "ExecuteImmediate" in name or name not in DESCRIBING and any(k.isInstance(plan) for k in others):
            return False
        below = [x.apply(i) for x in (plan.children(), plan.innerChildren()) for i in range(x.size())]
        return all(sound(x) for x in below if logical.isInstance(x))

    return sound(spark._jsparkSession.sessionState().sqlParser().parsePlan(text))


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def check_value(kind: str, value: Any) -> Any:
    """A value as the column type holds it, or an error; null is for the caller to allow."""
    value = bind(value)
    fits = {"i64": int, "text": str, "bytes": bytes, "uuid": bytes}[kind]
    if not isinstance(value, fits):
        raise TypeError(f"{kind} can't hold {type(value).__name__}")
    if kind == "uuid" and len(value) != 16:
        raise ValueError("a uuid has 16 bytes")
    if kind == "text" and "\0" in value:
        raise ValueError("text must not contain NUL")
    return value


@dataclass
class Upsert:
    """Sets some columns of a row; those that aren't named stay as they are."""

    table: Table
    key: tuple
    values: dict[str, Any]

    def set(self, **values: Any) -> Upsert:
        kinds = {f.name: f.kind for f in self.table.values}
        for name, v in values.items():
            if name not in kinds:
                raise SchemaError(f"{self.table.name} has no column {name}")
            if name in self.values:
                raise ValueError(f"{name} is named twice")
            self.values[name] = None if v is None else check_value(kinds[name], v)
        return self

    def null(self, *names: str) -> Upsert:
        return self.set(**dict.fromkeys(names))


@dataclass
class Delete:
    table: Table
    key: tuple


def _key(table: Table, key: tuple) -> tuple:
    if len(key) != len(table.key):
        raise ValueError(f"{table.name} has {len(table.key)} key columns")
    return tuple(check_value(f.kind, v) for f, v in zip(table.key, key))


def upsert(table: Table, *key: Any) -> Upsert:
    return Upsert(table, _key(table, key), {})


def delete(table: Table, *key: Any) -> Delete:
    return Delete(table, _key(table, key))


def ops_schema(table: Table) -> T.StructType:
    out = [T.StructField("_seq", T.LongType()), *[T.StructField(f.name, f.spark) for f in table.key], T.StructField("kind", T.StringType()), T.StructField("ts", T.LongType())]
    for f in table.values:
        out += [T.StructField(f"{f.name}_set", T.BooleanType()), T.StructField(f.name, f.spark)]
    return T.StructType(out)


def ops_frame(spark: SparkSession, table: Table, ops: list[tuple[int, Upsert | Delete]]) -> DataFrame:
    """Stamped operations as a wide DataFrame, their order of arrival in ``_seq``."""
    rows = []
    for seq, (ts, op) in enumerate(ops):
        row = [seq, *op.key, "U" if isinstance(op, Upsert) else "D", ts]
        for f in table.values:
            named = isinstance(op, Upsert) and f.name in op.values
            row += [named, op.values[f.name] if named else None]
        rows.append(tuple(row))
    return spark.createDataFrame(rows, ops_schema(table))


class Store:
    """Declared tables over DataFrames of their operations; each is a temp view of its live rows."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: dict[str, Table] = {}
        self.views: dict[str, DataFrame] = {}

    def register(self, table: Table, ops: DataFrame) -> DataFrame:
        Catalog([*[t for t in self.tables.values() if t.name != table.name], table])
        view = fold.fold(ops, table)
        return self._add(table, view)

    def register_physical(self, table: Table, stored: DataFrame) -> DataFrame:
        """A table from its stored physical rows, if their schema fits; value columns that are missing are null."""
        faults = [f for f in reconcile(table, stored.schema) if "may be null" not in f]
        if faults:
            raise SchemaError("; ".join(faults))
        have = set(stored.columns)
        rows = stored.where("upsert_ts >= deleted_ts AND upsert_ts >= 1")
        return self._add(table, rows.select(*table.keys, *[F.col(f.name) if f.name in have else F.lit(None).cast(f.spark).alias(f.name) for f in table.values]))

    def _add(self, table: Table, view: DataFrame) -> DataFrame:
        self.tables[table.name], self.views[table.name] = table, view
        view.createOrReplaceTempView(table.name)
        return view

    def describe(self, name: str) -> list[tuple[str, str, int | None]]:
        """(column, type, place in the key) of a table."""
        t = self.tables[name]
        return [(f.name, f.kind, i) for i, f in enumerate(t.key)] + [(f.name, f.kind, None) for f in t.values]

    def get(self, name: str, *key: Any) -> DataFrame:
        """The row of a key, or none. The key's filter reaches below the merge, down to the scan."""
        t, out = self.tables[name], self.views[name]
        for f, v in zip(t.key, _key(t, key)):
            out = out.where(F.col(f.name) == F.lit(v))
        return out.limit(1)

    def get_all(self, name: str) -> DataFrame:
        return self.views[name]

    def query(self, name: str, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Filters, order, offset and limit put on a table's view; its columns stay."""
        view = self.views[name]
        return build(view).select(*view.columns)

    def sql(self, text: str, *args: Any) -> DataFrame:
        """Any statement that only reads, with positional arguments; nothing is run before that is certain."""
        if not reads(self.spark, text):
            raise PermissionError("only statements that read are allowed")
        return self.spark.sql(text, args=[bind(a) for a in args]) if args else self.spark.sql(text)


class Domain:
    """Tables declared in one place, each with its reads, writes and events.

    ``Domain(spark, {"notes": (5, {"k": "i64"}, {"a": "text"})})`` gives ``domain.notes`` with get, all,
    query, upsert, delete and watch. ``load`` says what operations the tables are made of.
    """

    def __init__(self, spark: SparkSession, tables: dict[str, tuple]):
        self.store = Store(spark)
        self.catalog = Catalog([declare(name, *spec) for name, spec in tables.items()])
        self.ops: dict[str, DataFrame] = {}
        for t in self.catalog.by_name.values():
            setattr(self, t.name, Accessor(self, t))

    def load(self, **ops: DataFrame) -> Domain:
        for name, df in ops.items():
            self.ops[name] = df
            self.store.register(self.catalog.by_name[name], df)
        return self

    def write(self, *stamped: tuple[int, Upsert | Delete]) -> Domain:
        """Add stamped operations, of any of the tables, after those that there are."""
        for name in dict.fromkeys(op.table.name for _, op in stamped):
            t = self.catalog.by_name[name]
            new = ops_frame(self.store.spark, t, [(ts, op) for ts, op in stamped if op.table.name == name])
            had = self.ops.get(name)
            after = 0 if had is None else (had.agg(F.max("_seq")).first()[0] or 0) + 1
            new = new.withColumn("_seq", F.col("_seq") + after)
            self.load(**{name: new if had is None else had.unionByName(new, allowMissingColumns=True)})
        return self


@dataclass
class Accessor:
    """The reads, writes and events of one table of a domain."""

    domain: Domain
    table: Table

    def get(self, *key: Any) -> Row | None:
        return one(self.domain.store.get(self.table.name, *key))

    def all(self) -> DataFrame:
        return self.domain.store.get_all(self.table.name)

    def query(self, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
        return self.domain.store.query(self.table.name, build)

    def upsert(self, *key: Any, **values: Any) -> Upsert:
        return upsert(self.table, *key).set(**values)

    def delete(self, *key: Any) -> Delete:
        return delete(self.table, *key)

    def watch(self, **key: Any) -> DataFrame:
        """The events of the table, or of the rows with some key values."""
        return feed.watch(feed.change_feed(self.domain.ops[self.table.name], self.table, "_seq"), **key)


def first(df: DataFrame) -> Row | None:
    return df.first()


def one(df: DataFrame) -> Row | None:
    """The only row, or None if there is none; an error if there are more."""
    rows = df.take(2)
    if len(rows) > 1:
        raise CardinalityError("more than one row")
    return rows[0] if rows else None


def exactly_one(df: DataFrame) -> Row:
    row = one(df)
    if row is None:
        raise CardinalityError("no row")
    return row


def value(row: Row, name: str, kind: str, optional: bool = False) -> Any:
    """A checked column of a row."""
    v = row[name]
    if v is None:
        if not optional:
            raise ValueError(f"{name} is null")
        return None
    return check_value(kind, bytes(v) if isinstance(v, bytearray) else v)
