"""Applying a stream of inserts, updates and deletes with an embedded database per bucket.

The state of a key is (upsert stamp, delete stamp, and for each cell its value and stamp); two
states merge by taking the greater of each part. Operations are folded to states where they
are read, a bounded number of rows at a time, so that a hot key leaves each map task as a few
rows. The states are then spread over buckets by the hash of the whole key, and each bucket that
they touch is built by a DuckDB inside its task: first the rows stored so far, then the new states
by conflicting inserts, a bounded number at a time, which update a row only where the new
stamp, or at equal stamps the new value, is greater. Deletes stay as tombstones, so operations
that come late find them. The buckets' results, and the buckets that weren't touched, become the next
version of the table at once.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomfold.session import mounted, shared_folder, ship
from loomfold.sources import bucketed
from loomfold.sources.bucketed import BUCKET
from loomfold.sources.versioned import Version, VersionedTable

#: Rows and bytes of operations that are folded at a time where they are read.
FOLD_ROWS, FOLD_BYTES = 200_000, 64 << 20
#: Rows and bytes of states that one upsert takes; bounds the memory of a task besides its bucket.
STATEMENT_ROWS, STATEMENT_BYTES = 20_000, 16 << 20
#: Memory that one embedded database may take; beyond it the database spills.
MEMORY = "400MB"

_SQL = {"string": "VARCHAR", "bigint": "BIGINT", "binary": "BLOB"}


@dataclass(frozen=True)
class Shape:
    """Key and value columns of the table with their Spark types (string, bigint, binary)."""

    key: tuple[tuple[str, str], ...]
    cells: tuple[tuple[str, str], ...]

    @property
    def schema(self) -> T.StructType:
        kinds = {"string": T.StringType(), "bigint": T.LongType(), "binary": T.BinaryType()}
        out = [T.StructField(c, kinds[t]) for c, t in self.key] + [T.StructField(c, T.LongType()) for c in ("upsert_ts", "delete_ts")]
        for c, t in self.cells:
            out += [T.StructField(f"{c}_ts", T.LongType()), T.StructField(c, kinds[t])]
        return T.StructType(out)

    @property
    def keys(self) -> str:
        return ", ".join(f'"{c}"' for c, _ in self.key)

    def merge_select(self, source: str) -> str:
        """States merged by key. A value ranks by stamp, then presence, then itself."""
        cells = "".join(f', max({{t: "{c}_ts", p: "{c}" IS NOT NULL, v: "{c}"}}) AS "_{c}"' for c, _ in self.cells)
        out = "".join(f', "_{c}".t AS "{c}_ts", "_{c}".v AS "{c}"' for c, _ in self.cells)
        return f"SELECT {self.keys}, upsert_ts, delete_ts{out} FROM (SELECT {self.keys}, max(upsert_ts) AS upsert_ts, max(delete_ts) AS delete_ts{cells} FROM {source} GROUP BY {self.keys})"

    @property
    def create(self) -> str:
        key = ", ".join(f'"{c}" {_SQL[t]}' for c, t in self.key)
        cells = "".join(f', "{c}_ts" BIGINT, "{c}" {_SQL[t]}' for c, t in self.cells)
        return f"CREATE TABLE state ({key}, upsert_ts BIGINT, delete_ts BIGINT{cells}, PRIMARY KEY ({self.keys}))"

    @property
    def upsert(self) -> str:
        better = {c: f'(excluded."{c}_ts" > state."{c}_ts" OR excluded."{c}_ts" = state."{c}_ts" AND excluded."{c}" IS NOT NULL AND (state."{c}" IS NULL OR excluded."{c}" > state."{c}"))' for c, _ in self.cells}
        sets = ["upsert_ts = greatest(state.upsert_ts, excluded.upsert_ts)", "delete_ts = greatest(state.delete_ts, excluded.delete_ts)"]
        for c, b in better.items():
            sets += [f'"{c}_ts" = greatest(state."{c}_ts", excluded."{c}_ts")', f'"{c}" = CASE WHEN {b} THEN excluded."{c}" ELSE state."{c}" END']
        when = " OR ".join(["excluded.upsert_ts > state.upsert_ts", "excluded.delete_ts > state.delete_ts", *better.values()])
        return f"INSERT INTO state {self.merge_select('incoming')} ON CONFLICT ({self.keys}) DO UPDATE SET {', '.join(sets)} WHERE {when}"


def _connect(spill: str | None = None):
    import duckdb

    con = duckdb.connect(":memory:")
    con.execute(f"SET threads = 1; SET memory_limit = '{MEMORY}'; SET preserve_insertion_order = false")
    con.execute("SET temp_directory = ?", [spill or ""])
    return con


def _chunks(batches: Iterator[pa.RecordBatch], rows: int, size: int) -> Iterator[pa.Table]:
    held, n, b = [], 0, 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n, b = n + batch.num_rows, b + batch.nbytes
        if n >= rows or b >= size:
            yield pa.Table.from_batches(held)
            held, n, b = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)


def _batches(table: pa.Table, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    yield from table.cast(schema).to_batches(max_chunksize=10_000)


def _prefold(shape: Shape, rows: int):
    from pyspark.sql.pandas.types import to_arrow_schema

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con, schema = _connect(), to_arrow_schema(shape.schema)
        for incoming in _chunks(batches, rows, FOLD_BYTES):
            con.register("incoming", incoming)
            yield from _batches(con.sql(shape.merge_select("incoming")).to_arrow_table(), schema)
            con.unregister("incoming")
        con.close()

    return fold


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, pa.RecordBatch]]:
    """(bucket, whether new, rows) of a stream that is in this order; the last two columns say which."""
    for b in batches:
        bucket, new = b.column(b.num_columns - 2), b.column(b.num_columns - 1)
        at = 0
        while at < b.num_rows:
            end, of = at, (bucket[at].as_py(), new[at].as_py())
            if (bucket[b.num_rows - 1].as_py(), new[b.num_rows - 1].as_py()) == of:
                end = b.num_rows
            else:
                while (bucket[end].as_py(), new[end].as_py()) == of:
                    end += 1
            yield *of, b.slice(at, end - at).select(range(b.num_columns - 2))
            at = end


def _build(shape: Shape, rows: int, spill: str | None):
    """Buckets, each from its stored rows and then its new states; a task that has several builds them one after the other."""
    from pyspark.sql.pandas.types import to_arrow_schema

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = f"{spill}/{uuid.uuid4().hex}" if spill else None
        if own:
            os.makedirs(own)
        con, schema = _connect(own), to_arrow_schema(shape.schema)
        try:
            for bucket, spans in groupby(_spans(batches), key=itemgetter(0)):
                con.execute(shape.create)
                for new, part in groupby(spans, key=itemgetter(1)):
                    for incoming in _chunks((x[2] for x in part), rows, STATEMENT_BYTES):
                        con.register("incoming", incoming)
                        con.execute(shape.upsert if new else "INSERT INTO state FROM incoming")
                        con.unregister("incoming")
                for batch in con.sql("FROM state").to_arrow_reader(10_000):
                    for b in _batches(pa.Table.from_batches([batch]), schema):
                        yield pa.RecordBatch.from_arrays([*b.columns, pa.array([bucket] * b.num_rows, pa.int32())], [*schema.names, BUCKET])
                con.execute("DROP TABLE state")
        finally:
            con.close()
            if own:
                shutil.rmtree(own, ignore_errors=True)

    return build


def effective(ops: DataFrame, shape: Shape) -> DataFrame:
    """Operations as states. Those with a null key part or without a stamp of at least 1 do nothing.

    ``ops`` has the key and value columns, ``kind`` (any spelling that begins with u or d once
    trimmed, other kinds do nothing), ``ts`` and ``<cell>_set`` flags, of which null is false.
    Flags of deletes are ignored.
    """
    first = F.lower(F.substring(F.trim("kind"), 1, 1))
    real: Column = (F.col("ts") >= 1) & first.isin("u", "d")
    for c, _ in shape.key:
        real = real & F.col(c).isNotNull()
    up = first == "u"
    columns = [*[F.col(c) for c, _ in shape.key], F.when(up, F.col("ts")).otherwise(0).alias("upsert_ts"), F.when(up, 0).otherwise(F.col("ts")).cast("bigint").alias("delete_ts")]
    for c, _ in shape.cells:
        on = up & F.coalesce(F.col(f"{c}_set"), F.lit(False))
        columns += [F.when(on, F.col("ts")).otherwise(0).alias(f"{c}_ts"), F.when(on, F.col(c)).alias(c)]
    return ops.where(real).select(*columns)


def apply(spark: SparkSession, ops: DataFrame, target: VersionedTable, shape: Shape, buckets: int | None = None) -> Version:
    """Merge ``ops`` into ``target`` and publish the next version.

    An op that was applied before, or comes late, changes nothing it shouldn't. ``ops`` is read
    once; only buckets that it touches are read and rewritten. ``buckets`` sets their number for
    a new table, which is else planned by bytes. Where the shared folder is mounted a bucket that
    is larger than planned spills there.
    """
    ship(spark)
    base = target.current()
    folded = bucketed.staged(spark, effective(ops, shape).mapInArrow(_prefold(shape, FOLD_ROWS), shape.schema))
    plan = bucketed.plan(target, base, folded, [c for c, _ in shape.key], buckets)
    rows = plan.incoming.withColumn("_new", F.lit(True))
    if plan.stored is not None:
        rows = plan.stored.withColumn("_new", F.lit(False)).unionByName(rows)
    placed = rows.repartitionById(plan.tasks, F.pmod(BUCKET, F.lit(plan.tasks)))
    if plan.stored is not None or not plan.exact:
        placed = placed.sortWithinPartitions(BUCKET, "_new")
    out = T.StructType([*shape.schema, T.StructField(BUCKET, T.IntegerType())])
    built = placed.mapInArrow(_build(shape, STATEMENT_ROWS, mounted(f"{shared_folder(spark)}/spill")), out)
    return bucketed.publish(target, base, plan, built)


def live(state: DataFrame, shape: Shape) -> DataFrame:
    """Current rows: alive if the upsert stamp isn't below the delete stamp; cells older than the delete are null."""
    alive = state.where("upsert_ts >= 1 AND upsert_ts >= delete_ts")
    out = [*[F.col(c) for c, _ in shape.key], "upsert_ts", F.expr("nullif(delete_ts, 0)").alias("delete_ts")]
    for c, _ in shape.cells:
        kept = (F.col(f"{c}_ts") >= F.greatest("delete_ts", F.lit(1))) & F.col(c).isNotNull()
        out += [F.when(kept, F.col(c)).alias(c), F.when(kept, F.col(f"{c}_ts")).alias(f"{c}_ts")]
    return alive.select(*out)


def cells(rows: DataFrame, shape: Shape) -> DataFrame:
    """A line (key..., cell, ts) 'row' for each live row and one for each of its non-null cells."""
    lines = [F.struct(F.lit("row").alias("cell"), F.col("upsert_ts").alias("ts"))]
    lines += [F.struct(F.lit(c).alias("cell"), F.when(F.col(c).isNotNull(), F.col(f"{c}_ts")).alias("ts")) for c, _ in shape.cells]
    keys = [c for c, _ in shape.key]
    return rows.select(*keys, F.explode(F.array(*lines)).alias("_l")).select(*keys, "_l.cell", "_l.ts").where("ts IS NOT NULL")


#: The table of row_ops.
ROW_OPS = Shape((("k0", "string"), ("k1", "bigint")), (("body", "string"), ("n", "bigint"), ("who", "binary")))
