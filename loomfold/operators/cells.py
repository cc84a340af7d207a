"""The merge without a schema: cells in long form, for tables and columns nobody declared.

Long operations have ``table_id``, ``pk`` (any one column), ``kind``, ``ts`` and ``cells``, an
array of (column_id, value). A value has one field for each way of ordering, of which the
column's type sets one: ``i`` for I64, ``t`` for Text, ``b`` for Bytes and Uuid. An explicit
null sets none, and so ranks lowest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomfold.schema import Table

VALUE = "struct<i:bigint,t:string,b:binary>"
CELLS = f"array<struct<column_id:int,value:{VALUE}>>"
FIELD = {"i64": "i", "text": "t", "bytes": "b", "uuid": "b"}
#: Stands for the row itself among the column ids, which are 0 to 255.
ROW = -1


def explode(ops: DataFrame) -> DataFrame:
    """(table_id, pk, column_id, kind, ts, value): a row for each cell and one for the row itself."""
    marks = F.array(F.struct(F.lit(ROW).alias("column_id"), F.lit(None).cast(VALUE).alias("value")))
    own = F.transform(F.coalesce("cells", F.array().cast(CELLS)), lambda c: F.struct(c["column_id"].alias("column_id"), c["value"].alias("value")))
    both = F.concat(marks, F.when(F.col("kind") == "U", own).otherwise(F.array().cast(CELLS)))
    return ops.where("ts >= 1 AND pk IS NOT NULL").select("table_id", "pk", "kind", "ts", F.explode(both).alias("_c")).select("table_id", "pk", "_c.column_id", "kind", "ts", "_c.value")


def fold(ops: DataFrame) -> DataFrame:
    """Cells that show: (table_id, pk, column_id, ts, value) of living rows; ROW stands for the row.

    Cells are merged first; the row's stamps then meet them in a window over the merged cells
    of a key, of which there are at most 257, so no join is needed.
    """
    from pyspark.sql import Window

    up = F.col("kind") == "U"
    # Sorting begins with a hash, as keys of several columns, or texts that begin alike, are slow to compare.
    merged = explode(ops).withColumn("_p", F.xxhash64("table_id", "pk")).groupBy("_p", "column_id", "table_id", "pk").agg(F.max(F.when(up, F.struct("ts", "value"))).alias("m"), F.max(F.when(~up, F.col("ts"))).alias("d"))
    w = Window.partitionBy("_p", "table_id", "pk")
    row = F.col("column_id") == ROW
    known = merged.withColumn("_d", F.coalesce(F.max(F.when(row, F.col("d"))).over(w), F.lit(0).cast("bigint"))).withColumn("_u", F.max(F.when(row, F.col("m")["ts"])).over(w))
    shown = known.where((F.col("_u") >= F.col("_d")) & F.col("m").isNotNull() & (row | (F.col("m")["ts"] >= F.col("_d"))))
    return shown.select("table_id", "pk", "column_id", F.col("m")["ts"].alias("ts"), F.col("m")["value"].alias("value"))


def pivot(cells: DataFrame, table: Table) -> DataFrame:
    """Rows of one declared table from the folded cells; unknown columns are left out."""
    own = cells.where(F.col("table_id") == table.table_id)
    out = [F.max(F.when(F.col("column_id") == f.column_id, F.col("value")[FIELD[f.kind]])).alias(f.name) for f in table.values]
    return own.groupBy("pk").agg(*out, F.max(F.col("column_id") == ROW).alias("_row")).where("_row").drop("_row")


def widen(ops: DataFrame, table: Table, keys: list[str], as_json: bool = False) -> DataFrame:
    """Wide operations as long ones; ``pk`` is a struct of the key columns, or its JSON where tables with other keys join in."""
    value = lambda f: F.struct(*[(F.col(f.name) if FIELD[f.kind] == x else F.lit(None)).cast(k).alias(x) for x, k in (("i", "bigint"), ("t", "string"), ("b", "binary"))])
    items = [F.when(F.coalesce(F.col(f"{f.name}_set"), F.lit(False)), F.struct(F.lit(f.column_id).alias("column_id"), value(f).alias("value"))) for f in table.values]
    cells = F.filter(F.array(*items), lambda c: c.isNotNull()) if items else F.array().cast(CELLS)
    return ops.select(F.lit(table.table_id).alias("table_id"), (F.to_json(F.struct(*keys)) if as_json else F.struct(*keys)).alias("pk"), "kind", "ts", cells.alias("cells"))


def as_text(value: Column) -> Column:
    """A value for people to read; null if it is an explicit null."""
    return F.coalesce(value["i"].cast("string"), value["t"], F.hex(value["b"]))
