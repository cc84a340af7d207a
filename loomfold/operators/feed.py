"""Which operation, in order of arrival, changed which columns of which row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomfold.operators.fold import admissible
from loomfold.schema import Table


def change_feed(ops: DataFrame, table: Table, order: str = "seq") -> DataFrame:
    """(order, key..., kind, ts, changed) of the operations that took effect.

    ``changed`` names the columns whose value the operation set; a rewrite of the value that
    stands, at its stamp, is named too. An upsert takes effect if it is the first on its key,
    or isn't older than the greatest delete and raises the upsert stamp or any cell; a delete
    if it is the first or newer than the greatest delete.
    """
    before = Window.partitionBy(*table.keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    up = F.col("kind") == "U"
    zero = F.lit(0).cast("bigint")
    cols = {"_first": F.count(F.lit(1)).over(before) == 0, "_d": F.coalesce(F.max(F.when(~up, F.col("ts"))).over(before), zero), "_u": F.coalesce(F.max(F.when(up, F.col("ts"))).over(before), zero)}
    for f in table.values:
        mine = F.when(up & F.coalesce(F.col(f"{f.name}_set"), F.lit(False)), F.struct(F.col("ts").alias("t"), F.col(f.name).alias("v")))
        none = F.struct(zero.alias("t"), F.lit(None).cast(f.spark).alias("v"))
        cols[f"_new_{f.name}"] = mine
        cols[f"_old_{f.name}"] = F.coalesce(F.max(mine).over(before), none)
    known = admissible(ops, table).withColumns(cols)
    raised = F.col("ts") > F.col("_u")
    for f in table.values:
        raised = raised | F.coalesce(F.col(f"_new_{f.name}") > F.col(f"_old_{f.name}"), F.lit(False))
    effect = F.when(up, F.col("_first") | ((F.col("ts") >= F.col("_d")) & raised)).otherwise(F.col("_first") | (F.col("ts") > F.col("_d")))
    named = [F.when(F.col(f"_new_{f.name}") >= F.col(f"_old_{f.name}"), F.lit(f.name)) for f in table.values]
    changed = F.array_compact(F.array(*named)) if named else F.array().cast("array<string>")
    return known.where(effect).select(order, *table.keys, "kind", "ts", changed.alias("changed"), *[F.col(f.name) for f in table.values])


def watch(feed: DataFrame, **key) -> DataFrame:
    """The feed of one row, or of a part of the key; of the whole table without arguments."""
    out = feed
    for name, value in key.items():
        out = out.where(F.col(name) == F.lit(value))
    return out


def column_changes(feed: DataFrame, table: Table, order: str = "seq") -> DataFrame:
    """(order, column, change): for each event and column 'unchanged', 'set_null' or 'set'; deletes have none."""
    kinds = F.array(*[F.struct(F.lit(f.name).alias("column"), F.when(~F.array_contains("changed", f.name), "unchanged").when(F.col(f.name).isNull(), "set_null").otherwise("set").alias("change")) for f in table.values])
    return feed.where("kind = 'U'").select(order, F.explode(kinds).alias("_c")).select(order, "_c.column", "_c.change")
