"""Checks of operations; what fails is kept aside with the reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomfold.functions import ids
from loomfold.functions.scalar import is_uuid

#: A value in general form: at most one field is set.
VALUE = "struct<b:binary,t:string,i:bigint,u:binary>"


def _tag(v: Column) -> Column:
    """Type tag of a general value; null if it has no field set."""
    return F.when(v["b"].isNotNull(), 0).when(v["t"].isNotNull(), 1).when(v["i"].isNotNull(), 2).when(v["u"].isNotNull(), 3)


def reason() -> Column:
    """Why an operation in general form (table_id, kind, ts, pk, sets, nulls) is rejected; null if it isn't."""
    tags = F.transform("pk", lambda v: F.coalesce(_tag(v), F.lit(-1)))
    wanted = F.array(*[F.coalesce(ids.key_type(F.col("table_id"), i), F.lit(-1)) for i in range(4)])
    columns = F.concat(F.transform("sets", lambda s: s["column_id"]), F.col("nulls"))
    return (
        F.when(F.col("ts").isNull() | (F.col("ts") < 1), "no stamp")
        .when(~F.col("kind").isin("U", "D") | F.col("kind").isNull(), "unknown kind")
        .when(F.col("pk").isNull() | (F.size("pk") != ids.key_count(F.col("table_id"))), "wrong number of key values")
        .when(tags != F.slice(wanted, F.lit(1), F.size("pk")), "wrong type of a key value")
        .when(F.exists("pk", lambda v: v["u"].isNotNull() & ~is_uuid(v["u"])), "uuid of another length")
        .when(F.exists("sets", lambda s: F.coalesce(_tag(s["value"]), F.lit(-1)) != ids.column_type(s["column_id"])), "wrong type of a column's value")
        .when(F.size(F.array_distinct(columns)) < F.size(columns), "column named twice")
        .when(F.exists("pk", lambda v: F.instr(v["t"], "\0") > 0) | F.exists("sets", lambda s: F.instr(s["value"]["t"], "\0") > 0), "text with NUL")
    )


def split(ops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Operations that pass, and those that don't with ``reason``."""
    marked = ops.withColumn("reason", reason())
    return marked.where("reason IS NULL").drop("reason"), marked.where("reason IS NOT NULL")
