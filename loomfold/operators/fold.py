"""The merge of operations to rows: one mergeable aggregation by primary key.

Operations in wide form have the key columns, ``kind`` ('U' or 'D'), ``ts`` and for each value
column ``<c>_set`` and ``<c>``; set to null and not set are different. For a key, D is the
greatest delete stamp, U the greatest upsert stamp and M_c the greatest (stamp, value) among
upserts that set c, null being the lowest value. A row lives if U >= D; a cell shows M_c's
value if its stamp is at least D. All three merge by maximum, so partial states can be stored,
repeated and merged in any order; the live view can't.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomfold.schema import Table


def admissible(ops: DataFrame, table: Table) -> DataFrame:
    """Operations that can take effect: whole key, stamp of at least 1, known kind."""
    ok: Column = (F.col("ts") >= 1) & F.col("kind").isin("U", "D")
    for k in table.keys:
        ok = ok & F.col(k).isNotNull()
    return ops.where(ok)


def partials(ops: DataFrame, table: Table) -> DataFrame:
    """(key..., u, d, m_<c>...) of wide operations, one row a key. One shuffle, after a map-side merge."""
    up = F.col("kind") == "U"
    out = [F.max(F.when(up, F.col("ts"))).alias("u"), F.max(F.when(~up, F.col("ts"))).alias("d")]
    for f in table.values:
        mentioned = up & F.coalesce(F.col(f"{f.name}_set"), F.lit(False))
        out.append(F.max(F.when(mentioned, F.struct(F.col("ts").alias("t"), F.col(f.name).alias("v")))).alias(f"m_{f.name}"))
    return admissible(ops, table).groupBy(*table.keys).agg(*out)


def merge(*states: DataFrame, table: Table) -> DataFrame:
    """Partial states merged into one, such as a stored snapshot and what came since."""
    both = states[0]
    for s in states[1:]:
        both = both.unionByName(s)
    names = ["u", "d", *[f"m_{f.name}" for f in table.values]]
    return both.groupBy(*table.keys).agg(*[F.max(n).alias(n) for n in names])


def physical(state: DataFrame, table: Table) -> DataFrame:
    """All rows, dead ones too, with their stamps; 0 stands for no stamp.

    The upsert stamp of a dead row follows all its upserts, including ones that came after
    the delete that covers them.
    """
    d = F.coalesce("d", F.lit(0).cast("bigint"))
    out = [*[F.col(k) for k in table.keys], F.coalesce("u", F.lit(0).cast("bigint")).alias("upsert_ts"), d.alias("deleted_ts")]
    for f in table.values:
        m = F.col(f"m_{f.name}")
        out += [F.when(m["t"] >= d, m["v"]).alias(f.name), F.coalesce(F.when(m["t"] >= d, m["t"]), F.lit(0).cast("bigint")).alias(f"{f.name}_lww")]
    return state.select(*out)


def live(state: DataFrame, table: Table) -> DataFrame:
    """The rows that readers see."""
    d = F.coalesce("d", F.lit(0).cast("bigint"))
    shown = [F.when(F.col(f"m_{f.name}")["t"] >= d, F.col(f"m_{f.name}")["v"]).alias(f.name) for f in table.values]
    return state.where(F.col("u") >= d).select(*table.keys, *shown)


def fold(ops: DataFrame, table: Table) -> DataFrame:
    return live(partials(ops, table), table)


def as_of(ops: DataFrame, table: Table, ts: int) -> DataFrame:
    """The rows as the operations stamped up to ``ts`` make them."""
    return fold(ops.where(F.col("ts") <= ts), table)
