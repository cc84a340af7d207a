"""Hybrid logical clocks, assigned to whole logs by prefix maxima."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomfold.functions.scalar import stamp, too_far_ahead


def assign(ticks: DataFrame, by: list[str], order: str, start: Column | int = 0) -> DataFrame:
    """The clock after each tick, as ``stamp``.

    ``ticks`` has ``wall`` (milliseconds) for a local tick and ``remote`` (a stamp) for an
    observation; one of them is null. A local tick takes the greater of the wall clock and the
    last stamp plus one; an observation moves the clock past a stamp that isn't below it. With
    n the number of local ticks so far that is n + max(start, candidates - n).
    """
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = F.count("wall").over(w)
    candidate = F.coalesce(stamp(F.col("wall")), F.col("remote") + 1)
    return ticks.withColumn("_n", local).withColumn("stamp", F.col("_n") + F.greatest(F.lit(start).cast("bigint") if isinstance(start, int) else start, F.max(candidate - F.col("_n")).over(w))).drop("_n")


def increasing(rows: DataFrame, by: list[str], order: str, wall: str, name: str) -> DataFrame:
    """A strictly increasing number: the wall clock, or one more than the last."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    n = F.row_number().over(Window.partitionBy(*by).orderBy(order))
    return rows.withColumn("_n", n).withColumn(name, F.col("_n") + F.max(F.col(wall) - F.col("_n")).over(w)).drop("_n")


def admitted(entries: DataFrame, by: list[str], order: str, now_ms: Column, ts: str = "ts") -> DataFrame:
    """``admitted``: whether an entry may be committed. One too far ahead holds back all later entries of its log."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return entries.withColumn("admitted", ~F.max(F.coalesce(too_far_ahead(F.col(ts), now_ms), F.lit(False))).over(w))


def committable(entries: DataFrame, by: list[str], order: str, committed: str) -> DataFrame:
    """Entries that follow their log's committed size without a gap; repeated places count once."""
    fresh = entries.where(F.col(order) >= F.col(committed)).dropDuplicates([*by, order])
    n = F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1
    return fresh.withColumn("_gap", F.col(order) - F.col(committed) - n).where("_gap = 0").drop("_gap")
