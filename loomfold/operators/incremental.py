"""Processing only new or changed records, with the target table as the only state.

A target row carries the key and the version of the source row it was made of. What a run has
to do is therefore the newest version of every source record, anti-joined against the target;
no watermark or offset is kept beside the data that could disagree with it. A run that fails
publishes nothing and is simply run again; a run that succeeds publishes its rows and, with
them, the fact that they were handled, in one atomic step.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomfold.sources.versioned import Version, VersionedTable


def newest(source: DataFrame, key: list[str], version: str, carry: list[str], ties: list[str]) -> DataFrame:
    """One row a record: the one of greatest ``version``, at ties of greatest ``ties``.

    A null version is lower than any other, a null key part is a key of its own. Rows that are
    repeated whole count once. The maximum is merged map-side, so a hot record costs one row
    a map task.
    """
    inner = [version, *ties, *[c for c in carry if c not in (version, *ties)]]
    top = source.groupBy(*key).agg(F.max(F.struct(*inner)).alias("_top"))
    return top.select(*key, *[F.col("_top")[c].alias(c) for c in dict.fromkeys([version, *carry])])


def pending(source: DataFrame, target: DataFrame, key: list[str], version: str) -> DataFrame:
    """Rows of ``source`` whose key the target doesn't hold in that version.

    Keys and versions are compared null-safely; an empty target leaves all rows, an empty
    source none. Other columns of the target may have any names.
    """
    done = target.select(*[F.col(c).alias(f"_done_{c}") for c in (*key, version)])
    on: Column = F.lit(True)
    for c in (*key, version):
        on = on & source[c].eqNullSafe(done[f"_done_{c}"])
    return source.join(done, on, "left_anti")


def run(source: DataFrame, target: VersionedTable, key: list[str], version: str, work: Callable[[DataFrame], DataFrame]) -> Version:
    """One run: ``work`` turns the pending rows into target rows, which are then published.

    ``work`` must keep the key and version columns. Raises VersionConflict, with nothing
    published, if another run published first; its records are then no longer pending.
    """
    base = target.current()
    todo = pending(source, target.read(base), key, version)
    return target.append(work(todo), base=base)


def covered(records: DataFrame, attempts: DataFrame, by: list[str], position: str, since: str, low: str, high: str, began: str) -> DataFrame:
    """Records for which an attempt with equal ``by`` has ``low < position <= high`` and ``began >= since``.

    The result is one equi-join on (by, slice) that keeps the records' side streaming and leaves
    hot slices to be split; see ``sliced``. Nulls in any of the compared columns match nothing;
    intervals that hold no position are ignored.
    """
    own, pieces = sliced(records, attempts, by, position, low, high, began)
    on = facing(own, pieces, by) & (own[position] > pieces["_lo"]) & (own[position] <= pieces["_hi"]) & (own[since] <= pieces["_at"])
    return own.join(pieces, on, "left_semi").drop("_slice", "_bits")


def sliced(records: DataFrame, attempts: DataFrame, by: list[str], position: str, low: str, high: str, began: str) -> tuple[DataFrame, DataFrame]:
    """Records with their ``_slice``, and the pieces (_by_..., _in, _lo, _hi, _at) of the attempts in each slice.

    Each ``by`` has slices of its own width, as units and lengths may differ from one to the
    next: a power of two from the mean length of its attempts, cut to where its records are.
    So its attempts touch at most three slices each on average, whatever their lengths, and where they
    follow one another a slice holds few of them; attempts that span a whole slice collapse into
    the latest of them.
    """
    names = {c: f"_by_{c}" for c in by}
    span = records.groupBy(*by).agg(F.min(position).alias("_least"), F.max(position).alias("_most")).withColumnsRenamed(names)
    real = attempts.where(F.col(low) < F.col(high)).where(F.col(began).isNotNull()).select(*[F.col(c).alias(n) for c, n in names.items()], F.col(low).alias("_lo"), F.col(high).alias("_hi"), F.col(began).alias("_at"))
    before = F.coalesce(F.try_subtract("_least", F.lit(1)), F.col("_least"))
    cut = real.groupBy(*names.values(), "_lo", "_hi").agg(F.max("_at").alias("_at")).join(span, list(names.values())).withColumns({"_lo": F.greatest("_lo", before), "_hi": F.least("_hi", "_most")}).where("_lo < _hi").drop("_least", "_most")
    # Lengths as doubles: they may be longer than a bigint holds.
    mean = F.avg(F.col("_hi").cast("double") - F.col("_lo").cast("double"))
    widths = cut.groupBy(*names.values()).agg(F.least(F.ceil(F.log2(mean)), F.lit(62)).cast("int").alias("_bits"))
    pieces = (
        cut.join(widths, list(names.values()))
        .withColumn("_in", F.explode(F.expr("sequence(shiftright(_lo + 1, _bits), shiftright(_hi, _bits))")))
        .withColumns({"_lo": F.expr("greatest(_lo, coalesce(try_subtract(shiftleft(_in, _bits), 1), _lo))"), "_hi": F.expr("least(_hi, shiftleft(_in, _bits) + (shiftleft(1L, _bits) - 1))")})
        .groupBy(*names.values(), "_in", "_lo", "_hi")
        .agg(F.max("_at").alias("_at"))
    )
    own = records.join(widths.withColumnsRenamed({n: c for c, n in names.items()}), by).withColumn("_slice", F.expr(f"shiftright(`{position}`, _bits)"))
    return own.select(*records.columns, "_slice", "_bits"), pieces


def facing(own: DataFrame, pieces: DataFrame, by: list[str]) -> Column:
    """The keys on which records meet pieces."""
    on = own["_slice"] == pieces["_in"]
    for c in by:
        on = on & (own[c] == pieces[f"_by_{c}"])
    return on
