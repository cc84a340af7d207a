"""References to records that do not exist.

Parents are compressed into runs of consecutive integer keys. A reference is matched to the
last run that starts at or before its key; it is an orphan if there is none or its key lies
beyond the run's end. Runs are cut at fixed block borders, so no window partition ever holds
more than 2**BLOCK_BITS parents and as many distinct references, whatever is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Keys in a block, as a power of two. Smaller than the rows a window keeps in memory.
BLOCK_BITS = 11


def runs(parents: DataFrame, by: list[str], key: str, block_bits: int = BLOCK_BITS) -> DataFrame:
    """(by..., _block, run_start, run_end) of the parents' keys; repeated keys count once, null keys not."""
    w = Window.partitionBy(*by, "_block").orderBy(key)
    keys = parents.where(F.col(key).isNotNull()).select(*by, key).distinct().withColumn("_block", F.shiftright(key, block_bits))
    islands = keys.withColumn("_island", F.col(key) - F.row_number().over(w))
    return islands.groupBy(*by, "_block", "_island").agg(F.min(key).alias("run_start"), F.max(key).alias("run_end")).drop("_island")


def orphan_keys(references: DataFrame, parents: DataFrame, by: list[str], key: str, block_bits: int = BLOCK_BITS) -> DataFrame:
    """Distinct (by..., key) of ``references`` that no parent has.

    Keys are compared null-safely in ``by``; a reference with a null ``key`` points nowhere
    and is an orphan. With no parents every reference is one, with no references none.
    """
    asked = references.select(*by, key).distinct().withColumn("_block", F.shiftright(key, block_bits))
    points = asked.select(*by, "_block", F.col(key).alias("_at"), F.lit(1).alias("_ask"), F.lit(None).cast("bigint").alias("_end"))
    starts = runs(parents, by, key, block_bits).select(*by, "_block", F.col("run_start").alias("_at"), F.lit(0).alias("_ask"), F.col("run_end").alias("_end"))
    w = Window.partitionBy(*by, "_block").orderBy(F.col("_at").asc_nulls_first(), "_ask").rowsBetween(Window.unboundedPreceding, 0)
    matched = points.unionByName(starts).withColumn("_reach", F.last("_end", ignorenulls=True).over(w))
    lost = matched.where("_ask = 1 AND (_at IS NULL OR _reach IS NULL OR _at > _reach)")
    return lost.select(*by, F.col("_at").alias(key))


def matching(rows: DataFrame, keys: DataFrame, columns: list[str], how: str = "left_semi") -> DataFrame:
    """Rows whose ``columns`` are, null-safely, among the distinct ``keys``.

    The keys' side has each key once, so a hot key is only many rows on the left, which
    adaptive execution splits.
    """
    right = keys.select(*[F.col(c).alias(f"_key_{c}") for c in columns])
    on = F.lit(True)
    for c in columns:
        on = on & rows[c].eqNullSafe(right[f"_key_{c}"])
    return rows.join(right, on, how)


def report(orphans: DataFrame, all_references: DataFrame, at: str) -> DataFrame:
    """Per table and month of ``at``: references, orphans and their share in parts per million."""
    period = F.date_format(F.trunc(F.col(at).cast("timestamp_ntz").cast("date"), "month"), "yyyy-MM")
    count = lambda df, name: df.groupBy("ref_table", F.coalesce(period, F.lit("unknown")).alias("period")).agg(F.count("*").alias(name))
    both = count(all_references, "n_references").join(count(orphans, "n_orphans"), ["ref_table", "period"], "left")
    return both.withColumn("n_orphans", F.coalesce("n_orphans", F.lit(0))).withColumn("orphans_ppm", F.expr("n_orphans * 1000000 div n_references"))
