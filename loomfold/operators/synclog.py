"""What the replicas' sync log says about handled records: problem 1 on its own tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomfold.operators.incremental import covered, newest, pending
from loomfold.session import table, work_folder
from loomfold.sources.versioned import VersionedTable

KEY = ["record_type", "replica", "k0", "k1"]
TARGET = T.StructType([T.StructField("record_type", T.StringType()), *[T.StructField(c, T.LongType()) for c in ("replica", "k0", "k1", "version", "record_id")]])


def records(branch_changes: DataFrame, pack_reads: DataFrame) -> DataFrame:
    """Every record once, in its newest row: branches by changed_at, packs by last_ts.

    Ties of the version go to the row seen last, then to the greatest id.
    """
    change = branch_changes.select(F.lit("change").alias("record_type"), "replica", F.col("branch_id").alias("k0"), F.lit(None).cast("bigint").alias("k1"), F.col("changed_at").alias("version"), "seen_at", F.col("change_id").alias("record_id"))
    pack = pack_reads.select(F.lit("pack").alias("record_type"), "replica", F.col("pack_id").alias("k0"), F.col("seq_end").alias("k1"), F.col("last_ts").alias("version"), "seen_at", F.col("todo_id").alias("record_id"))
    return newest(change.unionByName(pack), KEY, "version", ["seen_at", "record_id"], ["seen_at", "record_id"])


def successful(sync_runs: DataFrame) -> DataFrame:
    """The intervals of the attempts that ended well, one row for each kind of record."""
    ok = sync_runs.where(F.lower(F.trim("status")) == "ok")
    return ok.select(
        "replica", "started_at",
        F.explode(F.array(
            F.struct(F.lit("change").alias("record_type"), F.col("stamp_from").alias("low"), F.col("stamp_to").alias("high")),
            F.struct(F.lit("pack").alias("record_type"), F.col("wall_from").alias("low"), F.col("wall_to").alias("high")),
        )).alias("_i"),
    ).select("_i.record_type", "replica", "_i.low", "_i.high", "started_at")


def replayed_target(spark: SparkSession, current: DataFrame, sync_runs: DataFrame) -> VersionedTable:
    """The target as the successful attempts left it: a row for each record and version they handled."""
    done = covered(current, successful(sync_runs), ["record_type", "replica"], "version", "seen_at", "low", "high", "started_at")
    target = VersionedTable(spark, work_folder(spark, "sync-target"), TARGET)
    target.append(done.select(*KEY, "version", "record_id"))
    return target


def to_handle(spark: SparkSession, folder: str) -> DataFrame:
    """Records that the next run must handle, with all key columns."""
    current = records(table(spark, folder, "branch_changes"), table(spark, folder, "pack_reads"))
    target = replayed_target(spark, current, table(spark, folder, "sync_runs"))
    return pending(current, target.read(), KEY, "version")
