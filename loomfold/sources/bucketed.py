"""Merged states of keys in buckets: a run rewrites the buckets that it touches, and no other.

A key's bucket is its hash modulo a number of buckets that is stored with the table, so a bucket
keeps its keys from one version to the next. Buckets are planned by bytes. When they have grown
beyond that, their number doubles, which splits each in two and is the one case in which a run
rewrites all of them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomfold.session import remove, width, work_folder
from loomfold.sources.versioned import Version, VersionedTable

#: Bytes of rows, as they lie in memory, that a bucket is planned for.
BUCKET_BYTES = 96 << 20
#: Name of the column that holds a row's bucket while a run lasts.
BUCKET = "_bucket"


def row_bytes(schema: T.StructType) -> Column:
    """About what a row takes in memory."""

    def of(c: Column, t: T.DataType) -> Column:
        if isinstance(t, (T.StringType, T.BinaryType)):
            return F.coalesce(F.octet_length(c), F.lit(0)) + 16
        if isinstance(t, T.StructType):
            return sum((of(c[f.name], f.dataType) for f in t), F.lit(1))
        if isinstance(t, T.ArrayType):
            return F.coalesce(F.size(c), F.lit(0)) * _flat_bytes(t.elementType)
        return F.lit(8)

    return sum((of(F.col(f"`{f.name}`"), f.dataType) for f in schema), F.lit(8)).cast("bigint")


def _flat_bytes(t: T.DataType) -> int:
    """About what an element of an array takes, without looking into it."""
    return sum(_flat_bytes(f.dataType) for f in t) if isinstance(t, T.StructType) else 48 if isinstance(t, (T.StringType, T.BinaryType)) else 8


def bucket_of(key: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int").alias(BUCKET)


@dataclass(frozen=True)
class Plan:
    """What a run reads and leaves. ``stored`` has the rows of the touched buckets, or is None if there are none."""

    buckets: int
    tasks: int
    stays: tuple[str, ...]
    stored: DataFrame | None
    incoming: DataFrame
    bytes: int
    seen: Observation | None
    scratch: str

    @property
    def exact(self) -> bool:
        """Whether each task has just one bucket."""
        return self.tasks == self.buckets


@dataclass(frozen=True)
class Staged:
    """New states, written once so that they are computed once, and their bytes."""

    states: DataFrame
    bytes: int
    path: str


def staged(spark: SparkSession, states: DataFrame) -> Staged:
    seen, path = Observation(), work_folder(spark, "new-states")
    states.observe(seen, F.sum(row_bytes(states.schema)).alias("bytes")).write.parquet(path)
    return Staged(spark.read.schema(states.schema).parquet(path), seen.get["bytes"] or 0, path)


def plan(target: VersionedTable, base: Version, new: Staged, key: list[str], buckets: int | None = None) -> Plan:
    """The buckets that new states touch, with what is stored in them. ``buckets`` sets their number for a new table."""
    states, n_bytes = new.states, new.bytes
    spark, had = states.sparkSession, base.facts.get("buckets")
    if not had:
        n = buckets or max(width(spark), -(-n_bytes // BUCKET_BYTES))
        return Plan(n, n, (), None, states.withColumn(BUCKET, bucket_of(key, n)), 0, None, new.path)
    n = had
    while base.facts["bytes"] + n_bytes > n * BUCKET_BYTES:
        n *= 2
    incoming = states.withColumn(BUCKET, bucket_of(key, n))
    parts = [b for p in base.parts for b in ([p] if "=" in p else target.below(p))]
    if n == had:
        # At most as many numbers as there are buckets.
        touched = {f"{BUCKET}={r[0]}" for r in incoming.select(BUCKET).distinct().collect()}
        stays = tuple(p for p in parts if p.rpartition("/")[2] not in touched)
    else:
        touched, stays = range(n), ()
    read = tuple(p for p in parts if p not in set(stays))
    seen = Observation() if read else None
    stored = target.read_parts(read).observe(seen, F.sum(row_bytes(target.schema)).alias("bytes")).withColumn(BUCKET, bucket_of(key, n)) if read else None
    return Plan(n, max(1, min(n, len(touched))), stays, stored, incoming, base.facts["bytes"], seen, new.path)


def publish(target: VersionedTable, base: Version, p: Plan, merged: DataFrame, facts: dict | None = None) -> Version:
    """The merged rows of the touched buckets, with their BUCKET, and all other buckets become the next version. What was staged goes."""
    out = Observation()
    part = target.stage(merged.observe(out, F.sum(row_bytes(target.schema)).alias("bytes")), by=BUCKET)
    total = p.bytes - ((p.seen.get["bytes"] or 0) if p.seen else 0) + (out.get["bytes"] or 0)
    parts = (*p.stays, *(target.below(part) if p.stays else (part,)))
    version = target.commit(base, parts, {**(facts or {}), "buckets": p.buckets, "bytes": total, "rewritten": len(target.below(part))})
    remove(target.spark, p.scratch)
    return version
