"""The merge over streams: running state, atomic snapshots, the change feed.

Late operations are never dropped for their age, so nothing here sets a watermark; state
grows with the number of keys. Snapshots lie in buckets, of which a micro-batch rewrites those
that its keys fall in.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from loomfold.operators import fold
from loomfold.operators.feed import change_feed
from loomfold.schema import Table
from loomfold.sources import bucketed
from loomfold.sources.bucketed import BUCKET
from loomfold.sources.versioned import Version, VersionedTable


def states(ops: DataFrame, table: Table) -> DataFrame:
    """The partial states of a stream of operations, for output mode update or complete; ``fold.live`` reads them."""
    return fold.partials(ops, table)


def _merge_in(batch: DataFrame, target: VersionedTable, base: Version, table: Table, facts: dict, before: Callable[[DataFrame | None], None] | None = None) -> Version:
    """The next snapshot: partial states of the batch merged with those stored in the buckets they touch."""
    new = bucketed.staged(batch.sparkSession, fold.partials(batch, table))
    plan = bucketed.plan(target, base, new, table.keys)
    if before:
        before(target.read_parts(base.parts) if base.parts else None)
    rows = plan.incoming if plan.stored is None else plan.stored.unionByName(plan.incoming)
    names = ["u", "d", *[f"m_{f.name}" for f in table.values]]
    # One exchange, by bucket, serves the merge and the files.
    merged = rows.repartition(plan.tasks, BUCKET).groupBy(BUCKET, *table.keys).agg(*[F.max(n).alias(n) for n in names])
    return bucketed.publish(target, base, plan, merged, facts)


def into_snapshot(ops: DataFrame, target: VersionedTable, table: Table, checkpoint: str, on_version: Callable[[int], None] | None = None) -> StreamingQuery:
    """Merge each micro-batch into a stored snapshot of partial states, published atomically.

    Merging is idempotent, so a batch that is tried again after its version was published
    changes nothing, and any number of streams, each with its checkpoint, may feed a snapshot
    one after the other.
    """

    def take(batch: DataFrame, batch_id: int) -> None:
        base = target.current()
        version = _merge_in(batch, target, base, table, {"taken": base.facts.get("taken", {})})
        if on_version:
            on_version(version.number)

    return ops.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def snapshot_schema(table: Table) -> T.StructType:
    out = [T.StructField(f.name, f.spark) for f in table.key] + [T.StructField(c, T.LongType()) for c in ("u", "d")]
    out += [T.StructField(f"m_{f.name}", T.StructType([T.StructField("t", T.LongType()), T.StructField("v", f.spark)])) for f in table.values]
    return T.StructType(out)


def _stream_id(spark: SparkSession, checkpoint: str) -> str:
    """What names a stream as long as its checkpoint lives."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/metadata")
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).open(path)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["id"]
    finally:
        stream.close()


def _as_operations(states: DataFrame, table: Table, place: T.StructType) -> DataFrame:
    """Stored states as the fewest operations that lead to them, placed before all others."""
    flags = lambda own: [x for f in table.values for x in (F.lit(f is own).alias(f"{f.name}_set"), (F.col(f"m_{f.name}.v") if f is own else F.lit(None).cast(f.spark)).alias(f.name))]
    one = lambda kind, ts, own=None: F.when(ts.isNotNull(), F.struct(F.lit(kind).alias("kind"), ts.alias("ts"), *flags(own)))
    parts = [one("U", F.col("u")), one("D", F.col("d")), *[one("U", F.col(f"m_{f.name}.t"), f) for f in table.values]]
    return states.select(*table.keys, F.lit(None).cast(place).alias("_place"), F.explode(F.array_compact(F.array(*parts))).alias("_o")).select(*table.keys, "_place", "_o.*")


def into_feed(ops: DataFrame, target: VersionedTable, table: Table, out: str, checkpoint: str, order: str = "seq") -> StreamingQuery:
    """The change feed of a stream into ``out``, in order of arrival: within a micro-batch by ``order``, else as batches come.

    A batch's feed is that of its operations after the stored states of its keys, so it is made by
    the same built-in windows as in batch: values keep their types, and a hot key is a sorted
    partition that spills, not a group in memory. The feed of a batch is written under its number
    before the snapshot is published; a retry replaces it, or finds that the snapshot has the batch.
    """
    spark = ops.sparkSession
    keep = [*table.keys, "kind", "ts", *[x for f in table.values for x in (f"{f.name}_set", f.name)]]

    def take(batch: DataFrame, batch_id: int) -> None:
        base, me = target.current(), _stream_id(spark, checkpoint)
        taken = base.facts.get("taken", {})
        if taken.get(me, -1) >= batch_id:
            return
        new = batch.select(F.struct(F.col(order)).alias("_place"), *keep)

        def write(stored: DataFrame | None) -> None:
            both = new
            if stored is not None:
                known = stored.join(new.select(*table.keys).distinct(), table.keys, "left_semi")
                both = new.unionByName(_as_operations(known, table, new.schema["_place"].dataType))
            feed = change_feed(both, table, "_place").where("_place IS NOT NULL").select(F.col("_place")[order].alias(order), *table.keys, "kind", "ts", "changed")
            feed.write.mode("overwrite").parquet(f"{out}/stream={me}/batch={batch_id:012d}")

        _merge_in(batch, target, base, table, {"taken": taken | {me: batch_id}}, write)

    return ops.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def feed_schema(table: Table, order: str = "seq") -> T.StructType:
    return T.StructType([T.StructField(order, T.LongType()), *[T.StructField(f.name, f.spark) for f in table.key], T.StructField("kind", T.StringType()), T.StructField("ts", T.LongType()), T.StructField("changed", T.ArrayType(T.StringType()))])


def read_feed(spark: SparkSession, out: str, table: Table, order: str = "seq") -> DataFrame:
    schema = feed_schema(table, order)
    return spark.read.schema(schema).parquet(out).select(*schema.names)


def run_to_end(query: StreamingQuery) -> None:
    try:
        query.awaitTermination()
    finally:
        query.stop()


def admit(batch: DataFrame, waiting: DataFrame, by: list[str], order: str, now_ms) -> tuple[DataFrame, DataFrame]:
    """A micro-batch and what waits, split into entries to commit and entries held back by clock skew."""
    from loomfold.operators.clock import admitted

    both = admitted(waiting.unionByName(batch), by, order, now_ms)
    return both.where("admitted").drop("admitted"), both.where("NOT admitted").drop("admitted")


def anchored(incoming: DataFrame, known: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Segments whose predecessor (size, hash) is known or that begin a log, and those that wait for it."""
    k = known.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("size").alias("_size"), F.col("hash").alias("_hash")).distinct()
    on = (incoming["idx_start"] == k["_size"]) & (incoming["prev_hash"] == k["_hash"])
    for c in by:
        on = on & (incoming[c] == k[f"_{c}"])
    ready = incoming.where("idx_start = 0").unionByName(incoming.where("idx_start > 0").join(k, on, "left_semi"))
    return ready, incoming.where("idx_start > 0").join(k, on, "left_anti")


def parquet_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the files at a path, each discovered once."""
    from loomfold.streaming.compactor import discoverable

    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(discoverable(path))
