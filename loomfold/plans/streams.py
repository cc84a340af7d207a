"""Queries that run streams to their end, or bytes there and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfold.functions import codec
from loomfold.operators import fold
from loomfold.plans import core
from loomfold.plans import fixtures as fx
from loomfold.session import table, work_folder
from loomfold.sources.versioned import VersionedTable
from loomfold.streaming import merge


def stream_fold_equals_batch(spark: SparkSession, d: str) -> DataFrame:
    t = fx.USER_STATE
    root = work_folder(spark, "stream-fold")
    target = VersionedTable(spark, f"{root}/snapshot", merge.snapshot_schema(t))
    ops = fx.user_ops_of(merge.parquet_stream(spark, f"{d}/events.parquet"), fx.COARSE)
    merge.run_to_end(merge.into_snapshot(ops, target, t, f"{root}/checkpoint"))
    return fold.live(target.read(), t)


def _feed_of_stream(spark: SparkSession, ops: DataFrame, t) -> DataFrame:
    root = work_folder(spark, "stream-feed")
    target = VersionedTable(spark, f"{root}/snapshot", merge.snapshot_schema(t))
    merge.run_to_end(merge.into_feed(ops, target, t, f"{root}/feed", f"{root}/checkpoint"))
    return merge.read_feed(spark, f"{root}/feed", t)


def stream_feed(spark: SparkSession, d: str) -> DataFrame:
    ops = fx.user_ops_of(merge.parquet_stream(spark, f"{d}/events.parquet"), fx.COARSE)
    return _feed_of_stream(spark, ops, fx.USER_STATE).select("seq", "user_id", "kind", "ts", F.array_join("changed", ",").alias("changed"))


LARGE = 1 << 60


def stream_feed_batches(spark: SparkSession, d: str) -> DataFrame:
    """The feed of values beyond 2**53 that come in four parts, the stream being stopped and started in between."""
    t, root, e = fx.USER_STATE, work_folder(spark, "stream-feed-in"), table(spark, d, "events")
    target = VersionedTable(spark, f"{root}/snapshot", merge.snapshot_schema(t))
    least, most = e.agg(F.min("event_id"), F.max("event_id")).first()
    step = ((most or 0) - (least or 0)) // 4 + 1
    for i in range(4):
        part = e.where((F.col("event_id") >= (least or 0) + i * step) & (F.col("event_id") < (least or 0) + (i + 1) * step))
        part.write.mode("append").parquet(f"{root}/events")
        ops = fx.user_ops_of(merge.parquet_stream(spark, f"{root}/events"), fx.COARSE).withColumn("score", F.col("score") + LARGE)
        merge.run_to_end(merge.into_feed(ops, target, t, f"{root}/feed", f"{root}/checkpoint"))
    return merge.read_feed(spark, f"{root}/feed", t).select("seq", "user_id", "kind", "ts", F.array_join("changed", ",").alias("changed"))


def codec_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """All well-formed operations of row_ops, encoded to bytes and decoded again."""
    t = fx.ROW_STATE
    value = lambda **v: F.struct(*[v.get(k, F.lit(None)).cast(kind).alias(k) for k, kind in {"b": "binary", "t": "string", "i": "bigint", "u": "binary"}.items()])
    on = lambda c: F.coalesce(F.col(f"{c}_set"), F.lit(False))
    kinds = {"body": "t", "n": "i", "who": "u"}
    ids = {f.name: f.column_id for f in t.values}
    sets = F.array(*[F.when(on(c) & F.col(c).isNotNull(), F.struct(F.lit(ids[c]).alias("column_id"), value(**{k: F.col(c)}).alias("value"))) for c, k in kinds.items()])
    nulls = F.array(*[F.when(on(c) & F.col(c).isNull(), F.lit(ids[c])) for c in kinds])
    real = fx.row_ops(spark, d).where("k0 IS NOT NULL AND k1 IS NOT NULL")
    general = real.select("seq", F.lit(t.table_id).alias("table_id"), "kind", F.array(value(t=F.col("k0")), value(i=F.col("k1"))).alias("pk"), F.filter(sets, lambda s: s.isNotNull()).alias("sets"), F.filter(nulls, lambda s: s.isNotNull()).alias("nulls"))
    back = codec.decode_ops(codec.encode_ops(general, ["seq"]), "body", ["seq"])
    named = lambda c: (F.exists("sets", lambda s: s["column_id"] == ids[c]) | F.array_contains("nulls", ids[c])).alias(f"{c}_set")
    got = lambda c, k: F.try_element_at(F.filter("sets", lambda s: s["column_id"] == ids[c]), F.lit(1))["value"][k]
    return back.select("seq", "table_id", "kind", F.col("pk")[0]["t"].alias("k0"), F.col("pk")[1]["i"].alias("k1"), *[named(c) for c in kinds], got("body", "t").alias("body"), got("n", "i").alias("n"), F.hex(got("who", "u")).alias("who"), "error")


_LIVE = core._live_sql(fx.user_ops_sql(fx.COARSE), fx.USER_STATE)
_ON = ", ".join(f"kind = 'U' AND coalesce({c}_set, false) AS {c}_set" for c in ("body", "n", "who"))
QUERIES = {
    "stream_fold_equals_batch": (stream_fold_equals_batch, _LIVE),
    "stream_feed": (stream_feed, core.QUERIES["change_feed"][1]),
    "stream_feed_batches": (stream_feed_batches, core.QUERIES["change_feed"][1].replace("CAST(round(value * 100) AS BIGINT)", f"CAST(round(value * 100) AS BIGINT) + {LARGE}")),
    "codec_roundtrip": (
        codec_roundtrip,
        f"WITH {fx.ROW_OPS} SELECT seq, {fx.ROW_STATE.table_id} AS table_id, kind, k0, k1, {_ON}, CASE WHEN kind = 'U' AND body_set THEN body END AS body, CASE WHEN kind = 'U' AND n_set THEN n END AS n, CASE WHEN kind = 'U' AND who_set THEN hex(who) END AS who, NULL::VARCHAR AS error FROM ops WHERE k0 IS NOT NULL AND k1 IS NOT NULL",
    ),
}
