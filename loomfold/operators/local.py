"""Local writes: stamped, put at the end of their logs, chained, and committed, all in one step."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomfold.functions.scalar import HASH_PREFIX
from loomfold.operators import chains, clock

LOG = ["peer_id", "container"]


def own_roots(branches: DataFrame) -> DataFrame:
    """(peer_id, container, head_size, head_hash, commit_size, fault) of the branches that local writes go to.

    That is a log's root, whatever forks it has: when a replica was restored from a backup and wrote on, what
    it wrote before comes back as a fork and is committed like any other. A log with branches but
    without a root, or whose root has ``head_err``, takes no writes; ``fault`` says so.
    """
    root = F.col("parent_id").isNull()
    out = branches.groupBy(*LOG).agg(F.min_by(F.struct("head_size", "head_hash", "commit_size", "head_err", "commit_err"), F.col("id")).alias("_any"), F.min_by(F.when(root, F.struct("head_size", "head_hash", "commit_size", "head_err", "commit_err")), F.when(root, F.col("id"))).alias("_r"))
    fault = F.when(F.col("_r").isNull(), "no root").when(F.col("_r.head_err").isNotNull(), "head error").when(F.col("_r.commit_err").isNull() & (F.col("_r.commit_size") != F.col("_r.head_size")), "sizes differ")
    return out.select(*LOG, "_r.head_size", "_r.head_hash", "_r.commit_size", F.col("_r.commit_err").isNull().alias("commits"), fault.alias("fault"))


@dataclass(frozen=True)
class Written:
    """``entries``: what was written, each entry a segment of its own. ``heads``: the logs' new heads. ``rejected``: writes with ``fault``."""

    entries: DataFrame
    heads: DataFrame
    rejected: DataFrame


def execute(ops: DataFrame, roots: DataFrame, order: str = "seq", prefix: str = HASH_PREFIX, last_stamp: int = 0) -> Written:
    """Write ``ops`` (peer_id, container, order, wall, user_id, body) to the logs whose heads are ``roots``.

    A write's stamp is the replica's clock, its place the next of its log, its segment goes from
    the log's hash before it to the one after it. A log without a head begins. Where the log's commit
    has stalled only the head moves, else the commit goes with it. Writes of one replica
    are one sequence by ``order``; replicas and logs don't wait for one another.
    """
    held = roots.select(*LOG, "head_size", "head_hash", "commit_size", "commits", "fault")
    both = ops.join(held, LOG, "left")
    rejected = both.where("fault IS NOT NULL").select(*ops.columns, "fault")
    here = both.where("fault IS NULL").withColumns({"head_size": F.coalesce("head_size", F.lit(0).cast("bigint")), "commits": F.coalesce("commits", F.lit(True)), "remote": F.lit(None).cast("bigint")})
    stamped = clock.assign(here, ["peer_id"], order, last_stamp).drop("remote")
    placed = stamped.withColumn("idx", F.col("head_size") + F.row_number().over(Window.partitionBy(*LOG).orderBy(order)) - 1)
    h = chains.entry_hash(F.lit("op"), F.col("peer_id"), F.col("container"), F.col("idx"), F.col("stamp"), F.col("user_id"), F.col("body"), prefix)
    hashed = placed.withColumn("_h", h)
    chained = chains.chain_hashes(hashed, LOG, "idx", "_h", prefix, start="head_hash")
    entries = placed.join(chained, [*LOG, "idx"]).select(*LOG, order, F.col("idx").alias("start_idx"), (F.col("idx") + 1).alias("end_size"), "stamp", "user_id", "body", F.col("chain_hash").alias("end_hash"), "commits", F.col("commit_size").alias("_had"))
    top = F.max_by(F.struct("end_hash", "commits", "_had"), F.col("end_size"))
    heads = entries.groupBy(*LOG).agg(F.max("end_size").alias("head_size"), top.alias("_t"))
    heads = heads.select(*LOG, "head_size", F.col("_t.end_hash").alias("head_hash"), F.when(F.col("_t.commits"), F.col("head_size")).otherwise(F.coalesce("_t._had", F.lit(0))).alias("commit_size"))
    return Written(entries.drop("_had"), heads, rejected)
