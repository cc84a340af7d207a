"""Far too many small files: a checkpointed streaming compactor for packs.

A file stream discovers each file of the packs once and takes what is there in micro-batches.
A batch is written to the folder named by its batch id, in overwrite mode; the checkpoint
fixes which files a batch id stands for, so a retry replaces what the failed try wrote.

``compact`` then merges the batches that it hasn't merged yet into the compactor's state: the best copy
of each pack and the marks of what is superseded, all keyed by pack, in buckets of which only those
that the batches touch are rewritten. From the state the current packs and their segments, each
once, are written to files of about the wanted size, measured in bytes written, which become the next version of the output.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomfold.operators import packfiles
from loomfold.operators.delivery import copy_order, first_copies, kept_packs
from loomfold.operators.references import matching
from loomfold.session import work_folder
from loomfold.sources import bucketed
from loomfold.sources.bucketed import BUCKET
from loomfold.sources.versioned import Version, VersionedTable

#: Bodies smaller than this are to be consolidated.
SMALL_BYTES = 16_384
#: Wanted size of an output file.
FILE_BYTES = 256 << 20
#: Discovered files that one micro-batch takes.
BATCH_FILES = 1_000
#: Kinds of rows of state and output.
PACK, SEGMENT, SELF_GONE, PEER_GONE = "pack", "segment", "self_gone", "peer_gone"

_TYPES = {"string": T.StringType(), "bigint": T.LongType(), "binary": T.BinaryType(), "timestamp_ntz": T.TimestampNTZType()}


def _struct(**kinds: str) -> T.StructType:
    return T.StructType([T.StructField(c, _TYPES[k]) for c, k in kinds.items()])


_SEGMENT = _struct(peer="bigint", container_id="binary", idx_start="bigint", idx_end="bigint", prev_chain_hash="binary", end_chain_hash="binary", body_start="bigint", body_end="bigint")
_BEST = _struct(peer="bigint", seq_start="bigint", generation="bigint", received_at="timestamp_ntz", delivery_id="bigint", body_size="bigint", deleted_at="timestamp_ntz").add("segments", T.ArrayType(_SEGMENT))
_KEY = ["kind", "pack_id", "seq_end", "unknown", "gone_peer", "gone_start", "gone_generation"]
STATE = _struct(**dict(zip(_KEY, ["string"] + ["bigint"] * 6))).add("best", _BEST)
#: A pack has its size and no segment columns, a segment its place and the pack that it was taken from.
OUTPUT = T.StructType([*_struct(kind="string", pack_id="bigint", seq_end="bigint", body_size="bigint"), *_SEGMENT])


@dataclass(frozen=True)
class Ingested:
    """What the stream has written so far."""

    root: str

    def read(self, spark: SparkSession, after: int = -1) -> DataFrame:
        """The packs of all batches, or of those after one; other folders aren't opened."""
        return spark.read.parquet(f"{self.root}/batches").where(F.col("batch") > after).drop("batch")

    def last(self, spark: SparkSession) -> int:
        """The last batch written, by the names of the folders."""
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/batches")
        return max(int(s.getPath().getName().partition("=")[2]) for s in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path))

    def state(self, spark: SparkSession) -> VersionedTable:
        return VersionedTable(spark, f"{self.root}/state", STATE)


def discoverable(path: str) -> str:
    """A glob for exactly this path: a stream takes a folder, or by a glob a single file as well."""
    return f"{path[:-1]}[{path[-1]}]"


def ingest(spark: SparkSession, path: str, root: str | None = None, batch_files: int = BATCH_FILES) -> Ingested:
    """Take all files below ``path`` that ``root``'s checkpoint doesn't know yet; a new root if none is given."""
    root = root or work_folder(spark, "compactor")
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", batch_files).parquet(discoverable(path))

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/batches/batch={batch_id:012d}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return Ingested(root)


def current_packs(packs: DataFrame) -> DataFrame:
    """(delivery_id, pack_id, seq_end, body_size, deleted_at) of the packs that are kept and not deleted."""
    sized = packs.withColumn("body_size", packfiles.body_size(packs))
    return kept_packs(sized, ["body_size", "deleted_at"]).where("deleted_at IS NULL")


def small_packs(packs: DataFrame, below: int = SMALL_BYTES) -> DataFrame:
    """(pack_id, seq_end) of current packs whose body is smaller than ``below``. An unknown size isn't small."""
    return current_packs(packs).where(F.col("body_size") < below).select("pack_id", "seq_end")


def current_segments(packs: DataFrame) -> DataFrame:
    """Each segment of the current packs once.

    A segment is named by author, container, its range and its end hash. Where several packs
    carry it, the copy of the least (pack_id, seq_end, body_start) stays.
    """
    kept = matching(packs, current_packs(packs).select("delivery_id"), ["delivery_id"])
    return _each_once(packfiles.segments(packfiles.identified(kept)))


def _each_once(segments: DataFrame) -> DataFrame:
    columns = [c for c in segments.columns if c != "generation"]
    return first_copies(segments, ["peer", "container_id", "idx_start", "idx_end", "end_chain_hash"], [F.col(c) for c in ("pack_id", "seq_end", "body_start")], columns)


def states(packs: DataFrame) -> DataFrame:
    """Packs as rows of the state, the best copy of each, and a row for each mark that they make on others."""
    placed = lambda s, peer: F.struct(peer.alias("peer"), *[s[n].alias(n) for n in _SEGMENT.names[1:]])
    none = F.array().cast(T.ArrayType(_SEGMENT))
    own = F.transform(F.filter("self_segments", lambda s: s.isNotNull()), lambda s: placed(s, F.col("peer")))
    relayed = F.flatten(F.transform(F.filter("peer_data", lambda p: p.isNotNull() & p["segments"].isNotNull()), lambda p: F.transform(F.filter(p["segments"], lambda s: s.isNotNull()), lambda s: placed(s, p["peer"]))))
    full = packfiles.identified(packs)
    best = F.struct("peer", "seq_start", "generation", F.col("received_at").cast("timestamp_ntz").alias("received_at"), "delivery_id", packfiles.body_size(full).alias("body_size"), F.col("deleted_at").cast("timestamp_ntz").alias("deleted_at"), F.concat(F.coalesce(own, none), F.coalesce(relayed, none)).alias("segments"))
    blank = F.lit(None).cast("bigint")
    known = F.col("pack_id").isNotNull() & F.col("seq_end").isNotNull()
    rows = full.select(F.lit(PACK).alias("kind"), "pack_id", "seq_end", F.when(~known, F.col("delivery_id")).alias("unknown"), *[blank.alias(c) for c in _KEY[4:]], best.alias("best"))
    gone = packfiles.self_superseded(packs).select(F.lit(SELF_GONE).alias("kind"), "pack_id", "seq_end", *[blank.alias(c) for c in _KEY[3:]])
    gone = gone.unionByName(packfiles.peer_superseded(packs).select(F.lit(PEER_GONE).alias("kind"), "pack_id", "seq_end", blank.alias("unknown"), F.col("peer").alias("gone_peer"), F.col("seq_start").alias("gone_start"), F.col("generation").alias("gone_generation")))
    return _merged(rows.unionByName(gone.withColumn("best", F.lit(None).cast(_BEST))), _KEY)


def _merged(rows: DataFrame, by: list[str]) -> DataFrame:
    """The best copy of each key, whichever batch it came in; merged map-side."""
    order = F.struct(*[c.alias(f"_{i}") for i, c in enumerate(copy_order(F.col("best.generation"), F.col("best.received_at"), F.col("best.delivery_id")))])
    return rows.groupBy(*by).agg(F.min_by("best", order).alias("best"))


def living(state: DataFrame) -> DataFrame:
    """The current packs of a state: best copies that no mark names, and that aren't deleted."""
    packs = state.where(F.col("kind") == PACK).select("pack_id", "seq_end", "best.*")
    kept = matching(packs, state.where(F.col("kind") == SELF_GONE).select("pack_id", "seq_end"), ["pack_id", "seq_end"], "left_anti")
    marks = state.where(F.col("kind") == PEER_GONE).select("pack_id", "seq_end", F.col("gone_peer").alias("peer"), F.col("gone_start").alias("seq_start"), F.col("gone_generation").alias("generation"))
    return matching(kept, marks, marks.columns, "left_anti").where("deleted_at IS NULL")


def compacted(state: DataFrame) -> DataFrame:
    """The rows of the output: the current packs, and their segments, each once."""
    packs = living(state)
    segments = _each_once(packs.select("pack_id", "seq_end", F.explode("segments").alias("s")).select("pack_id", "seq_end", "s.*"))
    own = packs.select(F.lit(PACK).alias("kind"), "pack_id", "seq_end", "body_size")
    return own.unionByName(segments.withColumn("kind", F.lit(SEGMENT)), allowMissingColumns=True).select(*OUTPUT.names)


def compact(spark: SparkSession, ingested: Ingested, target: VersionedTable, file_bytes: int = FILE_BYTES) -> Version:
    """Merge the batches that aren't in the state yet, and publish the output in files of about ``file_bytes``.

    A run that fails between the two publications merges the same batches again, which changes
    nothing. Without a new batch the output stays as it is.
    """
    held, base = ingested.state(spark), target.current()
    before, last = held.current(), ingested.last(spark)
    merged = before.facts.get("batch", -1)
    if merged < last:
        new = bucketed.staged(spark, states(ingested.read(spark, merged)))
        plan = bucketed.plan(held, before, new, ["pack_id", "seq_end"])
        rows = plan.incoming if plan.stored is None else plan.stored.unionByName(plan.incoming)
        before = bucketed.publish(held, before, plan, _merged(rows.repartition(plan.tasks, BUCKET), [BUCKET, *_KEY]), {"batch": last})
    if base.facts.get("batch", -1) == last:
        return base
    return sized(target, compacted(held.read(before)), ["kind", "peer", "container_id", "idx_start", "pack_id"], file_bytes, {"batch": last}, base)


def sized(target: VersionedTable, rows: DataFrame, order: list[str], file_bytes: int, facts: dict, base: Version) -> Version:
    """Publish rows in files of about ``file_bytes``, sorted by ``order`` across and within files.

    How many bytes rows take is known once they are written, so they are written as they come, and
    then dealt out to as many files as that makes; once more if sorted they take less than half or more than twice the room.
    """
    part = target.stage(rows)
    files = 0
    while True:
        bytes_ = target.size(part)
        wanted = max(1, -(-bytes_ // file_bytes))
        if files and (wanted <= 2 * files and files <= 2 * wanted):
            return target.commit(base, (part,), {**facts, "bytes": bytes_, "files": files})
        source = target.read_parts((part,))
        dealt = source.repartitionByRange(wanted, *order) if wanted > 1 else source.coalesce(1)
        new, files = target.stage(dealt.sortWithinPartitions(*order)), wanted
        target.discard(part)
        part = new


def output_packs(output: DataFrame, below: int | None = None) -> DataFrame:
    """(pack_id, seq_end) of the packs in the output, or of those with a body smaller than ``below``."""
    small = F.lit(True) if below is None else F.col("body_size") < below
    return output.where((F.col("kind") == PACK) & small).select("pack_id", "seq_end")


def output_segments(output: DataFrame) -> DataFrame:
    return output.where(F.col("kind") == SEGMENT).drop("kind", "body_size")
