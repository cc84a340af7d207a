"""Queries of pack files: segments made of operations, packs built of them, and read again."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomfold.operators import chains
from loomfold.session import ship, table
from loomfold.sources import packs as pk

#: Entries of a segment, and bytes of a chunk and of a pack in these queries; small, so that logs have several chunks and rounds several packs.
ENTRIES, CHUNK, PACK = 20, 4_000, 100_000
LOG = ["peer_id", "container"]


def _entries(spark: SparkSession, d: str) -> DataFrame:
    """row_ops as entries of their authors' logs, in order of arrival."""
    peers = table(spark, d, "peers").select(F.col("id").alias("peer"), "peer_id")
    o = table(spark, d, "row_ops").where("container IS NOT NULL").join(peers, "peer")
    idx = F.row_number().over(Window.partitionBy(*LOG).orderBy("seq")) - 1
    return o.select(*LOG, idx.cast("bigint").alias("idx"), F.coalesce("ts", F.lit(0)).alias("ts"), F.col("who").alias("user_id"), F.coalesce(F.col("body").cast("binary"), F.lit(b"")).alias("body"))


def _segments(entries: DataFrame) -> DataFrame:
    """(log..., start_idx, end_size, prev_hash, end_hash, body) of ENTRIES entries each, encoded."""
    ship(entries.sparkSession)
    h = chains.entry_hash(F.lit("op"), *[F.col(c) for c in (*LOG, "idx", "ts", "user_id", "body")])
    chain = chains.chain_hashes(entries.withColumn("_h", h), LOG, "idx", "_h")
    of = (F.floor(F.col("idx") / ENTRIES)).alias("_s")
    ends = chain.groupBy(*LOG, of).agg(F.max("idx").alias("_last"), F.max_by("chain_hash", "idx").alias("end_hash"))
    seed = F.lag("end_hash").over(Window.partitionBy(*LOG).orderBy("_s"))
    ends = ends.withColumn("prev_hash", seed)
    # At most ENTRIES entries each.
    own = entries.groupBy(*LOG, of).agg(F.sort_array(F.collect_list(F.struct("idx", "ts", "user_id", "body"))).alias("e"))
    both = own.join(ends, [*LOG, "_s"]).select(*LOG, (F.col("_s") * ENTRIES).alias("start_idx"), (F.col("_last") + 1).alias("end_size"), "prev_hash", "end_hash", "e")
    out = T.StructType([*[f for f in both.schema if f.name != "e"], T.StructField("body", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(out)
        for b in batches:
            rows = []
            for peer, container, start, size, before, after, e in zip(*[c.to_pylist() for c in b.columns]):
                before = before or pk.Chain(peer, container).hash
                plain = [{"entry_type": "op", "ts": x["ts"], "user_id": x["user_id"] or b"", "body": x["body"]} for x in e]
                rows.append((peer, container, start, size, before, after, pk.encode_segment(start, before, pk.UNSIGNED, plain)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return both.mapInArrow(run, out)


def _built(spark: SparkSession, d: str) -> DataFrame:
    """The packs that the first peer makes of all logs, by three topics."""
    author = table(spark, d, "peers").where("id = 1").select(F.col("peer_id").alias("author"))
    none = F.lit(None).cast("bigint")
    s = _segments(_entries(spark, d)).join(F.broadcast(author.limit(1))).select(
        F.pmod(F.xxhash64("container"), F.lit(3)).alias("topic"), "author", F.lit(0).cast("bigint").alias("first_seq"), F.array().cast("array<struct<id:bigint,end_seq:bigint>>").alias("parents"),
        F.xxhash64(*LOG).alias("branch_id"), *LOG, "end_size", none.alias("published_size"), "body",
    )
    return pk.build(s, ["topic"], 1_700_000_000_000, chunk_bytes=CHUNK, pack_bytes=PACK)


def pack_build(spark: SparkSession, d: str) -> DataFrame:
    """All entries, through segments, joined segments and packs, and back."""
    author = table(spark, d, "peers").where("id = 1").select(F.col("peer_id").alias("_author")).limit(1)
    read = pk.unpack(_built(spark, d), ["topic"]).join(F.broadcast(author))
    return read.select(F.hex(F.coalesce("peer_id", "_author")).alias("peer_id"), F.hex("container").alias("container"), "idx", "ts", F.hex("user_id").alias("user_id"), F.col("body").cast("string").alias("body"), "error")


def pack_marks(spark: SparkSession, d: str) -> DataFrame:
    """How far each log is published after the round, of how many entries."""
    marks = _built(spark, d).select(F.explode("published").alias("p")).groupBy("p.branch_id").agg(F.max("p.published_size").alias("published_size"))
    sizes = _entries(spark, d).groupBy(*LOG).agg(F.count("*").alias("n_entries")).withColumn("branch_id", F.xxhash64(*LOG))
    return sizes.join(marks, "branch_id", "left").select(F.hex("peer_id").alias("peer_id"), F.hex("container").alias("container"), "n_entries", "published_size")


def pack_headers(spark: SparkSession, d: str) -> DataFrame:
    """The headers of the packs table, encoded and decoded again; entries that are null, or ranges that end before they begin, can't be encoded."""
    ship(spark)
    peers = table(spark, d, "peers").select(F.col("id").alias("_id"), "peer_id")
    p = table(spark, d, "packs").select("delivery_id", F.coalesce("packed_at", F.lit(0)).alias("packed_at"), "parents", "self_supersedes", "self_segments")
    relayed = table(spark, d, "packs").select("delivery_id", F.posexplode("peer_data").alias("_pos", "x")).join(peers, F.col("x.peer") == F.col("_id")).groupBy("delivery_id").agg(F.sort_array(F.collect_list(F.struct("_pos", "peer_id", "x.supersedes", "x.segments"))).alias("peer_data"))
    rows = p.join(relayed, "delivery_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                whole = lambda items: [x for x in items or () if x is not None]
                h = {"packed_at": r["packed_at"], **{c: whole(r[c]) for c in ("parents", "self_supersedes", "self_segments")}, "body_sha256": bytes(32), "signature": pk.UNSIGNED}
                h["peer_data"] = [{"peer_id": x["peer_id"], "supersedes": whole(x["supersedes"]), "segments": whole(x["segments"])} for x in r["peer_data"] or ()]
                data = pk.encode_header(h)
                back = pk.decode_header(data)
                out.append((r["delivery_id"], back["packed_at"], len(back["parents"]), sum(x["end_seq"] for x in back["parents"]), len(back["self_supersedes"]), len(back["self_segments"]), sum(x["body_end"] - x["body_start"] for x in back["self_segments"]), sum(len(x["segments"]) for x in back["peer_data"]), back == h))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["delivery_id", "packed_at", "n_parents", "parent_seqs", "n_superseded", "n_segments", "body_bytes", "n_relayed", "same"])

    return rows.mapInArrow(run, "delivery_id bigint, packed_at bigint, n_parents bigint, parent_seqs bigint, n_superseded bigint, n_segments bigint, body_bytes bigint, n_relayed bigint, same boolean")


_E = "e AS (SELECT p.peer_id, o.container, row_number() OVER (PARTITION BY o.peer, o.container ORDER BY o.seq) - 1 AS idx, coalesce(o.ts, 0) AS ts, o.who, coalesce(o.body, '') AS body FROM row_ops o JOIN peers p ON p.id = o.peer WHERE o.container IS NOT NULL)"
_N = "len([x FOR x IN {} IF x IS NOT NULL])"
QUERIES = {
    "pack_build": (pack_build, f"WITH {_E} SELECT hex(peer_id) AS peer_id, hex(container) AS container, idx, ts, coalesce(hex(who), '') AS user_id, body, NULL::VARCHAR AS error FROM e"),
    "pack_marks": (pack_marks, f"WITH {_E} SELECT hex(peer_id) AS peer_id, hex(container) AS container, count(*) AS n_entries, count(*) AS published_size FROM e GROUP BY ALL"),
    "pack_headers": (
        pack_headers,
        f"""SELECT delivery_id, coalesce(packed_at, 0) AS packed_at, coalesce({_N.format('parents')}, 0) AS n_parents, coalesce(list_sum([x.end_seq FOR x IN parents]), 0) AS parent_seqs, coalesce({_N.format('self_supersedes')}, 0) AS n_superseded, coalesce({_N.format('self_segments')}, 0) AS n_segments,
coalesce(list_sum([x.body_end - x.body_start FOR x IN self_segments]), 0) AS body_bytes, coalesce((SELECT sum(len(y.segments)) FROM (SELECT unnest(peer_data) AS y) JOIN peers ON peers.id = y.peer), 0) AS n_relayed, true AS same FROM packs""",
    ),
}
