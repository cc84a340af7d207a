"""The packs table: file identities, copies to keep, references, segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Start-end-id-generation in hex, then the endings of body and header files.
NAME = r"(?i)^\s*(?:.*/)?([0-9a-f]{1,16})-([0-9a-f]{1,16})-([0-9a-f]{1,16})-([0-9a-f]{1,16})(?:\.uqp(?:\.meta)?)?\s*$"
FILE = ["seq_start", "seq_end", "pack_id", "generation"]


def named(file_name: Column, place: int) -> Column:
    """One of the four numbers of a file name, null where the name doesn't have the form."""
    text = F.regexp_extract(F.coalesce(file_name, F.lit("")), NAME, place)
    return F.when(text != "", F.conv(text, 16, -10).try_cast("bigint"))


def identified(packs: DataFrame) -> DataFrame:
    """The packs with the four numbers of the file id filled from the columns or, where null, from the name."""
    name = packs["file_name"]
    return packs.withColumns({c: F.coalesce(packs[c], named(name, i + 1)) for i, c in enumerate(FILE)})


def body_size(packs: DataFrame) -> Column:
    """``body_len``, or else the greatest ``body_end`` of the header's segments; null if there is none."""
    own = F.array_max(F.transform("self_segments", lambda s: s["body_end"]))
    others = F.array_max(F.transform("peer_data", lambda p: F.array_max(F.transform(p["segments"], lambda s: s["body_end"]))))
    return F.coalesce(packs["body_len"], F.greatest(own, others))


def self_superseded(packs: DataFrame) -> DataFrame:
    """Distinct (pack_id, seq_end) that any row's self_supersedes names; null entries name nothing."""
    s = packs.select(F.explode("self_supersedes").alias("s"))
    return s.select(F.col("s.id").alias("pack_id"), F.col("s.end_seq").alias("seq_end")).where("pack_id IS NOT NULL AND seq_end IS NOT NULL").distinct()


def peer_superseded(packs: DataFrame) -> DataFrame:
    """Distinct (peer, four numbers) that any row's peer_data names."""
    p = packs.select(F.explode("peer_data").alias("p")).select(F.col("p.peer").alias("peer"), F.explode("p.supersedes").alias("s"))
    return p.select("peer", "s.seq_start", "s.seq_end", F.col("s.id").alias("pack_id"), "s.generation").dropna().distinct()


def parent_references(packs: DataFrame) -> DataFrame:
    """A row for each entry of parents: (row_id, ref_pos, pack_id, end_seq, received_at). Null entries are no references."""
    refs = packs.select("delivery_id", "received_at", F.posexplode("parents").alias("ref_pos", "_p")).where("_p IS NOT NULL")
    return refs.select(F.col("delivery_id").alias("row_id"), F.col("ref_pos").cast("bigint").alias("ref_pos"), F.col("_p.id").alias("pack_id"), F.col("_p.end_seq").alias("seq_end"), "received_at")


def segments(packs: DataFrame) -> DataFrame:
    """A row for each segment of a pack's own log and of its peer data, with the log's author."""
    head = ["pack_id", "seq_end", "generation"]
    own = packs.select(*head, "peer", F.explode("self_segments").alias("s"))
    relayed = packs.select(*head, F.explode("peer_data").alias("p")).select(*head, F.col("p.peer").alias("peer"), F.explode("p.segments").alias("s"))
    return own.unionByName(relayed).where("s IS NOT NULL").select(*head, "peer", "s.*")
