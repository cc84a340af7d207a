"""Messages delivered more than once: exactly one copy of each is kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomfold.operators import packfiles
from loomfold.operators.references import matching


def first_copies(messages: DataFrame, identifier: list[str], order: list[Column], keep: list[str]) -> DataFrame:
    """One row an identifier: the ``keep`` columns of the copy that is least in ``order``.

    ``min_by`` over a struct; its partial result is merged map-side, so the copies of a hot
    message never meet in one task. ``order`` should end in a tie-break that is unique;
    copies equal in all of it are equal rows. Null parts of an identifier are compared as
    values: callers that know null identifiers to be unrelated add a column that is unique.
    """
    least = F.min_by(F.struct(*keep), F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)]))
    kept = messages.groupBy(*identifier).agg(least.alias("_kept"))
    return kept.select(*[F.col("_kept")[c].alias(c) for c in keep])


def copy_order(generation: Column, received_at: Column, delivery_id: Column) -> list[Column]:
    """What makes the least copy of a pack: the highest generation, then the earliest received, then the lowest id; nulls last."""
    return [-F.coalesce(generation, F.lit(-1)), received_at.isNull(), received_at, F.coalesce(delivery_id, F.lit(2**63 - 1))]


def kept_packs(packs: DataFrame, carry: list[str]) -> DataFrame:
    """The delivery of each pack to keep, with the columns of ``carry``.

    Copies share pack id and end seq; the highest generation stays, then the earliest
    received, then the lowest delivery id (nulls last). A pack that any row supersedes, by
    (id, end seq) or by (peer, exact file), isn't kept at all. A delivery whose id is
    unknown is a message of its own.
    """
    full = packfiles.identified(packs).withColumn("_unknown", F.when(F.col("pack_id").isNull() | F.col("seq_end").isNull(), F.col("delivery_id")))
    columns = list(dict.fromkeys(["delivery_id", "peer", *packfiles.FILE, *carry]))
    best = first_copies(full, ["pack_id", "seq_end", "_unknown"], copy_order(F.col("generation"), F.col("received_at"), F.col("delivery_id")), columns)
    best = matching(best, packfiles.self_superseded(packs), ["pack_id", "seq_end"], "left_anti")
    return matching(best, packfiles.peer_superseded(packs), ["peer", *packfiles.FILE], "left_anti").select(*columns)


def dropped_deliveries(packs: DataFrame) -> DataFrame:
    """(delivery_id) of the deliveries not to keep, each once."""
    return matching(packs.select("delivery_id"), kept_packs(packs, []), ["delivery_id"], "left_anti").distinct()
