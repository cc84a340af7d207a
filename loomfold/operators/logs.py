"""Relational bookkeeping of logs: branches, forks, pages, publishing, placement.

Tables: branches (id, parent_id, fork_size, head_size, commit_size, peer, container, head_hash,
changed_at), segments (branch_id, start_idx, end_size, len, end_hash), peers (id, peer_id),
published (remote_id, branch_id, published_size, pending_since).
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomfold.operators.chains import chain_hashes  # noqa: F401
from loomfold.session import work_folder

#: Rows of a page of changes, rows and bytes of a page of segments.
CHANGES_PAGE, PAGE_ROWS, PAGE_BYTES = 1_000, 1_024, 4 << 20
LOG = ["peer", "container"]


def changes_since(branches: DataFrame, peers: DataFrame, stamp: int, limit: int = CHANGES_PAGE) -> DataFrame:
    """The first branches that changed after a stamp and have entries of their own, in order of stamp and id."""
    fresh = branches.where((F.col("changed_at") > stamp) & (F.col("head_size") > F.coalesce("fork_size", F.lit(0))))
    known = fresh.join(peers.select(F.col("id").alias("peer"), "peer_id"), "peer")
    return known.orderBy("changed_at", "id").limit(min(limit, CHANGES_PAGE)).select("id", "peer_id", "container", "head_size", "head_hash", "changed_at")


def logs_behind(branches: DataFrame, peers: DataFrame) -> DataFrame:
    """Logs with a branch whose commit lags its head."""
    lag = branches.where("commit_size < head_size").select(*LOG).distinct()
    return lag.join(peers.select(F.col("id").alias("peer"), "peer_id"), "peer")


def publish_plan(segments: DataFrame, branches: DataFrame, peers: DataFrame, published: DataFrame, containers: DataFrame, remote_id: int, topic: int, own_peer: int, due_ms: int, default_topic: int = 0) -> DataFrame:
    """Segments to publish on a remote: own ones that it lacks, others' once they waited past ``due_ms``."""
    state = published.where(F.col("remote_id") == remote_id).select(F.col("branch_id").alias("_pb"), "published_size", "pending_since")
    b = branches.select("id", *LOG).join(peers.select(F.col("id").alias("peer"), "peer_id"), "peer").join(containers.select("container", "topic"), "container", "left").where(F.coalesce("topic", F.lit(default_topic)) == topic)
    known = b.join(state, b["id"] == state["_pb"], "left").where((F.col("peer") == own_peer) | (F.col("pending_since") < due_ms))
    s = segments.select("branch_id", "start_idx", "end_size", "len").distinct()
    return s.join(known, s["branch_id"] == known["id"]).where(F.col("end_size") > F.coalesce("published_size", F.lit(0))).select("branch_id", "start_idx", "end_size", "len", "peer", "container", "published_size")


def pending_marks(branches: DataFrame, published: DataFrame, remote_id: int, own_peer: int, now_ms: int) -> DataFrame:
    """Branches of others with unpublished entries that aren't marked as pending on a remote yet."""
    state = published.where(F.col("remote_id") == remote_id).select(F.col("branch_id").alias("_pb"), "published_size", "pending_since")
    both = branches.join(state, branches["id"] == state["_pb"], "left").where(F.col("pending_since").isNull() & (F.col("peer") != own_peer))
    return both.where(F.col("head_size") > F.coalesce("published_size", F.lit(0))).select(F.lit(remote_id).alias("remote_id"), F.col("id").alias("branch_id"), F.lit(0).cast("bigint").alias("published_size"), F.lit(now_ms).cast("bigint").alias("pending_since"))


def published_marks(published: DataFrame, news: DataFrame) -> DataFrame:
    """High-water marks after new ones: sizes only go up, a mark that is reached isn't pending any more."""
    both = published.select("remote_id", "branch_id", "published_size").unionByName(news.select("remote_id", "branch_id", "published_size"))
    return both.groupBy("remote_id", "branch_id").agg(F.max("published_size").alias("published_size"))


def branch_paths(branches: DataFrame, leaves: DataFrame, on_loop: str = "stop") -> DataFrame:
    """(leaf, branch_id, upper, depth): each leaf's way to its root, with the size up to which a branch counts.

    By pointer doubling: a round joins the ways so far to leaps of their own length, so a way of
    n forks takes log2(n) rounds, whatever its depth. A leaf that comes back to a branch of its way
    (a loop, which no sound log has) stops there, or is an error if ``on_loop`` is "raise".
    """
    spark = branches.sparkSession
    root = work_folder(spark, "paths")
    leap = branches.where("parent_id IS NOT NULL").select(F.col("id").alias("_from"), F.col("parent_id").alias("_to"), F.col("fork_size").alias("_upper"))
    ways = leaves.select(F.col("id").alias("leaf"), F.col("id").alias("branch_id"), F.col("head_size").alias("upper"), F.lit(0).cast("bigint").alias("depth"))
    most = branches.count()
    for i in count():
        ways.write.parquet(f"{root}/ways/{i}")
        leap.write.parquet(f"{root}/leaps/{i}")
        ways, leap = (spark.read.schema(df.schema).parquet(f"{root}/{name}/{i}") for name, df in (("ways", ways), ("leaps", leap)))
        more = ways.join(leap, ways["branch_id"] == leap["_from"]).select("leaf", F.col("_to").alias("branch_id"), F.col("_upper").alias("upper"), (F.col("depth") + (1 << i)).alias("depth"))
        if leap.isEmpty() or more.isEmpty():
            return ways
        ways = ways.unionByName(more)
        if 1 << i > most:
            if on_loop == "raise":
                raise ValueError("a branch descends from itself")
            # Whoever still has a way to go walks in a loop, each branch of which was seen by now.
            first = ways.groupBy("leaf", "branch_id").agg(F.min(F.struct("depth", "upper")).alias("_m"))
            return first.select("leaf", "branch_id", "_m.upper", "_m.depth")
        nearer = leap.select(F.col("_from").alias("_a"), F.col("_to").alias("_b"))
        leap = nearer.join(leap, nearer["_b"] == leap["_from"]).select(F.col("_a").alias("_from"), "_to", "_upper")


def fetch_pages(paths: DataFrame, segments: DataFrame, start: int, max_bytes: int = PAGE_BYTES, max_rows: int = PAGE_ROWS) -> DataFrame:
    """For each leaf the first page of segments past a size: root first, at least one, within bytes and rows.

    Branches are cut to a page each before they meet the leaves, so a leaf takes at most a page
    and the segment that exceeds it from every branch of its way. A segment that starts before an
    earlier one (lines that overlap) isn't cut there, as for some leaf not all that precede it may count.
    """
    s = segments.where(F.col("end_size") > start).select("branch_id", "start_idx", "end_size", "len").distinct()
    here = Window.partitionBy("branch_id").orderBy("end_size", "start_idx").rowsBetween(Window.unboundedPreceding, 0)
    own = s.withColumns({"_sum": F.sum("len").over(here), "_n": F.count(F.lit(1)).over(here), "_top": F.max("start_idx").over(here)})
    cut = own.where((F.col("start_idx") < F.col("_top")) | ((F.col("_sum") - F.col("len") <= max_bytes) & (F.col("_n") <= max_rows + 1))).drop("_sum", "_n", "_top")
    w = Window.partitionBy("leaf").orderBy(F.col("depth").desc(), "end_size", "start_idx").rowsBetween(Window.unboundedPreceding, 0)
    counted = paths.join(cut, "branch_id").where(F.col("start_idx") < F.col("upper")).withColumns({"_sum": F.sum("len").over(w), "_n": F.count(F.lit(1)).over(w)})
    return counted.where((F.col("_n") == 1) | ((F.col("_sum") <= max_bytes) & (F.col("_n") <= max_rows))).select("leaf", "depth", "branch_id", "start_idx", "end_size", "len")


def catch_up_order(branches: DataFrame) -> DataFrame:
    """Branches whose commit lags, numbered within their log so that parents come before forks."""
    w = Window.partitionBy(*LOG).orderBy("id")
    return branches.where("commit_size < head_size").withColumn("place", F.row_number().over(w))


def inherited_commits(branches: DataFrame) -> DataFrame:
    """Forks that committed less than their fork size whose parent has reached it: they start from there."""
    parent = branches.select(F.col("id").alias("_p"), F.col("commit_size").alias("_reached"))
    forks = branches.where("parent_id IS NOT NULL").where("commit_size < fork_size")
    return forks.join(parent, forks["parent_id"] == parent["_p"]).where("_reached >= fork_size").select("id", F.col("fork_size").alias("commit_size"))


def reaches(branches: DataFrame, segments: DataFrame) -> DataFrame:
    """(id, start, reach): from where a branch's commit goes on, and how far its stored segments lead without a gap.

    A fork goes on from its fork size at least. Where no segment holds the next entry, reach is start.
    """
    b = branches.select(F.col("id").alias("branch_id"), F.greatest("commit_size", "fork_size").alias("start_idx"), "head_size")
    c = covered_ranges(segments.select("branch_id", "start_idx", "end_size"), ["branch_id"], "start_idx", "end_size")
    points = b.select("branch_id", "start_idx", "head_size", F.lit(1).alias("_ask"), F.lit(None).cast("bigint").alias("_end"))
    held = c.select("branch_id", "start_idx", F.lit(None).cast("bigint").alias("head_size"), F.lit(0).alias("_ask"), F.col("end_size").alias("_end"))
    w = Window.partitionBy("branch_id").orderBy("start_idx", "_ask").rowsBetween(Window.unboundedPreceding, 0)
    both = points.unionByName(held).withColumn("_end", F.last("_end", ignorenulls=True).over(w)).where("_ask = 1")
    return both.select(F.col("branch_id").alias("id"), F.col("start_idx").alias("start"), F.when(F.col("_end") > F.col("start_idx"), F.least("_end", F.greatest("head_size", "start_idx"))).otherwise(F.col("start_idx")).alias("reach"))


def catch_up(branches: DataFrame, segments: DataFrame) -> DataFrame:
    """(id, commit_size, outcome): commit sizes after one run over all branches, parents before forks.

    ``branches`` has ``retry``, whether a branch may be tried. A fork that is below its fork size
    starts once its parent has reached it in the same run, so forks of forks follow at any depth.
    Outcomes: done (at its head), missing_segment, waits_for_parent, not_tried. Whether a branch starts
    depends on whether its parent did; these dependencies are composed along the way to the root by pointer
    doubling, so a chain of n forks takes log2(n) rounds.
    """
    spark, root = branches.sparkSession, work_folder(branches.sparkSession, "catch-up")
    b = branches.join(reaches(branches, segments), "id")
    p = b.select(F.col("id").alias("_pid"), F.col("commit_size").alias("_had"), F.col("reach").alias("_may"))
    alone = F.col("fork_size").isNull() | (F.col("commit_size") >= F.col("fork_size"))
    may = F.coalesce(F.col("retry"), F.lit(False))
    own = b.join(p, b["parent_id"] == p["_pid"], "left").select(
        "id", "commit_size", "start", "reach", "head_size", may.alias("retry"),
        # Whether it starts if its parent does, and if it doesn't.
        (may & (alone | F.coalesce(F.col("_may") >= F.col("fork_size"), F.lit(False)))).alias("_then"),
        (may & (alone | F.coalesce(F.col("_had") >= F.col("fork_size"), F.lit(False)))).alias("_else"),
        F.when(F.col("_pid").isNotNull() & ~alone, F.col("_pid")).alias("_up"),
    )
    own.write.parquet(f"{root}/own")
    own = spark.read.schema(own.schema).parquet(f"{root}/own")
    f, most = own.select("id", "_then", "_else", "_up"), own.count()
    for i in count():
        f.write.parquet(f"{root}/{i}")
        f = spark.read.schema(f.schema).parquet(f"{root}/{i}")
        if f.where("_up IS NOT NULL AND _then <> _else").isEmpty():
            break
        if 1 << i > 2 * most:
            raise ValueError("a branch descends from itself")
        u = f.select(F.col("id").alias("_i"), F.col("_then").alias("_t"), F.col("_else").alias("_e"), F.col("_up").alias("_u"))
        of = lambda x: F.when(F.col(x), F.col("_then")).otherwise(F.col("_else"))
        f = f.join(u, f["_up"] == u["_i"], "left").select("id", F.when(F.col("_i").isNull(), F.col("_then")).otherwise(of("_t")).alias("_then"), F.when(F.col("_i").isNull(), F.col("_else")).otherwise(of("_e")).alias("_else"), F.col("_u").alias("_up"))
    # Beyond the last fork that waits nothing starts of itself.
    starts = f.select("id", F.col("_else").alias("_starts"))
    outcome = F.when(~F.col("retry"), "not_tried").when(~F.col("_starts"), "waits_for_parent").when(F.col("reach") >= F.col("head_size"), "done").otherwise("missing_segment")
    return own.join(starts, "id").select("id", F.when(F.col("_starts"), F.col("reach")).otherwise(F.col("commit_size")).alias("commit_size"), outcome.alias("outcome"))


def peer_inits(inits: DataFrame, wanted: DataFrame) -> DataFrame:
    """The init records of the peers asked for, by ``peer_id``; peers without a record give no row."""
    return inits.join(wanted.select("peer_id").distinct(), "peer_id", "left_semi")


def latest_change(branches: DataFrame) -> DataFrame:
    """One row: the greatest stamp of a change, 0 if there is none."""
    return branches.agg(F.coalesce(F.max("changed_at"), F.lit(0).cast("bigint")).alias("changed_at"))


def branch_stamps(branches: DataFrame, peers: DataFrame) -> DataFrame:
    """Every branch with its stamp, in order of stamp and id."""
    known = branches.join(peers.select(F.col("id").alias("peer"), "peer_id"), "peer")
    return known.orderBy("changed_at", "id").select("id", "peer_id", "container", "head_size", "changed_at")


def unpublished(branches: DataFrame, published: DataFrame, remote_ids: list[int]) -> DataFrame:
    """(remote_id, peer, container): logs of which a remote lacks entries, for each remote of the replica's configuration."""
    marks = published.select("remote_id", F.col("branch_id").alias("id"), "published_size")
    each = branches.select("id", "head_size", *LOG, F.explode(F.array(*[F.lit(r).cast(marks.schema["remote_id"].dataType) for r in remote_ids])).alias("remote_id"))
    return each.join(marks, ["remote_id", "id"], "left").where(F.col("head_size") > F.coalesce("published_size", F.lit(0))).select("remote_id", *LOG).distinct()


def snapshot(branches: DataFrame, peers: DataFrame) -> DataFrame:
    """Per log its author and the sorted (head_size, head_hash, fork_size) of its branches, by which replicas are compared."""
    known = branches.join(peers.select(F.col("id").alias("peer"), "peer_id"), "peer")
    return known.groupBy("peer_id", "container").agg(F.sort_array(F.collect_list(F.struct("head_size", "head_hash", "fork_size"))).alias("heads"))


def publish_order(plan: DataFrame) -> DataFrame:
    """The order in which a pack takes segments: by branch, then by place."""
    return plan.orderBy("branch_id", "end_size", "start_idx")


def fork_points(segments: DataFrame, branches: DataFrame) -> DataFrame:
    """Logs that have two hashes at one size: the least such size and the number of hashes there."""
    s = segments.select("branch_id", "end_size", "end_hash").join(branches.select(F.col("id").alias("branch_id"), *LOG), "branch_id")
    at = s.groupBy(*LOG, "end_size").agg(F.count_distinct("end_hash").alias("n_lines")).where("n_lines > 1")
    return at.groupBy(*LOG).agg(F.min(F.struct("end_size", "n_lines")).alias("_m")).select(*LOG, F.col("_m.end_size").alias("fork_at"), F.col("_m.n_lines").alias("n_lines"))


def fork_tree(segments: DataFrame, by: list[str]) -> DataFrame:
    """(by..., branch, parent, fork_size, head_size, head_hash): the lines of each log and where they part, from its segments' hashes.

    ``segments`` has by..., idx_start, prev_hash, idx_end, end_hash. Where several end at one size and hash
    the one that begins last (the finest, of those whose begin is known) leads there. Of several that begin at one size and
    hash the one of least (end, hash) carries the line on, the others are forks of it. A branch is
    named by the end hash of its first segment; parents of lines that begin without an anchor are null.
    Repeated and empty segments don't count. Lines are followed by pointer doubling.
    """
    spark, root = segments.sparkSession, work_folder(segments.sparkSession, "fork-tree")
    e = segments.where("idx_start < idx_end").select(*by, "idx_start", "prev_hash", "idx_end", "end_hash").distinct()
    begin, end = [*by, "idx_start", "prev_hash"], [*by, "idx_end", "end_hash"]
    ends = e.select(*[F.col(c).alias(b) for c, b in zip(end, begin)]).distinct().withColumn("_known", F.lit(True))
    best = F.max(F.struct(F.coalesce("_known", F.col("idx_start") == 0).alias("known"), F.col("idx_start"), F.col("prev_hash")))
    own = e.join(ends, begin, "left").groupBy(*end).agg(best.alias("_b")).select(*by, "_b.idx_start", "_b.prev_hash", "idx_end", "end_hash")
    first = F.min(F.struct("idx_end", "end_hash")).over(Window.partitionBy(*begin))
    own = own.withColumn("_main", first == F.struct("idx_end", "end_hash")).withColumn("_side", F.when(~F.col("_main"), first["end_hash"]))
    own.write.parquet(f"{root}/own")
    own = spark.read.schema(own.schema).parquet(f"{root}/own")
    before = own.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("idx_end").alias("_end"), F.col("end_hash").alias("_before"))
    on = (own["idx_start"] == before["_end"]) & (own["prev_hash"] == before["_before"])
    for c in by:
        on = on & (own[c] == before[f"_{c}"])
    # An end hash names a segment now; ``_to`` is the one that its line comes from, or itself where a branch begins.
    linked = own.join(before, on, "left").select(*own.columns, "_before")
    linked.write.parquet(f"{root}/linked")
    linked = spark.read.schema(linked.schema).parquet(f"{root}/linked")
    way = linked.select(*by, "idx_end", "end_hash", F.when(F.col("_main"), F.col("_before")).alias("_to"), F.when(F.col("_main") & F.col("_before").isNotNull(), F.col("idx_start")).alias("_at"))
    for i in count():
        way.write.parquet(f"{root}/{i}")
        way = spark.read.schema(way.schema).parquet(f"{root}/{i}")
        up = way.select(*by, F.col("idx_end").alias("_at"), F.col("end_hash").alias("_to"), F.col("_at").alias("_next_at"), F.col("_to").alias("_next"))
        if way.join(up, [*by, "_at", "_to"]).where("_next IS NOT NULL").isEmpty():
            break
        way = way.join(up, [*by, "_at", "_to"], "left").select(*by, "idx_end", "end_hash", F.coalesce("_next", "_to").alias("_to"), F.when(F.col("_next").isNotNull(), F.col("_next_at")).otherwise(F.col("_at")).alias("_at"))
    of = way.select(*by, "idx_end", "end_hash", F.coalesce("_to", "end_hash").alias("branch"))
    lines = linked.join(of, [*by, "idx_end", "end_hash"])
    heads = lines.groupBy(*by, "branch").agg(F.max(F.struct("idx_end", "end_hash")).alias("_h"))
    starts = lines.where(F.col("branch") == F.col("end_hash")).select(*by, "branch", F.when(~F.col("_main"), F.col("idx_start")).alias("fork_size"), F.when(~F.col("_main"), F.coalesce("_before", "_side")).alias("_up"))
    parents = of.select(*by, F.col("end_hash").alias("_up"), F.col("branch").alias("parent"))
    return starts.join(heads, [*by, "branch"]).join(parents, [*by, "_up"], "left").select(*by, "branch", "parent", "fork_size", F.col("_h.idx_end").alias("head_size"), F.col("_h.end_hash").alias("head_hash"))


def covered_ranges(ranges: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """Union of half-open ranges per ``by``; ranges that touch become one. Empty and null ranges don't count."""
    real = ranges.where(F.col(start) < F.col(end)).groupBy(*by, start).agg(F.max(end).alias(end))
    w = Window.partitionBy(*by).orderBy(start)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = real.withColumn("_new", F.coalesce((F.col(start) > reach).cast("int"), F.lit(1))).withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*by, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def within(rows: DataFrame, covered: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """``within``: whether a row's range lies in one covered range, matched to the last that starts before it."""
    c = covered.select(*by, F.col(start).alias("_s"), F.lit(0).alias("_k"), F.col(end).alias("_e"))
    both = rows.withColumns({"_s": F.col(start), "_k": F.lit(1), "_e": F.lit(None).cast("bigint")}).unionByName(c, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy("_s", "_k").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("within", F.coalesce(F.last("_e", ignorenulls=True).over(w) >= F.col(end), F.lit(False))).where("_k = 1").drop("_s", "_k", "_e")


def placement(incoming: DataFrame, branches: DataFrame) -> DataFrame:
    """``placement`` of incoming segments (peer, container, idx_start, idx_end, prev_hash, end_hash).

    empty, first, exists (its end is a head), exact (it begins at a head), overlaps (a head lies
    beyond its begin), no_anchor.
    """
    key = ["peer", "container", "size", "hash"]
    heads = branches.select(*LOG, F.col("head_size").alias("size"), F.col("head_hash").alias("hash"))
    logs = heads.groupBy(*LOG).agg(F.max("size").alias("_most"))
    known = heads.distinct()

    def at(df: DataFrame, size: str, hash_: str, name: str) -> DataFrame:
        h = known.select(*[F.col(c).alias(f"_{c}") for c in key], F.lit(True).alias(name))
        on = (df["peer"] == h["_peer"]) & (df["container"] == h["_container"]) & (df[size] == h["_size"]) & (df[hash_] == h["_hash"])
        return df.join(h, on, "left").drop(*[f"_{c}" for c in key])

    seen = at(at(incoming, "idx_end", "end_hash", "_end"), "idx_start", "prev_hash", "_begin").join(logs, LOG, "left")
    how = (
        F.when(F.col("idx_end") <= F.col("idx_start"), "empty")
        .when(F.col("_most").isNull(), F.when(F.col("idx_start") == 0, "first").otherwise("no_anchor"))
        .when(F.col("_end"), "exists")
        .when(F.col("_begin"), "exact")
        .when(F.col("_most") > F.col("idx_start"), "overlaps")
        .otherwise("no_anchor")
    )
    return seen.withColumn("placement", how).drop("_end", "_begin", "_most")


def head_placement(start: Column, end: Column, head: Column, hash_at_head: Column, head_hash: Column) -> Column:
    """How a body attaches to a head: nothing_new, exact, suffix, or mismatch if it isn't on the head's line."""
    return F.when(end <= head, "nothing_new").when(~hash_at_head.eqNullSafe(head_hash), "mismatch").when(start == head, "exact").otherwise("suffix")


def slices(points: DataFrame, ranges: DataFrame, by: list[str], idx: str, start: str, end: str) -> tuple[DataFrame, DataFrame]:
    """Ranges as pieces, and points, with the ``_slice`` they fall in.

    Each ``by`` has slices of about its ranges' mean length, a power of two, so that a point meets
    the few ranges of its slice, not all of its ``by``, and a ``by`` that is hot falls apart. Empty ranges hold nothing.
    """
    s = ranges.where(F.col(start) < F.col(end))
    mean = F.avg(F.col(end).cast("double") - F.col(start).cast("double"))
    bits = s.groupBy(*by).agg(F.least(F.ceil(F.log2(mean)), F.lit(62)).cast("int").alias("_bits"))
    pieces = s.join(bits, by).withColumn("_slice", F.explode(F.expr(f"sequence(shiftright(`{start}`, _bits), shiftright(`{end}` - 1, _bits))"))).drop("_bits")
    return pieces, points.join(bits, by).withColumn("_slice", F.expr(f"shiftright(`{idx}`, _bits)")).drop("_bits")


def lookup(points: DataFrame, segments: DataFrame) -> DataFrame:
    """Segments that hold the entries asked for: (branch_id, idx) with start_idx <= idx < end_size. Overlapping segments all count."""
    pieces, asked = slices(points, segments.select("branch_id", "start_idx", "end_size", "len").distinct(), ["branch_id"], "idx", "start_idx", "end_size")
    return asked.join(pieces, ["branch_id", "_slice"]).where("start_idx <= idx AND idx < end_size").drop("_slice")


def tips(packs: DataFrame, by: list[str]) -> DataFrame:
    """Packs that no pack of the same ``by`` names as a parent or supersedes."""
    own = packs.select(*by, "pack_id", "seq_end").distinct()
    named = packs.select(*by, F.explode(F.concat(F.coalesce("parents", F.array().cast("array<struct<id:bigint,end_seq:bigint>>")), F.coalesce("self_supersedes", F.array().cast("array<struct<id:bigint,end_seq:bigint>>")))).alias("r"))
    gone = named.select(*by, F.col("r.id").alias("pack_id"), F.col("r.end_seq").alias("seq_end")).distinct()
    return own.join(gone, [*by, "pack_id", "seq_end"], "left_anti")


def heads_by_log(branches: DataFrame) -> DataFrame:
    """Per log the sorted heads of its branches. The branches of one log are few; entries aren't gathered."""
    return branches.groupBy(*LOG).agg(F.sort_array(F.collect_list(F.struct("head_size", F.hex("head_hash").alias("head_hash")))).alias("heads"))
