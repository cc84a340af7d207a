"""Queries of the data-pipeline problems 1 to 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfold.operators import changefeed, delivery, packfiles, references, synclog
from loomfold.operators.references import matching, orphan_keys
from loomfold.session import table, work_folder
from loomfold.sources.versioned import VersionedTable
from loomfold.streaming import compactor


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return synclog.to_handle(spark, folder).select("record_type", "record_id")


def p1_backlog(spark: SparkSession, folder: str) -> DataFrame:
    """Per replica and kind: records waiting and the greatest version among them."""
    return synclog.to_handle(spark, folder).groupBy("record_type", "replica").agg(F.count("*").alias("n_waiting"), F.max("version").alias("newest_version"))


def _named_log(log_id):
    """A log's bytes, peer and container, by its text; text that isn't of whole bytes stays text, which names no log."""
    text = F.regexp_replace(F.lower(log_id), "[^0-9a-f]", "")
    return F.when(F.length(text) % 2 == 0, F.unhex(text)).otherwise(text.cast("binary"))


def _references(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """All references and the orphans among them, repeated where their rows are: (ref_table, row_id, ref_pos, at)."""
    packs = packfiles.identified(table(spark, folder, "packs"))
    refs = packfiles.parent_references(packs).select("row_id", "ref_pos", "pack_id", "seq_end", F.col("received_at").alias("at"))
    lost = orphan_keys(refs, packs.where("deleted_at IS NULL").select("pack_id", "seq_end"), ["pack_id"], "seq_end")
    pack_orphans = matching(refs, lost, ["pack_id", "seq_end"])

    deps = table(spark, folder, "log_deps").select(F.col("dep_id").alias("row_id"), F.lit(0).cast("bigint").alias("ref_pos"), _named_log(F.col("log_id")).alias("log"), F.col("log_size").alias("size"), "hash_prefix", F.col("noted_at").alias("at"))
    peers = table(spark, folder, "peers").select(F.col("id").alias("peer"), "peer_id")
    living = table(spark, folder, "branches").where("deleted_at IS NULL").join(peers, "peer").select(F.col("id").alias("branch_id"), F.concat("peer_id", "container").alias("log"))
    heads = table(spark, folder, "segments").join(living, "branch_id").select("log", F.col("end_size").alias("size"), "end_hash")
    # Without a prefix any living branch of the log will do: such a reference is to the log's place 0, which every one has.
    bare, exact = F.col("hash_prefix").isNull().alias("bare"), F.col("hash_prefix").isNotNull()
    placed = deps.select("log", F.when(bare, 0).otherwise(F.col("size")).alias("size"), "hash_prefix", bare, "row_id", "ref_pos", "at")
    places = heads.select("log", "size", F.lit(False).alias("bare")).unionByName(living.select("log", F.lit(0).cast("bigint").alias("size"), F.lit(True).alias("bare")))
    asked = placed.select("log", "bare", "size", "hash_prefix").distinct()
    nowhere = orphan_keys(asked, places, ["log", "bare"], "size")
    # Where a head is there, its hash has to begin with the prefix.
    reached = matching(asked.where(exact), nowhere, ["log", "bare", "size"], "left_anti")
    h = heads.distinct().select(F.col("log").alias("_log"), F.col("size").alias("_size"), "end_hash")
    wrong = reached.join(h, (F.col("log") == F.col("_log")) & (F.col("size") == F.col("_size")) & F.startswith("end_hash", "hash_prefix"), "left_anti")
    lost = matching(asked, nowhere, ["log", "bare", "size"]).unionByName(wrong)
    dep_orphans = matching(placed, lost, ["log", "bare", "size", "hash_prefix"])

    columns = ["ref_table", "row_id", "ref_pos", "at"]
    everything = refs.withColumn("ref_table", F.lit("packs")).select(columns).unionByName(deps.withColumn("ref_table", F.lit("log_deps")).select(columns))
    orphans = pack_orphans.withColumn("ref_table", F.lit("packs")).select(columns).unionByName(dep_orphans.withColumn("ref_table", F.lit("log_deps")).select(columns))
    return everything, orphans


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return _references(spark, folder)[1].select("ref_table", "row_id", "ref_pos").distinct()


def p2_report(spark: SparkSession, folder: str) -> DataFrame:
    everything, orphans = _references(spark, folder)
    return references.report(orphans.distinct(), everything.distinct(), "at")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return delivery.dropped_deliveries(table(spark, folder, "packs"))


def p3_kept(spark: SparkSession, folder: str) -> DataFrame:
    return delivery.kept_packs(table(spark, folder, "packs"), []).select("delivery_id", "pack_id", "seq_end", "generation")


def current_state(spark: SparkSession, folder: str) -> DataFrame:
    target = VersionedTable(spark, work_folder(spark, "row-state"), changefeed.ROW_OPS.schema)
    changefeed.apply(spark, table(spark, folder, "row_ops"), target, changefeed.ROW_OPS)
    return changefeed.live(target.read(), changefeed.ROW_OPS)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return changefeed.cells(current_state(spark, folder), changefeed.ROW_OPS)


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select("k0", "k1", "upsert_ts", "delete_ts", "body", "n", F.hex("who").alias("who"))


def p4_rows(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(current_state(spark, folder))


def p4_incremental(spark: SparkSession, folder: str) -> DataFrame:
    """The rows after four runs, each with what arrived since the one before; later runs meet stored rows."""
    ops = table(spark, folder, "row_ops")
    target = VersionedTable(spark, work_folder(spark, "row-state"), changefeed.ROW_OPS.schema)
    at = F.col("arrived_at").cast("timestamp").cast("double")
    cuts = ops.agg(*[F.percentile_approx(at, p, 1000).alias(f"c{p}") for p in (0.25, 0.5, 0.75)]).first()
    for i, high in enumerate([*cuts, None]):
        low = cuts[i - 1] if i else None
        here = F.lit(True) if low is None else at > low
        here = here & (at <= high) if high is not None else here
        changefeed.apply(spark, ops.where(F.coalesce(here, F.lit(i == 0))), target, changefeed.ROW_OPS)
    return _shown(changefeed.live(target.read(), changefeed.ROW_OPS))


def _compacted(spark: SparkSession, packs: str, batch_files: int = compactor.BATCH_FILES) -> VersionedTable:
    taken = compactor.ingest(spark, packs, batch_files=batch_files)
    target = VersionedTable(spark, work_folder(spark, "compacted"), compactor.OUTPUT)
    compactor.compact(spark, taken, target)
    return target


def _segments_shown(target: VersionedTable) -> DataFrame:
    s = compactor.output_segments(target.read())
    return s.select("peer", F.hex("container_id").alias("container"), "idx_start", "idx_end", F.hex("end_chain_hash").alias("end_chain_hash"), "pack_id", "seq_end", "body_start", "body_end")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return compactor.output_packs(_compacted(spark, f"{folder}/packs.parquet").read(), compactor.SMALL_BYTES)


def p5_segments(spark: SparkSession, folder: str) -> DataFrame:
    return _segments_shown(_compacted(spark, f"{folder}/packs.parquet"))


def p5_small_files(spark: SparkSession, folder: str) -> DataFrame:
    """The same from packs in a hundred small files, that come in two lots and are compacted after each, in several batches."""
    root, packs = work_folder(spark, "small-files"), table(spark, folder, "packs")
    target = VersionedTable(spark, f"{root}/out", compactor.OUTPUT)
    for half in (0, 1):
        packs.where(F.pmod(F.xxhash64("delivery_id"), F.lit(2)) == half).repartition(50).write.mode("append").parquet(f"{root}/in/packs")
        taken = compactor.ingest(spark, f"{root}/in/packs", f"{root}/work", batch_files=20)
        compactor.compact(spark, taken, target)
    return _segments_shown(target)


# Shared pieces of the SQL equivalents.
_PACKS = r"""
named AS (SELECT *, regexp_extract(coalesce(file_name, ''), '^\s*(?:.*/)?([0-9a-f]{1,16})-([0-9a-f]{1,16})-([0-9a-f]{1,16})-([0-9a-f]{1,16})(?:\.uqp(?:\.meta)?)?\s*$', ['a', 'b', 'c', 'd'], 'i') AS f FROM packs),
idp AS (SELECT delivery_id, received_at, peer, parents, self_supersedes, self_segments, peer_data, body_len, deleted_at,
  coalesce(seq_start, try_cast('0x' || f.a AS BIGINT)) AS seq_start, coalesce(seq_end, try_cast('0x' || f.b AS BIGINT)) AS seq_end,
  coalesce(pack_id, try_cast('0x' || f.c AS BIGINT)) AS pack_id, coalesce(generation, try_cast('0x' || f.d AS BIGINT)) AS generation FROM named)"""
_KEPT = (
    _PACKS
    + """,
ranked AS (SELECT *, row_number() OVER (PARTITION BY pack_id, seq_end ORDER BY generation DESC NULLS LAST, received_at NULLS LAST, delivery_id) AS r FROM idp),
self_s AS (SELECT s.id AS pack_id, s.end_seq AS seq_end FROM (SELECT unnest(self_supersedes) AS s FROM packs)),
peer_p AS (SELECT unnest(peer_data) AS p FROM packs),
peer_s AS (SELECT p.peer AS peer, unnest(p.supersedes) AS s FROM peer_p),
kept AS (SELECT * FROM ranked k WHERE r = 1
  AND NOT EXISTS (SELECT 1 FROM self_s x WHERE x.pack_id = k.pack_id AND x.seq_end = k.seq_end)
  AND NOT EXISTS (SELECT 1 FROM peer_s x WHERE x.peer = k.peer AND x.s.id = k.pack_id AND x.s.seq_start = k.seq_start AND x.s.seq_end = k.seq_end AND x.s.generation = k.generation))"""
)
_WAITING = """
c AS (SELECT replica, branch_id, max(struct_pack(v := changed_at, s := seen_at, i := change_id)) AS m FROM branch_changes GROUP BY ALL),
p AS (SELECT replica, pack_id, seq_end, max(struct_pack(v := last_ts, s := seen_at, i := todo_id)) AS m FROM pack_reads GROUP BY ALL),
ok AS (SELECT * FROM sync_runs WHERE lower(trim(status)) = 'ok'),
waiting AS (SELECT 'change' AS record_type, replica, m.i AS record_id, m.v AS version FROM c WHERE NOT EXISTS (SELECT 1 FROM ok WHERE ok.replica = c.replica AND ok.started_at >= m.s AND ok.stamp_from < m.v AND m.v <= ok.stamp_to)
UNION ALL SELECT 'pack', replica, m.i, m.v FROM p WHERE NOT EXISTS (SELECT 1 FROM ok WHERE ok.replica = p.replica AND ok.started_at >= m.s AND ok.wall_from < m.v AND m.v <= ok.wall_to))"""
_ORPHANS = (
    _PACKS
    + """,
refs AS (SELECT DISTINCT delivery_id AS row_id, pos - 1 AS ref_pos, parents[pos].id AS pid, parents[pos].end_seq AS es, received_at AS noted FROM (SELECT *, unnest(generate_series(1, len(parents))) AS pos FROM packs) WHERE parents[pos] IS NOT NULL),
alive AS (SELECT DISTINCT pack_id, seq_end FROM idp WHERE deleted_at IS NULL),
deps AS (SELECT DISTINCT dep_id AS row_id, regexp_replace(lower(log_id), '[^0-9a-f]', '', 'g') AS log, log_size, lower(hex(hash_prefix)) AS prefix, noted_at AS noted FROM log_deps),
living AS (SELECT b.id, lower(hex(p.peer_id) || hex(b.container)) AS log FROM branches b JOIN peers p ON p.id = b.peer WHERE b.deleted_at IS NULL),
heads AS (SELECT DISTINCT log, end_size, lower(hex(end_hash)) AS h FROM segments s JOIN living l ON l.id = s.branch_id),
everything AS (SELECT 'packs' AS ref_table, row_id, ref_pos, noted, NOT EXISTS (SELECT 1 FROM alive a WHERE a.pack_id = refs.pid AND a.seq_end = refs.es) AS lost FROM refs
UNION ALL SELECT 'log_deps', row_id, 0, noted, CASE WHEN prefix IS NULL THEN log NOT IN (SELECT log FROM living) ELSE NOT EXISTS (SELECT 1 FROM heads h WHERE h.log = deps.log AND h.end_size = deps.log_size AND starts_with(h.h, deps.prefix)) END FROM deps)"""
)
_FOLD = """
ops AS (SELECT *, lower(substring(trim(kind), 1, 1)) = 'u' AS up FROM row_ops WHERE k0 IS NOT NULL AND k1 IS NOT NULL AND ts >= 1 AND lower(substring(trim(kind), 1, 1)) IN ('u', 'd')),
f AS (SELECT k0, k1, coalesce(max(ts) FILTER (WHERE up), 0) AS u, coalesce(max(ts) FILTER (WHERE NOT up), 0) AS d,
  max(struct_pack(t := ts, p := body IS NOT NULL, v := body)) FILTER (WHERE up AND body_set) AS mb,
  max(struct_pack(t := ts, p := n IS NOT NULL, v := n)) FILTER (WHERE up AND n_set) AS mn,
  max(struct_pack(t := ts, p := who IS NOT NULL, v := who)) FILTER (WHERE up AND who_set) AS mw FROM ops GROUP BY ALL),
live AS (SELECT k0, k1, u, d, CASE WHEN mb.t >= d THEN mb END AS mb, CASE WHEN mn.t >= d THEN mn END AS mn, CASE WHEN mw.t >= d THEN mw END AS mw FROM f WHERE u >= 1 AND u >= d)"""

_P4_ROWS = f"WITH {_FOLD} SELECT k0, k1, u AS upsert_ts, nullif(d, 0) AS delete_ts, mb.v AS body, mn.v AS n, hex(mw.v) AS who FROM live"

_P5_SEGMENTS = f"""WITH {_KEPT}, cur AS (SELECT * FROM kept WHERE deleted_at IS NULL),
pd AS (SELECT pack_id, seq_end, unnest(peer_data) AS p FROM cur),
seg AS (SELECT pack_id, seq_end, peer, unnest(self_segments) AS s FROM cur UNION ALL SELECT pack_id, seq_end, p.peer, unnest(p.segments) FROM pd),
one AS (SELECT *, row_number() OVER (PARTITION BY peer, s.container_id, s.idx_start, s.idx_end, s.end_chain_hash ORDER BY pack_id, seq_end, s.body_start) AS r FROM seg WHERE s IS NOT NULL)
SELECT peer, hex(s.container_id) AS container, s.idx_start AS idx_start, s.idx_end AS idx_end, hex(s.end_chain_hash) AS end_chain_hash, pack_id, seq_end, s.body_start AS body_start, s.body_end AS body_end FROM one WHERE r = 1"""

QUERIES = {
    "p1_found": (p1_found, f"WITH {_WAITING} SELECT record_type, record_id FROM waiting"),
    "p1_backlog": (p1_backlog, f"WITH {_WAITING} SELECT record_type, replica, count(*) AS n_waiting, max(version) AS newest_version FROM waiting GROUP BY ALL"),
    "p2_found": (p2_found, f"WITH {_ORPHANS} SELECT DISTINCT ref_table, row_id, ref_pos FROM everything WHERE lost"),
    "p2_report": (p2_report, f"WITH {_ORPHANS} SELECT ref_table, coalesce(strftime(noted, '%Y-%m'), 'unknown') AS period, count(*) AS n_references, count(*) FILTER (WHERE lost) AS n_orphans, count(*) FILTER (WHERE lost) * 1000000 // count(*) AS orphans_ppm FROM everything GROUP BY ALL"),
    "p3_found": (p3_found, f"WITH {_KEPT} SELECT delivery_id FROM packs WHERE delivery_id NOT IN (SELECT delivery_id FROM kept)"),
    "p3_kept": (p3_kept, f"WITH {_KEPT} SELECT delivery_id, pack_id, seq_end, generation FROM kept"),
    "p4_found": (p4_found, f"WITH {_FOLD} SELECT k0, k1, 'row' AS cell, u AS ts FROM live UNION ALL SELECT k0, k1, 'body', mb.t FROM live WHERE mb.p UNION ALL SELECT k0, k1, 'n', mn.t FROM live WHERE mn.p UNION ALL SELECT k0, k1, 'who', mw.t FROM live WHERE mw.p"),
    "p4_rows": (p4_rows, _P4_ROWS),
    "p4_incremental": (p4_incremental, _P4_ROWS),
    "p5_found": (p5_found, f"WITH {_KEPT} SELECT pack_id, seq_end FROM kept WHERE deleted_at IS NULL AND coalesce(body_len, greatest(list_max([s.body_end FOR s IN self_segments]), list_max(flatten([[s.body_end FOR s IN p.segments] FOR p IN peer_data])))) < 16384"),
    "p5_segments": (p5_segments, _P5_SEGMENTS),
    "p5_small_files": (p5_small_files, _P5_SEGMENTS),
}
