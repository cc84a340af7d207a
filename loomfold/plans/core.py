"""Queries of the engine's own operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomfold.functions import ids, scalar
from loomfold.operators import cells as longform
from loomfold.operators import chains, clock, compare, delivery, feed, fold, local, logs, packfiles, validate
from loomfold.plans import fixtures as fx
from loomfold.query import Store
from loomfold.session import table

Q: dict[str, tuple] = {}


def query(name: str, sql: str | None):
    def add(f):
        Q[name] = (f, sql)
        return f

    return add


def _live_sql(ops: str, t, hexed: tuple[str, ...] = ()) -> str:
    cols = ", ".join([*t.keys, *[f"{'hex(' if c.name in hexed else ''}{fx.shown(c.name)}{')' if c.name in hexed else ''} AS {c.name}" for c in t.values]])
    return f"WITH {fx.fold_sql(ops, t)} SELECT {cols} FROM f WHERE u >= d"


def _hexed(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.hex(c) for c in columns})


# --- the merge -----------------------------------------------------------------------------


@query("fold_live_fine", _live_sql(fx.user_ops_sql(fx.FINE), fx.USER_STATE))
def fold_live_fine(spark: SparkSession, d: str) -> DataFrame:
    return fold.fold(fx.user_ops(spark, d, fx.FINE), fx.USER_STATE)


@query("fold_live_coarse", _live_sql(fx.user_ops_sql(fx.COARSE), fx.USER_STATE))
def fold_live_coarse(spark, d):
    return fold.fold(fx.user_ops(spark, d, fx.COARSE), fx.USER_STATE)


@query("fold_composite_lineitem", _live_sql(fx.LINE_OPS, fx.LINE_STATE))
def fold_composite_lineitem(spark, d):
    return fold.fold(fx.line_ops(spark, d), fx.LINE_STATE)


@query("fold_three_pk", _live_sql(fx.PART_OPS, fx.PART_STATE, ("tag",)))
def fold_three_pk(spark, d):
    return _hexed(fold.fold(fx.part_ops(spark, d), fx.PART_STATE), "tag")


@query("fold_row_ops", _live_sql(fx.ROW_OPS, fx.ROW_STATE, ("who",)))
def fold_row_ops(spark, d):
    return _hexed(fold.fold(fx.row_ops(spark, d), fx.ROW_STATE), "who")


@query(
    "fold_physical",
    f"WITH {fx.fold_sql(fx.user_ops_sql(fx.COARSE), fx.USER_STATE)} SELECT user_id, coalesce(u, 0) AS upsert_ts, d AS deleted_ts, {fx.shown('page')} AS page, CASE WHEN m_page.t >= d THEN m_page.t ELSE 0 END AS page_lww, {fx.shown('score')} AS score, CASE WHEN m_score.t >= d THEN m_score.t ELSE 0 END AS score_lww FROM f",
)
def fold_physical(spark, d):
    return fold.physical(fold.partials(fx.user_ops(spark, d, fx.COARSE), fx.USER_STATE), fx.USER_STATE)


@query("fold_tombstones", f"WITH {fx.fold_sql(fx.LINE_OPS, fx.LINE_STATE)} SELECT k0, k1, d AS deleted_ts FROM f WHERE u IS NULL OR u < d")
def fold_tombstones(spark, d):
    t = fx.LINE_STATE
    return fold.physical(fold.partials(fx.line_ops(spark, d), t), t).where("upsert_ts < deleted_ts").select("k0", "k1", "deleted_ts")


@query("fold_explicit_null", f"WITH {fx.fold_sql(fx.LINE_OPS, fx.LINE_STATE)} SELECT k0, k1, m_flag.t AS flag_ts FROM f WHERE u >= d AND m_flag.t >= d AND NOT m_flag.p")
def fold_explicit_null(spark, d):
    """Rows that show a null because it was set, not because nothing was."""
    t = fx.LINE_STATE
    s = fold.physical(fold.partials(fx.line_ops(spark, d), t), t)
    return s.where("upsert_ts >= deleted_ts AND flag_lww >= 1 AND flag IS NULL").select("k0", "k1", F.col("flag_lww").alias("flag_ts"))


def _ties_sql(ops: str, t, c: str, out: str) -> str:
    keys = ", ".join(t.keys)
    return f"WITH {ops}, x AS (SELECT {keys}, ts, count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS n, max({c}) AS v FROM ops WHERE kind = 'U' AND {c}_set AND ts >= 1 GROUP BY {keys}, ts) SELECT {keys}, ts, {out} AS winner FROM x WHERE n > 1"


def _ties(ops: DataFrame, t, c: str) -> DataFrame:
    """The winner wherever several values meet at one stamp."""
    x = ops.where(f"kind = 'U' AND {c}_set AND ts >= 1").groupBy(*t.keys, "ts").agg((F.count_distinct(c) + F.max(F.col(c).isNull().cast("int"))).alias("n"), F.max(F.struct("ts", c)).alias("m"))
    return x.where("n > 1").select(*t.keys, "ts", F.col("m")[c].alias("winner"))


@query("fold_tiebreak_text", _ties_sql(fx.user_ops_sql(fx.COARSE), fx.USER_STATE, "page", "v"))
def fold_tiebreak_text(spark, d):
    return _ties(fx.user_ops(spark, d, fx.COARSE), fx.USER_STATE, "page")


@query("fold_tiebreak_i64", _ties_sql(fx.user_ops_sql(fx.COARSE), fx.USER_STATE, "score", "v"))
def fold_tiebreak_i64(spark, d):
    return _ties(fx.user_ops(spark, d, fx.COARSE), fx.USER_STATE, "score")


@query("fold_tiebreak_bytes", _ties_sql(fx.ROW_OPS, fx.ROW_STATE, "who", "hex(v)"))
def fold_tiebreak_bytes(spark, d):
    return _hexed(_ties(fx.row_ops(spark, d), fx.ROW_STATE, "who"), "winner")


_UNTIL = fx.user_ops_sql(fx.COARSE).replace("FROM events)", "FROM events WHERE date_diff('day', DATE '2023-12-31', CAST(ts AS DATE)) <= 15)")


@query("fold_as_of", _live_sql(_UNTIL, fx.USER_STATE))
def fold_as_of(spark, d):
    return fold.as_of(fx.user_ops(spark, d, fx.COARSE), fx.USER_STATE, 15)


@query("fold_snapshot_delta", _live_sql(fx.LINE_OPS, fx.LINE_STATE))
def fold_snapshot_delta(spark, d):
    """Partials of the older and of the newer half of the operations, merged."""
    t, ops = fx.LINE_STATE, fx.line_ops(spark, d)
    return fold.live(fold.merge(fold.partials(ops.where("ts < 0 OR ts <= 800"), t), fold.partials(ops.where("ts > 800"), t), table=t), t)


@query("row_history", f"WITH {fx.user_ops_sql(fx.FINE)} SELECT user_id, ts, kind, CASE WHEN page_set AND kind = 'U' THEN page END AS page, CASE WHEN score_set AND kind = 'U' THEN score END AS score, row_number() OVER (PARTITION BY user_id ORDER BY ts, seq) AS version FROM ops")
def row_history(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "seq")
    mine = lambda c: F.when(F.col(f"{c}_set") & (F.col("kind") == "U"), F.col(c)).alias(c)
    return fx.user_ops(spark, d, fx.FINE).select("user_id", "ts", "kind", mine("page"), mine("score"), F.row_number().over(w).alias("version"))


@query("cells_fold", f"WITH {fx.fold_sql(fx.LINE_OPS, fx.LINE_STATE)}, live AS (SELECT * FROM f WHERE u >= d) SELECT k0, k1, -1 AS column_id, u AS ts, NULL::VARCHAR AS value FROM live " + " ".join(f"UNION ALL SELECT k0, k1, {c.column_id}, m_{c.name}.t, m_{c.name}.v::VARCHAR FROM live WHERE m_{c.name}.t >= d" for c in fx.LINE_STATE.values))
def cells_fold(spark, d):
    long = longform.widen(fx.line_ops(spark, d), fx.LINE_STATE, ["k0", "k1"])
    return longform.fold(long).select("pk.k0", "pk.k1", "column_id", "ts", longform.as_text(F.col("value")).alias("value"))


@query("cells_pivot_equals_wide", _live_sql(fx.LINE_OPS, fx.LINE_STATE))
def cells_pivot_equals_wide(spark, d):
    long = longform.widen(fx.line_ops(spark, d), fx.LINE_STATE, ["k0", "k1"])
    return longform.pivot(longform.fold(long), fx.LINE_STATE).select("pk.k0", "pk.k1", "qty", "flag", "price")


# --- ids and checks --------------------------------------------------------------------------


@query(
    "table_id_decode",
    """WITH x AS (SELECT o_orderkey AS k, CAST(o_orderkey * 7919 % 65536 AS INTEGER) AS id FROM orders), y AS (SELECT *, (id >> 14) + 1 AS n FROM x)
SELECT k, id, n AS key_count, (id >> 12) & 3 AS type0, CASE WHEN n > 1 THEN (id >> 10) & 3 END AS type1, CASE WHEN n > 2 THEN (id >> 8) & 3 END AS type2, CASE WHEN n > 3 THEN (id >> 6) & 3 END AS type3,
id & ((1 << (14 - 2 * n)) - 1) AS idx, 't__t0x' || lower(printf('%04x', id)) AS name, id AS packed FROM y""",
)
def table_id_decode(spark, d):
    x = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.expr("cast(o_orderkey * 7919 % 65536 AS int)").alias("id"))
    t = [ids.key_type(F.col("id"), i) for i in range(4)]
    idx = ids.table_index(F.col("id"))
    packed = F.coalesce(*[F.when(ids.key_count(F.col("id")) == n, ids.pack_table_id(idx, t[:n])) for n in range(1, 5)])
    return x.select("k", "id", ids.key_count(F.col("id")).alias("key_count"), *[c.alias(f"type{i}") for i, c in enumerate(t)], idx.alias("idx"), ids.table_name("t", F.col("id")).alias("name"), packed.alias("packed"))


@query("column_id_decode", "SELECT p_partkey AS k, p_partkey * 31 % 256 AS id, p_partkey * 31 % 256 >> 6 AS kind, p_partkey * 31 % 256 & 63 AS idx, list_value('bytes', 'text', 'i64', 'uuid')[CAST((p_partkey * 31 % 256 >> 6) + 1 AS INTEGER)] AS kind_name, printf('c0x%02x_lww', CAST(p_partkey * 31 % 256 AS INTEGER)) AS name, p_partkey * 31 % 256 AS parsed FROM part")
def column_id_decode(spark, d):
    x = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.expr("p_partkey * 31 % 256").alias("id"))
    name = ids.column_name(F.col("id"), stamp=True)
    return x.select("k", "id", ids.column_type(F.col("id")).alias("kind"), ids.column_index(F.col("id")).alias("idx"), ids.type_name(ids.column_type(F.col("id"))).alias("kind_name"), name.alias("name"), ids.parse_column_name(name).alias("parsed"))


@query(
    "op_validation_rejects",
    """SELECT seq, CASE WHEN ts IS NULL OR ts < 1 THEN 'no stamp' WHEN upper(substring(trim(kind), 1, 1)) NOT IN ('U', 'D') THEN 'unknown kind' WHEN k0 IS NULL OR k1 IS NULL THEN 'wrong number of key values'
WHEN body_set AND n_set AND seq % 5 = 0 THEN 'column named twice' WHEN n_set AND n IS NOT NULL AND seq % 7 = 0 THEN 'wrong type of a column''s value' END AS reason FROM row_ops
WHERE ts IS NULL OR ts < 1 OR k0 IS NULL OR k1 IS NULL OR body_set AND n_set AND seq % 5 = 0 OR n_set AND n IS NOT NULL AND seq % 7 = 0""".replace("WHEN body_set AND n_set AND seq % 5 = 0 THEN 'column named twice' WHEN n_set AND n IS NOT NULL AND seq % 7 = 0 THEN 'wrong type of a column''s value' END", "WHEN n_set AND n IS NOT NULL AND seq % 7 = 0 THEN 'wrong type of a column''s value' WHEN body_set AND n_set AND seq % 5 = 0 THEN 'column named twice' END"),
)
def op_validation_rejects(spark, d):
    """All operations in general form; some are damaged by their seq so that every reason occurs."""
    t = fx.ROW_STATE
    none = {"b": "binary", "t": "string", "i": "bigint", "u": "binary"}
    value = lambda **v: F.struct(*[v.get(k, F.lit(None)).cast(kind).alias(k) for k, kind in none.items()])
    body, n = t.values[0].column_id, t.values[1].column_id
    on = lambda c: F.coalesce(F.col(f"{c}_set"), F.lit(False))
    wrong = F.col("seq") % 7 == 0
    key = F.filter(F.array(F.when(F.col("k0").isNotNull(), value(t=F.col("k0"))), F.when(F.col("k1").isNotNull(), value(i=F.col("k1")))), lambda v: v.isNotNull())
    sets = F.array(F.when(on("body") & F.col("body").isNotNull(), F.struct(F.lit(body).alias("column_id"), value(t=F.col("body")).alias("value"))), F.when(on("n") & F.col("n").isNotNull(), F.struct(F.lit(n).alias("column_id"), F.when(wrong, value(t=F.col("n").cast("string"))).otherwise(value(i=F.col("n"))).alias("value"))))
    nulls = F.array(F.when(on("body") & F.col("body").isNull(), F.lit(body)), F.when(on("n") & F.col("n").isNull(), F.lit(n)), *[F.when(on("body") & on("n") & (F.col("seq") % 5 == 0), F.lit(body))])
    ops = fx.row_ops(spark, d).select("seq", F.lit(t.table_id).alias("table_id"), "kind", "ts", key.alias("pk"), F.filter(sets, lambda s: s.isNotNull()).alias("sets"), F.filter(nulls, lambda s: s.isNotNull()).alias("nulls"))
    return validate.split(ops)[1].select("seq", "reason")


@query("hlc_pack_unpack", "SELECT event_id, ((epoch_us(ts) // 1000) << 16) + event_id % 65536 AS stamp, (epoch_us(ts) // 1000) AS millis, event_id % 65536 AS counter, strftime(ts, '%Y-%m-%d %H:%M') AS at FROM events")
def hlc_pack_unpack(spark, d):
    e = table(spark, d, "events").select("event_id", scalar.stamp(F.expr("unix_millis(cast(ts AS timestamp))"), F.expr("event_id % 65536")).alias("stamp"))
    s = F.col("stamp")
    return e.select("event_id", "stamp", scalar.stamp_millis(s).alias("millis"), scalar.stamp_counter(s).alias("counter"), F.date_format(scalar.stamp_time(s), "yyyy-MM-dd HH:mm").alias("at"))


@query("hash_tagged", "SELECT id, lower(hex(peer_id)) AS peer_hex, sha256(CAST('loom1/PeerInit' AS BLOB) || unhex('0000') || peer_id) AS init_hash, hex(peer_id) AS parsed, octet_length(peer_id) = 16 AS is_uuid FROM peers")
def hash_tagged(spark, d):
    p = table(spark, d, "peers")
    h = scalar.peer_hex(F.col("peer_id"))
    return p.select("id", h.alias("peer_hex"), F.lower(F.hex(scalar.tagged_sha256("PeerInit", F.col("peer_id")))).alias("init_hash"), F.hex(scalar.parse_peer_hex(h)).alias("parsed"), scalar.is_uuid(F.col("peer_id")).alias("is_uuid"))


@query("peer_init_check", "WITH c AS (SELECT id, peer_id, CAST('app' AS BLOB) || CAST(coalesce(peer_label, '') AS BLOB) AS d FROM peers), x AS (SELECT *, unhex(sha256(CAST('loom1/PeerInit' AS BLOB) || unhex('0000') || d)) AS own FROM c) SELECT id, CASE WHEN id % 3 = 0 THEN peer_id ELSE own END = own AS genuine FROM x")
def peer_init_check(spark, d):
    """Init records made of the labels; every third claims another peer's id."""
    p = table(spark, d, "peers").withColumn("own", scalar.peer_of(F.lit(b"app"), F.coalesce(F.col("peer_label").cast("binary"), F.lit(b""))))
    return p.select("id", (F.when(F.col("id") % 3 == 0, F.col("peer_id")).otherwise(F.col("own")) == F.col("own")).alias("genuine"))


@query("peer_init_lookup", "SELECT hex(peer_id) AS peer_id, peer_label FROM peers WHERE id IN (SELECT peer FROM branches WHERE head_size > commit_size)")
def peer_init_lookup(spark, d):
    """The records of the authors whose logs lag."""
    wanted = _b(spark, d).where("head_size > commit_size").join(table(spark, d, "peers").select(F.col("id").alias("peer"), "peer_id"), "peer")
    return _hexed(logs.peer_inits(table(spark, d, "peers"), wanted).select("peer_id", "peer_label"), "peer_id")


@query("zigzag_text_checks", "SELECT seq, CAST(CASE WHEN x >= 9223372036854775808 THEN x - 18446744073709551616 ELSE x END AS BIGINT) AS zig, n AS back, body IS NOT NULL AND instr(body, chr(0)) = 0 AS is_text FROM (SELECT *, CASE WHEN n >= 0 THEN n::HUGEINT * 2 ELSE -(n::HUGEINT) * 2 - 1 END AS x FROM row_ops)")
def zigzag_text_checks(spark, d):
    z = scalar.zigzag(F.col("n"))
    return table(spark, d, "row_ops").select("seq", z.alias("zig"), scalar.unzigzag(z).alias("back"), F.coalesce(scalar.is_text(F.col("body")), F.lit(False)).alias("is_text"))


# --- feed and clock ---------------------------------------------------------------------------

_FEED = f"""{fx.user_ops_sql(fx.COARSE)}, pre AS (SELECT *, count(*) OVER w AS before, coalesce(max(CASE WHEN kind = 'D' THEN ts END) OVER w, 0) AS dd, coalesce(max(CASE WHEN kind = 'U' THEN ts END) OVER w, 0) AS uu,
coalesce(max(CASE WHEN kind = 'U' AND page_set THEN struct_pack(t := ts, p := page IS NOT NULL, v := coalesce(page, '')) END) OVER w, struct_pack(t := 0, p := false, v := '')) AS mp,
coalesce(max(CASE WHEN kind = 'U' AND score_set THEN struct_pack(t := ts, p := score IS NOT NULL, v := coalesce(score, 0)) END) OVER w, struct_pack(t := 0, p := false, v := 0)) AS ms
FROM ops WINDOW w AS (PARTITION BY user_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
eff AS (SELECT *, kind = 'U' AND page_set AND struct_pack(t := ts, p := page IS NOT NULL, v := coalesce(page, '')) >= mp AS cp, kind = 'U' AND score_set AND struct_pack(t := ts, p := score IS NOT NULL, v := coalesce(score, 0)) >= ms AS cs,
kind = 'U' AND page_set AND struct_pack(t := ts, p := page IS NOT NULL, v := coalesce(page, '')) > mp AS rp, kind = 'U' AND score_set AND struct_pack(t := ts, p := score IS NOT NULL, v := coalesce(score, 0)) > ms AS rs FROM pre),
feed AS (SELECT * FROM eff WHERE CASE WHEN kind = 'U' THEN before = 0 OR ts >= dd AND (ts > uu OR rp OR rs) ELSE before = 0 OR ts > dd END)"""


def _user_feed(spark, d) -> DataFrame:
    return feed.change_feed(fx.user_ops(spark, d, fx.COARSE), fx.USER_STATE)


@query("change_feed", f"WITH {_FEED} SELECT seq, user_id, kind, ts, CASE WHEN cp AND cs THEN 'page,score' WHEN cp THEN 'page' WHEN cs THEN 'score' ELSE '' END AS changed FROM feed")
def change_feed(spark, d):
    return _user_feed(spark, d).select("seq", "user_id", "kind", "ts", F.array_join("changed", ",").alias("changed"))


@query("watch_table", f"WITH {_FEED} SELECT kind, count(*) AS n, count(DISTINCT user_id) AS n_rows FROM feed GROUP BY kind")
def watch_table(spark, d):
    return feed.watch(_user_feed(spark, d)).groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("n_rows"))


@query("watch_row", f"WITH {_FEED} SELECT seq, kind, ts FROM feed WHERE user_id = 7")
def watch_row(spark, d):
    return feed.watch(_user_feed(spark, d), user_id=7).select("seq", "kind", "ts")


@query("feed_column_changes", f"""WITH {_FEED} SELECT seq, 'page' AS "column", CASE WHEN NOT cp THEN 'unchanged' WHEN page IS NULL THEN 'set_null' ELSE 'set' END AS change FROM feed WHERE kind = 'U' UNION ALL SELECT seq, 'score', CASE WHEN NOT cs THEN 'unchanged' WHEN score IS NULL THEN 'set_null' ELSE 'set' END FROM feed WHERE kind = 'U'""")
def feed_column_changes(spark, d):
    return feed.column_changes(_user_feed(spark, d), fx.USER_STATE)


_TICKS = "ticks AS (SELECT user_id, event_id, CASE WHEN event_id % 5 <> 0 THEN (epoch_us(ts) // 1000) END AS wall, CASE WHEN event_id % 5 = 0 THEN ((epoch_us(ts) // 1000) << 16) + 3 END AS remote FROM events)"


def _ticks(spark, d) -> DataFrame:
    ms = "unix_millis(cast(ts AS timestamp))"
    return table(spark, d, "events").selectExpr("user_id", "event_id", f"CASE WHEN event_id % 5 <> 0 THEN {ms} END AS wall", f"CASE WHEN event_id % 5 = 0 THEN shiftleft({ms}, 16) + 3 END AS remote")


@query("hlc_local", "WITH x AS (SELECT user_id, event_id, (epoch_us(ts) // 1000) << 16 AS c, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) SELECT user_id, event_id, n + greatest(0, max(c - n) OVER (PARTITION BY user_id ORDER BY event_id)) AS stamp FROM x")
def hlc_local(spark, d):
    e = table(spark, d, "events").selectExpr("user_id", "event_id", "unix_millis(cast(ts AS timestamp)) AS wall", "cast(NULL AS bigint) AS remote")
    return clock.assign(e, ["user_id"], "event_id").select("user_id", "event_id", "stamp")


@query("hlc_mixed", f"WITH {_TICKS}, x AS (SELECT *, count(wall) OVER (PARTITION BY user_id ORDER BY event_id) AS n, coalesce(wall << 16, remote + 1) AS c FROM ticks) SELECT user_id, event_id, n + greatest(0, max(c - n) OVER (PARTITION BY user_id ORDER BY event_id)) AS stamp FROM x")
def hlc_mixed(spark, d):
    return clock.assign(_ticks(spark, d), ["user_id"], "event_id").select("user_id", "event_id", "stamp")


@query("skew_rejects", "SELECT change_id, (changed_at >> 16) - (epoch_us(seen_at) // 1000) > 60000 AS rejected FROM (SELECT DISTINCT change_id, changed_at, seen_at FROM branch_changes)")
def skew_rejects(spark, d):
    b = table(spark, d, "branch_changes").select("change_id", "changed_at", "seen_at").distinct()
    return b.select("change_id", scalar.too_far_ahead(F.col("changed_at"), F.expr("unix_millis(cast(seen_at AS timestamp))")).alias("rejected"))


@query("skew_admission", "SELECT user_id, event_id, bool_and((epoch_us(ts) // 1000) <= (epoch_us(TIMESTAMP '2024-01-20') // 1000) + 60000) OVER (PARTITION BY user_id ORDER BY event_id) AS admitted FROM events")
def skew_admission(spark, d):
    """An entry ahead of the clock holds back its log's later entries."""
    e = table(spark, d, "events").selectExpr("user_id", "event_id", "shiftleft(unix_millis(cast(ts AS timestamp)), 16) AS ts")
    now = F.expr("unix_millis(TIMESTAMP'2024-01-20 00:00:00')")
    return clock.admitted(e, ["user_id"], "event_id", now).select("user_id", "event_id", "admitted")


@query("changed_at_increasing", "WITH x AS (SELECT o_custkey, o_orderkey, (epoch_us(o_orderdate) // 1000) // 86400000 AS wall, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) SELECT o_custkey, o_orderkey, n + max(wall - n) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS changed_at FROM x")
def changed_at_increasing(spark, d):
    o = table(spark, d, "orders").selectExpr("o_custkey", "o_orderkey", "unix_millis(cast(o_orderdate AS timestamp)) div 86400000 AS wall")
    return clock.increasing(o, ["o_custkey"], "o_orderkey", "wall", "changed_at").select("o_custkey", "o_orderkey", "changed_at")


@query("commit_prefix", "WITH o AS (SELECT DISTINCT peer, container, idx FROM row_ops WHERE idx >= 2), x AS (SELECT *, row_number() OVER (PARTITION BY peer, container ORDER BY idx) + 1 AS n FROM o) SELECT peer, hex(container) AS container, idx FROM x WHERE idx = n")
def commit_prefix(spark, d):
    """Entries of each log that follow size 2 without a gap."""
    o = table(spark, d, "row_ops").select("peer", "container", "idx").withColumn("committed", F.lit(2).cast("bigint"))
    return clock.committable(o, ["peer", "container"], "idx", "committed").select("peer", F.hex("container").alias("container"), "idx")


# --- logs ----------------------------------------------------------------------------------------

_STAMP = 103900000000000000


def _b(spark, d):
    return table(spark, d, "branches")


@query("changes_since", f"SELECT b.id, hex(p.peer_id) AS peer_id, hex(b.container) AS container, b.head_size, hex(b.head_hash) AS head_hash, b.changed_at FROM branches b JOIN peers p ON p.id = b.peer WHERE b.changed_at > {_STAMP} AND b.head_size > coalesce(b.fork_size, 0) ORDER BY b.changed_at, b.id LIMIT 1000")
def changes_since(spark, d):
    return _hexed(logs.changes_since(_b(spark, d), table(spark, d, "peers"), _STAMP), "peer_id", "container", "head_hash")


@query("logs_behind", "SELECT DISTINCT b.peer, hex(b.container) AS container, hex(p.peer_id) AS peer_id FROM branches b JOIN peers p ON p.id = b.peer WHERE commit_size < head_size")
def logs_behind(spark, d):
    return _hexed(logs.logs_behind(_b(spark, d), table(spark, d, "peers")), "container", "peer_id")


_PUBLISHED = "published AS (SELECT n % 3 AS remote_id, id AS branch_id, commit_size AS published_size, CASE WHEN id % 2 = 0 THEN changed_at >> 16 END AS pending_since FROM branches)"
_CONTAINERS = "containers AS (SELECT DISTINCT container, CASE WHEN ascii(right(hex(container), 1)) % 2 = 0 THEN 1 END AS topic FROM branches)"


def _published(spark, d):
    return _b(spark, d).selectExpr("n % 3 AS remote_id", "id AS branch_id", "commit_size AS published_size", "CASE WHEN id % 2 = 0 THEN shiftright(changed_at, 16) END AS pending_since")


def _containers(spark, d):
    return _b(spark, d).select("container").distinct().selectExpr("container", "CASE WHEN ascii(right(hex(container), 1)) % 2 = 0 THEN 1 END AS topic")


_DUE = 1585000000000


_PLAN = f"""WITH {_PUBLISHED}, {_CONTAINERS}, s AS (SELECT DISTINCT branch_id, start_idx, end_size, len FROM segments)
SELECT s.branch_id, s.start_idx, s.end_size, s.len, b.peer, hex(b.container) AS container, p.published_size FROM s JOIN branches b ON b.id = s.branch_id LEFT JOIN containers c ON c.container = b.container JOIN peers e ON e.id = b.peer LEFT JOIN published p ON p.branch_id = b.id AND p.remote_id = 1
WHERE coalesce(c.topic, 0) = 0 AND s.end_size > coalesce(p.published_size, 0) AND (b.peer = 1 OR p.pending_since < {_DUE})"""


@query("publish_plan", _PLAN)
def publish_plan(spark, d):
    plan = logs.publish_plan(table(spark, d, "segments"), _b(spark, d), table(spark, d, "peers"), _published(spark, d), _containers(spark, d), 1, 0, 1, _DUE)
    return _hexed(plan, "container")


@query("publish_order", _PLAN + " ORDER BY s.branch_id, s.end_size, s.start_idx")
def publish_order(spark, d):
    """The same in the order in which a pack takes it."""
    plan = logs.publish_plan(table(spark, d, "segments"), _b(spark, d), table(spark, d, "peers"), _published(spark, d), _containers(spark, d), 1, 0, 1, _DUE)
    return logs.publish_order(_hexed(plan, "container"))


@query("pending_mark", f"WITH {_PUBLISHED} SELECT 1 AS remote_id, b.id AS branch_id, 0 AS published_size, {_DUE} AS pending_since FROM branches b LEFT JOIN published p ON p.branch_id = b.id AND p.remote_id = 1 WHERE p.pending_since IS NULL AND b.peer <> 1 AND b.head_size > coalesce(p.published_size, 0)")
def pending_mark(spark, d):
    return logs.pending_marks(_b(spark, d), _published(spark, d), 1, 1, _DUE)


@query("published_high_water", f"WITH {_PUBLISHED}, news AS (SELECT 1 AS remote_id, branch_id, end_size AS published_size FROM segments) SELECT remote_id, branch_id, max(published_size) AS published_size FROM (SELECT remote_id, branch_id, published_size FROM published UNION ALL SELECT * FROM news) GROUP BY ALL")
def published_high_water(spark, d):
    news = table(spark, d, "segments").selectExpr("1 AS remote_id", "branch_id", "end_size AS published_size")
    return logs.published_marks(_published(spark, d).withColumn("remote_id", F.col("remote_id").cast("int")), news)


_PATH = "RECURSIVE leaves AS (SELECT * FROM branches WHERE id NOT IN (SELECT parent_id FROM branches WHERE parent_id IS NOT NULL)), p AS (SELECT id AS leaf, id AS branch_id, head_size AS upper, 0 AS depth FROM leaves UNION ALL SELECT p.leaf, b.parent_id, b.fork_size, p.depth + 1 FROM p JOIN branches b ON b.id = p.branch_id WHERE b.parent_id IS NOT NULL)"


def _paths(spark, d):
    b = _b(spark, d)
    parents = b.where("parent_id IS NOT NULL").select(F.col("parent_id").alias("id")).distinct()
    return logs.branch_paths(b, b.join(parents, "id", "left_anti"))


@query("branch_path", f"WITH {_PATH} SELECT leaf, branch_id, upper, depth FROM p")
def branch_path(spark, d):
    return _paths(spark, d)


@query("fetch_page", f"WITH {_PATH}, s AS (SELECT DISTINCT branch_id, start_idx, end_size, len FROM segments), r AS (SELECT p.leaf, p.depth, s.*, sum(s.len) OVER w AS cum, row_number() OVER w AS rn FROM p JOIN s ON s.branch_id = p.branch_id AND s.end_size > 2 AND s.start_idx < p.upper WINDOW w AS (PARTITION BY p.leaf ORDER BY p.depth DESC, s.end_size, s.start_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) SELECT leaf, depth, branch_id, start_idx, end_size, len FROM r WHERE rn = 1 OR cum <= 1500 AND rn <= 1024")
def fetch_page(spark, d):
    return logs.fetch_pages(_paths(spark, d), table(spark, d, "segments"), 2, max_bytes=1500)


@query("catch_up_order", "SELECT id, peer, hex(container) AS container, row_number() OVER (PARTITION BY peer, container ORDER BY id) AS place FROM branches WHERE commit_size < head_size")
def catch_up_order(spark, d):
    return _hexed(logs.catch_up_order(_b(spark, d)).select("id", "peer", "container", "place"), "container")


@query("inherited_commits", "SELECT f.id, f.fork_size AS commit_size FROM branches f JOIN branches p ON p.id = f.parent_id WHERE f.commit_size < f.fork_size AND p.commit_size >= f.fork_size")
def inherited_commits(spark, d):
    return logs.inherited_commits(_b(spark, d))


_REASON = "CASE n % 7 WHEN 0 THEN 'internal' WHEN 1 THEN 'skew' WHEN 2 THEN 'incompatible' WHEN 3 THEN 'need_key' WHEN 4 THEN 'awaiting_deps' WHEN 5 THEN 'frozen' END"
_NOW = 1585000000000


def _stalled(spark, d) -> DataFrame:
    """The branches with a reason for which they may have stalled, made of their ``n``."""
    b = _b(spark, d).withColumn("reason", F.expr(_REASON))
    now = F.lit(_NOW).cast("bigint")
    tried = scalar.retry_now(F.col("reason"), now, F.expr("shiftright(changed_at, 16)"), F.expr("n % 12"), F.col("changed_at"), False, key_came=F.expr("n % 2 = 0"), deps_done=F.expr("id % 2 = 0"))
    return b.withColumn("retry", tried)


_RETRY = f"""stalled AS (SELECT *, {_REASON} AS reason FROM branches),
tried AS (SELECT *, CASE WHEN reason IS NULL THEN true WHEN reason = 'internal' THEN {_NOW} >= (changed_at >> 16) + CAST(least(1000 * power(2, n % 12), 300000) AS BIGINT) WHEN reason = 'skew' THEN NOT ((changed_at >> 16) - {_NOW} > 60000) WHEN reason = 'need_key' THEN n % 2 = 0 WHEN reason = 'awaiting_deps' THEN id % 2 = 0 ELSE false END AS retry FROM stalled)"""


@query("retry_states", f"WITH {_RETRY} SELECT id, reason, retry FROM tried")
def retry_states(spark, d):
    return _stalled(spark, d).select("id", "reason", "retry")


@query("catch_up", f"""WITH RECURSIVE {_RETRY},
s AS (SELECT DISTINCT branch_id, start_idx AS a, end_size AS z FROM segments WHERE start_idx < end_size),
i AS (SELECT *, sum(CASE WHEN m IS NULL OR a > m THEN 1 ELSE 0 END) OVER (PARTITION BY branch_id ORDER BY a, z) AS g FROM (SELECT *, max(z) OVER (PARTITION BY branch_id ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM s)),
r AS (SELECT branch_id, min(a) AS a, max(z) AS z FROM i GROUP BY branch_id, g),
q AS (SELECT t.*, greatest(commit_size, coalesce(fork_size, 0)) AS start_at, coalesce((SELECT max(least(r.z, greatest(t.head_size, greatest(commit_size, coalesce(fork_size, 0))))) FROM r WHERE r.branch_id = t.id AND r.a <= greatest(commit_size, coalesce(fork_size, 0)) AND r.z > greatest(commit_size, coalesce(fork_size, 0))), greatest(commit_size, coalesce(fork_size, 0))) AS reach FROM tried t),
w AS (SELECT id, retry AND (fork_size IS NULL OR commit_size >= fork_size) AS starts, CASE WHEN retry AND (fork_size IS NULL OR commit_size >= fork_size) THEN reach ELSE commit_size END AS now_at FROM q WHERE parent_id IS NULL OR parent_id NOT IN (SELECT id FROM branches)
UNION ALL SELECT q.id, q.retry AND (q.fork_size IS NULL OR q.commit_size >= q.fork_size OR w.now_at >= q.fork_size), CASE WHEN q.retry AND (q.fork_size IS NULL OR q.commit_size >= q.fork_size OR w.now_at >= q.fork_size) THEN q.reach ELSE q.commit_size END FROM w JOIN q ON q.parent_id = w.id)
SELECT q.id, w.now_at AS commit_size, CASE WHEN NOT retry THEN 'not_tried' WHEN NOT starts THEN 'waits_for_parent' WHEN reach >= head_size THEN 'done' ELSE 'missing_segment' END AS outcome FROM q JOIN w ON w.id = q.id""")
def catch_up(spark, d):
    return logs.catch_up(_stalled(spark, d), table(spark, d, "segments"))


@query("latest_change", "SELECT coalesce(max(changed_at), 0) AS changed_at FROM branches")
def latest_change(spark, d):
    return logs.latest_change(_b(spark, d))


@query("branch_stamps", "SELECT b.id, hex(p.peer_id) AS peer_id, hex(container) AS container, head_size, changed_at FROM branches b JOIN peers p ON p.id = b.peer ORDER BY changed_at, b.id")
def branch_stamps(spark, d):
    return _hexed(logs.branch_stamps(_b(spark, d), table(spark, d, "peers")), "peer_id", "container")


@query("unpublished", f"WITH {_PUBLISHED} SELECT DISTINCT r.remote_id, b.peer, hex(b.container) AS container FROM branches b, (VALUES (0), (1), (2)) r(remote_id) LEFT JOIN published p ON p.branch_id = b.id AND p.remote_id = r.remote_id WHERE b.head_size > coalesce(p.published_size, 0)")
def unpublished(spark, d):
    return _hexed(logs.unpublished(_b(spark, d), _published(spark, d), [0, 1, 2]), "container")


@query("log_snapshot", "SELECT hex(p.peer_id) AS peer_id, hex(container) AS container, string_agg(head_size || ':' || hex(head_hash) || ':' || coalesce(CAST(fork_size AS VARCHAR), ''), ' ' ORDER BY head_size, hex(head_hash), fork_size NULLS FIRST) AS heads FROM branches b JOIN peers p ON p.id = b.peer GROUP BY ALL")
def log_snapshot(spark, d):
    text = F.array_join(F.transform("heads", lambda h: F.concat(h["head_size"].cast("string"), F.lit(":"), F.hex(h["head_hash"]), F.lit(":"), F.coalesce(h["fork_size"].cast("string"), F.lit("")))), " ")
    return _hexed(logs.snapshot(_b(spark, d), table(spark, d, "peers")).withColumn("heads", text), "peer_id", "container")


@query("fork_points", "WITH x AS (SELECT peer, container, end_size, count(DISTINCT end_hash) AS n FROM segments s JOIN branches b ON b.id = s.branch_id GROUP BY ALL HAVING count(DISTINCT end_hash) > 1) SELECT peer, hex(container) AS container, min(end_size) AS fork_at, arg_min(n, end_size) AS n_lines FROM x GROUP BY peer, container")
def fork_points(spark, d):
    return _hexed(logs.fork_points(table(spark, d, "segments"), _b(spark, d)), "container")


@query("fork_tree", """WITH RECURSIVE e0 AS (SELECT DISTINCT peer, s.container_id AS c, s.idx_start AS a, s.prev_chain_hash AS p, s.idx_end AS z, s.end_chain_hash AS h FROM (SELECT peer, unnest(self_segments) AS s FROM packs) WHERE s.idx_start < s.idx_end AND peer IS NOT NULL AND s.container_id IS NOT NULL AND s.prev_chain_hash IS NOT NULL AND s.end_chain_hash IS NOT NULL),
e AS (SELECT * FROM e0 UNION SELECT peer, c, a, p, z, unhex(sha256(h)) FROM e0 WHERE z % 3 = 0),
x AS (SELECT DISTINCT peer, c, z, h FROM e),
o AS (SELECT e.peer, e.c, e.z, e.h, max(struct_pack(k := e.a = 0 OR x.h IS NOT NULL, a := e.a, p := e.p)) AS m FROM e LEFT JOIN x ON x.peer = e.peer AND x.c = e.c AND x.z = e.a AND x.h = e.p GROUP BY ALL),
f AS (SELECT peer, c, m.a AS a, m.p AS p, z, h FROM o),
g AS (SELECT *, row_number() OVER w = 1 AS main, first_value(h) OVER w AS side FROM f WINDOW w AS (PARTITION BY peer, c, a, p ORDER BY z, h)),
l AS (SELECT g.*, b.h AS before FROM g LEFT JOIN f b ON b.peer = g.peer AND b.c = g.c AND b.z = g.a AND b.h = g.p),
r AS (SELECT peer, c, z, h, h AS branch FROM l WHERE NOT main OR before IS NULL UNION ALL SELECT l.peer, l.c, l.z, l.h, r.branch FROM r JOIN l ON l.peer = r.peer AND l.c = r.c AND l.a = r.z AND l.p = r.h AND l.main)
SELECT l.peer, hex(l.c) AS container, hex(l.h) AS branch, hex(u.branch) AS parent, CASE WHEN NOT l.main THEN l.a END AS fork_size, d.z AS head_size, hex(d.h) AS head_hash FROM l JOIN (SELECT peer, c, branch, max(struct_pack(z := z, h := h)) AS m, max(z) AS z, arg_max(h, z) AS h FROM r GROUP BY ALL) d ON d.peer = l.peer AND d.c = l.c AND d.branch = l.h
LEFT JOIN r u ON u.peer = l.peer AND u.c = l.c AND u.h = coalesce(l.before, l.side) AND NOT l.main WHERE NOT l.main OR l.before IS NULL""")
def fork_tree(spark, d):
    """The lines of the logs that packs carry, and where they part; every third end gets a second line beside it."""
    s = table(spark, d, "packs").where("peer IS NOT NULL").select("peer", F.explode("self_segments").alias("s"))
    rows = s.select("peer", F.col("s.container_id").alias("container"), "s.idx_start", F.col("s.prev_chain_hash").alias("prev_hash"), "s.idx_end", F.col("s.end_chain_hash").alias("end_hash")).dropna()
    rows = rows.unionByName(rows.where("idx_end % 3 = 0").withColumn("end_hash", F.unhex(F.sha2("end_hash", 256))))
    return _hexed(logs.fork_tree(rows, ["peer", "container"]), "container", "branch", "parent", "head_hash")


@query("heads_by_log", "SELECT peer, hex(container) AS container, string_agg(head_size || ':' || hex(head_hash), ' ' ORDER BY head_size, hex(head_hash)) AS heads FROM branches GROUP BY peer, container")
def heads_by_log(spark, d):
    text = F.array_join(F.transform("heads", lambda h: F.concat(h["head_size"].cast("string"), F.lit(":"), h["head_hash"])), " ")
    return _hexed(logs.heads_by_log(_b(spark, d)).withColumn("heads", text), "container")


_IDPACKS = """named AS (SELECT *, regexp_extract(coalesce(file_name, ''), '^\\s*(?:.*/)?([0-9a-f]{1,16})-([0-9a-f]{1,16})-([0-9a-f]{1,16})-([0-9a-f]{1,16})(?:\\.uqp(?:\\.meta)?)?\\s*$', ['a', 'b', 'c', 'd'], 'i') AS f FROM packs),
idp AS (SELECT * EXCLUDE (f, seq_start, seq_end, pack_id, generation), coalesce(seq_start, try_cast('0x' || f.a AS BIGINT)) AS seq_start, coalesce(seq_end, try_cast('0x' || f.b AS BIGINT)) AS seq_end, coalesce(pack_id, try_cast('0x' || f.c AS BIGINT)) AS pack_id, coalesce(generation, try_cast('0x' || f.d AS BIGINT)) AS generation FROM named)"""


def _packs(spark, d):
    return packfiles.identified(table(spark, d, "packs"))


@query("covered_ranges", f"WITH {_IDPACKS}, r AS (SELECT DISTINCT peer, seq_start AS s, seq_end AS e FROM idp WHERE seq_start < seq_end), x AS (SELECT *, max(e) OVER (PARTITION BY peer ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM r), y AS (SELECT *, sum(CASE WHEN m IS NULL OR s > m THEN 1 ELSE 0 END) OVER (PARTITION BY peer ORDER BY s, e) AS g FROM x) SELECT peer, min(s) AS seq_start, max(e) AS seq_end FROM y GROUP BY peer, g")
def covered_ranges(spark, d):
    return logs.covered_ranges(_packs(spark, d), ["peer"], "seq_start", "seq_end").select("peer", "seq_start", "seq_end")


@query("covered_skip", f"WITH {_IDPACKS}, c AS (SELECT DISTINCT peer, seq_start, seq_end FROM idp WHERE generation = 0), q AS (SELECT DISTINCT delivery_id, peer, seq_start, seq_end FROM idp WHERE generation > 0), x AS (SELECT *, max(seq_end) OVER (PARTITION BY peer ORDER BY seq_start, seq_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM c), y AS (SELECT *, sum(CASE WHEN m IS NULL OR seq_start > m THEN 1 ELSE 0 END) OVER (PARTITION BY peer ORDER BY seq_start, seq_end) AS g FROM x), u AS (SELECT peer, min(seq_start) AS s, max(seq_end) AS e FROM y GROUP BY peer, g) SELECT delivery_id, EXISTS (SELECT 1 FROM u WHERE u.peer = q.peer AND u.s <= q.seq_start AND q.seq_end <= u.e) AS within FROM q")
def covered_skip(spark, d):
    """Whether the later generations lie in what the first generations cover."""
    p = _packs(spark, d).select("delivery_id", "peer", "seq_start", "seq_end", "generation")
    have = logs.covered_ranges(p.where("generation = 0"), ["peer"], "seq_start", "seq_end")
    return logs.within(p.where("generation > 0").drop("generation"), have, ["peer"], "seq_start", "seq_end").select("delivery_id", "within")


@query("pack_names", f"WITH {_IDPACKS} SELECT delivery_id, printf('%04x-%04x-', seq_start, seq_end) || printf('%016x', pack_id) || printf('-%02x', generation) AS canonical, regexp_replace(regexp_replace(trim(file_name), '^.*/', ''), '\\.uqp(\\.meta)?$', '') = printf('%04x-%04x-', seq_start, seq_end) || printf('%016x', pack_id) || printf('-%02x', generation) AS is_canonical FROM idp")
def pack_names(spark, d):
    """The one spelling of each file id, and whether the delivery's name has it."""
    canonical = F.format_string("%04x-%04x-%016x-%02x", "seq_start", "seq_end", "pack_id", "generation")
    own = F.regexp_replace(F.regexp_replace(F.trim("file_name"), "^.*/", ""), r"\.uqp(\.meta)?$", "")
    return _packs(spark, d).select("delivery_id", canonical.alias("canonical"), (own == canonical).alias("is_canonical"))


@query("dedupe_packs", f"WITH {_IDPACKS}, r AS (SELECT *, row_number() OVER (PARTITION BY pack_id, seq_end ORDER BY generation DESC, received_at, delivery_id) AS r FROM idp) SELECT delivery_id, pack_id, seq_end, generation FROM r WHERE r = 1 ORDER BY seq_end")
def dedupe_packs(spark, d):
    order = [-F.col("generation"), F.col("received_at"), F.col("delivery_id")]
    return delivery.first_copies(_packs(spark, d), ["pack_id", "seq_end"], order, ["delivery_id", "pack_id", "seq_end", "generation"]).orderBy("seq_end", "pack_id")


@query("pack_tips", f"WITH {_IDPACKS}, gone AS (SELECT peer, r.id AS pack_id, r.end_seq AS seq_end FROM (SELECT peer, unnest(list_concat(coalesce(parents, []), coalesce(self_supersedes, []))) AS r FROM idp)) SELECT DISTINCT peer, pack_id, seq_end FROM idp t WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.peer = t.peer AND g.pack_id = t.pack_id AND g.seq_end = t.seq_end)")
def pack_tips(spark, d):
    return logs.tips(_packs(spark, d), ["peer"])


@query("next_pack_seq", f"WITH {_IDPACKS} SELECT peer, coalesce(max(seq_end), 0) AS seq_start, coalesce(max(seq_end), 0) + 1 AS seq_end FROM idp GROUP BY peer")
def next_pack_seq(spark, d):
    top = F.coalesce(F.max("seq_end"), F.lit(0))
    return _packs(spark, d).groupBy("peer").agg(top.alias("seq_start"), (top + 1).alias("seq_end"))


@query("segment_placement", """WITH i AS (SELECT DISTINCT peer, s.container_id AS container, s.idx_start AS a, s.idx_end AS z, s.prev_chain_hash AS ph, s.end_chain_hash AS eh FROM (SELECT peer, unnest(self_segments) AS s FROM packs)),
l AS (SELECT peer, container, max(head_size) AS most FROM branches GROUP BY ALL)
SELECT i.peer, hex(i.container) AS container, a AS idx_start, z AS idx_end, hex(eh) AS end_hash, CASE WHEN z <= a THEN 'empty' WHEN l.most IS NULL THEN CASE WHEN a = 0 THEN 'first' ELSE 'no_anchor' END
WHEN EXISTS (SELECT 1 FROM branches b WHERE b.peer = i.peer AND b.container = i.container AND b.head_size = z AND b.head_hash = eh) THEN 'exists' WHEN EXISTS (SELECT 1 FROM branches b WHERE b.peer = i.peer AND b.container = i.container AND b.head_size = a AND b.head_hash = ph) THEN 'exact' WHEN l.most > a THEN 'overlaps' ELSE 'no_anchor' END AS placement
FROM i LEFT JOIN l ON l.peer = i.peer AND l.container = i.container""")
def segment_placement(spark, d):
    s = table(spark, d, "packs").select("peer", F.explode("self_segments").alias("s")).where("s IS NOT NULL")
    incoming = s.select("peer", F.col("s.container_id").alias("container"), "s.idx_start", "s.idx_end", F.col("s.prev_chain_hash").alias("prev_hash"), F.col("s.end_chain_hash").alias("end_hash")).distinct()
    return _hexed(logs.placement(incoming, _b(spark, d)).drop("prev_hash"), "container", "end_hash")


@query("head_placement", "SELECT s.branch_id, s.start_idx, s.end_size, CASE WHEN s.end_size <= b.commit_size THEN 'nothing_new' WHEN c.h IS NULL OR c.h <> b.head_hash THEN 'mismatch' WHEN s.start_idx = b.commit_size THEN 'exact' ELSE 'suffix' END AS placement FROM (SELECT DISTINCT branch_id, start_idx, end_size FROM segments) s JOIN branches b ON b.id = s.branch_id LEFT JOIN (SELECT branch_id, end_size, max(end_hash) AS h FROM segments GROUP BY ALL) c ON c.branch_id = b.id AND c.end_size = b.head_size")
def head_placement(spark, d):
    s = table(spark, d, "segments")
    at = s.groupBy("branch_id", "end_size").agg(F.max("end_hash").alias("h")).withColumnRenamed("end_size", "_size")
    b = _b(spark, d).select(F.col("id").alias("branch_id"), "commit_size", "head_hash", F.col("head_size").alias("_size")).join(at, ["branch_id", "_size"], "left").drop("_size")
    rows = s.select("branch_id", "start_idx", "end_size").distinct().join(b, "branch_id")
    return rows.select("branch_id", "start_idx", "end_size", logs.head_placement(F.col("start_idx"), F.col("end_size"), F.col("commit_size"), F.col("h"), F.col("head_hash")).alias("placement"))


@query("segment_lookup", "SELECT b.id AS branch_id, b.commit_size AS idx, s.start_idx, s.end_size, s.len FROM branches b JOIN (SELECT DISTINCT branch_id, start_idx, end_size, len FROM segments) s ON s.branch_id = b.id AND s.start_idx <= b.commit_size AND b.commit_size < s.end_size")
def segment_lookup(spark, d):
    points = _b(spark, d).select(F.col("id").alias("branch_id"), F.col("commit_size").alias("idx"))
    return logs.lookup(points, table(spark, d, "segments"))


@query("backoff_schedule", "SELECT DISTINCT todo_id, last_ts, coalesce(attempts, 0) AS attempts, CAST(least(1000 * power(2, least(coalesce(attempts, 0), 31)), 300000) AS BIGINT) AS delay_ms, last_ts + CAST(least(1000 * power(2, least(coalesce(attempts, 0), 31)), 300000) AS BIGINT) <= 1586000000000 AS due FROM pack_reads")
def backoff_schedule(spark, d):
    r = table(spark, d, "pack_reads").select("todo_id", "last_ts", F.coalesce("attempts", F.lit(0).cast("bigint")).alias("attempts")).distinct()
    return r.withColumn("delay_ms", scalar.backoff(F.col("attempts"), 1_000, 300_000)).withColumn("due", scalar.retry_now(F.lit("internal"), F.lit(1586000000000), F.col("last_ts"), F.col("attempts"), F.lit(0).cast("bigint"), False))


@query("blocked_reasons", f"WITH {_IDPACKS}, have AS (SELECT DISTINCT pack_id, seq_end FROM idp) SELECT delivery_id, q.seq_start >= q.seq_end AS bad_metadata, body_len IS NULL AS no_body, count(r) FILTER (WHERE h.pack_id IS NULL) AS n_pending_parents FROM (SELECT delivery_id, seq_start, seq_end, body_len, unnest(CASE WHEN len(parents) > 0 THEN parents ELSE [NULL] END) AS r FROM idp) q LEFT JOIN have h ON h.pack_id = r.id AND h.seq_end = r.end_seq GROUP BY ALL")
def blocked_reasons(spark, d):
    """Why a pack can't be read yet: flags, and the number of its parents that haven't arrived."""
    p = _packs(spark, d)
    have = p.select("pack_id", F.col("seq_end")).distinct()
    waits = packfiles.parent_references(p).join(have, ["pack_id", "seq_end"], "left_anti").groupBy("row_id").agg(F.count("*").alias("n"))
    flags = p.select("delivery_id", (F.col("seq_start") >= F.col("seq_end")).alias("bad_metadata"), F.col("body_len").isNull().alias("no_body"))
    return flags.join(waits, flags["delivery_id"] == waits["row_id"], "left").select("delivery_id", "bad_metadata", "no_body", F.coalesce("n", F.lit(0)).alias("n_pending_parents"))


@query("chain_hash", """WITH e AS (SELECT user_id, list(sha256(props) ORDER BY event_id) AS l FROM events GROUP BY user_id) SELECT user_id, len(l) AS size,
list_reduce(list_prepend(sha256(CAST('loom1/ChainSeed' AS BLOB) || unhex('00') || CAST(CAST(user_id AS VARCHAR) AS BLOB)), l), lambda a, x: sha256(CAST('loom1/ChainHash' AS BLOB) || unhex('00') || unhex(a) || unhex(x) || unhex('00'))) AS chain_hash FROM e""")
def chain_hash(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", F.unhex(F.sha2("props", 256)).alias("h"))
    chained = logs.chain_hashes(e, ["user_id"], "event_id", "h")
    return chained.groupBy("user_id").agg(F.count("*").alias("size"), F.max_by("chain_hash", "event_id").alias("c")).select("user_id", "size", F.lower(F.hex("c")).alias("chain_hash"))


@query("chain_verify", """WITH x AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS idx FROM events)
SELECT user_id, min(idx) AS start_idx, max(idx) + 1 AS end_size, NOT (user_id % 5 = 0 AND idx // 16 = 1) AS intact, NOT (user_id % 5 = 0 AND idx // 16 = 2) AS linked FROM x GROUP BY user_id, idx // 16""")
def chain_verify(spark, d):
    """Stored segments of 16 entries, of which some end with another hash: these aren't intact, the next ones not linked."""
    e = table(spark, d, "events").select("user_id", (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).cast("bigint").alias("idx"), F.unhex(F.sha2("props", 256)).alias("entry_hash"), F.lit(None).cast("binary").alias("cipher"))
    chain = chains.chain_hashes(e, ["user_id"], "idx", "entry_hash")
    ends = chain.groupBy("user_id", F.expr("idx div 16").alias("b")).agg(F.min("idx").alias("start_idx"), (F.max("idx") + 1).alias("end_size"), F.max_by("chain_hash", "idx").alias("end_hash"))
    before = F.lag("end_hash").over(Window.partitionBy("user_id").orderBy("b"))
    seed = scalar.tagged_sha256("ChainSeed", F.col("user_id").cast("string").cast("binary"))
    stored = ends.withColumn("prev_hash", F.coalesce(before, seed)).withColumn("end_hash", F.when(F.expr("user_id % 5 = 0 AND b = 1"), F.unhex(F.sha2("end_hash", 256))).otherwise(F.col("end_hash")))
    return chains.verify(e, stored, ["user_id"])


_LOCAL = f"""roots AS (SELECT peer, container, arg_min(struct_pack(h := head_size, c := commit_size, e := n % 5 = 0), id) FILTER (WHERE parent_id IS NULL) AS r, count(*) AS n FROM branches GROUP BY ALL),
o AS (SELECT o.*, p.peer_id, x.r, CASE WHEN x.n IS NULL THEN NULL WHEN x.r IS NULL THEN 'no root' WHEN NOT x.r.e AND x.r.c <> x.r.h THEN 'sizes differ' END AS fault FROM row_ops o JOIN peers p ON p.id = o.peer LEFT JOIN roots x ON x.peer = o.peer AND x.container = o.container WHERE o.container IS NOT NULL)"""


def _local(spark, d) -> local.Written:
    peers = table(spark, d, "peers").select(F.col("id").alias("peer"), "peer_id")
    ops = table(spark, d, "row_ops").where("container IS NOT NULL").join(peers, "peer").select("peer_id", "container", "seq", F.coalesce(F.expr("unix_millis(cast(arrived_at AS timestamp))"), F.lit(0)).alias("wall"), F.col("who").alias("user_id"), F.coalesce(F.col("body").cast("binary"), F.lit(b"")).alias("body"))
    b = _b(spark, d).join(peers, "peer").withColumn("head_err", F.lit(None).cast("string")).withColumn("commit_err", F.expr("CASE WHEN n % 5 = 0 THEN 'internal' END"))
    return local.execute(ops, local.own_roots(b))


@query("local_exec", f"""WITH {_LOCAL}, x AS (SELECT *, coalesce(epoch_us(arrived_at) // 1000, 0) << 16 AS c, row_number() OVER (PARTITION BY peer ORDER BY seq) AS k FROM o WHERE fault IS NULL)
SELECT seq, coalesce(r.h, 0) + row_number() OVER (PARTITION BY peer, container ORDER BY seq) - 1 AS start_idx, k + greatest(0, max(c - k) OVER (PARTITION BY peer ORDER BY seq)) AS stamp, coalesce(r.e OR r.c = r.h, true) AND NOT coalesce(r.e, false) AS commits FROM x""")
def local_exec(spark, d):
    """All row_ops as local writes of their authors, on top of the branches that there are."""
    return _local(spark, d).entries.select("seq", "start_idx", "stamp", "commits")


@query("local_rejects", f"WITH {_LOCAL} SELECT seq, fault FROM o WHERE fault IS NOT NULL")
def local_rejects(spark, d):
    return _local(spark, d).rejected.select("seq", "fault")


@query("replica_diff", "SELECT 0 AS only_a, 0 AS only_b")
def replica_diff(spark, d):
    """Two replicas that got the same operations in other orders, one of them twice, agree."""
    ops = fx.line_ops(spark, d)
    return compare.difference(fold.fold(ops, fx.LINE_STATE), fold.fold(ops.unionByName(ops), fx.LINE_STATE))


@query("peer_groups", "WITH RECURSIVE r AS (SELECT DISTINCT peer, container FROM branches), g AS (SELECT DISTINCT peer AS a, peer AS b FROM r UNION SELECT g.a, y.peer FROM g JOIN r x ON x.peer = g.b JOIN r y ON y.container = x.container) SELECT a AS peer, min(b) AS label FROM g GROUP BY a")
def peer_groups(spark, d):
    return compare.groups(_b(spark, d), "peer", "container")


# --- typed and raw reads ---------------------------------------------------------------------------


def _store(spark, d) -> Store:
    s = Store(spark)
    s.register(fx.USER_STATE, fx.user_ops(spark, d, fx.FINE))
    s.register(fx.LINE_STATE, fx.line_ops(spark, d))
    return s


_USER, _LINE = _live_sql(fx.user_ops_sql(fx.FINE), fx.USER_STATE), _live_sql(fx.LINE_OPS, fx.LINE_STATE)


@query("get_row", f"SELECT * FROM ({_LINE}) WHERE k0 = 1 AND k1 = 7")
def get_row(spark, d):
    return _store(spark, d).get("line_state", 1, 7)


@query("get_all", _USER)
def get_all(spark, d):
    return _store(spark, d).get_all("user_state")


@query("query_filter_order_limit", f"SELECT * FROM ({_LINE}) WHERE qty > 10 AND flag IS NOT DISTINCT FROM NULL ORDER BY qty DESC, k0, k1 LIMIT 50 OFFSET 5")
def query_filter_order_limit(spark, d):
    return _store(spark, d).query("line_state", lambda q: q.where((F.col("qty") > 10) & F.col("flag").eqNullSafe(F.lit(None))).orderBy(F.desc("qty"), "k0", "k1").offset(5).limit(50))


@query("raw_sql_join", f"SELECT c.c_custkey, u.score FROM ({_USER}) u JOIN customer c ON c.c_custkey = u.user_id WHERE u.score > 5000")
def raw_sql_join(spark, d):
    table(spark, d, "customer").createOrReplaceTempView("customer")
    return _store(spark, d).sql("SELECT c.c_custkey, u.score FROM user_state u JOIN customer c ON c.c_custkey = u.user_id WHERE u.score > ?", 5000)


@query("raw_sql_window", f"SELECT k0, k1, qty, rank() OVER (PARTITION BY k1 ORDER BY qty DESC NULLS LAST) AS r FROM ({_LINE})")
def raw_sql_window(spark, d):
    return _store(spark, d).sql("SELECT k0, k1, qty, rank() OVER (PARTITION BY k1 ORDER BY qty DESC) AS r FROM line_state")


@query("raw_sql_group", f"SELECT flag, k1, count(*) AS n, sum(qty) AS qty, max(price) AS price FROM ({_LINE}) GROUP BY GROUPING SETS ((flag, k1), (flag), ())")
def raw_sql_group(spark, d):
    return _store(spark, d).sql("SELECT flag, k1, count(*) AS n, sum(qty) AS qty, max(price) AS price FROM line_state GROUP BY GROUPING SETS ((flag, k1), (flag), ())")


QUERIES = Q
