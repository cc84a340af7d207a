"""Ids, declarations, checks, typed reads, codec, clock, logs, packs, streams."""

import random
import uuid

import pytest
from helpers import NOTES, frame, sequential, up
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomfold import query as q
from loomfold.functions import codec, ids
from loomfold.operators import clock, compare, feed, fold, logs, validate
from loomfold.schema import Catalog, Field, SchemaError, Table, reconcile, table
from loomfold.session import work_folder
from loomfold.sources import packs as pk
from loomfold.sources.versioned import VersionedTable
from loomfold.streaming import merge


# --- declarations


@pytest.mark.parametrize(
    "make",
    [
        lambda: table("", 1, {"k": "i64"}),
        lambda: table("t", 1, {}),
        lambda: table("t", 1, dict.fromkeys("abcde", "i64")),
        lambda: table("t", 1, {"k": "float"}),
        lambda: table("t", 1, {"k": "i64"}, {"k": "text"}),
        lambda: table("t", 4096, {"k": "i64"}),
        lambda: Table("t", 1, (Field("k", "i64"),), (Field("a", "text", 64),)),
        lambda: Table("t", 1, (Field("k", "i64"),), (Field("a", "text", 1), Field("b", "text", 1))),
        lambda: Catalog([NOTES, NOTES]),
        lambda: Catalog([NOTES, table("other", 5, {"k": "i64"})]),
    ],
)
def test_bad_declarations(make):
    with pytest.raises(SchemaError):
        make()


def test_table_ids_pack_and_name(spark):
    t = table("t", 9, {"a": "text", "b": "uuid"}, {"x": "i64"})
    df = spark.createDataFrame([(t.table_id, t.values[0].column_id)], "t int, c int")
    r = df.select(ids.key_count(F.col("t")), ids.type_name(ids.key_type(F.col("t"), 0)), ids.type_name(ids.key_type(F.col("t"), 1)), ids.key_type(F.col("t"), 2), ids.table_index(F.col("t")), ids.type_name(ids.column_type(F.col("c")))).first()
    assert tuple(r) == (2, "text", "uuid", None, 9, "i64")
    names = df.select(ids.parse_table_name("p", ids.table_name("p", F.col("t"))), ids.parse_table_name("p", F.lit("p__t0xZZZZ")), ids.parse_column_name(F.lit("c0x80_lww")), ids.parse_column_name(F.lit("c0x8")))
    assert tuple(names.first()) == (t.table_id, None, 128, None)


def test_reconcile_reports_single_defects(spark):
    s = NOTES.physical
    assert reconcile(NOTES, s) == []
    without = lambda *n: type(s)([f for f in s if f.name not in n])
    assert reconcile(NOTES, without("a", "a_lww")) == []
    assert reconcile(NOTES, without("a")) == ["a is missing"]
    assert reconcile(NOTES, without("k")) == ["k is missing"]
    assert reconcile(NOTES, without("upsert_ts")) == ["upsert_ts is missing"]


def test_validation_reasons(spark):
    t = table("v", 3, {"a": "text"}, {"x": "i64", "y": "text"})
    x, y = (f.column_id for f in t.values)
    v = lambda b=None, t=None, i=None, u=None: (b, t, i, u)
    rows = [
        (1, t.table_id, "U", 5, [v(t="k")], [(x, v(i=1))], [y], None),
        (2, t.table_id, "U", None, [v(t="k")], [], [], "no stamp"),
        (3, t.table_id, "Z", 5, [v(t="k")], [], [], "unknown kind"),
        (4, t.table_id, "D", 5, [], [], [], "wrong number of key values"),
        (5, t.table_id, "D", 5, [v(i=1)], [], [], "wrong type of a key value"),
        (6, t.table_id, "U", 5, [v(t="k")], [(x, v(t="1"))], [], "wrong type of a column's value"),
        (7, t.table_id, "U", 5, [v(t="k")], [(x, v(i=1))], [x], "column named twice"),
        (8, t.table_id, "U", 5, [v(t="k\0")], [], [], "text with NUL"),
    ]
    df = spark.createDataFrame(rows, f"seq int, table_id int, kind string, ts bigint, pk array<{validate.VALUE}>, sets array<struct<column_id:int,value:{validate.VALUE}>>, nulls array<int>, want string")
    good, bad = validate.split(df)
    assert [r["seq"] for r in good.collect()] == [1]
    assert all(r["reason"] == r["want"] for r in bad.collect()) and bad.count() == 7


# --- typed reads and writes


def test_store(spark):
    t = table("events_t", 7, {"k": "text", "seq": "i64"}, {"payload": "bytes", "who": "uuid"})
    me = uuid.uuid4()
    ops = [(1, q.upsert(t, "a", 1).set(payload=b"x")), (2, q.upsert(t, "a", 2).set(who=me)), (3, q.upsert(t, "b", 1).null("payload")), (4, q.delete(t, "a", 2)), (5, q.upsert(t, "a", 1).null("who"))]
    s = q.Store(spark)
    s.register(t, q.ops_frame(spark, t, ops))
    assert q.value(q.exactly_one(s.get("events_t", "a", 1)), "payload", "bytes") == b"x"
    assert q.one(s.get("events_t", "a", 2)) is None
    assert s.get_all("events_t").count() == 2
    assert [r["k"] for r in s.query("events_t", lambda d: d.where(F.col("seq") == 1).orderBy(F.desc("k")).offset(1).limit(5)).collect()] == ["a"]
    assert s.sql("SELECT count(*) AS n FROM events_t WHERE k = ?", "a").first()["n"] == 1
    assert s.describe("events_t")[0] == ("k", "text", 0)
    for text in ("DROP VIEW events_t", "WITH a AS (SELECT 1 AS x) INSERT INTO tt SELECT * FROM a", "FROM (SELECT 1 AS x) INSERT INTO tt SELECT x", "EXPLAIN DROP VIEW events_t", "SET a = b", "EXECUTE IMMEDIATE 'DROP VIEW events_t'", "INSERT OVERWRITE DIRECTORY '/tmp/x' USING parquet SELECT 1"):
        with pytest.raises(PermissionError):
            s.sql(text)
    assert s.sql("WITH a AS (SELECT 1 AS x) SELECT x FROM a").count() == 1 and s.sql("DESCRIBE events_t").count() == 4
    with pytest.raises(TypeError):
        s.sql("SELECT ?", 1.5)
    with pytest.raises(q.CardinalityError):
        q.one(s.get_all("events_t"))
    with pytest.raises(TypeError):
        q.upsert(t, 1, 1)
    with pytest.raises(ValueError):
        q.upsert(t, "a", 1).set(payload=b"").set(payload=b"")
    with pytest.raises(ValueError):
        q.bind(2**63)
    assert q.bind(True) == 1 and q.bind(me) == me.bytes and q.quote("a`b") == "`a``b`"


def test_domain(spark):
    d = q.Domain(spark, {"notes_d": (5, {"k": "i64"}, {"a": "text", "b": "i64"}), "tags_d": (6, {"t": "text"}, {})})
    d.write((1, d.notes_d.upsert(1, a="x")), (2, d.tags_d.upsert("red")), (3, d.notes_d.upsert(2, b=7)))
    d.write((4, d.notes_d.delete(2)), (5, d.notes_d.upsert(1, b=None)))
    assert tuple(d.notes_d.get(1)) == (1, "x", None) and d.notes_d.get(2) is None and d.tags_d.all().count() == 1
    assert d.notes_d.query(lambda x: x.where("a = 'x'")).count() == 1
    assert [(r["kind"], r["changed"]) for r in d.notes_d.watch(k=1).orderBy("_seq").collect()] == [("U", ["a"]), ("U", ["b"])]
    assert d.store.sql("SELECT count(*) AS n FROM notes_d, tags_d").first()["n"] == 1
    with pytest.raises(SchemaError):
        d.notes_d.upsert(1, c=1)


def test_key_filter_reaches_the_scan(spark, small):
    from loomfold.plans import fixtures as fx

    s = q.Store(spark)
    s.register(fx.LINE_STATE, fx.line_ops(spark, small))
    plan = s.get("line_state", 1, 7)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(l_orderkey,1)" in plan


# --- codec

VALUES = {0: st.binary(max_size=40), 1: st.text(st.characters(exclude_characters="\0", exclude_categories=["Cs"]), max_size=40), 2: st.integers(-(2**63), 2**63 - 1), 3: st.binary(min_size=16, max_size=16)}


@st.composite
def operations(draw):
    table_id = draw(st.integers(0, 65535))
    key = [draw(VALUES[k]) for k in codec.key_kinds(table_id)]
    if draw(st.booleans()):
        return table_id, key, None, None
    cols = draw(st.lists(st.integers(0, 255), unique=True, max_size=8))
    cut = draw(st.integers(0, len(cols)))
    return table_id, key, [(c, draw(VALUES[c >> 6])) for c in cols[:cut]], cols[cut:]


@settings(max_examples=200, deadline=None)
@given(operations())
def test_operations_round_trip(op):
    data = codec.encode_op(*op)
    assert codec.decode_op(data) == op
    with pytest.raises(codec.DecodeError):
        codec.decode_op(data + b"\0")
    with pytest.raises(codec.DecodeError):
        codec.decode_op(data[:-1])


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**64 - 1), st.integers(-(2**63), 2**63 - 1))
def test_integers_round_trip(u, i):
    assert codec.get_uint(codec.put_uint(u)) == (u, len(codec.put_uint(u))) and len(codec.put_uint(u)) <= 9
    assert codec.get_int(codec.put_int(i))[0] == i


@pytest.mark.parametrize("data", [b"", b"\x80", b"\x80\x00", b"\xff" * 8, b"\xff" * 8 + b"\x00", b"\x02\x00\x00"])
def test_wrong_integers(data):
    with pytest.raises(codec.DecodeError):
        codec.get_uint(data) if data[:1] != b"\x02" else codec.decode_op(data)


def test_bytes_of_operations():
    """Worked out by hand from the layout: tag, table id lowest byte first, key, number of sets with column and value, number of nulls with columns."""
    a, b = (f.column_id for f in NOTES.values)
    assert (NOTES.table_id, a, b) == (0x2005, 0x40, 0x80)
    assert codec.encode_op(NOTES.table_id, [1], [(a, "xy"), (b, -3)], []) == bytes.fromhex("00" "0520" "02" "02" "40" "027879" "80" "05" "00")
    assert codec.encode_op(NOTES.table_id, [-64], [], [a, b]) == bytes.fromhex("00" "0520" "7f" "00" "02" "40" "80")
    assert codec.encode_op(NOTES.table_id, [64], None, None) == bytes.fromhex("01" "0520" "8001")
    t = table("t", 9, {"a": "text", "b": "uuid"}, {"x": "bytes"})
    assert codec.encode_op(t.table_id, ["é", b"u" * 16], [(t.values[0].column_id, b"\0\1")], []) == bytes.fromhex("00" "095c" "02c3a9" + "75" * 16 + "01" "00" "020001" "00")
    assert codec.put_uint(300) == b"\xac\x02" and codec.put_uint(2**64 - 1) == b"\xff" * 9 and codec.put_int(-(2**63)) == b"\xff" * 9


# --- clock


def test_clock_equals_sequential(spark):
    rng = random.Random(1)
    rows = []
    for log in range(6):
        t = 0
        for i in range(60):
            local = rng.random() < 0.6
            wall, remote = (rng.randint(0, 40), None) if local else (None, rng.randint(0, 40 << 16))
            t = max(wall << 16, t + 1) if local else (remote + 1 if remote >= t else t)
            rows.append((log, i, wall, remote, t))
    df = spark.createDataFrame(rows, "log int, i int, wall bigint, remote bigint, want bigint")
    assert clock.assign(df, ["log"], "i").where("stamp <> want").count() == 0


def test_skew_holds_back_the_log(spark):
    df = spark.createDataFrame([(1, 0, 100 << 16), (1, 1, (100 + 60_001) << 16), (1, 2, 5), (2, 0, (100 + 60_000) << 16)], "log int, i int, ts bigint")
    got = {(r["log"], r["i"]) for r in clock.admitted(df, ["log"], "i", F.lit(100)).where("admitted").collect()}
    assert got == {(1, 0), (2, 0)}
    gap = spark.createDataFrame([(1, 3), (1, 4), (1, 4), (1, 6), (2, 4)], "log int, i bigint").withColumn("done", F.lit(3))
    assert {(r["log"], r["i"]) for r in clock.committable(gap, ["log"], "i", "done").collect()} == {(1, 3), (1, 4)}


# --- logs


def test_paths_stop_at_cycles(spark):
    b = spark.createDataFrame([(1, None, None, 9), (2, 1, 5, 12), (3, 2, 7, 20), (4, 5, 1, 2), (5, 4, 1, 2)], "id bigint, parent_id bigint, fork_size bigint, head_size bigint")
    got = {tuple(r) for r in logs.branch_paths(b, b.where("id IN (3, 4)")).collect()}
    assert got == {(3, 3, 20, 0), (3, 2, 7, 1), (3, 1, 5, 2), (4, 4, 2, 0), (4, 5, 1, 1)}


def test_deep_paths_reach_their_root(spark):
    n = 67
    b = spark.createDataFrame([(i, i - 1 if i else None, i if i else None, i + 1) for i in range(n)], "id bigint, parent_id bigint, fork_size bigint, head_size bigint")
    paths = logs.branch_paths(b, b.where(F.col("id") == n - 1))
    assert sorted((r["depth"], r["branch_id"], r["upper"]) for r in paths.collect()) == [(n - 1 - i, i, n if i == n - 1 else i + 1) for i in reversed(range(n))]
    segments = spark.createDataFrame([(i, i, i + 1, 10) for i in range(n)], "branch_id bigint, start_idx bigint, end_size bigint, len bigint")
    page = logs.fetch_pages(paths, segments, 0, max_bytes=30)
    assert sorted(r["start_idx"] for r in page.collect()) == [0, 1, 2]


def test_long_chains_and_loops(spark):
    n = 200
    b = spark.createDataFrame([(i, i - 1 if i else None, i if i else None, i + 1) for i in range(n)], "id bigint, parent_id bigint, fork_size bigint, head_size bigint")
    paths = logs.branch_paths(b, b.where("id IN (199, 5)"), on_loop="raise")
    assert paths.groupBy("leaf").agg(F.count("*"), F.count_distinct("branch_id"), F.max("depth")).orderBy("leaf").collect() == [(5, 6, 6, 5), (199, 200, 200, 199)]
    ring = spark.createDataFrame([(i, (i + 1) % 3, 1, 2) for i in range(3)], b.schema)
    with pytest.raises(ValueError):
        logs.branch_paths(ring, ring, on_loop="raise")


def test_pages_and_lookups_equal_brute_force(spark):
    rng = random.Random(6)
    b = [(1, None, None, 60), (2, 1, 20, 50), (3, 2, 30, 70), (4, 1, 5, 40)]
    # At most one segment for each place, as those of one place may come in either order.
    s = list({(i, a, z): (i, a, z, rng.randint(1, 30)) for i in (1, 2, 3, 4) for a in range(0, 60, 4) for _ in range(rng.randint(0, 2)) if (z := a + rng.randint(0, 9))}.values())
    paths = logs.branch_paths(spark.createDataFrame(b, "id bigint, parent_id bigint, fork_size bigint, head_size bigint"), spark.createDataFrame(b, "id bigint, parent_id bigint, fork_size bigint, head_size bigint"))
    segments = spark.createDataFrame(s, "branch_id bigint, start_idx bigint, end_size bigint, len bigint")
    way = {}
    for r in paths.collect():
        way.setdefault(r["leaf"], []).append((r["depth"], r["branch_id"], r["upper"]))
    for most, rows in ((40, 99), (200, 3), (0, 5)):
        want = set()
        for leaf, w in way.items():
            total = n = 0
            for depth, branch, upper in sorted(w, reverse=True):
                for x in sorted({x for x in s if x[0] == branch and x[2] > 3 and x[1] < upper}, key=lambda x: (x[2], x[1], x[3])):
                    total, n = total + x[3], n + 1
                    if n == 1 or total <= most and n <= rows:
                        want.add((leaf, depth, *x))
        got = logs.fetch_pages(paths, segments, 3, most, rows).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)
    points = [(rng.randint(1, 5), rng.randint(-3, 70)) for _ in range(200)]
    got = sorted(map(tuple, logs.lookup(spark.createDataFrame(points, "branch_id bigint, idx bigint"), segments).collect()))
    assert got == sorted((p[0], p[1], *x[1:]) for p in points for x in set(s) if x[0] == p[0] and x[1] <= p[1] < x[2])


def test_ranges_touching_become_one(spark):
    r = spark.createDataFrame([("a", 0, 2), ("a", 2, 3), ("a", 5, 6), ("a", 5, 9), ("a", 4, 4), ("b", 1, 2)], "p string, s bigint, e bigint")
    c = logs.covered_ranges(r, ["p"], "s", "e")
    assert {tuple(x) for x in c.select("p", "s", "e").collect()} == {("a", 0, 3), ("a", 5, 9), ("b", 1, 2)}
    asked = spark.createDataFrame([("a", 1, 3), ("a", 2, 6), ("c", 1, 2)], "p string, s bigint, e bigint")
    assert {(x["p"], x["s"], x["within"]) for x in logs.within(asked, c, ["p"], "s", "e").collect()} == {("a", 1, True), ("a", 2, False), ("c", 1, False)}


def test_groups(spark):
    links = spark.createDataFrame([(1, "x"), (2, "x"), (2, "y"), (5, "y"), (7, "z"), (9, None)], "m bigint, s string")
    assert {tuple(r) for r in compare.groups(links, "m", "s").collect()} == {(1, 1), (2, 1), (5, 1), (7, 7)}


def test_chain_is_a_chain(spark):
    import hashlib

    rows = [("p", i, bytes([i]) * 32) for i in range(5)] + [("q", 0, b"z" * 32)]
    df = spark.createDataFrame(rows, "log string, i bigint, h binary")
    got = {(r["log"], r["i"]): bytes(r["chain_hash"]) for r in logs.chain_hashes(df, ["log"], "i", "h").collect()}
    chain = hashlib.sha256(b"loom1/ChainSeed\0" + b"p").digest()
    for i in range(5):
        chain = hashlib.sha256(b"loom1/ChainHash\0" + chain + bytes([i]) * 32 + b"\0").digest()
        assert got["p", i] == chain
    assert len(got) == 6


def test_entry_hashes_chains_and_local_writes(spark):
    """Against hashlib: sizes of one to nine bytes, ciphers in force, seeds of binary ids, logs that go on from a head."""
    import hashlib

    from loomfold.operators import chains, local

    tag = lambda d: ("loom1/" + d).encode().ljust(16, b"\0")
    sha = lambda *p: hashlib.sha256(b"".join(p)).digest()
    numbers = [0, 1, 127, 128, 2**14 - 1, 2**14, 2**21, 2**28, 2**35, 2**42, 2**49, 2**56 - 1, 2**56, 2**62, 2**63 - 1]
    df = spark.createDataFrame([(n,) for n in numbers], "n bigint").select("n", chains.varint(F.col("n")), chains.little(F.col("n")))
    assert all(bytes(v) == codec.put_uint(n) and bytes(w) == n.to_bytes(8, "little") for n, v, w in df.collect())
    p, c, key = b"p" * 32, b"c" * 16, b"\1" + b"f" * 32
    sized = lambda b: codec.put_uint(len(b)) + b
    rows = [("op", 5, b"u", b"x" * 200), ("use_key", None, None, key), ("op", -7, None, b""), ("expunged", None, None, b"h" * 32)]
    e = spark.createDataFrame([(p, c, i, *r) for i, r in enumerate(rows)], "peer_id binary, container binary, idx bigint, kind string, ts bigint, user_id binary, body binary")
    h = chains.entry_hash(*[F.col(x) for x in ("kind", "peer_id", "container", "idx", "ts", "user_id", "body")])
    e = e.withColumn("entry_hash", h).withColumn("cipher", chains.active_cipher(F.col("kind"), F.col("body"), ["peer_id", "container"], "idx"))
    got = {r["idx"]: bytes(r["chain_hash"]) for r in chains.chain_hashes(e, ["peer_id", "container"], "idx", "entry_hash", cipher="cipher").collect()}
    chain, cipher = sha(tag("ChainSeed"), p, c), None
    for i, (kind, ts, user, body) in enumerate(rows):
        cipher = body if kind == "use_key" else cipher
        eh = {"op": lambda: sha(tag("LogOp"), p, c, codec.put_uint(i), sized((ts or 0).to_bytes(8, "little", signed=True)), sized(user or b""), sized(body)), "use_key": lambda: sha(tag("LogUseKey"), p, c, codec.put_uint(i), body), "expunged": lambda: body}[kind]()
        chain = sha(tag("ChainHash"), chain, eh, b"\1" + cipher if cipher else b"\0")
        assert got[i] == chain
    ops = spark.createDataFrame([(p, c, 1, 50, None, b"a"), (p, c, 2, 40, b"w", b"b"), (p, b"d" * 16, 3, 60, None, b"z"), (p, b"e" * 16, 4, 70, None, b"no")], "peer_id binary, container binary, seq bigint, wall bigint, user_id binary, body binary")
    branches = [(1, p, c, None, 4, chain, 4, None, None), (2, p, c, 1, 9, chain, 9, None, None), (3, p, b"d" * 16, None, 7, chain, 5, None, "skew"), (4, p, b"e" * 16, 3, 7, chain, 7, None, None)]
    b = spark.createDataFrame(branches, "id bigint, peer_id binary, container binary, parent_id bigint, head_size bigint, head_hash binary, commit_size bigint, head_err string, commit_err string")
    w = local.execute(ops, local.own_roots(b))
    assert [(r["seq"], r["fault"]) for r in w.rejected.collect()] == [(4, "no root")]
    ent = {r["seq"]: r for r in w.entries.collect()}
    assert [(ent[i]["start_idx"], ent[i]["stamp"], ent[i]["commits"]) for i in (1, 2, 3)] == [(4, 50 << 16, True), (5, (50 << 16) + 1, True), (7, 60 << 16, False)]
    for i, cc in ((1, c), (2, c)):
        eh = sha(tag("LogOp"), p, cc, codec.put_uint(ent[i]["start_idx"]), sized(ent[i]["stamp"].to_bytes(8, "little")), sized(ent[i]["user_id"] or b""), sized(bytes(ent[i]["body"])))
        chain = sha(tag("ChainHash"), chain, eh, b"\0")
        assert bytes(ent[i]["end_hash"]) == chain
    heads = {bytes(r["container"]): (r["head_size"], r["commit_size"], bytes(r["head_hash"])) for r in w.heads.collect()}
    assert heads[c] == (6, 6, chain) and heads[b"d" * 16][:2] == (8, 5)


def test_publish_order(spark, small):
    from loomfold.plans.registry import ALL

    rows = [(r["branch_id"], r["end_size"], r["start_idx"]) for r in ALL["publish_order"][0](spark, small).collect()]
    assert rows == sorted(rows)


def test_fork_tree(spark):
    """A line in three segments and once in one, a fork of it that forks again, a line without an anchor, repeats, an empty segment."""
    rows = [("l", 0, "s", 3, "a"), ("l", 3, "a", 5, "b"), ("l", 5, "b", 9, "c"), ("l", 0, "s", 9, "c"), ("l", 3, "a", 6, "x"), ("l", 6, "x", 7, "y"), ("l", 6, "x", 8, "z"), ("l", 8, "z", 12, "w"), ("l", 20, "q", 22, "r"), ("l", 3, "a", 5, "b"), ("l", 4, "k", 4, "k"), ("m", 0, "s", 3, "a")]
    t = logs.fork_tree(spark.createDataFrame(rows, "log string, idx_start bigint, prev_hash string, idx_end bigint, end_hash string"), ["log"])
    assert {tuple(r) for r in t.collect()} == {("l", "a", None, None, 9, "c"), ("l", "x", "a", 3, 7, "y"), ("l", "z", "x", 6, 12, "w"), ("l", "r", None, None, 22, "r"), ("m", "a", None, None, 3, "a")}


def test_catch_up_equals_sequential(spark):
    rng = random.Random(11)
    rows, segs = [], []
    for i in range(160):
        parent = rng.choice([None, *range(max(0, i - 6), i)]) if i else None
        fork = rng.randint(0, 12) if parent is not None else None
        head = (fork or 0) + rng.randint(0, 10)
        rows.append((i, parent, fork, head, rng.randint(0, head), rng.random() < 0.8))
        a = fork or 0
        while a < head:
            z = min(head, a + rng.randint(1, 4))
            if rng.random() < 0.85:
                segs.append((i, a, z))
            a = z
    want, sizes = {}, {}
    for i, parent, fork, head, had, retry in rows:
        size, how = had, "not_tried"
        if retry:
            how = "done"
            if fork is not None and size < fork:
                if parent is not None and sizes[parent] >= fork:
                    size = fork
                else:
                    how = "waits_for_parent"
            if how == "done":
                while size < head and (s := next((z for j, a, z in segs if j == i and a <= size < z), None)):
                    size = s
                how = "done" if size >= head else "missing_segment"
        sizes[i] = size
        want[i] = (size, how)
    b = spark.createDataFrame(rows, "id bigint, parent_id bigint, fork_size bigint, head_size bigint, commit_size bigint, retry boolean")
    got = {r["id"]: (r["commit_size"], r["outcome"]) for r in logs.catch_up(b, spark.createDataFrame(segs, "branch_id bigint, start_idx bigint, end_size bigint")).collect()}
    assert got == want


# --- pack files


def log_segments(peer, container, sizes, start=0, chain=None):
    """Encoded segments of a log that follow one another, and the chain after them."""
    chain, out, i = chain or pk.Chain(peer, container), [], start
    for n in sizes:
        size, before = chain.size, chain.hash
        entries = [{"entry_type": "op", "ts": 100 + i + k, "user_id": b"", "body": bytes([i + k])} for k in range(n)]
        for e in entries:
            chain.add(e)
        out.append((size, chain.size, pk.encode_segment(size, before, b"\0" + bytes([i]) * 64, [*entries, {"entry_type": "signature", "body": b"\0" * 65}])))
        i += n
    return out, chain


def test_segments_join_and_are_cut():
    peer, c = b"p" * 32, b"c" * 16
    segs, chain = log_segments(peer, c, [3, 2, 4])
    joined, at = pk.join_segments(peer, c, [x[2] for x in segs])
    assert (at["idx_start"], at["idx_end"], at["end_chain_hash"]) == (0, 9, chain.hash) and at["prev_chain_hash"] == pk.Chain(peer, c).hash
    s = pk.open_segment(joined)
    assert [e["body"] for e in s.entries] == [bytes([i]) for i in range(9)] and s.signature == b"\0" + bytes([5]) * 64
    rest, at = pk.join_segments(peer, c, [x[2] for x in segs], start=4)
    assert (at["idx_start"], at["idx_end"]) == (4, 9) and len(pk.open_segment(rest).entries) == 5
    again, _ = pk.join_segments(peer, c, [pk.join_segments(peer, c, [segs[0][2], segs[1][2]])[0], segs[2][2]], 4)
    assert again == rest and pk.suffix(peer, c, joined, 4)[0] == rest
    for bad in ([segs[0][2], segs[2][2]], [segs[1][2], segs[0][2]], []):
        with pytest.raises(pk.DecodeError):
            pk.join_segments(peer, c, bad)
    for start in (9, 20):
        with pytest.raises(pk.DecodeError):
            pk.join_segments(peer, c, [x[2] for x in segs], start)
    key = b"\1" + b"f" * 32
    keyed = pk.encode_segment(0, pk.Chain(peer, c).hash, b"\0" * 65, [{"entry_type": "use_key", "body": key}, {"entry_type": "op", "ts": 1, "user_id": b"u", "body": b"x"}])
    cut, _ = pk.suffix(peer, c, keyed, 1)
    assert pk.open_segment(cut).cipher == key


def test_rounds_of_packs(spark, tmp_path):
    """Two topics; a log with a gap stays out, others go on from what is published, large rounds make several packs in a row."""
    me, other, rows = b"m" * 32, b"o" * 32, []
    for branch, (peer, topic, sizes, done) in enumerate([(me, 1, [3] * 12, None), (other, 1, [2, 2, 2], 3), (me, 1, [2] * 20, None), (me, 2, [1], None)]):
        c = bytes([branch]) * 16
        for i, (a, z, body) in enumerate(log_segments(peer, c, sizes)[0]):
            if z > (done or 0) and not (branch == 2 and i == 7):
                rows.append((topic, me, 5, [(77, 5)], branch, peer, c, z, done, body))
    df = spark.createDataFrame(rows, "topic int, author binary, first_seq bigint, parents array<struct<id:bigint,end_seq:bigint>>, branch_id bigint, peer_id binary, container binary, end_size bigint, published_size bigint, body binary")
    size = max(len(r[-1]) for r in rows)
    built = pk.build(df, ["topic"], 123, chunk_bytes=4 * size, pack_bytes=2 * size).cache()
    got = {t: sorted((r for r in built.collect() if r["topic"] == t and r["pack_no"] >= 0), key=lambda r: r["pack_no"]) for t in (1, 2)}
    assert [r["pack_no"] for r in got[1]] == list(range(len(got[1]))) and len(got[1]) > 1 and len(got[2]) == 1
    out = built.where("pack_no < 0").collect()
    assert len(out) == 1 and out[0]["topic"] == 1 and out[0]["header"] is None and len(out[0]["errors"]) > 1
    heads = [pk.decode_header(bytes(r["header"])) for r in got[1]]
    assert heads[0]["parents"] == [{"id": 77, "end_seq": 5}]
    for i, (h, r) in enumerate(zip(heads[1:], got[1])):
        name = r["file_name"].split("-")
        assert h["parents"] == [{"id": int.from_bytes(bytes.fromhex(name[2]), "big", signed=True), "end_seq": int(name[1], 16)}] and int(name[0], 16) == 5 + i
    marks = {}
    for r in got[1]:
        for p in r["published"]:
            marks[p["branch_id"]] = max(marks.get(p["branch_id"], 0), p["published_size"])
    upto = marks[2]
    assert marks == {0: 36, 1: 6, 2: upto} and upto < 14
    read = sorted((bytes(r["container"])[0], r["idx"], r["peer_id"] is None) for r in pk.unpack(built.where("topic = 1"), []).collect())
    assert read == [(0, i, True) for i in range(36)] + [(1, i, False) for i in range(3, 6)] + [(2, i, True) for i in range(upto)]
    # Files: written, listed, read as bodies, with what keeps some from being read.
    folder = str(tmp_path / "1" / "me")
    names = pk.publish(built.where("topic = 1"), folder)
    assert sorted(names) == sorted(r["file_name"] for r in got[1]) and pk.listing(spark, str(tmp_path)).count() == len(names)
    assert pk.bodies(spark, str(tmp_path), pk.headers(spark, str(tmp_path))).where("intact").count() == len(names)
    good, peers = got[1][0], spark.createDataFrame([(me,)], "peer_id binary")
    h = pk.decode_header(bytes(good["header"]))
    shifted = {**h, "self_segments": [{**d, "idx_end": d["idx_end"] + 1} for d in h["self_segments"]]}
    odd = [("fine", bytes(good["header"]), bytes(good["body"])), ("header", b"\x09", b""), ("hash", bytes(good["header"]), b"other"), ("none", bytes(good["header"]), None), ("metadata", pk.encode_header(shifted), bytes(good["body"]))]
    for name, body in (("newer", pk.encode_segment(0, me, b"\0" * 65, [])[:98] + b"\x07"), ("cut", pk.encode_segment(0, me, b"\0" * 65, [])[:50]), ("opaque", pk.encode_segment(0, me, b"\0" * 65, [])[:98] + b"\0\0")):
        d = {**h["self_segments"][0], "body_start": 0, "body_end": len(body)}
        odd.append((name, pk.encode_header({**h, "self_segments": [d], "peer_data": [{"peer_id": other, "supersedes": [], "segments": []}], "body_sha256": pk.body_hash(body)}), body))
    found = {r["name"]: (r["flags"], r["pending_parents"], r["missing_peers"]) for r in pk.blocked(spark.createDataFrame(odd, "name string, header binary, body binary"), ["name"], spark.createDataFrame([(77, 5)], "id bigint, end_seq bigint"), peers).collect()}
    assert found == {"header": (["corrupt_header"], 0, 0), "hash": (["bad_body_hash"], 0, 0), "none": (["bad_body_hash"], 0, 0), "metadata": (["bad_metadata"], 0, 0), "newer": (["needs_upgrade"], 0, 1), "cut": (["decode_error"], 0, 1), "opaque": (["need_key"], 0, 1)}
    assert all(r["pending_parents"] == 1 for r in pk.blocked(spark.createDataFrame(odd[:1], "name string, header binary, body binary"), ["name"], spark.createDataFrame([], "id bigint, end_seq bigint"), peers).collect())


def test_rounds_of_reading(spark, tmp_path):
    """A pack that waits for its parent, one that is damaged, and both again once they are whole."""
    me, other, folder = b"m" * 32, b"o" * 32, str(tmp_path / "t" / "me")
    c = b"c" * 16
    segs, _ = log_segments(me, c, [2, 3])

    def pack(i, parents, peers=()):
        a, z, body = segs[i]
        s = pk.open_segment(body)
        d = {"container_id": c, "idx_start": a, "idx_end": z, "prev_chain_hash": s.before, "end_chain_hash": b"h" * 32, "body_start": 0, "body_end": len(body)}
        return {"packed_at": 1, "parents": parents, "self_supersedes": [], "self_segments": [d], "peer_data": [{"peer_id": p, "supersedes": [], "segments": []} for p in peers], "body_sha256": pk.body_hash(body), "signature": pk.UNSIGNED}, body

    target = VersionedTable(spark, str(tmp_path / "read"), pk.READ)
    none, known = spark.createDataFrame([], "peer_id binary"), spark.createDataFrame([(other,)], "peer_id binary")
    first, second = pack(0, []), pack(1, [{"id": 10, "end_seq": 2}], [other])
    pk.write_pack(folder, "0002-0003-000000000000000b-00", *second)
    pk.write_pack(folder, "0001-0002-000000000000000a-00", first[0], b"half")
    stuck = lambda df: {r["path"][-38:-9]: (r["flags"], r["pending_parents"], r["missing_peers"]) for r in df.collect()}
    a, b = "0001-0002-000000000000000a-00", "0002-0003-000000000000000b-00"
    _, left = pk.read_round(spark, str(tmp_path), target, none)
    assert stuck(left) == {a: (["bad_body_hash"], 0, 0), b: ([], 1, 1)} and target.read().count() == 0
    pk.write_pack(folder, a, *first)
    _, left = pk.read_round(spark, str(tmp_path), target, none)
    assert stuck(left) == {b: ([], 0, 1)}
    for _ in range(2):
        _, left = pk.read_round(spark, str(tmp_path), target, known)
        assert left.count() == 0
        assert sorted(r["idx"] for r in target.read().where("entry_type = 'op'").collect()) == [0, 1, 2, 3, 4]
        assert target.read().where("entry_type IS NULL AND idx IS NULL").count() == 2


def test_packs_round_trip(spark, tmp_path):
    folder = str(tmp_path / "_" / "ab")
    sign, h = b"\0" + b"s" * 64, b"h" * 32
    entries = [{"entry_type": "op", "ts": 77, "user_id": b"", "body": b"op"}, {"entry_type": "signature", "body": sign}, {"entry_type": "expunged", "body": h}]
    body = pk.encode_segment(4, h, sign, entries)
    d = {"container_id": b"c" * 16, "idx_start": 4, "idx_end": 6, "prev_chain_hash": h, "end_chain_hash": h, "body_start": 0, "body_end": len(body)}
    header = {"packed_at": 5, "parents": [{"id": 3, "end_seq": 1}], "self_supersedes": [], "self_segments": [d], "peer_data": [{"peer_id": b"p" * 32, "supersedes": [{"seq_start": 1, "seq_end": 2, "id": -9, "generation": 1}], "segments": []}], "body_sha256": pk.body_hash(body), "signature": sign}
    assert pk.decode_header(pk.encode_header(header)) == header
    pk.write_pack(folder, "0001-0002-000000000000000a-00", header, body)
    pk.write_pack(folder, "0002-0003-000000000000000b-00", header | {"body_sha256": h}, body)
    pk.write_pack(folder, "0003-0003-000000000000000c-00", header, body)
    (tmp_path / "_" / "ab" / "0004-0005-000000000000000d-00.uqp.meta").write_bytes(b"\x09")
    assert pk.listing(spark, str(tmp_path)).count() == 4
    assert pk.listing(spark, str(tmp_path / "nothing")).count() == 0
    found = {r["seq_start"]: r for r in pk.headers(spark, str(tmp_path)).collect()}
    assert set(found) == {1, 2, 4} and found[4]["error"] == "unknown version 9" and found[1]["error"] is None
    good = pk.headers(spark, str(tmp_path)).where("error IS NULL")
    intact = {r["body_path"][-33:-29]: r["intact"] for r in pk.bodies(spark, str(tmp_path), good).collect()}
    assert sorted(intact.values()) == [False, True]
    read = pk.bodies(spark, str(tmp_path), good).where("intact").select("body_path", "content", F.lit(0).alias("body_start"), F.lit(len(body)).alias("body_end"), F.lit(4).alias("idx_start"))
    assert [(r["idx"], r["entry_type"], r["ts"]) for r in pk.entries(read).collect()] == [(4, "op", 77), (None, "signature", None), (5, "expunged", None)]
    pk.delete_pack(folder, "0001-0002-000000000000000a-00")
    pk.delete_pack(folder, "0001-0002-000000000000000a-00")
    assert pk.listing(spark, str(tmp_path)).count() == 3
    with pytest.raises(LookupError):
        pk.remote(spark, "nowhere", "")


# --- streams


def test_packs_of_deep_topics_are_listed(spark, tmp_path):
    for parts in (1, 8):
        pk.write_pack(str(tmp_path.joinpath(*["_t"] * parts, "ab")), "0001-0002-000000000000000a-00", {"packed_at": 5, "parents": [], "self_supersedes": [], "self_segments": [], "peer_data": [], "body_sha256": pk.body_hash(b""), "signature": b"\0" + b"s" * 64}, b"")
    assert pk.listing(spark, str(tmp_path)).count() == 2
    assert pk.headers(spark, str(tmp_path)).where("error IS NULL").count() == 2


def test_stream_equals_batch(spark, tmp_path):
    from test_fold import random_ops

    rng = random.Random(9)
    ops = random_ops(rng, 240)
    folder = str(tmp_path / "ops")
    df = frame(spark, ops)
    for i in range(4):
        df.where(f"seq >= {60 * i} AND seq < {60 * i + 60}").coalesce(1).write.mode("append").parquet(folder)
    target = VersionedTable(spark, str(tmp_path / "snap"), merge.snapshot_schema(NOTES))
    stream = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    merge.run_to_end(merge.into_snapshot(stream(), target, NOTES, str(tmp_path / "c1")))
    live, events = sequential(ops)
    assert {r["k"]: (r["a"], r["b"]) for r in fold.live(target.read(), NOTES).collect()} == live
    assert target.current().number == 4
    seen = VersionedTable(spark, str(tmp_path / "seen"), merge.snapshot_schema(NOTES))
    merge.run_to_end(merge.into_feed(stream(), seen, NOTES, str(tmp_path / "f"), str(tmp_path / "c2")))
    got = sorted((r["seq"], r["kind"], sorted(r["changed"])) for r in merge.read_feed(spark, str(tmp_path / "f"), NOTES).collect())
    assert got == events


def test_second_checkpoint_is_kept_and_large_values_stay(spark, tmp_path):
    n = 1 << 60
    target = VersionedTable(spark, str(tmp_path / "snap"), merge.snapshot_schema(NOTES))
    fed = VersionedTable(spark, str(tmp_path / "fed"), merge.snapshot_schema(NOTES))
    parts = [[up(1, 1, b=n + 1), up(1, 1, b=n + 2), up(1, 1, b=n + 1), up(1, 3, b=None)], [up(1, 2, b=n), up(1, 1, b=n + 3), up(1, 1, b=n + 2), up(2, 3, a="x")]]
    for i, ops in enumerate(parts):
        folder = str(tmp_path / f"in{i}")
        df = frame(spark, ops)
        df.write.parquet(folder)
        stream = lambda: spark.readStream.schema(df.schema).parquet(folder)  # noqa: E731, B023
        merge.run_to_end(merge.into_snapshot(stream(), target, NOTES, str(tmp_path / f"c{i}")))
        merge.run_to_end(merge.into_feed(stream(), fed, NOTES, str(tmp_path / "f"), str(tmp_path / f"d{i}")))
        # A stream that has nothing new adds nothing.
        merge.run_to_end(merge.into_feed(stream(), fed, NOTES, str(tmp_path / "f"), str(tmp_path / f"d{i}")))
    assert {r["k"]: (r["a"], r["b"]) for r in fold.live(target.read(), NOTES).collect()} == {1: (None, n + 3), 2: (None, n), 3: ("x", None)}
    assert sorted(map(tuple, fed.read().collect()), key=str) == sorted(map(tuple, target.read().collect()), key=str)
    got = sorted((r["k"], r["seq"], r["changed"]) for r in merge.read_feed(spark, str(tmp_path / "f"), NOTES).collect())
    assert got == [(1, 0, ["b"]), (1, 1, ["b"]), (1, 1, ["b"]), (2, 0, ["b"]), (3, 3, ["a"]), (3, 3, ["b"])]


def test_segments_wait_for_their_anchor(spark):
    known = spark.createDataFrame([("l", 3, "x")], "log string, size bigint, hash string")
    new = spark.createDataFrame([("l", 0, "-"), ("l", 3, "x"), ("l", 3, "y"), ("m", 3, "x")], "log string, idx_start bigint, prev_hash string")
    ready, waits = merge.anchored(new, known, ["log"])
    assert {tuple(r) for r in ready.collect()} == {("l", 0, "-"), ("l", 3, "x")} and waits.count() == 2


def test_watch(spark):
    f = feed.change_feed(frame(spark, [up(1, 1, a="x"), up(1, 2), up(2, 1, b=None)]), NOTES)
    assert feed.watch(f, k=1).count() == 2
    assert {tuple(r) for r in feed.column_changes(feed.watch(f, k=1), NOTES).collect()} == {(0, "a", "set"), (0, "b", "unchanged"), (2, "a", "unchanged"), (2, "b", "set_null")}


def test_work_folder_follows_the_cluster():
    from types import SimpleNamespace

    named = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: {"spark.checkpoint.dir": "file:///shared/"}.get(key, default)))
    assert work_folder(named, "x").startswith("file:///shared/x-")
