"""Problems 1 to 5 on small fixtures: nulls, ties, repeats, empty tables, clashing names."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from loomfold.operators import changefeed as cf
from loomfold.operators import delivery, incremental, references
from loomfold.sources.versioned import VersionConflict, VersionedTable

T0 = dt.datetime(2020, 1, 1)
SRC = "id bigint, v bigint, seen timestamp_ntz, _top string, _slice string"


def src(spark, rows):
    return spark.createDataFrame([(i, v, T0 + dt.timedelta(seconds=s), "x", "y") for i, v, s in rows], SRC)


def test_newest_takes_ties_nulls_and_repeats(spark):
    df = src(spark, [(1, 5, 0), (1, 5, 9), (1, 4, 10), (1, 5, 9), (2, None, 0), (None, 3, 0)])
    got = {(r["id"], r["v"], r["seen"]) for r in incremental.newest(df, ["id"], "v", ["seen"], ["seen"]).collect()}
    assert got == {(1, 5, T0 + dt.timedelta(seconds=9)), (2, None, T0), (None, 3, T0)}


def test_runs_handle_each_version_once(spark, tmp_path):
    schema = spark.createDataFrame([], "id bigint, v bigint, w string").schema
    target = VersionedTable(spark, str(tmp_path / "t"), schema)
    work = lambda df: df.withColumn("w", F.lit("done"))
    first = src(spark, [(1, 1, 0), (2, 1, 0), (None, None, 0)])
    assert incremental.run(first, target, ["id"], "v", work).number == 1
    assert incremental.pending(first, target.read(), ["id"], "v").count() == 0
    second = src(spark, [(1, 2, 0), (2, 1, 0), (3, 1, 0)])
    assert {r["id"] for r in incremental.pending(second, target.read(), ["id"], "v").collect()} == {1, 3}
    incremental.run(second, target, ["id"], "v", work)
    assert target.read().count() == 5

    def fails(df):
        raise RuntimeError("lost")

    third = src(spark, [(4, 1, 0)])
    with pytest.raises(RuntimeError):
        incremental.run(third, target, ["id"], "v", fails)
    assert target.current().number == 2
    assert incremental.pending(third, target.read(), ["id"], "v").count() == 1
    assert incremental.pending(src(spark, []), target.read(), ["id"], "v").count() == 0


def test_two_writers_conflict(spark, tmp_path):
    schema = spark.createDataFrame([], "id bigint").schema
    t = VersionedTable(spark, str(tmp_path / "t"), schema)
    base = t.current()
    t.append(spark.range(3), base=base)
    with pytest.raises(VersionConflict):
        t.append(spark.range(5), base=base)
    assert t.read().count() == 3
    assert t.read(t.version(1)).count() == 3


@pytest.mark.parametrize("seed", range(3))
def test_covered_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    runs = [(rng.choice(["a", "b", None]), rng.choice([None, *range(40)]), rng.choice([None, *range(60)]), rng.choice([None, *range(9)])) for _ in range(40)]
    runs.append(("a", 0, 10**15, 1))
    recs = [(rng.choice(["a", "b", None]), rng.choice([None, *range(70)]), rng.choice([None, *range(9)])) for _ in range(200)]
    a = spark.createDataFrame(runs, "r string, lo bigint, hi bigint, at bigint")
    d = spark.createDataFrame(recs, "r string, v bigint, seen bigint")
    got = sorted(map(tuple, incremental.covered(d, a, ["r"], "v", "seen", "lo", "hi", "at").collect()), key=str)
    want = sorted((x for x in recs if None not in x and any(None not in y and y[0] == x[0] and y[1] < x[1] <= y[2] and y[3] >= x[2] for y in runs)), key=str)
    assert got == want
    assert incremental.covered(d, a.limit(0), ["r"], "v", "seen", "lo", "hi", "at").count() == 0


def test_covered_slices_each_unit_apart(spark):
    """Stamps and milliseconds, a run that covers all, and one replica with a third of the rows: few candidates a record."""
    rng, runs, recs = random.Random(4), [], []
    for kind, step in (("pack", 3_600_000), ("change", 3_600_000 << 16)):
        for replica, n in ((1, 400), (2, 60), (3, 1)):
            runs += [(kind, replica, i * step, (i + 1) * step, i) for i in range(n)]
            recs += [(kind, replica, rng.randrange(n * step), rng.randrange(n)) for _ in range(3 * n)]
    runs.append(("pack", 1, -(2**63), 2**63 - 1, 7))
    a = spark.createDataFrame(runs, "kind string, r bigint, lo bigint, hi bigint, at bigint")
    d = spark.createDataFrame(recs, "kind string, r bigint, v bigint, seen bigint")
    got = sorted(map(tuple, incremental.covered(d, a, ["kind", "r"], "v", "seen", "lo", "hi", "at").collect()))
    assert got == sorted(x for x in recs if any(y[:2] == x[:2] and y[2] < x[2] <= y[3] and y[4] >= x[3] for y in runs))
    own, pieces = incremental.sliced(d, a, ["kind", "r"], "v", "lo", "hi", "at")
    assert pieces.count() <= 4 * len(runs)
    assert own.join(pieces, incremental.facing(own, pieces, ["kind", "r"])).count() <= 6 * len(recs)


@pytest.mark.parametrize("bits", [2, 11])
def test_orphans_equal_brute_force(spark, bits):
    rng = random.Random(bits)
    parents = [(rng.choice(["x", "y", None]), rng.choice([None, *range(-40, 60)])) for _ in range(120)]
    refs = [(rng.choice(["x", "y", "z", None]), rng.choice([None, *range(-50, 70)])) for _ in range(200)]
    p, r = (spark.createDataFrame(x, "b string, k bigint") for x in (parents, refs))
    got = {tuple(x) for x in references.orphan_keys(r, p, ["b"], "k", bits).collect()}
    assert got == {x for x in set(refs) if x[1] is None or x not in set(parents)}
    assert references.orphan_keys(r.limit(0), p, ["b"], "k").count() == 0
    assert references.orphan_keys(r, p.limit(0), ["b"], "k").count() == len(set(refs))


def test_runs_are_contiguous(spark):
    p = spark.createDataFrame([(k,) for k in (1, 2, 3, 3, 7, 8, 2047, 2048)], "k bigint").withColumn("b", F.lit(1))
    got = {(x["run_start"], x["run_end"]) for x in references.runs(p, ["b"], "k").collect()}
    assert got == {(1, 3), (7, 8), (2047, 2047), (2048, 2048)}


PACK = (
    "delivery_id bigint, received_at timestamp_ntz, peer bigint, file_name string, seq_start bigint, seq_end bigint, pack_id bigint, generation bigint, self_supersedes array<struct<id:bigint,end_seq:bigint>>, "
    "peer_data array<struct<peer:bigint,supersedes:array<struct<seq_start:bigint,seq_end:bigint,id:bigint,generation:bigint>>>>"
)


def test_deliveries(spark):
    t = lambda s: T0 + dt.timedelta(seconds=s)
    rows = [
        (1, t(5), 1, None, 0, 1, 10, 0, None, None),
        (2, t(3), 1, None, 0, 1, 10, 1, [], []),
        (3, t(1), 1, "_/ab/0000-0001-000000000000000A-01.uqp", None, None, None, None, None, None),
        (4, t(1), 2, None, 1, 2, 11, 0, None, None),
        (5, t(2), 1, None, 2, 3, 12, 0, [(11, 2), None], None),
        (6, t(2), 1, "no name", None, None, None, None, None, None),
        (7, t(2), 1, None, None, None, None, None, None, None),
        (8, t(2), 3, None, 4, 6, 13, 2, None, None),
        (9, t(2), 1, None, 7, 8, 14, 0, None, [(3, [(4, 6, 13, 2)]), (3, None)]),
        (10, t(2), 3, None, 4, 7, 13, 1, None, [(3, [(4, 7, 13, 0)])]),
        (11, None, 1, None, 0, 1, 15, None, None, None),
        (12, t(9), 1, None, 0, 1, 15, None, None, None),
    ]
    p = spark.createDataFrame(rows, PACK)
    assert {r["delivery_id"] for r in delivery.dropped_deliveries(p).collect()} == {1, 2, 4, 8, 11}
    assert delivery.dropped_deliveries(p.limit(0)).count() == 0


SHAPE = cf.Shape((("k0", "string"), ("k1", "bigint")), (("body", "string"), ("n", "bigint"), ("who", "binary")))
OPS = "seq bigint, k0 string, k1 bigint, kind string, ts bigint, body_set boolean, body string, n_set boolean, n bigint, who_set boolean, who binary, upsert_ts string, state string"


def random_ops(rng, n):
    maybe = lambda *v: rng.choice(v)
    return [
        (i, maybe("a", "A", "", None, "é"), maybe(1, 2, None), maybe("U", "upsert ", "D", "delete", "u", None, "?"), maybe(None, 0, -3, 1, 2, 3, 4), maybe(True, False, None), maybe(None, "", "x", "y" * 50), maybe(True, False, None), maybe(None, -1, 5), maybe(True, None), maybe(None, b"\x80", b"\x7f"), "clash", "clash")
        for i in range(n)
    ]


def brute(ops):
    rows: dict = {}
    for _, k0, k1, kind, ts, *cells, _, _ in ops:
        first = (kind or "").strip()[:1].lower()
        if k0 is None or k1 is None or ts is None or ts < 1 or first not in ("u", "d"):
            continue
        r = rows.setdefault((k0, k1), {"u": 0, "d": 0, "c": {}})
        r[first] = max(r[first], ts)
        if first == "u":
            for name, on, v in zip(("body", "n", "who"), cells[::2], cells[1::2]):
                if on:
                    rank = (ts, v is not None, v.encode() if isinstance(v, str) else v or 0 if not isinstance(v, bytes) else v)
                    if name not in r["c"] or rank > r["c"][name]:
                        r["c"][name] = rank
    out = set()
    for k, r in rows.items():
        if r["u"] >= max(1, r["d"]):
            out.add((*k, "row", r["u"]))
            out |= {(*k, n, x[0]) for n, x in r["c"].items() if x[0] >= r["d"] and x[1]}
    return out


@pytest.mark.parametrize("statement", [7, 200_000])
def test_change_feed_equals_brute_force(spark, tmp_path, monkeypatch, statement):
    monkeypatch.setattr(cf, "STATEMENT_ROWS", statement)
    rng = random.Random(statement)
    ops = random_ops(rng, 400)
    late = random_ops(rng, 100) + rng.sample(ops, 50)
    target = VersionedTable(spark, str(tmp_path / "s"), SHAPE.schema)
    cf.apply(spark, spark.createDataFrame(ops, OPS), target, SHAPE)
    lines = lambda: {tuple(r) for r in cf.cells(cf.live(target.read(), SHAPE), SHAPE).collect()}
    assert lines() == brute(ops)
    cf.apply(spark, spark.createDataFrame(late, OPS), target, SHAPE)
    assert lines() == brute(ops + late)
    assert target.current().number == 2


def test_change_feed_rewrites_touched_buckets_and_splits_full_ones(spark, tmp_path, monkeypatch):
    from loomfold.sources import bucketed

    rng = random.Random(3)
    key = lambda ops: [(*o[:2], o[0] % 50, *o[3:]) for o in ops]
    first = key(random_ops(rng, 600))
    target = VersionedTable(spark, str(tmp_path / "s"), SHAPE.schema)
    lines = lambda: {tuple(r) for r in cf.cells(cf.live(target.read(), SHAPE), SHAPE).collect()}
    v1 = cf.apply(spark, spark.createDataFrame(first, OPS), target, SHAPE, buckets=16)
    assert v1.facts["buckets"] == 16 and v1.facts["rewritten"] == len(target.below(v1.parts[0])) > 8
    more = [(0, "a", 7, "U", 9, True, "late", False, None, None, None, "", ""), (1, "a", 7, "delete", 2, None, None, None, None, None, None, "", "")]
    v2 = cf.apply(spark, spark.createDataFrame(more, OPS), target, SHAPE)
    assert v2.facts["rewritten"] == 1 and len(v2.parts) == v1.facts["rewritten"] and lines() == brute(first + more)
    sizes = target.read().agg(F.sum(bucketed.row_bytes(SHAPE.schema))).first()[0]
    assert v2.facts["bytes"] == sizes
    monkeypatch.setattr(bucketed, "BUCKET_BYTES", v2.facts["bytes"] // 16)
    third = key(random_ops(rng, 300))
    v3 = cf.apply(spark, spark.createDataFrame(third, OPS), target, SHAPE)
    assert v3.facts["buckets"] >= 32 and len(v3.parts) == 1 and lines() == brute(first + more + third)
    assert target.read(v1).count() == len({(o[1], o[2]) for o in first if None not in o[1:3] and (o[4] or 0) >= 1 and (o[3] or "").strip()[:1].lower() in ("u", "d")})


def test_large_bucket_spills(spark, tmp_path):
    """400,000 keys of 1.2 KB each, thrice the memory of a task's database, in one bucket, and once more over it."""
    n = 400_000
    ops = spark.range(n).selectExpr("id AS seq", "'k' AS k0", "id AS k1", "'U' AS kind", "5L AS ts", "true AS body_set", "rpad(sha2(cast(id AS string), 512), 1200, sha2(cast(id + 1 AS string), 512)) AS body", "false AS n_set", "1L AS n", "false AS who_set", "cast(NULL AS binary) AS who")
    target = VersionedTable(spark, str(tmp_path / "s"), SHAPE.schema)
    cf.apply(spark, ops, target, SHAPE, buckets=1)
    assert target.read().agg(F.count("*"), F.sum(F.length("body"))).first()[:] == (n, n * 1200)


def test_change_feed_of_nothing(spark, tmp_path):
    target = VersionedTable(spark, str(tmp_path / "s"), SHAPE.schema)
    cf.apply(spark, spark.createDataFrame([], OPS), target, SHAPE)
    assert cf.live(target.read(), SHAPE).count() == 0


def test_compactor_discovers_once_and_retries_replace(spark, tmp_path, small):
    from loomfold.operators import packfiles
    from loomfold.streaming import compactor

    packs = spark.read.parquet(f"{small}/packs.parquet")
    folder = str(tmp_path / "in.parquet")
    packs.repartition(5).write.parquet(folder)
    root = str(tmp_path / "work")
    n = packs.count()
    assert compactor.ingest(spark, folder, root, batch_files=2).read(spark).count() == n
    assert compactor.ingest(spark, folder, root).read(spark).count() == n
    more = packs.withColumn("delivery_id", F.col("delivery_id") + 10**6)
    more.coalesce(1).write.mode("append").parquet(folder)
    taken = compactor.ingest(spark, folder, root)
    assert taken.read(spark).count() == 2 * n
    # The copies add no pack and no segment.
    assert compactor.small_packs(taken.read(spark)).count() == compactor.small_packs(packs).count()
    want = compactor.current_segments(packs)
    target = VersionedTable(spark, str(tmp_path / "segments"), compactor.OUTPUT)
    version = compactor.compact(spark, taken, target)
    assert compactor.compact(spark, taken, target) == version
    got = compactor.output_segments(target.read())
    assert sorted(map(tuple, got.select(want.columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert got.count() == got.select("peer", "container_id", "idx_start", "idx_end", "end_chain_hash").distinct().count()
    assert sorted(compactor.output_packs(target.read(), compactor.SMALL_BYTES).collect()) == sorted(compactor.small_packs(packs).collect())
    assert packfiles.segments(packfiles.identified(packs)).count() > got.count()
    # Later batches against the state: what they supersede or delete goes, of the state only their buckets are rewritten.
    one = packs.where("pack_id IS NOT NULL AND seq_end IS NOT NULL AND generation IS NOT NULL").limit(1).withColumns({"generation": F.lit(99).cast("bigint"), "deleted_at": F.lit("2030-01-01").cast("timestamp_ntz"), "delivery_id": F.lit(-1).cast("bigint")})
    one.coalesce(1).write.mode("append").parquet(folder)
    taken = compactor.ingest(spark, folder, root)
    compactor.compact(spark, taken, target)
    both = packs.unionByName(spark.createDataFrame(one.collect(), packs.schema))
    assert taken.state(spark).current().facts["rewritten"] < taken.state(spark).current().facts["buckets"]
    assert sorted(map(tuple, compactor.output_segments(target.read()).select(want.columns).collect()), key=str) == sorted(map(tuple, compactor.current_segments(both).collect()), key=str)
    assert sorted(compactor.output_packs(target.read()).collect()) == sorted(compactor.current_packs(both).select("pack_id", "seq_end").collect())


def test_files_have_the_wanted_size(spark, tmp_path):
    import glob
    import os

    from loomfold.streaming import compactor

    rows = spark.range(60_000).selectExpr("'segment' AS kind", "id AS pack_id", "id AS seq_end", "cast(NULL AS bigint) AS body_size", "CASE WHEN id % 3 = 0 THEN 1 ELSE id % 50 END AS peer", "unhex(substring(sha2(cast(id AS string), 256), 1, 32)) AS container_id", "id AS idx_start", "id + 1 AS idx_end", "unhex(sha2(cast(id AS string), 256)) AS prev_chain_hash", "unhex(sha2(cast(id + 1 AS string), 256)) AS end_chain_hash", "0L AS body_start", "9L AS body_end")
    target = VersionedTable(spark, str(tmp_path / "t"), compactor.OUTPUT)
    wanted = 500_000
    v = compactor.sized(target, rows, ["peer", "container_id"], wanted, {}, target.current())
    files = [os.path.getsize(f) for f in glob.glob(f"{tmp_path}/t/{v.parts[0]}/*.parquet")]
    assert len(files) == v.facts["files"] > 5 and all(wanted / 2 <= n <= 2 * wanted for n in files)
    assert target.read().count() == 60_000 and len(glob.glob(f"{tmp_path}/t/data/*")) == 1
    small = compactor.sized(target, rows.limit(0), ["peer"], wanted, {}, target.current())
    assert small.facts["files"] == 1 and target.read().count() == 0
