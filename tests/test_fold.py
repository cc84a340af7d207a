import random

import pytest
from helpers import NOTES, down, frame, sequential, up
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from loomfold.operators import cells, compare, feed, fold

#: name, operations, live (a, b) or None, events (kind, changed)
VECTORS = [
    ("newer", [up(100, a="old"), up(200, a="new")], ("new", None), [("U", ["a"]), ("U", ["a"])]),
    ("older last", [up(200, a="new"), up(100, a="old")], ("new", None), [("U", ["a"])]),
    ("tie up", [up(100, a="aaa"), up(100, a="bbb")], ("bbb", None), [("U", ["a"]), ("U", ["a"])]),
    ("tie down", [up(100, a="bbb"), up(100, a="aaa")], ("bbb", None), [("U", ["a"])]),
    ("delete", [up(100, a="x"), down(200)], None, [("U", ["a"]), ("D", [])]),
    ("late upsert", [down(200), up(100, a="x")], None, [("D", [])]),
    ("tie revives", [down(200), up(200, a="back")], ("back", None), [("D", []), ("U", ["a"])]),
    ("newer cell stays", [up(100, a="x"), up(300, b=9), down(200)], (None, 9), [("U", ["a"]), ("U", ["b"]), ("D", [])]),
    ("null wins", [up(100, a="x"), up(200, a=None)], (None, None), [("U", ["a"]), ("U", ["a"])]),
    ("null loses tie", [up(100, a=None), up(100, a="x")], ("x", None), [("U", ["a"]), ("U", ["a"])]),
    ("key only", [up(100), up(50)], (None, None), [("U", [])]),
    ("deletes", [down(100), down(200), down(50)], None, [("D", []), ("D", [])]),
    ("again", [up(100, a="x"), up(100, a="x")], ("x", None), [("U", ["a"])]),
]


@pytest.fixture(scope="module")
def vectors(spark):
    ops = [(kind, ts, i, s) for i, (_, v, *_) in enumerate(VECTORS) for kind, ts, _, s in v]
    return frame(spark, ops).cache()


def test_vectors_live(vectors):
    got = {r["k"]: (r["a"], r["b"]) for r in fold.fold(vectors, NOTES).collect()}
    assert got == {i: v[2] for i, v in enumerate(VECTORS) if v[2] is not None}


def test_vectors_feed(vectors):
    got: dict = {}
    for r in feed.change_feed(vectors, NOTES).orderBy("seq").collect():
        got.setdefault(r["k"], []).append((r["kind"], r["changed"]))
    assert got == {i: v[3] for i, v in enumerate(VECTORS)}


def test_vectors_cells(vectors, spark):
    long = cells.widen(vectors, NOTES, ["k"], as_json=True)
    got = {int(r["pk"].split(":")[1].rstrip("}")): (r["a"], r["b"]) for r in cells.pivot(cells.fold(long), NOTES).collect()}
    assert got == {i: v[2] for i, v in enumerate(VECTORS) if v[2] is not None}


def test_physical_stamps(vectors):
    rows = {r["k"]: r for r in fold.physical(fold.partials(vectors, NOTES), NOTES).collect()}
    dead = next(i for i, v in enumerate(VECTORS) if v[0] == "delete")
    assert (rows[dead]["upsert_ts"], rows[dead]["deleted_ts"], rows[dead]["a"], rows[dead]["a_lww"]) == (100, 200, None, 0)


def random_ops(rng, n):
    out = []
    for _ in range(n):
        k, ts = rng.randint(1, 12), rng.randint(1, 6)
        if rng.random() < 0.3:
            out.append(down(ts, k))
        else:
            sets = {}
            if rng.random() < 0.6:
                sets["a"] = rng.choice([None, "", "a", "b", "é"])
            if rng.random() < 0.5:
                sets["b"] = rng.choice([None, -1, 0, 7])
            out.append(up(ts, k, **sets))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_random_equals_sequential(spark, seed):
    rng = random.Random(seed)
    ops = random_ops(rng, 200)
    live, events = sequential(ops)
    df = frame(spark, ops)
    assert {r["k"]: (r["a"], r["b"]) for r in fold.fold(df, NOTES).collect()} == live
    got = [(r["seq"], r["kind"], sorted(r["changed"])) for r in feed.change_feed(df, NOTES).orderBy("seq").collect()]
    assert got == events


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(seed=st.integers(0, 10**6), cut=st.integers(0, 60))
def test_order_repetition_and_splits_change_nothing(spark, seed, cut):
    rng = random.Random(seed)
    ops = random_ops(rng, 60)
    mixed = ops + rng.sample(ops, 20)
    rng.shuffle(mixed)
    a = fold.fold(frame(spark, ops), NOTES)
    parts = [fold.partials(frame(spark, mixed[:cut]), NOTES), fold.partials(frame(spark, mixed[cut:]), NOTES)]
    b = fold.live(fold.merge(*parts, table=NOTES), NOTES)
    r = compare.difference(a, b).first()
    assert (r["only_a"], r["only_b"]) == (0, 0)


def test_empty_and_malformed(spark):
    assert fold.fold(frame(spark, []), NOTES).count() == 0
    df = frame(spark, [up(0, 1, a="x"), up(5, None, a="x"), ("X", 5, 2, {}), ("U", None, 3, {})])
    assert fold.fold(df, NOTES).count() == 0
    assert feed.change_feed(df, NOTES).count() == 0


def test_unknown_tables_and_columns_are_kept(spark):
    rows = [(999, "k1", "U", 5, [(7, (None, None, b"x"))]), (999, "k1", "U", 6, [(200, (None, None, None))]), (999, "k1", "U", 6, [(129, (9, None, None))]), (999, "k1", "U", 6, [(129, (10, None, None))]), (NOTES.table_id, "k2", "U", 5, [(63, (None, None, b"later"))])]
    ops = spark.createDataFrame(rows, f"table_id int, pk string, kind string, ts bigint, cells {cells.CELLS}")
    got = {(r["table_id"], r["pk"], r["column_id"], r["ts"], r["v"]) for r in cells.fold(ops).withColumn("v", cells.as_text(F.col("value"))).collect()}
    assert got == {(999, "k1", -1, 6, None), (999, "k1", 7, 5, "78"), (999, "k1", 200, 6, None), (999, "k1", 129, 6, "10"), (NOTES.table_id, "k2", -1, 5, None), (NOTES.table_id, "k2", 63, 5, "6C61746572")}
