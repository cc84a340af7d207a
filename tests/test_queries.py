"""Every named query of the core against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from loomfold.plans.registry import ALL


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{small}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def norm(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: None if v is None else str(int(v)) if isinstance(v, (bool, int)) or isinstance(v, float) and v == int(v) else str(v)
    return sorted(tuple(str(plain(r[i])) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in ALL.items() if sql))
def test_query_equals_sql(spark, small, con, name):
    run, sql = ALL[name]
    df = run(spark, small)
    want = con.execute(sql)
    columns = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert norm(df.collect(), df.columns) == norm(want.fetchall(), columns)
