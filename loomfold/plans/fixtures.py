"""Operations derived from the driver's tables, in Spark and in SQL, and the tables they fold to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfold.operators import changefeed
from loomfold.schema import table as declare
from loomfold.session import table

USER_STATE = declare("user_state", 1, {"user_id": "i64"}, {"page": "text", "score": "i64"})
LINE_STATE = declare("line_state", 2, {"k0": "i64", "k1": "i64"}, {"qty": "i64", "flag": "text", "price": "i64"})
PART_STATE = declare("part_state", 3, {"k0": "i64", "k1": "i64", "k2": "i64"}, {"qty": "i64", "tag": "bytes"})
ROW_STATE = declare("row_state", 4, {"k0": "text", "k1": "i64"}, {"body": "text", "n": "i64", "who": "uuid"})

FINE, COARSE = "fine", "coarse"


def user_ops(spark: SparkSession, folder: str, clock: str = FINE) -> DataFrame:
    return user_ops_of(table(spark, folder, "events"), clock)


def user_ops_of(e: DataFrame, clock: str = FINE) -> DataFrame:
    ms = "unix_millis(cast(ts AS timestamp))"
    ts = f"shiftleft({ms}, 16) + event_id % 65536" if clock == FINE else "cast(datediff(cast(ts AS date), DATE'2023-12-31') AS bigint)"
    return e.selectExpr(
        "user_id", "event_id AS seq", f"{ts} AS ts", "CASE WHEN event_type = 'error' THEN 'D' ELSE 'U' END AS kind",
        "event_type IN ('view', 'click') AS page_set", "props AS page",
        "event_type IN ('click', 'purchase') AS score_set", "CASE WHEN value >= 50 THEN cast(round(value * 100) AS bigint) END AS score",
    )


def user_ops_sql(clock: str = FINE) -> str:
    ts = "(epoch_us(ts) // 1000) * 65536 + event_id % 65536" if clock == FINE else "date_diff('day', DATE '2023-12-31', CAST(ts AS DATE))"
    return f"""ops AS (SELECT user_id, event_id AS seq, {ts} AS ts, CASE WHEN event_type = 'error' THEN 'D' ELSE 'U' END AS kind,
event_type IN ('view', 'click') AS page_set, props AS page, event_type IN ('click', 'purchase') AS score_set,
CASE WHEN value >= 50 THEN CAST(round(value * 100) AS BIGINT) END AS score FROM events)"""


def line_ops(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").selectExpr(
        "l_orderkey AS k0", "cast(l_linenumber AS bigint) AS k1", "cast(datediff(cast(l_shipdate AS date), DATE'1994-12-31') AS bigint) AS ts",
        "CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'D' ELSE 'U' END AS kind",
        "l_linestatus = 'O' AS qty_set", "cast(round(l_quantity) AS bigint) AS qty",
        "true AS flag_set", "CASE WHEN l_tax >= 0.02 THEN l_returnflag END AS flag",
        "l_returnflag = 'A' AS price_set", "cast(round(l_extendedprice * 100) AS bigint) AS price",
    )


LINE_OPS = """ops AS (SELECT l_orderkey AS k0, CAST(l_linenumber AS BIGINT) AS k1, date_diff('day', DATE '1994-12-31', CAST(l_shipdate AS DATE)) AS ts,
CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'D' ELSE 'U' END AS kind, l_linestatus = 'O' AS qty_set, CAST(round(l_quantity) AS BIGINT) AS qty,
true AS flag_set, CASE WHEN l_tax >= 0.02 THEN l_returnflag END AS flag, l_returnflag = 'A' AS price_set, CAST(round(l_extendedprice * 100) AS BIGINT) AS price FROM lineitem)"""


def part_ops(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").selectExpr(
        "l_partkey AS k0", "l_suppkey AS k1", "cast(l_linenumber AS bigint) AS k2", "cast(datediff(cast(l_shipdate AS date), DATE'1990-12-31') AS bigint) AS ts",
        "CASE WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN 'D' ELSE 'U' END AS kind",
        "true AS qty_set", "cast(round(l_quantity) AS bigint) AS qty", "l_linestatus = 'O' AS tag_set", "cast(l_returnflag AS binary) AS tag",
    )


PART_OPS = """ops AS (SELECT l_partkey AS k0, l_suppkey AS k1, CAST(l_linenumber AS BIGINT) AS k2, date_diff('day', DATE '1990-12-31', CAST(l_shipdate AS DATE)) AS ts,
CASE WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN 'D' ELSE 'U' END AS kind, true AS qty_set, CAST(round(l_quantity) AS BIGINT) AS qty, l_linestatus = 'O' AS tag_set, CAST(l_returnflag AS BLOB) AS tag FROM lineitem)"""


def row_ops(spark: SparkSession, folder: str) -> DataFrame:
    first = F.upper(F.substring(F.trim("kind"), 1, 1))
    return table(spark, folder, "row_ops").withColumn("kind", first)


ROW_OPS = "ops AS (SELECT * REPLACE (upper(substring(trim(kind), 1, 1)) AS kind) FROM row_ops)"
assert changefeed.ROW_OPS.key[0][0] == ROW_STATE.key[0].name


def fold_sql(ops: str, t) -> str:
    """CTEs ``ops`` and ``f`` (keys, u, d, m_<c>) of the fold in DuckDB, where a null must be told apart by hand."""
    keys = ", ".join(t.keys)
    known = " AND ".join(f"{k} IS NOT NULL" for k in t.keys)
    cells = "".join(f", max(struct_pack(t := ts, p := {c.name} IS NOT NULL, v := {c.name})) FILTER (WHERE kind = 'U' AND {c.name}_set) AS m_{c.name}" for c in t.values)
    return f"{ops}, f AS (SELECT {keys}, max(ts) FILTER (WHERE kind = 'U') AS u, coalesce(max(ts) FILTER (WHERE kind = 'D'), 0) AS d{cells} FROM ops WHERE ts >= 1 AND kind IN ('U', 'D') AND {known} GROUP BY {keys})"


def shown(c: str) -> str:
    return f"CASE WHEN m_{c}.t >= d THEN m_{c}.v END"
