"""Every fire query against its DuckDB SQL on the smallest tables."""

import math

import duckdb
import pytest

from emberline.plans.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    return repr(float(v)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    found = QUERIES[name](spark, DATA)
    cols = sorted(found.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in found.collect())
    res = duck.execute(ORACLES[name])
    names = [x[0] for x in res.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    assert got == sorted(tuple(plain(r[i]) for i in order) for r in res.fetchall())


def on_rows(spark, name, folder, **tables):
    """What a query and its SQL give on tables of their own, as sorted rows."""
    con = duckdb.connect()
    for t, df in tables.items():
        df.coalesce(1).write.parquet(f"file://{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    found = QUERIES[name](spark, f"file://{folder}")
    res = con.execute(ORACLES[name])
    order = [[x[0] for x in res.description].index(c) for c in found.columns]
    return sorted(tuple(map(plain, r)) for r in found.collect()), sorted(tuple(plain(r[i]) for i in order) for r in res.fetchall())


def test_tiles_of_all_coordinates(spark, tmp_path):
    events = spark.range(21 * 2099).selectExpr("id AS event_id", "id DIV 21 AS user_id", "TIMESTAMP '2020-01-01' AS ts", "'x' AS event_type")  # every offset with every coordinate
    got, want = on_rows(spark, "j_tile_assignment", tmp_path, events=events)
    assert len(got) == 21 * 2099 and got == want


def test_overlay_next_to_a_tie(spark, tmp_path):
    # the star's common area is 9.1505449994, which sums of products of whole coordinates take to 9.1505450003
    orders = spark.sql("SELECT 6857L AS o_orderkey, 996L AS o_custkey, TIMESTAMP '1997-01-01' AS o_orderdate")
    nation = spark.sql("SELECT 15 AS n_nationkey, 'NATION_15' AS n_name")
    blank = {t: spark.sql(f"SELECT {c} WHERE FALSE") for t, c in (("events", "0L AS event_id, TIMESTAMP '1997-01-01' AS ts, 0L AS user_id, 'x' AS event_type"), ("lineitem", "TIMESTAMP '1997-01-01' AS l_shipdate, 0L AS l_partkey, 0L AS l_suppkey"))}
    got, want = on_rows(spark, "r_polygon_overlay", tmp_path, orders=orders, nation=nation, **blank)
    assert len(got) == 1 and got == want
