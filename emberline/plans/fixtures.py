"""Inputs of the fire products derived from the star-schema tables.

One list of expressions serves both engines; DuckDB writes 1e0 where Spark writes 1D.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.operators.raster import Grid

GRID = Grid(west=-80.0, north=1.0, width=20.0 / 24, height=21.0 / 24, rows=24, cols=24)

DETECTIONS = (
    "event_id AS det_id",
    "CAST(ts AS DATE) AS acq_date",
    "-80.0D + CAST((user_id*7919)%1999 AS DOUBLE)/100.0D + CAST((event_id*37)%21-10 AS DOUBLE)*0.001D AS longitude",
    "-20.0D + CAST((user_id*104729)%2099 AS DOUBLE)/100.0D + CAST((event_id*53)%21-10 AS DOUBLE)*0.001D AS latitude",
    "CAST((event_id*31)%101 AS INT) AS confidence",
    "CAST((event_id*17)%4 AS INT) AS type",
    "event_type AS satellite",
)
ZONES = (
    "n_nationkey AS zone_id",
    "CASE WHEN n_nationkey=24 THEN NULL ELSE n_name END AS zone_name",
    "-80.0D + 4.0D*CAST(n_nationkey%5 AS DOUBLE) + 0.05D AS minx",
    "-20.0D + 4.2D*CAST(FLOOR(n_nationkey/5.0D) AS DOUBLE) + 0.05D AS miny",
    "-80.0D + 4.0D*CAST(n_nationkey%5 AS DOUBLE) + 4.1D AS maxx",
    "-20.0D + 4.2D*CAST(FLOOR(n_nationkey/5.0D) AS DOUBLE) + 4.1D AS maxy",
)
PIXELS = (
    "CAST(year(l_shipdate)+8 AS INT) AS year",
    "CAST(month(l_shipdate) AS INT) AS month",
    "CAST(dayofyear(l_shipdate) AS INT) AS doy",
    "CAST(l_partkey%24 AS INT) AS r",
    "CAST((l_partkey*7+l_suppkey)%24 AS INT) AS c",
)
PERIMETERS = (
    "o_orderkey AS perim_id",
    "CAST(o_orderdate AS DATE) AS start_date",
    "-81.5D + CAST((o_custkey*7919+o_orderkey*13)%2099 AS DOUBLE)/100.0D AS cx",
    "-19.5D + CAST((o_custkey*104729+o_orderkey*29)%1999 AS DOUBLE)/100.0D AS cy",
    "0.002D + 0.002D*CAST(o_orderkey%50 AS DOUBLE) AS hx",
    "0.002D + 0.003D*CAST(o_orderkey%20 AS DOUBLE) AS hy",
)


def duck(exprs: tuple[str, ...], table: str) -> str:
    """A DuckDB query for a list of expressions."""
    return re.sub(r"(\d\.\d+)D", r"\1e0", f"SELECT {', '.join(exprs)} FROM {table}")


#: DuckDB CTEs of all fixtures.
CTES = f"""
det AS ({duck(DETECTIONS, "events")}),
zone AS ({duck(ZONES, "nation")}),
px AS (SELECT year, month, r, c, MIN(doy) AS doy FROM ({duck(PIXELS, "lineitem")}) GROUP BY year, month, r, c),
perim0 AS ({duck(PERIMETERS, "orders")}),
perim AS (SELECT *, cx - hx AS minx, cy - hy AS miny, cx + hx AS maxx, cy + hy AS maxy FROM perim0),
grid AS (SELECT CAST(i // 24 AS INT) AS r, CAST(i % 24 AS INT) AS c FROM range(576) t(i)),
dem AS (SELECT r, c, CAST(((r*97+c*61+r*c*13)%53)*100 AS DOUBLE) AS elev FROM grid),
ys AS (SELECT CAST(y AS INT) AS year FROM range(2003, 2010) t(y)),
cls AS (SELECT year, r, c, CASE WHEN (r+c)%17=0 THEN NULL WHEN (r*5+c*3+year)%4=0 THEN 12 WHEN (r*5+c*3+year)%4=1 THEN 3 ELSE 21 END AS value FROM grid, ys WHERE r < 16 OR c < 16)
"""


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").selectExpr(*DETECTIONS)


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "nation").selectExpr(*ZONES)


def burned_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(year, month, row, col, doy): the first day a cell burned in a month."""
    return _read(spark, sf_dir, "lineitem").selectExpr(*PIXELS).groupBy("year", "month", F.col("r").alias("row"), F.col("c").alias("col")).agg(F.min("doy").alias("doy"))


def perimeters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "orders").selectExpr(*PERIMETERS).selectExpr("*", "cx - hx AS minx", "cy - hy AS miny", "cx + hx AS maxx", "cy + hy AS maxy")


def _grid(spark: SparkSession) -> DataFrame:
    return spark.range(GRID.rows * GRID.cols).selectExpr(f"CAST(id DIV {GRID.cols} AS INT) AS row", f"CAST(id % {GRID.cols} AS INT) AS col")


def cells(spark: SparkSession) -> DataFrame:
    return _grid(spark)


def elevation(spark: SparkSession) -> DataFrame:
    return _grid(spark).selectExpr("row", "col", "CAST(((row*97+col*61+row*col*13)%53)*100 AS DOUBLE) AS value")


def land_cover(spark: SparkSession) -> DataFrame:
    """(year, row, col, value): a class or no class; the cells of the south-east have no row, others one in 2003 to 2009."""
    years = _grid(spark).filter("row < 16 or col < 16").withColumn("year", F.explode(F.sequence(F.lit(2003), F.lit(2009))))
    return years.selectExpr("year", "row", "col", "CASE WHEN (row+col)%17=0 THEN NULL WHEN (row*5+col*3+year)%4=0 THEN 12 WHEN (row*5+col*3+year)%4=1 THEN 3 ELSE 21 END AS value")


# --- polygons: rings as lists of (x, y) expressions of cx, cy, hx, hy, written for both engines

def _around(points: tuple[tuple[float, float], ...], dx: float = 0.0) -> list[tuple[str, str]]:
    """A closed ring of points given in half-sizes around the centre, moved by dx half-sizes."""
    return [(f"cx + hx * {x + dx!r}D", f"cy + hy * {y!r}D") for x, y in (*points, points[0])]


DIAMOND = ((-1.0, 0.0), (0.0, -1.0), (1.0, 0.0), (0.0, 1.0))
SQUARE = ((-1.0, -1.0), (1.0, -1.0), (1.0, 1.0), (-1.0, 1.0))
STAR = ((1.0, 0.0), (0.25, 0.25), (0.0, 1.0), (-0.25, 0.25), (-1.0, 0.0), (-0.25, -0.25), (0.0, -1.0), (0.25, -0.25))
_HALF = tuple((x / 2, y / 2) for x, y in DIAMOND)
#: By the key modulo 5: a diamond with a hole, two diamonds apart, a star, a square; the fifth has no geometry.
SHAPES = ([(_around(DIAMOND), [_around(_HALF)])], [(_around(DIAMOND, -2.0), []), (_around(DIAMOND, 2.0), [])], [(_around(STAR), [])], [(_around(SQUARE), [])])
#: A star with a hole for each zone.
ZONE_SHAPE = [(_around(tuple((x * 1.08 if abs(x) < 0.3 else x, y * 1.08 if abs(y) < 0.3 else y) for x, y in STAR)), [_around(tuple((x / 8, y / 8) for x, y in SQUARE))])]


def _spark_ring(ring: list[tuple[str, str]]) -> str:
    return "array(" + ", ".join(f"named_struct('x', {x}, 'y', {y})" for x, y in ring) + ")"


def _spark_parts(parts: list) -> str:
    none = "CAST(array() AS array<array<struct<x:double,y:double>>>)"
    return "array(" + ", ".join(f"named_struct('shell', {_spark_ring(s)}, 'holes', {'array(' + ', '.join(map(_spark_ring, h)) + ')' if h else none})" for s, h in parts) + ")"


def _duck_rings(parts: list) -> str:
    """SELECT list items (part, ring, pts) of a shape as one list of structs."""
    ring = lambda r: "[" + ", ".join(f"{{'x': {x}, 'y': {y}}}" for x, y in r) + "]"
    rows = [f"{{'part': {i}, 'ring': {j}, 'pts': {ring(r)}}}" for i, (s, h) in enumerate(parts) for j, r in enumerate((s, *h))]
    return re.sub(r"(\d\.\d+)D", r"\1e0", "[" + ", ".join(rows) + "]")


def _duck_edges(name: str, key: str, source: str, rings: str) -> str:
    """CTEs of the edge relation `name` with the sign by which a ring's signed sums count."""
    return f"""
{name}_r AS MATERIALIZED (SELECT {key}, k.part, k.ring, k.pts FROM (SELECT {key}, unnest({rings}) AS k FROM {source})),
{name}_e AS (SELECT {key}, part, ring, pts[i].x AS x1, pts[i].y AS y1, pts[i+1].x AS x2, pts[i+1].y AS y2 FROM {name}_r, unnest(range(1, len(pts))) AS u(i)),
{name} AS MATERIALIZED (SELECT *, sign(sum(x1*y2-x2*y1) OVER (PARTITION BY {key}, part, ring)) * CASE WHEN ring = 0 THEN 1 ELSE -1 END AS s FROM {name}_e)"""


_ZONE_CENTRE = "(SELECT *, (minx+maxx)/2 AS cx, (miny+maxy)/2 AS cy, (maxx-minx)/2 AS hx, (maxy-miny)/2 AS hy FROM zone)"
#: DuckDB CTEs of the edges of perimeters (pe) and of zone stars (ze).
EDGES = (
    _duck_edges("pe", "perim_id", "perim WHERE perim_id % 5 < 4", "CASE perim_id % 5 " + " ".join(f"WHEN {i} THEN {_duck_rings(p)}" for i, p in enumerate(SHAPES)) + " END")
    + ","
    + _duck_edges("ze", "zone_id", _ZONE_CENTRE, _duck_rings(ZONE_SHAPE))
)


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perimeters with `parts` of the shapes above; null for a fifth of them."""
    case = "CASE perim_id % 5 " + " ".join(f"WHEN {i} THEN {_spark_parts(p)}" for i, p in enumerate(SHAPES)) + " END"
    return perimeters(spark, sf_dir).selectExpr("*", f"{case} AS parts")


def zone_stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones as stars with a hole."""
    z = zones(spark, sf_dir).selectExpr("*", "(minx+maxx)/2 AS cx", "(miny+maxy)/2 AS cy", "(maxx-minx)/2 AS hx", "(maxy-miny)/2 AS hy")
    return z.selectExpr("zone_id", "zone_name", f"{_spark_parts(ZONE_SHAPE)} AS parts")


def as_polygons(boxes: DataFrame) -> DataFrame:
    """Boxes with `parts`."""
    ring = _spark_ring([("minx", "miny"), ("maxx", "miny"), ("maxx", "maxy"), ("minx", "maxy"), ("minx", "miny")])
    return boxes.selectExpr("*", f"array(named_struct('shell', {ring}, 'holes', CAST(array() AS array<array<struct<x:double,y:double>>>))) AS parts")
