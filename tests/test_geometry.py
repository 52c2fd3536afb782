"""Analytic cases with known answers."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberline.functions import geo, scalar
from emberline.operators import raster as R
from emberline.operators import spatial_join as J
from emberline.operators.components import connected_components
from emberline.operators.skew import join_unique
from emberline.operators.spatial_join import edges_of, points_in_polygons
from emberline.plans import products as P
from emberline.sources import tables as S

RING = "array<struct<x:double,y:double>>"


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def ring(*points):
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in (*points, points[0])])


@pytest.mark.parametrize("lat,scale", [(0.0, 1.006739), (-2.4, 1.008484), (-8.1, 1.026858), (-15.3, 1.081075), (-18.35, 1.116015)])
def test_mercator_scale(spark, lat, scale):
    assert one(spark, geo.mercator_area_scale(F.lit(lat))) == pytest.approx(scale, abs=1e-6)


def test_ring_area_ignores_orientation_and_subtracts_holes(spark):
    box = [(-70, -10), (-69, -10), (-69, -9), (-70, -9)]
    a, b = one(spark, geo.ring_area_m2(ring(*box))), one(spark, geo.ring_area_m2(ring(*box[::-1])))
    assert a == pytest.approx(b, rel=1e-12)
    small = [(-70.0, -10.0), (-69.99, -10.0), (-69.99, -9.99), (-70.0, -9.99)]
    exact = one(spark, geo.box_area_m2(F.lit(-70.0), F.lit(-10.0), F.lit(-69.99), F.lit(-9.99)))
    assert one(spark, geo.ring_area_m2(ring(*small))) == pytest.approx(exact, rel=1e-5)
    hole = F.array(F.struct(ring(*box).alias("shell"), F.array(ring(*small)).alias("holes")))
    assert one(spark, geo.polygon_area_m2(hole)) == pytest.approx(a - one(spark, geo.ring_area_m2(ring(*small))), rel=1e-9)
    assert one(spark, geo.polygon_area_m2(F.lit(None).cast(f"array<struct<shell:{RING},holes:array<{RING}>>>"))) == 0


def test_shoelace_and_centroid(spark):
    square = ring((0, 0), (2, 0), (2, 2), (0, 2))
    assert one(spark, geo.ring_shoelace(square)) == 4
    c = one(spark, geo.ring_centroid(square))
    assert (c.x, c.y) == (1, 1)


@pytest.mark.parametrize("year,doy,month", [(2004, 60, 2), (2005, 60, 3), (2005, 0, 0), (2005, 367, 0), (2004, 366, 12)])
def test_month_of_day(spark, year, doy, month):
    assert one(spark, scalar.month_of_day(F.lit(year), F.lit(doy))) == month


def test_bands_and_dates(spark):
    assert [one(spark, scalar.band_of_year(F.lit(y), F.lit(b))) for y, b in ((2001, 40), (2024, 40), (2001, 24), (2000, 24))] == [17, 40, 1, None]
    assert one(spark, scalar.lenient_date(F.lit("2020-02-30"))) is None
    assert one(spark, scalar.lenient_date(F.lit("2020-02-03 10:00:00"))) == datetime.date(2020, 2, 3)
    assert one(spark, scalar.year_in(F.lit("GFA_1999_perimeters_2011.shp"))) == 2011
    assert one(spark, scalar.not_country(F.lit(None).cast("string"))) is True


def test_points_strictly_inside_polygons_with_holes(spark):
    poly = spark.range(1).select(F.lit(1).alias("pid"), F.array(F.struct(ring((0, 0), (4, 0), (4, 4), (0, 4)).alias("shell"), F.array(ring((1, 1), (2, 1), (2, 2), (1, 2))).alias("holes"))).alias("parts"))
    pts = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.5, 1.5), (3, 0.0, 2.0), (4, 5.0, 1.0), (5, 3.0, 3.0), (6, 1.0, 1.5)], "id int, x double, y double")
    got = points_in_polygons(pts, "id", edges_of(poly, "pid"), "pid")
    assert sorted(r.id for r in got.collect()) == [1, 5]


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 200), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(chain, "src long, dst long")).collect()}
    assert {got[i] for i in range(41)} == {0} and got[100] == got[101] == 100 and got[200] == 200


@pytest.mark.parametrize("local,hot", [(0, 10**9), (0, 15), (30, 10**9), (10**6, 10**9)])
def test_components_all_ways(spark, local, hot):
    rng = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (220, 2))] + [(1000, int(x)) for x in rng.integers(1001, 1100, 60)] + [(5, 5), (2000, 2000)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "src long, dst long"), local=local, hot=hot).collect()}
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {x: find(x) for x in root}


@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_with_hot_keys(spark, how):
    left = spark.range(300).selectExpr("CASE WHEN id % 3 = 0 THEN 7 WHEN id % 50 = 1 THEN NULL ELSE id END AS k", "id")
    right = spark.range(0, 200).selectExpr("id AS k", "id * 2 AS v")
    plain, split = (join_unique(left, right, "k", how, hot) for hot in (10**9, 20))
    assert plain.exceptAll(split).count() == 0 and plain.count() == split.count() > 150


def test_patches_by_day_and_month(spark):
    px = spark.createDataFrame([(2005, 1, 0, 0, 5), (2005, 1, 0, 1, 6), (2005, 1, 1, 1, 5), (2005, 2, 1, 0, 5)], "year int, month int, row int, col int, doy int")
    assert P.burned_patches(px).select("patch").distinct().count() == 3


def test_modes(spark):
    rows = spark.createDataFrame([(1, 3, 1), (1, 12, 2), (1, 3, 3), (1, 12, 4), (2, 9, 1)], "z int, v int, s int")
    mode = lambda **k: {r.z: r["mode"] for r in R.mode_by_rule(rows, ["z"], "v", **k).collect()}
    assert mode() == {1: 3, 2: 9} and mode(rule="listed", codes=[12, 3]) == {1: 12, 2: 0} and mode(rule="first", seq="s") == {1: 3, 2: 9}


ZONE = "zone_id int, zone_name string, minx double, miny double, maxx double, maxy double"
BOXES = "perim_id int, minx double, miny double, maxx double, maxy double"


def test_decomposition_cases(spark):
    z = spark.createDataFrame([(1, "A", 0.0, 0.0, 1.0, 1.0), (2, None, 2.0, 0.0, 3.0, 1.0), (3, "B", 0.0, 0.0, 0.6, 1.0)], ZONE)
    e = spark.createDataFrame(
        [(1, 0.1, 0.1, 0.2, 0.2), (2, 0.9, 0.1, 1.1, 0.2), (3, 1.0, 0.2, 1.1, 0.3), (4, 0.5, 0.5, 0.5005, 0.5005), (5, 2.1, 0.1, 2.2, 0.2), (6, -0.1, 0.1, 0.1, 0.2), (7, 5.0, 5.0, 5.0005, 5.0005)], BOXES
    )
    pieces = P.decompose(e, z)
    rows = sorted((r.perim_id, r.eco, r.residual) for r in pieces.collect())
    # 1 lies in A and B: the first has all of it; 3 only touches A; 4 is too small for a row; 5 lies in a nameless zone; 7 is alone, however small
    assert rows == [(1, "A", False), (2, "A", False), (2, "sin_region", True), (3, "sin_region", True), (5, "sin_region", False), (6, "A", False), (6, "B", False), (7, "sin_region", True)]
    assert pieces.filter("ha <= 0").count() == 0
    got = {r.perim_id: (r.eco, r.n_eco, round(r.eco_resid_ha / r.area_ha, 3)) for r in P.dominant(e, pieces).collect()}
    assert got == {1: ("A", 1, 0), 2: ("A", 1, 0.5), 3: ("sin_region", 0, 1), 4: ("sin_region", 0, 1), 5: ("sin_region", 1, 0), 6: ("A", 2, 0), 7: ("sin_region", 0, 1)}


def test_long_layer_and_its_balance(spark):
    grid = R.Grid(0.0, 1.0, 0.1, 0.1, 10, 20)
    z = spark.createDataFrame([(1, "A", 0.0, 0.0, 1.0, 1.0), (2, "B", 0.9, 0.0, 1.0, 1.0)], ZONE)
    e = spark.createDataFrame([(1, 0.82, 0.1, 1.2, 0.3, 2005), (2, 0.15, 0.15, 0.25, 0.25, 2005), (3, 0.2, 0.2, 0.3, 0.3, 1999)], BOXES + ", year int")
    cover = spark.range(200).selectExpr("2005 AS year", "CAST(id DIV 20 AS INT) AS row", "CAST(id % 20 AS INT) AS col", "CASE WHEN id % 2 = 0 THEN 12 ELSE 3 END AS value")
    layer, whole = P.long_layer(e, z, cover, grid), P.event_classes(e, cover, grid)
    rows = {(r.perim_id, r.eco): r for r in layer.collect()}
    # A and B overlap in 0.9 to 1.0: the pieces count it twice, what they leave is 1.0 to 1.2
    assert set(rows) == {(1, "A"), (1, "B"), (1, "sin_region"), (2, "A"), (3, "A")}
    of = {r.perim_id: r for r in whole.collect()}
    assert rows[2, "A"].cl12_eco_km2 == of[2].cl12_km2 and rows[2, "A"].is_dominant and rows[3, "A"].cl12_eco_km2 is None
    left = geo.box_area_m2(F.lit(1.1), F.lit(0.1), F.lit(1.2), F.lit(0.3))
    assert rows[1, "sin_region"].cl3_eco_km2 == pytest.approx(one(spark, left) / 1e6, rel=1e-5)
    assert rows[1, "A"].cl_x_eco_km2 == pytest.approx(0, abs=1e-3)
    ok = {r.perim_id: (r.ok12, r.ok3) for r in P.balance(layer, whole).collect()}
    assert ok == {1: (True, False), 2: (True, True), 3: (None, None)}


def test_uncovered_boxes_add_up(spark):
    e = spark.createDataFrame([(1, 0.0, 0.0, 4.0, 4.0), (2, 0.0, 0.0, 1.0, 1.0)], BOXES)
    held = spark.createDataFrame([(1, 1.0, 1.0, 2.0, 3.0), (1, 1.5, 2.0, 4.0, 3.0), (1, 0.0, 0.0, 4.0, 0.5)], BOXES)
    got = {r.perim_id: r.a for r in P.uncovered(e, held).groupBy("perim_id").agg(F.sum(F.expr("(maxx-minx)*(maxy-miny)")).alias("a")).collect()}
    assert got == {1: pytest.approx(16 - 2 - 2.5 + 0.5 - 2), 2: pytest.approx(1)}


def test_class_area_coverage(spark):
    px = spark.createDataFrame([(1, 0, 0), (2, 0, 1), (3, 9, 9)], "z int, row int, col int")
    cover = spark.createDataFrame([(0, 0, 12), (0, 1, 3)], "row int, col int, value int")
    assert {r.z: r.area for r in R.class_area(px, cover, ["z"], 12, F.lit(2.0)).collect()} == {1: 2.0, 2: 0.0, 3: None}


def test_sources(spark, tmp_path):
    assert S.tile_grid(spark, -1.0, 0.0, 0.5, 1.0, 1.0).orderBy("col").select("maxx").collect()[-1].maxx == 0.5
    b = spark.range(1).select(*[c.alias(n) for n, c in S.bounds_file(F.lit("x_Lat-5to-4_Lon-70to-69.tif")).items()]).first()
    assert (b.south, b.north, b.west, b.east) == (-5, -4, -70, -69)
    with pytest.raises(ValueError):
        S.one_layer(["a", "b"])
    df = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0), (2, 5.0, 5.0, 6.0, 6.0)], "id int, minx double, miny double, maxx double, maxy double")
    S.write_layer(df, f"file://{tmp_path}/l")
    got = S.read_layer(spark, f"file://{tmp_path}/l", ["id"], bbox=(-1, -1, 2, 2))
    assert [r.id for r in got.collect()] == [1]
    with pytest.raises(KeyError):
        S.read_layer(spark, f"file://{tmp_path}/l", ["nothing"])
    S.write_csv(df, f"file://{tmp_path}/c")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/c").count() == 2
    good, bad = S.quarantine(df, F.when(F.col("id") == 1, True))
    assert (good.count(), bad.count()) == (1, 1)


def test_layers_and_pruned_scans(spark, tmp_path):
    for names in (["a", "b"], []):
        with pytest.raises(ValueError):
            S.one_layer(names)
    assert S.one_layer(["Peru_eco", "x"], "ECO") == "Peru_eco"
    path = f"file://{tmp_path}/l"
    S.write_layer(spark.range(100).selectExpr("id", "id * 1D AS minx", "id * 1D AS miny", "id + 1D AS maxx", "id + 1D AS maxy", "array(id) AS shapes"), path)
    df = S.read_layer(spark, path, ["id"], (10.0, 0.0, 12.0, 100.0), columns=["id"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "shapes" not in plan and "PushedFilters: [IsNotNull(maxx)" in plan and sorted(r.id for r in df.collect()) == [9, 10, 11, 12]


def test_nearest_box_by_cells_equals_all_pairs(spark):
    import random

    rng = random.Random(3)
    boxes = [(i, x, y, x + rng.random() / 5, y + rng.random() / 5) for i, (x, y) in enumerate((rng.uniform(-3, 3), rng.uniform(-3, 3)) for _ in range(60))]
    pts = [(i, rng.uniform(-9, 9), rng.uniform(-9, 9)) for i in range(300)]
    b = spark.createDataFrame(boxes, "z int, minx double, miny double, maxx double, maxy double")
    p = spark.createDataFrame(pts, "k int, longitude double, latitude double")
    got = [{r.k: (r.value, round(r.distance, 9)) for r in J.nearest_box(p, b, ["k"], F.col("z"), F.col("z"), most=n).collect()} for n in (100, 10)]
    assert got[0] == got[1] and len(got[0]) == 300


def test_radius_pairs_at_all_latitudes(spark):
    import math
    import random

    rng = random.Random(4)
    pts = [(i, rng.uniform(10, 10.3), lat + rng.uniform(-0.02, 0.02), datetime.date(2020, 1, 1) + datetime.timedelta(rng.randrange(40))) for i, lat in enumerate([60.0, 59.98, 75.0, -0.01, -60.01, 10.0] * 50)]
    df = spark.createDataFrame(pts, "k int, longitude double, latitude double, day date")

    def km(a, b):
        p, q = math.radians(a[2]), math.radians(b[2])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
        return 2 * 6371.0 * math.asin(math.sqrt(h))

    want = {(a[0], b[0]) for a in pts for b in pts if a[0] < b[0] and abs((a[3] - b[3]).days) <= 15 and km(a, b) <= 1.0}
    got = [(r.a, r.b) for r in J.radius_time_pairs(df, "k", "day").collect()]
    assert len(want) > 20 and len(got) == len(set(got)) and set(got) == want


def test_polygon_relations_and_measures(spark):
    from emberline.operators import polygons as G

    ring = lambda *p: np.array([*p, p[0]], float)
    u = [(ring((0, 0), (5, 0), (5, 5), (4, 5), (4, 1), (1, 1), (1, 5), (0, 5)), [])]
    box = lambda x, y, w, h: [(ring((x, y), (x + w, y), (x + w, y + h), (x, y + h)), [])]
    assert G.relate(box(2, 2, 1, 1), u) == (False, False)  # in the mouth of the U
    assert G.relate(box(0.2, 0.2, 0.5, 0.5), u) == (True, True)
    assert G.relate(box(0.5, 2, 4, 1), u) == (True, False)
    assert G.relate(u, box(-1, -1, 9, 9)) == (True, True)
    holed = [(ring((0, 0), (4, 0), (4, 4), (0, 4)), [ring((1, 1), (3, 1), (3, 3), (1, 3))])]
    assert G.relate(box(1.5, 1.5, 1, 1), holed) == (False, False) and G.relate(box(0.5, 0.5, 3, 3), holed) == (True, False)
    assert G.plane_area(holed) == 12 and G.centroid(holed) == pytest.approx((2, 2)) and G.centroid([]) is None
    assert G.plane_area(G.intersection(u, box(0.5, 2, 4, 1))) == pytest.approx(1.0)
