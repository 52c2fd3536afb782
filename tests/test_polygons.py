from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberline.operators import polygons as G
from emberline.operators.raster import Grid

BOX = np.array([(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], float)
HOLE = np.array([(1, 1), (2, 1), (2, 2), (1, 2), (1, 1)], float)
DIAMOND = np.array([(2, 0), (4, 2), (2, 4), (0, 2), (2, 0)], float)


def plane(parts):
    return sum(abs(G.shoelace(s)) - sum(abs(G.shoelace(h)) for h in holes) for s, holes in parts)


def test_cleaning_and_validity():
    assert G.clean(np.array([(0, 0), (1, 1), (0, 0)], float)) is None and G.clean(np.zeros((0, 2))) is None
    assert len(G.clean(np.array([(0, 0), (0, 0), (1, 0), (1, 1)], float))) == 4
    assert G.crosses_itself(np.array([(0, 0), (1, 1), (1, 0), (0, 1), (0, 0)], float)) and not G.crosses_itself(BOX)


def test_intersection_areas():
    a, b = [(BOX, [HOLE])], [(DIAMOND, [])]
    assert plane(G.intersection(a, [(BOX + 2, [])])) == pytest.approx(4)
    assert plane(G.intersection([(BOX, [])], b)) == pytest.approx(8)
    rng = np.random.default_rng(0)
    x, y = rng.uniform(0, 4, (2, 40_000))
    share = (G.inside(a, x, y) & G.inside(b, x, y)).mean() * 16
    assert plane(G.intersection(a, b)) == pytest.approx(share, abs=0.15)
    assert G.intersection(a, [(BOX + 10, [])]) == [] and G.intersection(a, [(BOX + np.array([4, 0]), [])]) == []
    assert plane(G.clip_box(a, 0, 0, 2, 2)) == pytest.approx(3)


def test_representative_point_is_inside():
    for parts in ([(BOX, [HOLE])], [(DIAMOND, [])], [(np.array([(0, 0), (5, 0), (5, 5), (4, 5), (4, 1), (0, 1), (0, 0)], float), [])]):
        x, y = G.representative_point(parts)
        assert G.inside(parts, np.array([x]), np.array([y]))[0]
    assert G.representative_point([]) is None


def test_cells_and_outline():
    g = Grid(0.0, 4.0, 1.0, 1.0, 4, 4)
    assert len(G.touched_cells([(BOX * 0.5 + 0.25, [])], g, "center")) == 4 and len(G.touched_cells([(BOX * 0.5 + 0.25, [])], g)) == 9
    assert len(G.touched_cells([(DIAMOND, [])], g, "all_touched")) >= 12
    rows, cols = np.array([0, 0, 1, 2, 2, 2, 1, 0]), np.array([0, 1, 0, 0, 1, 2, 2, 2])
    rings = G.outline(rows, cols, g)
    assert len(rings) == 2 and abs(sum(G.shoelace(r) for r in rings)) == pytest.approx(8)
    assert len(G.outline(np.array([0, 1]), np.array([0, 1]), g)) == 2


def test_on_dataframes(spark):
    def sql(ring):
        return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ring])

    df = spark.range(1).select(F.lit(1).alias("a"), F.array(F.struct(sql(BOX).alias("shell"), F.array(sql(HOLE)).alias("holes"))).cast(G.PARTS_TYPE).alias("parts"))
    other = spark.range(1).select(F.lit("d").alias("b"), F.array(F.struct(sql(DIAMOND).alias("shell"), F.array().alias("holes"))).cast(G.PARTS_TYPE).alias("parts"))
    m = G.measures(df, "a").first()
    assert m.valid and m.area_m2 == pytest.approx(G.geodesic_area([(BOX, [HOLE])]))
    assert G.rasterise(df, "a", Grid(0.0, 4.0, 1.0, 1.0, 4, 4), "center").count() == 15
    o = G.overlay(df, other, "a", "b").collect()
    assert len(o) == 1 and o[0].area_m2 == pytest.approx(G.geodesic_area(G.intersection([(BOX, [HOLE])], [(DIAMOND, [])])))


def test_areas_far_from_the_origin():
    rng = np.random.default_rng(1)
    for _ in range(200):
        x, y, w, h = (float(v) for v in (rng.uniform(-81, -60), rng.uniform(-20, 1), rng.uniform(0.002, 0.1), rng.uniform(0.002, 0.06)))
        ring = DIAMOND * (w, h) + (x, y)
        exact = [(Fraction(float(p)), Fraction(float(q))) for p, q in ring]
        want = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(exact[:-1], exact[1:], strict=True))) / 2
        assert abs(G.shoelace(ring)) == pytest.approx(float(want), rel=1e-14, abs=0)
    assert G.shoelace(np.zeros((0, 2))) == 0
