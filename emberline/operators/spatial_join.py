"""Spatial joins by cell keys.

Catalyst plans an inequality join as a nested loop.  Here the side with extent
is spread over the grid cells it touches, both sides meet on equal cells, and
the exact predicate runs on what meets.  The cell is the caller's choice: about as
large as the extents.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions.geo import EARTH_RADIUS_KM, haversine_km
from emberline.plans.scratch import materialize


def _cells(low: Column, high: Column, size: float) -> Column:
    return F.sequence(F.floor(low / size), F.floor(high / size))


def _over_cells(df: DataFrame, size: float) -> DataFrame:
    """A row for each cell that the box minx..maxy touches."""
    return df.withColumn("_cx", F.explode(_cells(F.col("minx"), F.col("maxx"), size))).withColumn("_cy", F.explode(_cells(F.col("miny"), F.col("maxy"), size)))


def points_in_boxes(points: DataFrame, boxes: DataFrame, x: str = "longitude", y: str = "latitude", cell: float = 1.0, how: str = "left") -> DataFrame:
    """Points with the boxes that hold them in their interior; points on a border are in no box.

    Column names of the two sides must differ.  how: left, inner, left_semi or left_anti.
    A point in several boxes gives a row for each.
    """
    spread = _over_cells(boxes, cell).withColumnsRenamed({"_cx": "_bx", "_cy": "_by"})
    at = points.withColumns({"_px": F.floor(F.col(x) / cell), "_py": F.floor(F.col(y) / cell)})
    inside = (F.col(x) > F.col("minx")) & (F.col(x) < F.col("maxx")) & (F.col(y) > F.col("miny")) & (F.col(y) < F.col("maxy"))
    meet = (F.col("_px") == F.col("_bx")) & (F.col("_py") == F.col("_by"))
    return at.join(spread, meet & inside, how).drop("_px", "_py", "_bx", "_by")


def first_match(joined: DataFrame, key: list[str], value: Column, order: Column) -> DataFrame:
    """One row for each key: the value of the first match in the given order; null where there is none."""
    return joined.groupBy(*key).agg(F.min_by(F.struct(value.alias("v")), order).alias("m")).select(*key, F.col("m.v").alias("value"))


def edges_of(polygons: DataFrame, key: str, parts: str = "parts") -> DataFrame:
    """The edge relation (key, part, ring, seq, x1, y1, x2, y2) of polygons given as parts (shell, holes)."""
    rings = polygons.select(key, F.posexplode(parts).alias("part", "p")).select(key, "part", F.concat(F.array("p.shell"), F.coalesce("p.holes", F.array().cast("array<array<struct<x:double,y:double>>>"))).alias("rings"))
    rings = rings.select(key, "part", F.posexplode("rings").alias("ring", "r"))
    seq = F.posexplode(F.zip_with(F.slice("r", F.lit(1), F.greatest(F.size("r") - 1, F.lit(0))), F.slice("r", F.lit(2), F.greatest(F.size("r") - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))
    return rings.select(key, "part", "ring", seq.alias("seq", "e")).select(key, "part", "ring", "seq", F.col("e.a.x").alias("x1"), F.col("e.a.y").alias("y1"), F.col("e.b.x").alias("x2"), F.col("e.b.y").alias("y2"))


def points_in_polygons(points: DataFrame, point_key: str, edges: DataFrame, polygon_key: str, x: str = "x", y: str = "y", cell: float = 1.0) -> DataFrame:
    """(point key, polygon key) of all points strictly inside a part of a polygon, by crossing numbers over the edge relation.

    The candidate cells come from the polygons' bounds; a point on an edge is
    not in that part.  Parts may overlap, so a dissolved layer is its parts together.
    """
    bounds = edges.groupBy(polygon_key).agg(F.min("x1").alias("minx"), F.min("y1").alias("miny"), F.max("x1").alias("maxx"), F.max("y1").alias("maxy"))
    near = points_in_boxes(points.select(point_key, x, y), bounds, x, y, cell, "inner").select(point_key, x, y, polygon_key)
    px, py = F.col(x), F.col(y)
    run = (F.col("x2") - F.col("x1")) * (py - F.col("y1")) - (F.col("y2") - F.col("y1")) * (px - F.col("x1"))
    on = (run == 0) & px.between(F.least("x1", "x2"), F.greatest("x1", "x2")) & py.between(F.least("y1", "y2"), F.greatest("y1", "y2"))
    cross = ((F.col("y1") > py) != (F.col("y2") > py)) & (px < (F.col("x2") - F.col("x1")) * (py - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1"))
    hit = near.join(edges, polygon_key).groupBy(point_key, polygon_key, "part").agg(F.sum(F.when(cross, 1).otherwise(0)).alias("n"), F.max(on).alias("on"))
    return hit.filter((F.col("n") % 2 == 1) & ~F.col("on")).select(point_key, polygon_key).distinct()


def boxes_intersect(left: DataFrame, right: DataFrame, left_key: str, right_key: str, cell: float = 1.0, keep: Sequence[str] = ()) -> DataFrame:
    """(left key, right key) of boxes that share a point, borders included, with the columns `keep` of either side; each pair once."""
    own = ["minx", "miny", "maxx", "maxy"]
    kept = [[c for c in keep if c in side.columns] for side in (left, right)]
    a = _over_cells(left.select(left_key, *kept[0], *own), cell).withColumnsRenamed({c: f"a_{c}" for c in own})
    b = _over_cells(right.select(right_key, *kept[1], *own), cell).withColumnsRenamed({c: f"b_{c}" for c in own})
    touch = (F.col("a_minx") <= F.col("b_maxx")) & (F.col("b_minx") <= F.col("a_maxx")) & (F.col("a_miny") <= F.col("b_maxy")) & (F.col("b_miny") <= F.col("a_maxy"))
    # false for null: else the planner asks in the scan whether the bounds are null, for which it computes them, and what they come from, once for each
    met = a.join(b, ["_cx", "_cy"]).filter(F.coalesce(touch, F.lit(False)))
    # the pair is reported in the cell of its common corner only, so no distinct is needed
    corner = (F.col("_cx") == F.floor(F.greatest("a_minx", "b_minx") / cell)) & (F.col("_cy") == F.floor(F.greatest("a_miny", "b_miny") / cell))
    return met.filter(corner).select(left_key, right_key, *keep, *[f"a_{c}" for c in own], *[f"b_{c}" for c in own])


#: Up to this many boxes go to every task in one row; more are searched by cells.
DIMENSION_ROWS = 10_000


def _box_distance(px: Column, py: Column, minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    dx, dy = F.greatest(minx - px, px - maxx, F.lit(0.0)), F.greatest(miny - py, py - maxy, F.lit(0.0))
    return F.sqrt(dx * dx + dy * dy)


def nearest_box(points: DataFrame, boxes: DataFrame, key: list[str], value: Column, order: Column, x: str = "longitude", y: str = "latitude", most: int = DIMENSION_ROWS) -> DataFrame:
    """(key, value, distance): the nearest box of each point, ties by `order`; no boxes give no rows.

    Up to `most` boxes are compared with every point, in one row that each task
    gets; more are searched by cells that grow until the nearest is certain.
    """
    boxes = boxes.select("minx", "miny", "maxx", "maxy", value.alias("v"), order.alias("o"))
    if boxes.limit(most + 1).count() > most:
        return _nearest_by_cells(points.select(*key, x, y), boxes, key, x, y)
    listed = boxes.agg(F.collect_list(F.struct("minx", "miny", "maxx", "maxy", "v", "o")).alias("_boxes"))
    px, py = F.col(x), F.col(y)

    def ranked(b: Column) -> Column:
        return F.struct(_box_distance(px, py, b["minx"], b["miny"], b["maxx"], b["maxy"]).alias("d"), b["o"].alias("o"), b["v"].alias("v"))

    near = points.select(*key, x, y).join(F.broadcast(listed)).withColumn("m", F.array_min(F.transform("_boxes", ranked))).filter("m is not null")
    return near.select(*key, F.col("m.v").alias("value"), F.col("m.d").alias("distance"))


def _nearest_by_cells(points: DataFrame, boxes: DataFrame, key: list[str], x: str, y: str, cell: float = 0.25) -> DataFrame:
    """The same by a join on the nine cells around a point; a box found within a cell's width is the nearest.

    Points without one go on with cells four times as wide, until a cell is wider than all that there is.
    """
    px, py = F.col(x), F.col(y)
    ends = boxes.agg(F.min("minx"), F.min("miny"), F.max("maxx"), F.max("maxy")).first()
    far = points.agg(F.min(x), F.min(y), F.max(x), F.max(y)).first()
    if far[0] is None:
        return points.select(*key, F.lit(None).cast(boxes.schema["v"].dataType).alias("value"), F.lit(0.0).alias("distance")).limit(0)
    widest = max(max(ends[2], far[2]) - min(ends[0], far[0]), max(ends[3], far[3]) - min(ends[1], far[1]))
    rest, parts = points.filter(px.isNotNull() & py.isNotNull()), []
    while True:
        last = cell > widest
        spread = _over_cells(boxes, cell)
        steps = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
        at = rest.withColumn("_s", steps).withColumns({"_cx": F.floor(px / cell) + F.col("_s.i"), "_cy": F.floor(py / cell) + F.col("_s.j")})
        found = at.join(spread, ["_cx", "_cy"]).withColumn("d", _box_distance(px, py, *[F.col(c) for c in ("minx", "miny", "maxx", "maxy")]))
        found = found if last else found.filter(F.col("d") <= cell)
        best = found.groupBy(*key).agg(F.min(F.struct("d", "o", "v")).alias("m"))
        parts.append(materialize(best.select(*key, F.col("m.v").alias("value"), F.col("m.d").alias("distance")), "nearest"))
        if last:
            return reduce(DataFrame.unionByName, parts)
        rest, cell = rest.join(parts[-1].select(*key), key, "left_anti"), cell * 4


#: Half of the 27 cells around a cell of space and time, besides itself.
_FORWARD = [(i, j, t) for i in (-1, 0, 1) for j in (-1, 0, 1) for t in (-1, 0, 1) if (i, j, t) > (0, 0, 0)]


def radius_time_pairs(points: DataFrame, key: str, day: str, radius_km: float = 1.0, days: int = 15, x: str = "longitude", y: str = "latitude", most_lat: float = 60.0) -> DataFrame:
    """(a, b): pairs of points with a < b within the radius and the days, both inclusive.

    Cells are as high as the radius and as wide as it is at `most_lat`, and days
    are cut into spans; a point meets its own and the neighbouring cells, each
    pair of cells from one side.  Pairs with an end beyond most_lat are found in
    cells that go all around.  A point without place or day is left out; the
    meridian of 180 degrees isn't crossed.
    """
    high = radius_km / (EARTH_RADIUS_KM * math.pi / 180) * (1 + 1e-9)
    wide = high / math.cos(math.radians(most_lat))
    at = points.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(day).isNotNull()).select(
        F.col(key).alias("k"), F.col(x).alias("x"), F.col(y).alias("y"), F.datediff(F.col(day), F.lit("1970-01-01")).alias("d")
    )
    lat = F.abs("y")
    zones = F.when(lat <= most_lat - high, F.array(F.lit(False))).when(lat <= most_lat + high, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(True)))
    at = at.withColumn("polar", F.explode(zones))
    at = at.withColumns({"cx": F.when(F.col("polar"), F.lit(0).cast("long")).otherwise(F.floor(F.col("x") / wide)), "cy": F.floor(F.col("y") / high), "ct": F.floor(F.col("d") / (days + 1))})
    own = F.struct(*[F.lit(0).alias(c) for c in "ijt"])
    around = F.explode(F.array(own, *[F.struct(*[F.lit(v).alias(c) for c, v in zip("ijt", o, strict=True)]) for o in _FORWARD]))
    # cells that go all around have no neighbours aside
    other = at.withColumn("o", around).filter("not polar or o.i = 0").select(
        "polar", F.col("k").alias("k2"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("d").alias("d2"), (F.col("o") == own).alias("same"), (F.col("cx") + F.col("o.i")).alias("cx"), (F.col("cy") + F.col("o.j")).alias("cy"), (F.col("ct") + F.col("o.t")).alias("ct")
    )
    near = at.join(other, ["polar", "cx", "cy", "ct"]).filter("not same or k < k2").filter(F.abs(F.col("d") - F.col("d2")) <= days)
    near = near.filter(F.col("polar") == (F.greatest(lat, F.abs("y2")) > most_lat))
    return near.filter(haversine_km(F.col("y"), F.col("x"), F.col("y2"), F.col("x2")) <= radius_km).select(F.least("k", "k2").alias("a"), F.greatest("k", "k2").alias("b")).filter("a < b")
