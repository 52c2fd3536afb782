"""Registered queries over polygons with holes, concave rings and several parts, with SQL over their edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberline.functions import geo, scalar
from emberline.operators import polygon_batches as B
from emberline.operators import polygons as G
from emberline.operators import raster as R
from emberline.operators import spatial_join as J
from emberline.plans import fixtures as X
from emberline.plans import products as P
from emberline.plans.registry import query, sin_authalic_sql
from emberline.plans.scratch import scratch_path
from emberline.sources import tables as S

_E = f"+ {X.EDGES.strip()}"
_BOX = "(SELECT perim_id, min(x1) AS minx, min(y1) AS miny, max(x1) AS maxx, max(y1) AS maxy FROM pe GROUP BY perim_id)"


def _inside(points: str, key: str, x: str, y: str, edges: str, poly: str) -> str:
    """SELECT of (key, poly) of the points inside a part of a polygon, by crossing numbers."""
    return f"""SELECT DISTINCT {key}, {poly} FROM (SELECT p.{key}, e.{poly}, e.part, count(*) AS n FROM {points} p JOIN {edges} e
  ON ((e.y1 > p.{y}) <> (e.y2 > p.{y})) AND p.{x} < (e.x2-e.x1)*(p.{y}-e.y1)/(e.y2-e.y1)+e.x1 GROUP BY ALL) WHERE n % 2 = 1"""


def _within_box(minx: str, miny: str, maxx: str, maxy: str) -> str:
    """Plane area of what an edge adds to its polygon's area inside a box: the integral under the edge, clamped to the box."""
    xa, xb = f"least(greatest(x1, {minx}), {maxx})", f"least(greatest(x2, {minx}), {maxx})"
    h, m, u = f"(({maxy})-({miny}))", "((y2-y1)/(x2-x1))", f"(y1-({miny}))"
    g = lambda t: f"(CASE WHEN {t} <= 0 THEN 0 WHEN {t} < {h} THEN ({t})*({t})/2 ELSE {h}*({t}) - {h}*{h}/2 END)"
    at = lambda x: f"({u}+{m}*({x}-x1))"
    return f"(CASE WHEN x1 = x2 OR {xa} = {xb} THEN 0 WHEN y1 = y2 THEN -s*least(greatest({u}, 0), {h})*({xb}-{xa}) ELSE -s*({g(at(xb))}-{g(at(xa))})/{m} END)"


_T = lambda y: f"tan(asin({sin_authalic_sql(y)})/2)"
_ARC = f"2*atan2(tan(radians(x2-x1)/2)*({_T('y1')}+{_T('y2')}), 1+{_T('y1')}*{_T('y2')})"
_MX, _MY = "(6378137.0*radians({}))", "(6378137.0*ln(tan(pi()/4+radians({})/2)))"
_CROSS = "+".join(f"({_MX.format(a)}-{_MX.format('x0')})*({_MY.format(b)}-{_MY.format('y0')})*({k})" for a, b, k in (("x1", "y2", 1), ("x2", "y1", -1)))


@query(f"{_E} SELECT geom, count(*) AS n, count(*) FILTER (geom IN ('Polygon', 'MultiPolygon')) AS areal FROM (SELECT CASE WHEN perim_id % 5 = 4 THEN NULL WHEN perim_id % 5 = 1 THEN 'MultiPolygon' ELSE 'Polygon' END AS geom FROM perim) GROUP BY geom")
def p_polygonal_types(s, d):
    """Geometry types, and how many of each pass the filter on areal ones."""
    kind = scalar.geometry_type(F.col("parts"))
    shapes = X.polygons(s, d).select(kind.alias("geom"))
    return shapes.groupBy("geom").agg(F.count("*").alias("n"), F.count_if(F.col("geom").isin("Polygon", "MultiPolygon")).alias("areal"))


@query(f"{_E}, sel AS (SELECT det_id, longitude AS x, latitude AS y FROM det) {_inside('sel', 'det_id', 'x', 'y', 'ze', 'zone_id')}")
def j_point_in_polygon(s, d):
    """Detections in concave zones with holes."""
    points = X.detections(s, d).select("det_id", F.col("longitude").alias("x"), F.col("latitude").alias("y"))
    return J.points_in_polygons(points, "det_id", J.edges_of(X.zone_stars(s, d), "zone_id"), "zone_id", cell=5.0)


@query(f"""{_E},
a AS (SELECT perim_id, sum(ring_m2 * CASE WHEN ring = 0 THEN 1 ELSE -1 END) AS m2, sum(plane * CASE WHEN ring = 0 THEN 1 ELSE -1 END) AS merc FROM (
  SELECT perim_id, part, ring, {geo.AUTHALIC_R2!r}*abs(sum({_ARC})) AS ring_m2, abs(sum({_CROSS}))/2 AS plane
  FROM (SELECT *, first_value(x1) OVER w AS x0, first_value(y1) OVER w AS y0 FROM pe WINDOW w AS (PARTITION BY perim_id, part, ring ORDER BY x1, y1)) GROUP BY ALL) GROUP BY perim_id)
SELECT perim_id, round(coalesce(m2, 0)/1e6, 5) AS geodesic_km2, round(coalesce(merc, 0)/1e6, 4) AS mercator_km2 FROM perim LEFT JOIN a USING (perim_id)""")
def r_polygon_areas(s, d):
    """Ellipsoidal area and plane area in Mercator; 0 for what has no area."""
    project = lambda r: F.transform(r, lambda q: F.struct(geo.mercator_x(q["x"]).alias("x"), geo.mercator_y(q["y"]).alias("y")))
    plane = lambda r: geo.ring_shoelace(project(r))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v)
    merc = F.coalesce(total(F.transform("parts", lambda p: plane(p["shell"]) - total(F.transform(p["holes"], plane)))), F.lit(0.0))
    return X.polygons(s, d).select("perim_id", F.round(geo.polygon_area_m2(F.col("parts")) / 1e6, 5).alias("geodesic_km2"), F.round(merc / 1e6, 4).alias("mercator_km2"))


@query(f"{_E} SELECT perim_id, round(cx, 6) AS cx, round(cy, 6) AS cy, round(CASE perim_id % 5 WHEN 2 THEN cy-hy/8 WHEN 3 THEN cy END, 6) AS py, TRUE AS valid FROM perim WHERE perim_id % 5 < 4")
def r_centroid_and_point(s, d):
    """Centroids, and of stars and squares the height of the point on the surface, which is the middle of their widest line."""
    m = G.measures(X.polygons(s, d).filter("parts is not null"), "perim_id")
    return m.select("perim_id", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"), F.when((F.col("perim_id") % 5).isin(2, 3), F.round("py", 6)).alias("py"), "valid")


@query(f"{_E}, pt AS (SELECT perim_id, cx AS x, CASE perim_id % 5 WHEN 2 THEN cy-hy/8 ELSE cy END AS y FROM perim WHERE perim_id % 5 IN (2, 3)), hit AS ({_inside('pt', 'perim_id', 'x', 'y', 'ze', 'zone_id')}) SELECT perim_id, coalesce(arg_min(coalesce(zone_name, 'sin_region'), zone_id), 'sin_region') AS region FROM pt LEFT JOIN hit USING (perim_id) LEFT JOIN (SELECT zone_id, zone_name FROM zone) USING (zone_id) GROUP BY perim_id")
def j_surface_point_in_zone(s, d):
    """The zone that holds a polygon's representative point, the first by id."""
    zones = X.zone_stars(s, d)
    at = G.measures(X.polygons(s, d).filter("perim_id % 5 in (2, 3)"), "perim_id")
    hit = J.points_in_polygons(at.select("perim_id", "px", "py"), "perim_id", J.edges_of(zones, "zone_id"), "zone_id", "px", "py", 5.0)
    named = hit.join(zones.select("zone_id", F.coalesce("zone_name", F.lit(scalar.NO_REGION)).alias("n")), "zone_id").groupBy("perim_id").agg(F.min_by("n", "zone_id").alias("n"))
    return at.select("perim_id").join(named, "perim_id", "left").select("perim_id", F.coalesce("n", F.lit(scalar.NO_REGION)).alias("region"))


_RELATION = f"""{_E},
zb AS (SELECT zone_id, min(x1) AS zx0, min(y1) AS zy0, max(x1) AS zx1, max(y1) AS zy1 FROM ze GROUP BY zone_id),
near AS MATERIALIZED (SELECT perim_id, zone_id FROM {_BOX} JOIN zb ON minx <= zx1 AND zx0 <= maxx AND miny <= zy1 AND zy0 <= maxy),
ev AS (SELECT DISTINCT perim_id, x1 AS x, y1 AS y FROM pe),
zv AS (SELECT DISTINCT zone_id, x1 AS x, y1 AS y FROM ze),
vin AS MATERIALIZED (SELECT perim_id, zone_id, x, y FROM (SELECT n.perim_id, n.zone_id, v.x, v.y, count(*) AS k FROM near n JOIN ev v USING (perim_id) JOIN ze e ON e.zone_id = n.zone_id AND ((e.y1 > v.y) <> (e.y2 > v.y)) AND v.x < (e.x2-e.x1)*(v.y-e.y1)/(e.y2-e.y1)+e.x1 GROUP BY ALL) WHERE k % 2 = 1),
win AS MATERIALIZED (SELECT DISTINCT perim_id, zone_id FROM (SELECT n.perim_id, n.zone_id, v.x, v.y, count(*) AS k FROM near n JOIN zv v USING (zone_id) JOIN pe e ON e.perim_id = n.perim_id AND ((e.y1 > v.y) <> (e.y2 > v.y)) AND v.x < (e.x2-e.x1)*(v.y-e.y1)/(e.y2-e.y1)+e.x1 GROUP BY ALL) WHERE k % 2 = 1),
x AS MATERIALIZED (SELECT DISTINCT n.perim_id, n.zone_id FROM near n JOIN pe a USING (perim_id) JOIN ze b ON b.zone_id = n.zone_id
  WHERE ((a.x2-a.x1)*(b.y1-a.y1)-(a.y2-a.y1)*(b.x1-a.x1))*((a.x2-a.x1)*(b.y2-a.y1)-(a.y2-a.y1)*(b.x2-a.x1)) < 0
    AND ((b.x2-b.x1)*(a.y1-b.y1)-(b.y2-b.y1)*(a.x1-b.x1))*((b.x2-b.x1)*(a.y2-b.y1)-(b.y2-b.y1)*(a.x2-b.x1)) < 0),
rel AS MATERIALIZED (SELECT perim_id, zone_id, k IS NOT NULL AND k = total AND x.perim_id IS NULL AND w.perim_id IS NULL AS within
  FROM near LEFT JOIN (SELECT perim_id, zone_id, count(*) AS k FROM vin GROUP BY ALL) USING (perim_id, zone_id) JOIN (SELECT perim_id, count(*) AS total FROM ev GROUP BY perim_id) USING (perim_id)
  LEFT JOIN x USING (perim_id, zone_id) LEFT JOIN win w USING (perim_id, zone_id) WHERE k IS NOT NULL OR x.perim_id IS NOT NULL OR w.perim_id IS NOT NULL)
"""


def _related(s, d):
    return G.relations(X.polygons(s, d).filter("parts is not null"), X.zone_stars(s, d), "perim_id", "zone_id", 1.0)


@query(f"{_RELATION} SELECT perim_id, zone_id, within FROM rel")
def j_polygon_relations(s, d):
    """Perimeters with the concave zones they share an area with, and whether they lie within."""
    return _related(s, d)


@query(f"{_RELATION} SELECT perim_id, zone_id FROM rel WHERE perim_id NOT IN (SELECT perim_id FROM rel WHERE within)")
def j_polygon_intersects_not_within(s, d):
    """The pairs that remain to be cut once perimeters that lie within a zone are settled."""
    got = _related(s, d).groupBy("perim_id").agg(F.max("within").alias("settled"), F.collect_list("zone_id").alias("zones"))
    return got.filter("not settled").select("perim_id", F.explode("zones").alias("zone_id"))


_ZBOX = "(SELECT zone_id, zone_name, minx AS bx0, miny AS by0, maxx AS bx1, maxy AS by1 FROM zone)"
_CUT = f"cut AS MATERIALIZED (SELECT perim_id, zone_id, bx0, by0, bx1, by1, sum({_within_box('bx0', 'by0', 'bx1', 'by1')}) AS plane FROM pe JOIN {_BOX} b USING (perim_id) JOIN {_ZBOX} z ON minx < bx1 AND bx0 < maxx AND miny < by1 AND by0 < maxy GROUP BY ALL)"
_WHOLE = "own AS MATERIALIZED (SELECT perim_id, sum(s*(x1*y2-x2*y1))/2 AS whole FROM (SELECT perim_id, s, x1-cx AS x1, y1-cy AS y1, x2-cx AS x2, y2-cy AS y2 FROM pe JOIN (SELECT perim_id, cx, cy FROM perim) USING (perim_id)) GROUP BY perim_id)"


@query(f"{_E}, {_CUT}, {_WHOLE} SELECT perim_id, zone_id, round(plane*12392.1424, 5) AS common, round((whole-plane)*12392.1424, 5) + 0.0 AS rest, round((whole+(bx1-bx0)*(by1-by0)-plane)*12392.1424, 5) AS both FROM cut JOIN own USING (perim_id) WHERE plane > 1e-11")
def r_polygon_overlay(s, d):
    """Intersection, difference and union of perimeters and zones, as plane areas in square kilometres at the equator."""
    z = X.as_polygons(X.zones(s, d))
    got = G.overlay(X.polygons(s, d).filter("parts is not null"), z, "perim_id", "zone_id").filter("plane > 1e-11")
    return got.select("perim_id", "zone_id", F.round(F.col("plane") * 12392.1424, 5).alias("common"), (F.round(F.col("rest") * 12392.1424, 5) + 0.0).alias("rest"), F.round(F.col("both") * 12392.1424, 5).alias("both"))


@query(f"{_E}, aoi AS (SELECT perim_id, sum({_within_box('-73e0', '-14e0', '-68e0', '-8e0')}) AS plane FROM pe GROUP BY perim_id) SELECT perim_id, round(plane*12392.1424, 5) AS plane FROM aoi WHERE plane > 1e-11")
def r_clip_to_aoi(s, d):
    """The layer's geometries cut to a box; what is left of each, as plane area."""
    import numpy as np

    def cut(batch):
        p = B.read(batch.column("parts"))
        box = (np.full(p.rows, v) for v in (-73.0, -14.0, -68.0, -8.0))
        return {"perim_id": batch.column("perim_id"), "plane": B.clip_boxes(p, np.arange(p.rows), *box).plane_area()}

    near = G.bounds(X.polygons(s, d).select("perim_id", "parts").filter("parts is not null")).filter("maxx > -73 and minx < -68 and maxy > -14 and miny < -8")
    got = G.by_batch(near.select("perim_id", "parts"), cut, "perim_id long, plane double").filter("plane > 1e-11")
    return got.select("perim_id", F.round(F.col("plane") * 12392.1424, 5).alias("plane"))


_CELLS = "(SELECT r, c, -80.0+c*(20.0/24) AS bx0, 1.0-(r+1)*(21.0/24) AS by0, -80.0+(c+1)*(20.0/24) AS bx1, 1.0-r*(21.0/24) AS by1 FROM grid)"


@query(f"{_E}, t AS (SELECT zone_id, r, c, sum({_within_box('bx0', 'by0', 'bx1', 'by1')}) AS plane FROM ze JOIN {_CELLS} ON TRUE GROUP BY ALL), mid AS (SELECT r*24+c AS cell, r, c, (bx0+bx1)/2 AS x, (by0+by1)/2 AS y FROM {_CELLS}), hit AS ({_inside('mid', 'cell', 'x', 'y', 'ze', 'zone_id')}) SELECT t.zone_id, t.r AS row, t.c AS col, hit.cell IS NOT NULL AS center FROM t LEFT JOIN hit ON hit.zone_id = t.zone_id AND hit.cell = t.r*24+t.c WHERE plane > 1e-12")
def r_rasterise_zones(s, d):
    """The cells that concave zones with holes touch, and of which they hold the centre."""
    z = X.zone_stars(s, d)
    center = G.rasterise(z, "zone_id", X.GRID, "center").withColumn("center", F.lit(True))
    return G.rasterise(z, "zone_id", X.GRID).join(center, ["zone_id", "row", "col"], "left").withColumn("center", F.coalesce("center", F.lit(False)))


@query(f"{_E}, mid AS (SELECT r*24+c AS cell, (bx0+bx1)/2 AS x, (by0+by1)/2 AS y FROM {_CELLS}), hit AS ({_inside('mid', 'cell', 'x', 'y', 'ze', 'zone_id')}) SELECT (cell // 24)::INT AS row, (cell % 24)::INT AS col, elev AS value FROM (SELECT DISTINCT cell FROM hit WHERE zone_id IN (6, 7)) JOIN dem ON dem.r = cell // 24 AND dem.c = cell % 24")
def s_mask_crop(s, d):
    """A raster cropped to the cells whose centres lie in polygons."""
    mask = G.rasterise(X.zone_stars(s, d).filter("zone_id in (6, 7)"), "zone_id", X.GRID, "center")
    return R.crop(X.elevation(s), mask)


_CLS_BOX = f"(SELECT year, value, k.* FROM cls JOIN {_CELLS} k USING (r, c))"


@query(f"{_E}, m AS (SELECT perim_id, value, r, c, sum({_within_box('bx0', 'by0', 'bx1', 'by1')}) AS plane FROM pe JOIN {_BOX} b USING (perim_id) JOIN (SELECT perim_id, year(start_date)+8 AS year FROM perim) USING (perim_id) JOIN {_CLS_BOX} k USING (year) WHERE minx < bx1 AND bx0 < maxx AND miny < by1 AND by0 < maxy GROUP BY ALL), t AS (SELECT perim_id, sum(CASE WHEN value = 12 THEN plane ELSE 0 END) AS a, sum(CASE WHEN value = 3 THEN plane ELSE 0 END) AS b FROM m WHERE plane > 0 GROUP BY perim_id) SELECT perim_id, round(a*12392.1424, 5) AS cl12, round(b*12392.1424, 5) AS cl3 FROM perim LEFT JOIN t USING (perim_id) WHERE perim_id % 5 < 4")
def r_polygon_class_clip(s, d):
    """Class areas inside concave and holed perimeters, pixels cut to the polygon; null without cover, 0 without the class."""
    p = X.polygons(s, d).filter("parts is not null").withColumn("year", F.year("start_date") + 8)
    got = G.class_cut(p, "perim_id", X.land_cover(s), X.GRID, (12, 3))
    return got.select("perim_id", F.round(F.col("cl12_plane") * 12392.1424, 5).alias("cl12"), F.round(F.col("cl3_plane") * 12392.1424, 5).alias("cl3"))


_VILLAGE = "perim_id % 5 = 1 AND perim_id % 35 = 1"
_COUNTRY = f"""country AS MATERIALIZED (
  SELECT zone_id AS country_id, zone_id AS code, CASE WHEN zone_id = 3 THEN NULL ELSE zone_name END AS name, minx AS bx0, miny AS by0, maxx AS bx1, maxy AS by1 FROM zone WHERE zone_id < 8
  UNION ALL SELECT 1000 + perim_id, 1000 + perim_id, 'V' || perim_id, cx-hx/2, cy-hy/2, cx+hx/2, cy+hy/2 FROM perim WHERE {_VILLAGE})"""


def _countries(s, d):
    """A few zones, one without a name, and villages that lie between the parts of some perimeters."""
    z = X.zones(s, d).filter("zone_id < 8").selectExpr("CAST(zone_id AS BIGINT) AS country_id", "CASE WHEN zone_id = 3 THEN NULL ELSE zone_name END AS name", "minx", "miny", "maxx", "maxy")
    v = X.perimeters(s, d).filter(_VILLAGE).selectExpr("1000 + perim_id AS country_id", "CONCAT('V', perim_id) AS name", "cx - hx/2 AS minx", "cy - hy/2 AS miny", "cx + hx/2 AS maxx", "cy + hy/2 AS maxy")
    return X.as_polygons(z.unionByName(v)).withColumn("code", F.col("country_id"))


@query(f"""{_E}, {_COUNTRY},
met AS MATERIALIZED (SELECT perim_id, country_id, code, name, code <> perim_id % 8 AS other, sum({_within_box('bx0', 'by0', 'bx1', 'by1')}) AS plane FROM pe JOIN {_BOX} b USING (perim_id) JOIN country ON minx < bx1 AND bx0 < maxx AND miny < by1 AND by0 < maxy GROUP BY ALL),
one AS MATERIALIZED (SELECT perim_id, arg_min(code, (other, country_id)) AS code, arg_min(name, (other, country_id)) FILTER (name IS NOT NULL) AS name FROM met WHERE plane > 1e-12 GROUP BY perim_id HAVING count(name) > 0),
r1 AS (SELECT perim_id, cx, cy FROM perim WHERE perim_id % 5 < 4 AND perim_id NOT IN (SELECT perim_id FROM one)),
two AS MATERIALIZED (SELECT perim_id, arg_min(code, country_id) AS code, arg_min(name, country_id) AS name FROM r1 JOIN country ON cx > bx0 AND cx < bx1 AND cy > by0 AND cy < by1 WHERE name IS NOT NULL GROUP BY perim_id),
three AS (SELECT perim_id, code, name FROM (SELECT perim_id, code, name, row_number() OVER (PARTITION BY perim_id ORDER BY sqrt(pow(greatest(bx0-cx, cx-bx1, 0e0),2)+pow(greatest(by0-cy, cy-by1, 0e0),2)), country_id) AS k FROM r1, country WHERE name IS NOT NULL AND perim_id NOT IN (SELECT perim_id FROM two)) WHERE k = 1)
SELECT perim_id, code, name, 1 AS attempt FROM one UNION ALL SELECT perim_id, code, name, 2 FROM two UNION ALL SELECT perim_id, code, name, 3 FROM three""")
def j_polygon_country_cascade(s, d):
    """By intersection with a preferred code, else by the centroid, which may lie between a perimeter's parts, else the nearest."""
    p = X.polygons(s, d).filter("parts is not null").withColumn("adm0", F.col("perim_id") % 8)
    return G.country_cascade(p, _countries(s, d), "perim_id", "adm0")


@query("SELECT perim_id, cy, country FROM (SELECT perim_id, round(p.cy, 6) AS cy, 'C' || (zone_id % 3) AS country FROM perim p JOIN zone ON p.cx > zone.minx AND p.cx < zone.maxx AND p.cy > zone.miny AND p.cy < zone.maxy) GROUP BY ALL")
def j_centroid_in_dissolved(s, d):
    """Centroids within countries made of several zones that overlap; each is found once."""
    z = X.as_polygons(X.zones(s, d)).withColumn("country", F.concat(F.lit("C"), (F.col("zone_id") % 3).cast("string")))
    edges = J.edges_of(G.dissolve(z, "country"), "country")
    hit = J.points_in_polygons(X.perimeters(s, d).select("perim_id", "cx", "cy"), "perim_id", edges, "country", "cx", "cy", 5.0)
    return hit.join(X.perimeters(s, d).select("perim_id", F.round("cy", 6).alias("cy")), "perim_id")


@query("SELECT perim_id % 4 AS kind, count(*) AS n, count(*) FILTER (perim_id % 4 < 2) AS good, count(*) FILTER (perim_id % 4 >= 2) AS bad FROM perim GROUP BY 1")
def r_make_valid(s, d):
    """Rings that aren't closed or repeat points are mended; bow-ties and rings without area go to quarantine."""
    q = lambda x, y: F.struct((F.col("cx") + F.col("hx") * x).alias("x"), (F.col("cy") + F.col("hy") * y).alias("y"))
    ring = lambda *pts: F.array(*[q(float(x), float(y)) for x, y in pts])
    unclosed, repeated = ring((-1, -1), (1, -1), (1, 1), (-1, 1)), ring((-1, -1), (1, -1), (1, -1), (1, 1), (-1, 1), (-1, 1), (-1, -1))
    bow, flat = ring((-1, -1), (2, 1), (2, -1), (-1, 1), (-1, -1)), ring((-1, 0), (1, 0), (-1, 0))
    k = F.col("perim_id") % 4
    holes = F.array().cast(f"array<{G.RING_TYPE}>")
    shapes = X.perimeters(s, d).withColumn("parts", F.array(F.struct(F.when(k == 0, unclosed).when(k == 1, repeated).when(k == 2, bow).otherwise(flat).alias("shell"), holes.alias("holes"))))
    good, bad = S.quarantine(G.measures(shapes, "perim_id"), F.col("valid"))
    both = good.select("perim_id", F.lit(True).alias("good")).unionByName(bad.select("perim_id", F.lit(False).alias("good")))
    return both.groupBy((F.col("perim_id") % 4).alias("kind")).agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))


@query(f"{_E}, {_WHOLE} SELECT perim_id, year(start_date)::INT AS year, CASE WHEN perim_id % 5 = 1 THEN 'MultiPolygon' ELSE 'Polygon' END AS geom_type, round(whole*12392.1424, 5) AS plane FROM perim JOIN own USING (perim_id)")
def s_geojson_layer(s, d):
    """A layer written as GeoJSON and read again with one of its two properties left out."""
    path = scratch_path(s, "layer-geojson")
    p = X.polygons(s, d).filter("parts is not null").withColumn("year", F.year("start_date"))
    S.write_geojson(p, path, ["perim_id", "year", "hx"])
    got = S.read_geojson(s, path, "perim_id long, year int, hx double", keep=["perim_id", "year"])
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v)
    moved = lambda r: geo.ring_shoelace(F.transform(r, lambda q: F.struct((q["x"] - r[0]["x"]).alias("x"), (q["y"] - r[0]["y"]).alias("y"))))
    plane = total(F.transform("parts", lambda x: moved(x["shell"]) - total(F.transform(x["holes"], moved))))
    return got.select("perim_id", "year", "geom_type", F.round(plane * 12392.1424, 5).alias("plane"))


@query("SELECT perim_id FROM perim WHERE maxx >= -73 AND minx <= -70 AND maxy >= -12 AND miny <= -9")
def s_layer_bbox(s, d):
    """Rows of a stored layer whose bounds meet a box: ranges that reach the scan."""
    path = scratch_path(s, "layer")
    S.write_layer(X.perimeters(s, d), path)
    return S.read_layer(s, path, ["perim_id", "start_date"], (-73.0, -12.0, -70.0, -9.0), columns=["perim_id"])


@query(f"{_E}, own AS {_BOX} SELECT perim_id FROM own WHERE maxx >= -73 AND minx <= -70 AND maxy >= -12 AND miny <= -9")
def s_layer_bbox_of_geometry(s, d):
    """The same on a layer without bounds, which is read in full."""
    path = scratch_path(s, "layer")
    S.write_layer(X.polygons(s, d).filter("parts is not null").select("perim_id", "parts"), path)
    return S.read_layer(s, path, ["parts"], (-73.0, -12.0, -70.0, -9.0), columns=["perim_id"])


@query("SELECT 5 AS limited, count(*) AS n, count(DISTINCT year(start_date)) AS years FROM perim")
def s_layer_limit(s, d):
    """A scan of so many rows, and one of attributes only."""
    path = scratch_path(s, "layer")
    S.write_layer(X.polygons(s, d), path)
    few = S.read_layer(s, path, limit=5).agg(F.count("*").cast("int").alias("limited"))
    return few.join(F.broadcast(S.read_layer(s, path, columns=["start_date"]).agg(F.count("*").alias("n"), F.countDistinct(F.year("start_date")).alias("years"))))


@query("SELECT perim_id, round(6378137.0*radians(minx), 3) AS minx, round(6378137.0*ln(tan(pi()/4+radians(miny)/2)), 3) AS miny, round(6378137.0*radians(maxx), 3) AS maxx, round(6378137.0*ln(tan(pi()/4+radians(maxy)/2)), 3) AS maxy FROM perim")
def r_reproject_bounds(s, d):
    """Bounds in Mercator from 21 points of each side."""
    b = geo.mercator_bounds(*[F.col(c) for c in P.BOX])
    return X.perimeters(s, d).select("perim_id", *[F.round(c, 3).alias(n) for n, c in b.items()])
