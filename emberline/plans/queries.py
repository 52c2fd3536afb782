"""Registered queries over the derived fire inputs, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions import geo, scalar
from emberline.operators import raster as R
from emberline.operators import spatial_join as J
from emberline.plans import fixtures as X
from emberline.plans import products as P
from emberline.plans.registry import ORACLES, QUERIES, query
from emberline.plans.registry import box_area_sql as _area
from emberline.sources import tables as S

_E2 = geo.E2
_THEMATIC = "confidence >= 80 AND type IN (0, 2) AND latitude BETWEEN -20 AND 1 AND longitude BETWEEN -80 AND -60"
_SEL = f"+ sel AS (SELECT * FROM det WHERE {_THEMATIC})"
_HAV = "2*6371.0*asin(sqrt(pow(sin((radians(b.latitude)-radians(a.latitude))/2),2)+cos(radians(a.latitude))*cos(radians(b.latitude))*pow(sin((radians(b.longitude)-radians(a.longitude))/2),2)))"
_PAIRS = _SEL + f", pairs AS (SELECT a.det_id AS a, b.det_id AS b FROM sel a JOIN sel b ON a.det_id < b.det_id AND abs(a.acq_date - b.acq_date) <= 15 AND abs(a.latitude-b.latitude) < 0.02 WHERE {_HAV} <= 1.0)"
_CLUSTER = (
    _PAIRS
    + ", link AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs), reach AS (SELECT det_id AS a, det_id AS b FROM sel UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b), clu AS (SELECT a AS det_id, min(b) AS cluster FROM reach GROUP BY a)"
)
_IN = "longitude > minx AND longitude < maxx AND latitude > miny AND latitude < maxy"
_REGION = f", reg AS (SELECT det_id, coalesce(arg_min(zone_name, zone_id), 'sin_region') AS region FROM (SELECT det_id, zone_id, zone_name FROM sel LEFT JOIN (SELECT * FROM zone) z ON {_IN}) GROUP BY det_id)"


def _selected(s: SparkSession, d: str) -> DataFrame:
    return P.select_detections(X.detections(s, d))


def _clusters(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    points = _selected(s, d)
    return points, P.clusters(points)


# --- projections and filters


@query(f"SELECT det_id, latitude, longitude, acq_date, satellite, confidence, type FROM det WHERE {_THEMATIC}")
def p_thematic_filter(s, d):
    return _selected(s, d).select("det_id", "latitude", "longitude", "acq_date", "satellite", "confidence", "type")


@query("SELECT zone_id, zone_name, CASE WHEN zone_name = 'NATION_3' THEN 'Peru' ELSE zone_name END AS renamed FROM zone WHERE zone_name IS DISTINCT FROM 'NATION_2'")
def p_country_exclusion_nullsafe(s, d):
    z = X.zones(s, d).filter(scalar.not_country(F.col("zone_name"), "NATION_2"))
    return z.select("zone_id", "zone_name", F.when(F.col("zone_name") == "NATION_3", "Peru").otherwise(F.col("zone_name")).alias("renamed"))


@query("SELECT CASE WHEN latitude >= -5 AND latitude <= 1 THEN 'Zone_Equatorial' WHEN latitude >= -8 AND latitude < -5 THEN 'Transition_Zone' WHEN latitude >= -20 AND latitude < -8 THEN 'South_Zone' ELSE 'Not_Specified' END AS zone, count(*) AS n FROM det GROUP BY 1")
def p_zone_clima(s, d):
    return X.detections(s, d).groupBy(scalar.climate_zone(F.col("latitude")).alias("zone")).agg(F.count("*").alias("n"))


@query("SELECT year, doy, month AS band, CASE WHEN doy <= 0 OR doy > 366 THEN 0 ELSE month(make_date(year, 1, 1) + (doy - 1)) END::INT AS month, count(*) AS n FROM (SELECT year, month, doy FROM px UNION ALL SELECT year, month, doy - 366 FROM px) GROUP BY ALL")
def p_doy_month(s, d):
    px = X.burned_pixels(s, d).select("year", "month", "doy")
    both = px.unionAll(px.select("year", "month", F.col("doy") - 366))
    return both.groupBy("year", "doy", F.col("month").alias("band"), scalar.month_of_day(F.col("year"), F.col("doy")).alias("month")).agg(F.count("*").alias("n"))


@query("SELECT y::INT AS year, b::INT AS bands, CASE WHEN y-2024+b BETWEEN 1 AND b THEN (y-2024+b)::INT END AS from_last, CASE WHEN y-2000 BETWEEN 1 AND b THEN (y-2000)::INT END AS from_first, CASE WHEN y-1984 BETWEEN 1 AND b THEN (y-1984)::INT END AS from_1985 FROM range(1984, 2027) t(y), (VALUES (24), (40)) v(b)", ctes=False)
def p_band_anchor(s, d):
    y = s.range(1984, 2027).select(F.col("id").cast("int").alias("year")).withColumn("bands", F.explode(F.array(F.lit(24), F.lit(40))))
    at = lambda a: scalar.band_of_year(F.col("year"), F.col("bands"), a).cast("int")
    return y.select("year", "bands", at("last").alias("from_last"), at("first").alias("from_first"), at("1985").alias("from_1985"))


_DATE_TEXT = "CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') WHEN 2 THEN 'day ' || o_orderkey ELSE NULL END"


@query(f"SELECT o_orderkey, coalesce(try_cast(try_strptime(txt, '%Y-%m-%d') AS DATE), try_cast(try_strptime(txt, '%Y-%m-%d %H:%M:%S') AS DATE)) AS start_date FROM (SELECT o_orderkey, {_DATE_TEXT} AS txt FROM orders)", ctes=False)
def p_date_cascade(s, d):
    k = F.col("o_orderkey") % 4
    text = F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 1, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).when(k == 2, F.concat(F.lit("day "), F.col("o_orderkey").cast("string")))
    return s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", scalar.lenient_date(text).alias("start_date"))


@query("SELECT perim_id, printf('GFA_%d_%06d', year(start_date), perim_id) AS event_uid, year(start_date)::INT AS year, month(start_date)::INT AS month FROM perim")
def p_event_keys(s, d):
    p = X.perimeters(s, d)
    return p.select("perim_id", scalar.event_key("GFA", ("_%d", F.year("start_date")), ("_%06d", F.col("perim_id"))).alias("event_uid"), F.year("start_date").alias("year"), F.month("start_date").alias("month"))


@query("SELECT det_id, round(x, 3) AS x, round(y, 3) AS y, round(degrees(x/6378137.0), 6) AS lon, round(degrees(asin(tanh(y/6378137.0))), 6) AS lat FROM (SELECT det_id, 6378137.0*radians(longitude) AS x, 6378137.0*ln(tan(pi()/4+radians(latitude)/2)) AS y FROM det)", ctes=True)
def p_mercator_round_trip(s, d):
    """Forward and back; the SQL inverts with another formula (the Gudermannian as asin(tanh))."""
    at = X.detections(s, d).select("det_id", geo.mercator_x(F.col("longitude")).alias("x"), geo.mercator_y(F.col("latitude")).alias("y"))
    return at.select("det_id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), F.round(geo.inverse_mercator_lon(F.col("x")), 6).alias("lon"), F.round(geo.inverse_mercator_lat(F.col("y")), 6).alias("lat"))


# --- joins


@query(f"{_SEL} SELECT det_id, zone_id FROM sel JOIN zone ON {_IN}")
def j_point_in_zone(s, d):
    return J.points_in_boxes(_selected(s, d), X.zones(s, d), cell=5.0, how="inner").select("det_id", "zone_id")


@query(f"{_SEL}{_REGION} SELECT det_id, region FROM reg")
def j_zone_first_match(s, d):
    return P.with_region(_selected(s, d), X.zones(s, d))


@query(f"{_SEL}{_REGION} SELECT region, count(*) AS n FROM reg GROUP BY region")
def g_detections_by_region(s, d):
    return P.with_region(_selected(s, d), X.zones(s, d)).groupBy("region").agg(F.count("*").alias("n"))


@query(f"{_PAIRS} SELECT a, b FROM pairs")
def j_radius_time_pairs(s, d):
    return J.radius_time_pairs(_selected(s, d), "det_id", "acq_date")


_DIST = "sqrt(pow(greatest(minx-longitude, longitude-maxx, 0e0),2)+pow(greatest(miny-latitude, latitude-maxy, 0e0),2))"


@query(f"{_SEL} SELECT det_id, zone_id, round(dd, 6) AS distance FROM (SELECT det_id, zone_id, {_DIST} AS dd, row_number() OVER (PARTITION BY det_id ORDER BY {_DIST}, zone_id) AS k FROM sel, zone) WHERE k = 1")
def j_nearest_zone(s, d):
    near = J.nearest_box(_selected(s, d), X.zones(s, d), ["det_id"], F.col("zone_id"), F.col("zone_id"))
    return near.select("det_id", F.col("value").alias("zone_id"), F.round("distance", 6).alias("distance"))


_CASCADE = """
+ one AS (SELECT perim_id, arg_min(zone_name, zone_id) AS country FROM perim p JOIN zone z ON p.minx <= z.maxx AND z.minx <= p.maxx AND p.miny <= z.maxy AND z.miny <= p.maxy WHERE zone_name IS NOT NULL GROUP BY perim_id),
rest AS (SELECT perim_id, (minx+maxx)/2 AS x, (miny+maxy)/2 AS y FROM perim WHERE perim_id NOT IN (SELECT perim_id FROM one)),
three AS (SELECT perim_id, zone_name AS country FROM (SELECT perim_id, zone_name, row_number() OVER (PARTITION BY perim_id ORDER BY sqrt(pow(greatest(minx-x, x-maxx, 0e0),2)+pow(greatest(miny-y, y-maxy, 0e0),2)), zone_id) AS k FROM rest, zone WHERE zone_name IS NOT NULL) WHERE k = 1)
SELECT perim_id, country, 1 AS attempt FROM one UNION ALL SELECT perim_id, country, 3 FROM three
"""


@query(_CASCADE)
def j_country_cascade(s, d):
    return P.country_cascade(X.perimeters(s, d), X.zones(s, d), "perim_id")


@query("SELECT perim_id FROM perim p WHERE EXISTS (SELECT 1 FROM zone WHERE zone_name IN ('NATION_3', 'NATION_7', 'NATION_11', 'NATION_12', 'NATION_18') AND cx > minx AND cx < maxx AND cy > miny AND cy < maxy)".replace("cx > minx AND cx < maxx AND cy > miny AND cy < maxy", "p.cx > zone.minx AND p.cx < zone.maxx AND p.cy > zone.miny AND p.cy < zone.maxy"))
def j_centroid_in_country(s, d):
    z = X.zones(s, d).filter(F.col("zone_name").isin("NATION_3", "NATION_7", "NATION_11", "NATION_12", "NATION_18"))
    return J.points_in_boxes(X.perimeters(s, d).select("perim_id", "cx", "cy"), z, "cx", "cy", 5.0, "left_semi").select("perim_id")


@query("SELECT perim_id, zone_id FROM perim p JOIN zone z ON p.minx >= z.minx AND p.maxx <= z.maxx AND p.miny >= z.miny AND p.maxy <= z.maxy")
def j_perimeter_within_zone(s, d):
    met = J.boxes_intersect(X.perimeters(s, d), X.zones(s, d), "perim_id", "zone_id", 1.0)
    return met.filter("a_minx >= b_minx and a_maxx <= b_maxx and a_miny >= b_miny and a_maxy <= b_maxy").select("perim_id", "zone_id")


_DRAW = "(('0x' || substr(md5({} || '|{}'), 1, 8))::BIGINT % 1000000)"


@query(f"SELECT det_id, acq_date FROM det WHERE {_DRAW.format('det_id::VARCHAR', 42)} < 100000")
def a_bernoulli_sample(s, d):
    """A tenth of the detections, the same rows in every engine that has md5."""
    return X.detections(s, d).filter(scalar.sampled(F.col("det_id"), 0.1)).select("det_id", "acq_date")


@query(f"SELECT year, count(*) AS n, count(DISTINCT r*24+c) AS cells FROM px WHERE {_DRAW.format(chr(39)+'T'+chr(39)+' || (r//8) || '+chr(39)+'_'+chr(39)+' || (c//8)', 7)} < 500000 GROUP BY year")
def a_tile_sample(s, d):
    """Half of the tiles; whole tiles are taken or left, so a tile that is left is never read."""
    px = X.burned_pixels(s, d)
    tile = F.format_string("T%d_%d", F.floor(F.col("row") / 8), F.floor(F.col("col") / 8))
    kept = px.filter(scalar.sampled(tile, 0.5, 7))
    return kept.groupBy("year").agg(F.count("*").alias("n"), F.countDistinct("row", "col").alias("cells"))


# --- AT


@query("SELECT det_id, round(degrees((6378137.0*radians(longitude)-500)/6378137.0), 6) AS minx, round(degrees((6378137.0*radians(longitude)+500)/6378137.0), 6) AS maxx, round(degrees(2*atan(exp((6378137.0*ln(tan(pi()/4+radians(latitude)/2))-500)/6378137.0))-pi()/2), 6) AS miny, round(degrees(2*atan(exp((6378137.0*ln(tan(pi()/4+radians(latitude)/2))+500)/6378137.0))-pi()/2), 6) AS maxy FROM det")
def r_square_buffer(s, d):
    b = geo.square_buffer(F.col("longitude"), F.col("latitude"))
    return X.detections(s, d).select("det_id", *[F.round(c, 6).alias(n) for n, c in b.items()])


@query(f"{_CLUSTER} SELECT det_id, cluster FROM clu", recursive=True)
def r_cluster_components(s, d):
    return _clusters(s, d)[1]


@query(f"{_CLUSTER} SELECT cluster, count(*) AS n, arg_min(sel.det_id, (acq_date, sel.det_id)) AS det_id, min(acq_date) AS acq_date, arg_min(round(longitude, 6), (acq_date, sel.det_id)) AS longitude, arg_min(round(latitude, 6), (acq_date, sel.det_id)) AS latitude, arg_min(satellite, (acq_date, sel.det_id)) AS satellite FROM sel JOIN clu USING (det_id) GROUP BY cluster", recursive=True)
def g_first_event_per_cluster(s, d):
    points, of = _clusters(s, d)
    e = P.first_events(points, of)
    return e.select("cluster", "n", "det_id", "acq_date", F.round("longitude", 6).alias("longitude"), F.round("latitude", 6).alias("latitude"), "satellite")


@query("SELECT user_id, arg_min(p, (day, event_id)) AS props, arg_min(v, (day, event_id)) AS value FROM (SELECT user_id, event_id, CAST(ts AS DATE) AS day, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END AS p, CASE WHEN event_id % 5 < 2 THEN NULL ELSE value END AS v FROM events) GROUP BY user_id", ctes=False)
def g_first_nonnull_legacy(s, d):
    e = s.read.parquet(f"{d}/events.parquet").select("user_id", "event_id", F.to_date("ts").alias("day"), F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("props"), F.when(F.col("event_id") % 5 >= 2, F.col("value")).alias("value"))
    return P.first_non_null(e, "user_id", ["day", "event_id"], ["props", "value"])


_CELL = "CAST(floor((longitude+80.0)/(20.0/24)) AS INT) AS c, CAST(floor((1.0-latitude)/(21.0/24)) AS INT) AS r"


@query(f"{_SEL}{_REGION}, z AS (SELECT region, elev, v FROM (SELECT det_id, {_CELL} FROM sel) p JOIN reg USING (det_id) LEFT JOIN dem USING (r, c) LEFT JOIN (SELECT r, c, value AS v FROM cls WHERE year = 2008) k USING (r, c)) SELECT region, count(*) AS n, min(elev) AS dem_min, median(elev) AS dem_median, max(elev) AS dem_max, round(100.0*count(v)/count(*), 6) AS pct_class FROM z GROUP BY region")
def g_zone_summary(s, d):
    at = _selected(s, d).withColumns({"row": X.GRID.row_of(F.col("latitude")).cast("int"), "col": X.GRID.col_of(F.col("longitude")).cast("int")})
    cover = X.land_cover(s).filter("year = 2008").select("row", "col", F.col("value").alias("v"))
    rows = at.join(P.with_region(_selected(s, d), X.zones(s, d)), "det_id").join(X.elevation(s), ["row", "col"], "left").join(cover, ["row", "col"], "left")
    return rows.groupBy("region").agg(F.count("*").alias("n"), F.min("value").alias("dem_min"), F.median("value").alias("dem_median"), F.max("value").alias("dem_max"), F.round(F.count("v") * 100.0 / F.count("*"), 6).alias("pct_class"))


# --- rasters

_CENTER = "(-80.0+(c+0.5)*(20.0/24)) > minx AND (-80.0+(c+0.5)*(20.0/24)) < maxx AND (1.0-(r+0.5)*(21.0/24)) > miny AND (1.0-(r+0.5)*(21.0/24)) < maxy"
_TOUCH = "c >= floor((minx+80.0)/(20.0/24)) AND c <= floor((maxx+80.0)/(20.0/24)) AND r >= floor((1.0-maxy)/(21.0/24)) AND r <= floor((1.0-miny)/(21.0/24))"


@query(f"SELECT zone_id, median(elev) AS dem_median, avg(elev) AS dem_mean, count(elev) AS n FROM zone LEFT JOIN dem ON {_CENTER} GROUP BY zone_id")
def g_zonal_median_center(s, d):
    px = R.pixels_of_boxes(X.zones(s, d), ["zone_id"], X.GRID, "center")
    got = R.zonal(px, X.elevation(s), ["zone_id"], F.median("value").alias("dem_median"), F.avg("value").alias("dem_mean"), F.count("value").alias("n"))
    return X.zones(s, d).select("zone_id").join(got, "zone_id", "left").select("zone_id", "dem_median", "dem_mean", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query(f"SELECT zone_id, round(median(elev), 1) AS dem_median, count(elev) AS n FROM zone JOIN dem ON {_TOUCH} WHERE elev <> 0 GROUP BY zone_id")
def g_zonal_median_touched(s, d):
    px = R.pixels_of_boxes(X.zones(s, d), ["zone_id"], X.GRID, "all_touched")
    return R.zonal(px, X.elevation(s), ["zone_id"], F.round(F.median("value"), 1).alias("dem_median"), F.count("value").alias("n"), nodata=0.0)


@query(f"SELECT zone_id, value AS majority, n FROM (SELECT zone_id, value, count(*) AS n, row_number() OVER (PARTITION BY zone_id ORDER BY count(*) DESC, value) AS k FROM zone JOIN cls ON {_TOUCH} WHERE year = 2005 AND value IS NOT NULL GROUP BY zone_id, value) WHERE k = 1")
def g_zonal_majority(s, d):
    px = R.pixels_of_boxes(X.zones(s, d), ["zone_id"], X.GRID, "all_touched")
    return R.zonal_majority(px, X.land_cover(s).filter("year = 2005"), ["zone_id"])


@query("SELECT zone_id, round(sum(CASE WHEN value = 12 THEN (20.0/24*111320.0*cos(radians(1.0-(r+0.5)*(21.0/24))))*(21.0/24*111320.0) WHEN r IS NOT NULL THEN 0 END)/1e6, 3) AS cl12_km2, round(100.0*count(*) FILTER (value = 12)/nullif(count(r), 0), 6) AS pct FROM zone LEFT JOIN (SELECT * FROM cls WHERE year = 2006) k ON " + _TOUCH + " GROUP BY zone_id")
def g_class_area_multi_tile(s, d):
    """Null where no tile covers a zone, 0 where tiles do but have no pixel of the class."""
    px = R.pixels_of_boxes(X.zones(s, d), ["zone_id"], X.GRID, "all_touched")
    g = X.GRID
    area = geo.degree_pixel_area_m2(F.lit(g.width), F.lit(g.height), g.top(F.col("row") + 0.5))
    cover = X.land_cover(s).filter("year = 2006")
    share = px.join(cover, ["row", "col"]).groupBy("zone_id").agg(F.round(F.count_if(F.col("value") == 12) * 100.0 / F.count("*"), 6).alias("pct"))
    return R.class_area(px, cover, ["zone_id"], 12, area).select("zone_id", F.round(F.col("area") / 1e6, 3).alias("cl12_km2")).join(share, "zone_id", "left")


@query("SELECT zone_id, round(100.0*sum(h)/nullif(sum(t),0), 6) AS pct FROM (SELECT zone_id, r // 8 AS tr, c // 8 AS tc, count(*) FILTER (value = 3) AS h, count(value) AS t FROM zone JOIN cls ON " + _TOUCH + " WHERE year = 2007 GROUP BY ALL) GROUP BY zone_id")
def g_pct_weighted(s, d):
    px = R.pixels_of_boxes(X.zones(s, d), ["zone_id"], X.GRID, "all_touched").join(X.land_cover(s).filter("year = 2007"), ["row", "col"])
    parts = px.groupBy("zone_id", F.floor(F.col("row") / 8).alias("tr"), F.floor(F.col("col") / 8).alias("tc")).agg(F.count_if(F.col("value") == 3).alias("h"), F.count("value").alias("t"))
    return R.weighted_percent(parts, ["zone_id"], "h", "t").select("zone_id", F.round("pct", 6).alias("pct"))


@query("SELECT r AS row, c AS col, m::INT AS month, coalesce(v, -9999.0)::DOUBLE AS value FROM grid CROSS JOIN range(1, 13) t(m) LEFT JOIN (SELECT r, c, month, doy::DOUBLE AS v FROM px WHERE year = 2005) USING (r, c) WHERE v IS NULL OR month = m".replace("LEFT JOIN (SELECT r, c, month, doy::DOUBLE AS v FROM px WHERE year = 2005) USING (r, c) WHERE v IS NULL OR month = m", "LEFT JOIN (SELECT r AS pr, c AS pc, month AS pm, doy::DOUBLE AS v FROM px WHERE year = 2005) ON pr = r AND pc = c AND pm = m"))
def s_stack_months(s, d):
    bands = X.burned_pixels(s, d).filter("year = 2005").select("row", "col", "month", F.col("doy").cast("double").alias("value"))
    return R.stack(bands, X.cells(s), "month", list(range(1, 13)))


@query("SELECT r AS row, c AS col, arg_min(doy, month)::INT AS value FROM px WHERE year = 2006 GROUP BY r, c")
def s_mosaic_first(s, d):
    tiles = X.burned_pixels(s, d).filter("year = 2006").select("row", "col", "month", F.col("doy").alias("value"))
    return R.mosaic_first(tiles, ["month"])


@query(f"SELECT det_id, elev AS value FROM (SELECT det_id, {_CELL} FROM det) LEFT JOIN dem USING (r, c)")
def s_warp_nearest(s, d):
    out = R.warp_nearest(X.detections(s, d), X.elevation(s), X.GRID, F.col("longitude"), F.col("latitude"))
    return out.select("det_id", "value")


@query("""
+ t AS (SELECT det_id, (longitude+80.0)/(20.0/24)-0.5 AS x, (1.0-latitude)/(21.0/24)-0.5 AS y FROM det),
o AS (SELECT det_id, x, y, floor(y)+i AS r, floor(x)+j AS c FROM t, (VALUES (0,0),(0,1),(1,0),(1,1)) v(i,j))
SELECT det_id, round(sum((1-abs(y-o.r))*(1-abs(x-o.c))*elev) / nullif(sum(CASE WHEN elev IS NOT NULL THEN (1-abs(y-o.r))*(1-abs(x-o.c)) END), 0), 4) AS value
FROM o LEFT JOIN dem ON dem.r = o.r AND dem.c = o.c GROUP BY det_id
""")
def s_warp_bilinear(s, d):
    out = R.warp_bilinear(X.detections(s, d), X.elevation(s), X.GRID, ["det_id"], F.col("longitude"), F.col("latitude"))
    return out.select("det_id", F.round("value", 4).alias("value"))


@query("SELECT (r // 3)::INT AS row, (c // 3)::INT AS col, round(avg(elev), 6) AS value FROM dem GROUP BY ALL")
def s_warp_average(s, d):
    return R.warp_average(X.elevation(s), 3).select("row", "col", F.round("value", 6).alias("value"))


@query("SELECT (i // 20)::INT AS row, (i % 20)::INT AS col, -80.0::DOUBLE + (i % 20) AS minx, -20.0::DOUBLE + (i // 20) AS miny, least(-80.0::DOUBLE + (i % 20) + 1, -60.0) AS maxx, least(-20.0::DOUBLE + (i // 20) + 1, 1.0) AS maxy FROM range(420) t(i)", ctes=False)
def s_tile_grid(s, d):
    return S.tile_grid(s, -80.0, -20.0, -60.0, 1.0, 1.0)


_NAME = "'tile' || r || 'x' || c || '_' || year || '_' || lpad(month::VARCHAR, 2, '0') || CASE WHEN r = 3 THEN '.txt' ELSE '.tif' END"


@query(f"SELECT tile, year::INT AS year, count(DISTINCT month) AS months, min(month)::INT AS first_month FROM (SELECT regexp_extract(n, '^(.+)_(\\d{{4}})_(\\d{{2}})\\.tif$', 1) AS tile, regexp_extract(n, '^(.+)_(\\d{{4}})_(\\d{{2}})\\.tif$', 2)::INT AS year, regexp_extract(n, '^(.+)_(\\d{{4}})_(\\d{{2}})\\.tif$', 3)::INT AS month FROM (SELECT {_NAME} AS n FROM px) WHERE regexp_matches(n, '^(.+)_(\\d{{4}})_(\\d{{2}})\\.tif$')) GROUP BY tile, year")
def s_catalog_regex(s, d):
    px = X.burned_pixels(s, d)
    name = F.format_string("tile%dx%d_%d_%02d%s", "row", "col", "year", "month", F.when(F.col("row") == 3, ".txt").otherwise(".tif"))
    got = px.select(*[c.alias(n) for n, c in S.month_file(name).items()]).filter("tile is not null")
    return got.groupBy("tile", "year").agg(F.countDistinct("month").alias("months"), F.min("month").alias("first_month"))


@query("SELECT r AS row, c AS col FROM grid WHERE NOT EXISTS (SELECT 1 FROM px WHERE px.r = grid.r AND px.c = grid.c AND year = 2004 AND month = 2)")
def s_missing_tiles(s, d):
    have = X.burned_pixels(s, d).filter("year = 2004 and month = 2").select("row", "col")
    return S.missing_tiles(X.cells(s), have, ["row", "col"])


@query(f"SELECT r AS row, round({_area('0.0', '1.0-(r+1)*(21.0/24)', '20.0/24', '1.0-r*(21.0/24)')}/1e6, 4) AS km2 FROM grid WHERE c = 0")
def r_geodesic_area_cells(s, d):
    return X.cells(s).filter("col = 0").select("row", F.round(X.GRID.cell_area_m2(F.col("row")) / 1e6, 4).alias("km2"))


@query("SELECT det_id FROM det WHERE longitude > -73 AND longitude < -72 AND latitude > -14 AND latitude < -13")
def k_aoi_filter(s, d):
    inside = (F.col("longitude") > -73) & (F.col("longitude") < -72) & (F.col("latitude") > -14) & (F.col("latitude") < -13)
    return X.detections(s, d).filter(inside).select("det_id")


# --- BA

_PATCH = """
+ k AS MATERIALIZED (SELECT *, (year*100+month)::BIGINT*10000000000 + r::BIGINT*100000 + c AS pixel FROM px),
link AS MATERIALIZED (SELECT a.pixel AS a, b.pixel AS b FROM k a JOIN k b ON a.year = b.year AND a.month = b.month AND a.doy = b.doy AND abs(a.r-b.r) <= 1 AND abs(a.c-b.c) <= 1 AND a.pixel <> b.pixel),
reach AS (SELECT pixel AS a, pixel AS b FROM k UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b),
patch AS MATERIALIZED (SELECT k.*, m.patch FROM k JOIN (SELECT a AS pixel, min(b) AS patch FROM reach GROUP BY a) m USING (pixel))
"""


def _patches(s: SparkSession, d: str) -> DataFrame:
    return P.burned_patches(X.burned_pixels(s, d))


@query(f"{_PATCH} SELECT pixel, patch FROM patch", recursive=True)
def r_label_same_doy(s, d):
    return _patches(s, d).select("pixel", "patch")


@query(f"{_PATCH} SELECT patch, year, month, count(*) AS n_pix, median(doy) AS burn_day, median(nullif(elev, 0)) AS dem_median, round(avg(nullif(elev, 0)), 6) AS dem_mean FROM patch LEFT JOIN dem USING (r, c) GROUP BY patch, year, month", recursive=True)
def g_label_stats(s, d):
    out = P.patch_stats(_patches(s, d), X.elevation(s), nodata=0.0)
    return out.select("patch", "year", "month", "n_pix", F.col("burn_day").cast("double").alias("burn_day"), "dem_median", F.round("dem_mean", 6).alias("dem_mean"))


@query(f"{_PATCH} SELECT patch, count(*) AS n_pix FROM patch GROUP BY patch HAVING count(*) >= 5", recursive=True)
def g_min_pix(s, d):
    return _patches(s, d).groupBy("patch").agg(F.count("*").alias("n_pix")).filter(F.col("n_pix") >= P.MIN_PIX)


_CELL_M2 = _area("0.0", "1.0-(r+1)*(21.0/24)", "20.0/24", "1.0-r*(21.0/24)")


@query(f"SELECT year, month, count(*) AS n, round(sum(m2)/1e4, 2) AS area_ha, round(sum(CASE WHEN value = 12 THEN m2 END)/1e4, 2) AS cl12_ha, round(sum(CASE WHEN value = 3 THEN m2 END)/1e4, 2) AS cl3_ha FROM (SELECT px.*, value, {_CELL_M2} AS m2 FROM px LEFT JOIN cls USING (year, r, c)) GROUP BY GROUPING SETS ((year, month), (year))")
def g_year_month_grouping_sets(s, d):
    px = X.burned_pixels(s, d).withColumn("m2", X.GRID.cell_area_m2(F.col("row"))).join(X.land_cover(s), ["year", "row", "col"], "left")
    sets = px.groupingSets([["year", "month"], ["year"]], "year", "month")
    of = lambda k: F.round(F.sum(F.when(F.col("value") == k, F.col("m2"))) / 1e4, 2).alias(f"cl{k}_ha")
    return sets.agg(F.count("*").alias("n"), F.round(F.sum("m2") / 1e4, 2).alias("area_ha"), of(12), of(3))


@query(
    f"""{_PATCH}, tp AS MATERIALIZED (SELECT *, r // 8 AS tr, c // 8 AS tc FROM (SELECT k.*, k.pixel AS q FROM k)),
tlink AS MATERIALIZED (SELECT a.pixel AS a, b.pixel AS b FROM tp a JOIN tp b ON a.year=b.year AND a.month=b.month AND a.doy=b.doy AND a.tr=b.tr AND a.tc=b.tc AND abs(a.r-b.r)<=1 AND abs(a.c-b.c)<=1 AND a.pixel<>b.pixel),
treach AS (SELECT pixel AS a, pixel AS b FROM tp UNION SELECT treach.a, tlink.b FROM treach JOIN tlink ON tlink.a = treach.b),
own AS MATERIALIZED (SELECT tp.*, m.piece FROM tp JOIN (SELECT a AS pixel, min(b) AS piece FROM treach GROUP BY a) m USING (pixel)),
seam AS MATERIALIZED (SELECT DISTINCT a.piece AS a, b.piece AS b FROM own a JOIN own b ON a.year=b.year AND abs(a.r-b.r)<=1 AND abs(a.c-b.c)<=1 AND (a.tr<>b.tr OR a.tc<>b.tc) WHERE a.piece<>b.piece),
sreach AS (SELECT DISTINCT piece AS a, piece AS b FROM own UNION SELECT sreach.a, seam.b FROM sreach JOIN seam ON seam.a = sreach.b)
SELECT a AS patch, min(b) AS fire FROM sreach GROUP BY a""",
    recursive=True,
)
def r_reintegrate_border(s, d):
    px = X.burned_pixels(s, d).withColumns({"tr": F.floor(F.col("row") / 8), "tc": F.floor(F.col("col") / 8)})
    return P.reintegrate(P.burned_patches(px, ("year", "month", "doy", "tr", "tc")), 8)


# --- GFA


@query("SELECT region, n, lat, round(scale, 6) AS scale FROM (SELECT zone_name AS region, count(*) AS n, round(avg(cy), 6) AS lat, avg(pow(1-%r*pow(sin(radians(cy)),2),2)/(pow(cos(radians(cy)),2)*(1-%r))) AS scale FROM perim p JOIN zone z ON p.cx > z.minx AND p.cx < z.maxx AND p.cy > z.miny AND p.cy < z.maxy GROUP BY zone_name)" % (_E2, _E2))
def g_mercator_bias_audit(s, d):
    rows = J.points_in_boxes(X.perimeters(s, d).select("perim_id", "cx", "cy"), X.zones(s, d), "cx", "cy", 5.0, "inner")
    return rows.groupBy(F.col("zone_name").alias("region")).agg(F.count("*").alias("n"), F.round(F.avg("cy"), 6).alias("lat"), F.round(F.avg(geo.mercator_area_scale(F.col("cy"))), 6).alias("scale"))


_PIECE = _area("greatest(p.minx, z.minx)", "greatest(p.miny, z.miny)", "least(p.maxx, z.maxx)", "least(p.maxy, z.maxy)")
#: By the rules of the decomposition: within first, the others cut, one name added up, slivers dropped, the rest a row where it is large enough.
_ECO = f"""
+ ar AS MATERIALIZED (SELECT perim_id, {_area('minx', 'miny', 'maxx', 'maxy')}/1e4 AS area_ha FROM perim),
holder AS MATERIALIZED (SELECT perim_id, min(zone_id) AS zone_id FROM perim p JOIN zone z ON p.minx >= z.minx AND p.maxx <= z.maxx AND p.miny >= z.miny AND p.maxy <= z.maxy GROUP BY perim_id),
cut AS MATERIALIZED (
  SELECT h.perim_id, h.zone_id, p.minx, p.miny, p.maxx, p.maxy, area_ha AS ha FROM holder h JOIN perim p USING (perim_id) JOIN ar USING (perim_id)
  UNION ALL SELECT perim_id, z.zone_id, greatest(p.minx, z.minx), greatest(p.miny, z.miny), least(p.maxx, z.maxx), least(p.maxy, z.maxy), {_PIECE}/1e4
  FROM (SELECT * FROM perim WHERE perim_id NOT IN (SELECT perim_id FROM holder)) p JOIN zone z ON p.minx <= z.maxx AND z.minx <= p.maxx AND p.miny <= z.maxy AND z.miny <= p.maxy WHERE {_PIECE} > 0),
pc AS MATERIALIZED (SELECT perim_id, coalesce(zone_name, 'sin_region') AS eco, sum(ha) AS ha, any_value(area_ha) AS area_ha FROM cut JOIN zone USING (zone_id) JOIN ar USING (perim_id) GROUP BY 1, 2),
kept AS MATERIALIZED (SELECT perim_id, eco, ha, area_ha, FALSE AS residual FROM pc WHERE ha >= greatest(0.5, area_ha*0.001)),
pieces AS MATERIALIZED (SELECT * FROM kept
  UNION ALL SELECT perim_id, 'sin_region', area_ha, area_ha, TRUE FROM ar WHERE area_ha > 0 AND perim_id NOT IN (SELECT perim_id FROM pc)
  UNION ALL SELECT perim_id, 'sin_region', area_ha - used, area_ha, TRUE FROM (SELECT perim_id, area_ha, sum(CASE WHEN ha >= greatest(0.5, area_ha*0.001) THEN ha ELSE 0 END) AS used FROM pc GROUP BY perim_id, area_ha) WHERE area_ha - used >= greatest(0.5, area_ha*0.001)),
dom AS MATERIALIZED (SELECT perim_id, ar.area_ha, coalesce(arg_min(eco, (-round(ha, 6), eco)), 'sin_region') AS eco, count(ha) AS n_eco, coalesce(max(ha), 0) AS ha_dom, ar.area_ha - coalesce(sum(ha), 0) AS eco_resid_ha FROM ar LEFT JOIN kept USING (perim_id) GROUP BY perim_id, ar.area_ha)
"""
_POINT_ECO = "(SELECT perim_id, coalesce(arg_min(zone_name, zone_id), 'sin_region') AS eco_pt FROM perim p LEFT JOIN zone z ON p.cx > z.minx AND p.cx < z.maxx AND p.cy > z.miny AND p.cy < z.maxy GROUP BY perim_id)"


def _pieces(s: SparkSession, d: str) -> DataFrame:
    return P.decompose(X.perimeters(s, d), X.zones(s, d))


def _dominant(s: SparkSession, d: str) -> DataFrame:
    return P.dominant(X.perimeters(s, d), _pieces(s, d))


def _point_eco(s: SparkSession, d: str) -> DataFrame:
    points = X.perimeters(s, d).select("perim_id", F.col("cx").alias("longitude"), F.col("cy").alias("latitude"))
    return P.with_region(points, X.zones(s, d), "perim_id").withColumnRenamed("region", "eco_pt")


@query(f"{_ECO} SELECT perim_id, eco, n_eco, round(ha_dom, 2) AS ha_dom, round(eco_resid_ha, 2) + 0.0 AS eco_resid_ha FROM dom")
def r_eco_decompose(s, d):
    return _dominant(s, d).select("perim_id", "eco", "n_eco", F.round("ha_dom", 2).alias("ha_dom"), (F.round("eco_resid_ha", 2) + 0.0).alias("eco_resid_ha"))


@query(f"{_ECO} SELECT perim_id, eco, residual, round(ha, 2) AS ha FROM pieces")
def r_eco_long(s, d):
    return _pieces(s, d).select("perim_id", "eco", "residual", F.round("ha", 2).alias("ha"))


@query("SELECT perim_id, zone_id FROM perim p JOIN zone z ON p.minx <= z.maxx AND z.minx <= p.maxx AND p.miny <= z.maxy AND z.miny <= p.maxy WHERE perim_id NOT IN (SELECT q.perim_id FROM perim q JOIN zone y ON q.minx >= y.minx AND q.maxx <= y.maxx AND q.miny >= y.miny AND q.maxy <= y.maxy)")
def j_intersects_not_within(s, d):
    """Events with the zones they touch, of those events that lie within none."""
    met = J.boxes_intersect(X.perimeters(s, d), X.zones(s, d), "perim_id", "zone_id", 1.0)
    held = met.filter("a_minx >= b_minx and a_maxx <= b_maxx and a_miny >= b_miny and a_maxy <= b_maxy").select("perim_id")
    return met.join(held, "perim_id", "left_anti").select("perim_id", "zone_id")


@query(f"{_ECO} SELECT n_eco, count(*) AS events, round(sum(area_ha)/100, 4) AS km2, round(100.0*count(*)/sum(count(*)) OVER (), 6) AS pct_events, round(100.0*sum(area_ha)/sum(sum(area_ha)) OVER (), 6) AS pct_area FROM dom GROUP BY n_eco")
def g_eco_summary(s, d):
    by = _dominant(s, d).groupBy("n_eco").agg(F.count("*").alias("events"), F.sum("area_ha").alias("ha"))
    total = by.agg(F.sum("events").alias("all_events"), F.sum("ha").alias("all_ha"))  # one row
    share = lambda part, whole: F.round(F.col(part) * 100.0 / F.col(whole), 6)
    return by.join(F.broadcast(total)).select("n_eco", "events", F.round(F.col("ha") / 100, 4).alias("km2"), share("events", "all_events").alias("pct_events"), share("ha", "all_ha").alias("pct_area"))


@query(f"{_ECO} SELECT eco_pt AS point_eco, eco, count(*) AS n, round(sum(area_ha)/100, 4) AS km2 FROM dom JOIN {_POINT_ECO} USING (perim_id) WHERE eco_pt <> eco GROUP BY 1, 2 ORDER BY km2 DESC, point_eco, eco LIMIT 20")
def g_transfer_matrix_top20(s, d):
    rows = _dominant(s, d).join(_point_eco(s, d), "perim_id").filter("eco_pt <> eco")
    by = rows.groupBy(F.col("eco_pt").alias("point_eco"), "eco").agg(F.count("*").alias("n"), F.round(F.sum("area_ha") / 100, 4).alias("km2"))
    return by.orderBy(F.desc("km2"), "point_eco", "eco").limit(20)


_CUT = _area("greatest(minx, -80.0+c*(20.0/24))", "greatest(miny, 1.0-(r+1)*(21.0/24))", "least(maxx, -80.0+(c+1)*(20.0/24))", "least(maxy, 1.0-r*(21.0/24))")


_CLASS = f"""
, sums AS MATERIALIZED (SELECT perim_id, sum(CASE WHEN value = 12 THEN m2 ELSE 0 END)/1e6 AS a, sum(CASE WHEN value = 3 THEN m2 ELSE 0 END)/1e6 AS b
  FROM (SELECT perim_id, value, greatest({_CUT}, 0) AS m2 FROM (SELECT *, year(start_date)+8 AS year FROM perim) p JOIN cls USING (year) WHERE {_TOUCH}) GROUP BY perim_id),
whole AS MATERIALIZED (SELECT perim_id, area_ha, round(a, 6) AS cl12_km2, round(b, 6) AS cl3_km2, round(area_ha/100 - round(a, 6) - round(b, 6), 6) + 0.0 AS cl_x_km2 FROM ar LEFT JOIN sums USING (perim_id))
"""
#: What no kept piece of an event covers: the cells between the borders of the event and of its pieces.
_LONG = f"""{_ECO}{_CLASS},
held AS MATERIALIZED (SELECT cut.* FROM cut JOIN zone USING (zone_id) JOIN kept ON kept.perim_id = cut.perim_id AND kept.eco = coalesce(zone_name, 'sin_region')),
open AS (SELECT p.* FROM perim p JOIN pieces USING (perim_id) WHERE residual),
xs AS (SELECT perim_id, v, lead(v) OVER (PARTITION BY perim_id ORDER BY v) AS w FROM (SELECT perim_id, minx AS v FROM open UNION SELECT perim_id, maxx FROM open UNION SELECT h.perim_id, h.minx FROM held h SEMI JOIN open USING (perim_id) UNION SELECT h.perim_id, h.maxx FROM held h SEMI JOIN open USING (perim_id))),
yy AS (SELECT perim_id, v, lead(v) OVER (PARTITION BY perim_id ORDER BY v) AS w FROM (SELECT perim_id, miny AS v FROM open UNION SELECT perim_id, maxy FROM open UNION SELECT h.perim_id, h.miny FROM held h SEMI JOIN open USING (perim_id) UNION SELECT h.perim_id, h.maxy FROM held h SEMI JOIN open USING (perim_id))),
bare AS (SELECT xs.perim_id, xs.v AS minx, yy.v AS miny, xs.w AS maxx, yy.w AS maxy FROM xs JOIN yy USING (perim_id) WHERE xs.w IS NOT NULL AND yy.w IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM held h WHERE h.perim_id = xs.perim_id AND h.minx <= xs.v AND h.maxx >= xs.w AND h.miny <= yy.v AND h.maxy >= yy.w)),
part AS (SELECT perim_id, coalesce(zone_name, 'sin_region') AS eco, FALSE AS residual, minx, miny, maxx, maxy FROM held JOIN (SELECT zone_id, zone_name FROM zone) USING (zone_id) UNION ALL SELECT perim_id, 'sin_region', TRUE, minx, miny, maxx, maxy FROM bare),
psum AS MATERIALIZED (SELECT perim_id, eco, residual, sum(CASE WHEN value = 12 THEN m2 ELSE 0 END)/1e6 AS a, sum(CASE WHEN value = 3 THEN m2 ELSE 0 END)/1e6 AS b
  FROM (SELECT perim_id, eco, residual, value, greatest({_CUT}, 0) AS m2 FROM (SELECT part.*, year(start_date)+8 AS year FROM part JOIN (SELECT perim_id, start_date FROM perim) USING (perim_id)) p JOIN cls USING (year) WHERE {_TOUCH}) GROUP BY ALL),
layer AS MATERIALIZED (SELECT perim_id, eco, residual, eco = best AS is_dominant, round(ha, 2) AS area_ha_eco,
  CASE WHEN cl12_km2 IS NOT NULL THEN CASE WHEN single AND eco <> 'sin_region' THEN cl12_km2 ELSE round(coalesce(psum.a, 0), 6) END END AS cl12_eco_km2,
  CASE WHEN cl3_km2 IS NOT NULL THEN CASE WHEN single AND eco <> 'sin_region' THEN cl3_km2 ELSE round(coalesce(psum.b, 0), 6) END END AS cl3_eco_km2
  FROM (SELECT *, count(*) OVER (PARTITION BY perim_id) = 1 AS single FROM pieces) pieces JOIN whole USING (perim_id) JOIN (SELECT perim_id, eco AS best FROM dom) USING (perim_id) LEFT JOIN psum USING (perim_id, eco, residual))
"""


def _dated(s: SparkSession, d: str) -> DataFrame:
    return X.perimeters(s, d).withColumn("year", F.year("start_date") + 8)


def _layer(s: SparkSession, d: str) -> DataFrame:
    return P.long_layer(_dated(s, d), X.zones(s, d), X.land_cover(s), X.GRID)


@query(f"{_ECO}{_CLASS} SELECT perim_id, cl12_km2, cl3_km2, cl_x_km2 FROM whole")
def r_class_clip(s, d):
    return P.event_classes(_dated(s, d), X.land_cover(s), X.GRID).select("perim_id", "cl12_km2", "cl3_km2", "cl_x_km2")


@query(f"{_LONG} SELECT perim_id, eco, residual, is_dominant, area_ha_eco, cl12_eco_km2, cl3_eco_km2, round(area_ha_eco/100 - cl12_eco_km2 - cl3_eco_km2, 6) + 0.0 AS cl_x_eco_km2 FROM layer")
def r_eco_class_long(s, d):
    return _layer(s, d)


@query(f"{_LONG}, chk AS (SELECT perim_id, sum(cl12_eco_km2) AS sum12, sum(cl3_eco_km2) AS sum3 FROM layer GROUP BY perim_id) SELECT perim_id, round(sum12, 6) AS sum12, cl12_km2, abs(sum12-cl12_km2) <= greatest(1e-6, 0.005*cl12_km2) AS ok12, round(sum3, 6) AS sum3, cl3_km2, abs(sum3-cl3_km2) <= greatest(1e-6, 0.005*cl3_km2) AS ok3 FROM chk JOIN whole USING (perim_id)")
def g_balance_check(s, d):
    found = P.balance(_layer(s, d), P.event_classes(_dated(s, d), X.land_cover(s), X.GRID))
    return found.withColumns({c: F.round(c, 6) for c in ("sum12", "sum3")})


# --- audits, samples and exports


@query("SELECT det_id, acq_date FROM det ORDER BY md5(det_id || '|54'), det_id LIMIT 1000")
def a_fixed_sample(s, d):
    """1000 detections by the smallest digest of id and seed: the sample size is the feature."""
    return X.detections(s, d).orderBy(F.md5(F.concat(F.col("det_id").cast("string"), F.lit("|54"))), "det_id").limit(1000).select("det_id", "acq_date")


_AUDIT = "SELECT p.perim_id, zone_name, cy, pow(6378137.0, 2)*radians(p.maxx-p.minx)*(ln(tan(pi()/4+radians(p.maxy)/2))-ln(tan(pi()/4+radians(p.miny)/2))) AS m, %s AS g, pow(1-%r*pow(sin(radians(cy)),2),2)/(pow(cos(radians(cy)),2)*(1-%r)) AS k FROM perim p JOIN zone z ON p.cx > z.minx AND p.cx < z.maxx AND p.cy > z.miny AND p.cy < z.maxy" % (_area("p.minx", "p.miny", "p.maxx", "p.maxy"), _E2, _E2)


@query(f"SELECT zone_name AS region, grouping(zone_name) = 1 AS total, count(*) AS n, round(avg(cy), 6) AS lat, round(avg(m/g-1)*100, 6) AS bias_pct, round(avg(k-1)*100, 6) AS predicted_pct, round(avg(m/g-k)*100, 6) AS resid_pp, round(sum(m)/1e4, 2) AS mercator_ha, round(sum(g)/1e4, 2) AS geodesic_ha, round(sum(m-g)/1e6, 4) AS diff_km2 FROM ({_AUDIT}) GROUP BY GROUPING SETS ((zone_name), ())")
def g_area_audit(s, d):
    """By region and over all; a nameless region isn't the total."""
    a = _audit(s, d).withColumns({"bias": F.col("m") / F.col("g") - 1, "k": geo.mercator_area_scale(F.col("cy")) - 1})
    by = a.groupingSets([["zone_name"], []], "zone_name").agg(
        (F.grouping("zone_name") == 1).alias("total"),
        F.count("*").alias("n"),
        F.round(F.avg("cy"), 6).alias("lat"),
        F.round(F.avg("bias") * 100, 6).alias("bias_pct"),
        F.round(F.avg("k") * 100, 6).alias("predicted_pct"),
        F.round(F.avg(F.col("bias") - F.col("k")) * 100, 6).alias("resid_pp"),
        F.round(F.sum("m") / 1e4, 2).alias("mercator_ha"),
        F.round(F.sum("g") / 1e4, 2).alias("geodesic_ha"),
        F.round(F.sum(F.col("m") - F.col("g")) / 1e6, 4).alias("diff_km2"),
    )
    return by.withColumnRenamed("zone_name", "region")


def _audit(s: SparkSession, d: str) -> DataFrame:
    """Perimeters by the zone of their centre with Mercator (m) and ellipsoidal (g) areas in square metres."""
    p = X.perimeters(s, d).withColumns(
        {"m": (geo.mercator_x(F.col("maxx")) - geo.mercator_x(F.col("minx"))) * (geo.mercator_y(F.col("maxy")) - geo.mercator_y(F.col("miny"))), "g": geo.box_area_m2(F.col("minx"), F.col("miny"), F.col("maxx"), F.col("maxy"))}
    )
    return J.points_in_boxes(p.select("perim_id", "cx", "cy", "m", "g"), X.zones(s, d), "cx", "cy", 5.0, "inner")


@query("SELECT round(corr(m/g-1, pow(1-%r*pow(sin(radians(cy)),2),2)/(pow(cos(radians(cy)),2)*(1-%r))-1), 6) AS r, round(median(abs(m/g/(pow(1-%r*pow(sin(radians(cy)),2),2)/(pow(cos(radians(cy)),2)*(1-%r)))-1)), 6) AS median_deviation, CASE WHEN median(abs(m/g-1)) < 0.001 THEN 'geodesic' ELSE 'mercator' END AS stored_as FROM (SELECT cy, pow(6378137.0, 2)*radians(p.maxx-p.minx)*(ln(tan(pi()/4+radians(p.maxy)/2))-ln(tan(pi()/4+radians(p.miny)/2))) AS m, %s AS g FROM perim p JOIN zone z ON p.cx > z.minx AND p.cx < z.maxx AND p.cy > z.miny AND p.cy < z.maxy)" % (_E2, _E2, _E2, _E2, _area("p.minx", "p.miny", "p.maxx", "p.maxy")))
def g_bias_correlation(s, d):
    a = _audit(s, d)
    k, ratio = geo.mercator_area_scale(F.col("cy")), F.col("m") / F.col("g")
    return a.agg(F.round(F.corr(ratio - 1, k - 1), 6).alias("r"), F.round(F.median(F.abs(ratio / k - 1)), 6).alias("median_deviation"), F.when(F.median(F.abs(ratio - 1)) < 0.001, "geodesic").otherwise("mercator").alias("stored_as"))


@query(f"{_ECO} SELECT year(start_date)::INT AS year, count(*) AS n, count(*) FILTER (n_eco > 1) AS several, round(100.0*count(*) FILTER (n_eco > 1)/count(*), 6) AS pct_several, round(100.0*coalesce(sum(area_ha) FILTER (n_eco > 1), 0)/sum(area_ha), 6) AS pct_area_several, round(coalesce(sum(area_ha - ha_dom) FILTER (n_eco > 1), 0), 1) AS not_dominant_ha, count(*) FILTER (eco <> eco_pt) AS relabelled, round(100.0*coalesce(sum(area_ha) FILTER (eco <> eco_pt), 0)/sum(area_ha), 6) AS pct_area_relabelled, round(sum(eco_resid_ha), 1) AS resid_ha, count(*) FILTER (eco_resid_ha < -0.01) AS negative FROM dom JOIN {_POINT_ECO} USING (perim_id) JOIN (SELECT perim_id, start_date FROM perim) USING (perim_id) GROUP BY 1")
def g_yearly_report(s, d):
    rows = _dominant(s, d).join(_point_eco(s, d), "perim_id").join(X.perimeters(s, d).select("perim_id", "start_date"), "perim_id")
    several, other = F.col("n_eco") > 1, F.col("eco") != F.col("eco_pt")
    area = lambda cond, v="area_ha": F.sum(F.when(cond, F.col(v)).otherwise(0.0))
    rows = rows.withColumn("not_dominant", F.col("area_ha") - F.col("ha_dom"))
    return rows.groupBy(F.year("start_date").alias("year")).agg(
        F.count("*").alias("n"),
        F.count_if(several).alias("several"),
        F.round(F.count_if(several) * 100.0 / F.count("*"), 6).alias("pct_several"),
        F.round(area(several) * 100.0 / F.sum("area_ha"), 6).alias("pct_area_several"),
        F.round(area(several, "not_dominant"), 1).alias("not_dominant_ha"),
        F.count_if(other).alias("relabelled"),
        F.round(area(other) * 100.0 / F.sum("area_ha"), 6).alias("pct_area_relabelled"),
        F.round(F.sum("eco_resid_ha"), 1).alias("resid_ha"),
        F.count_if(F.col("eco_resid_ha") < -0.01).alias("negative"),
    )


@query(f"{_LONG} SELECT eco, count(*) AS n, round(sum(area_ha_eco)/100, 4) AS km2, round(100.0*sum(area_ha_eco)/sum(sum(area_ha_eco)) OVER (), 6) AS pct, round(sum(cl12_eco_km2), 4) AS cl12_km2, round(sum(cl3_eco_km2), 4) AS cl3_km2 FROM layer GROUP BY eco")
def g_area_per_eco(s, d):
    by = _layer(s, d).groupBy("eco").agg(F.count("*").alias("n"), F.sum("area_ha_eco").alias("ha"), F.sum("cl12_eco_km2").alias("c12"), F.sum("cl3_eco_km2").alias("c3"))
    total = by.agg(F.sum("ha").alias("all"))  # one row
    out = by.join(F.broadcast(total))
    return out.select("eco", "n", F.round(F.col("ha") / 100, 4).alias("km2"), F.round(F.col("ha") * 100.0 / F.col("all"), 6).alias("pct"), F.round("c12", 4).alias("cl12_km2"), F.round("c3", 4).alias("cl3_km2"))


@query(f"""
+ v AS (SELECT zone_id, value, r*24+c AS seq FROM zone JOIN cls ON {_TOUCH} WHERE year = 2004 AND value IS NOT NULL),
n AS (SELECT zone_id, value, count(*) AS n, min(seq) AS seen FROM v GROUP BY ALL),
a AS (SELECT zone_id, arg_min(value, (-n, value)) AS smallest, arg_min(value, (-n, seen)) AS first FROM n GROUP BY zone_id),
b AS (SELECT zone_id, arg_min(value, (-n, CASE value WHEN 12 THEN 1 ELSE 2 END)) AS listed FROM n WHERE value IN (12, 3) GROUP BY zone_id)
SELECT zone_id, smallest, first, coalesce(listed, 0) AS listed FROM a LEFT JOIN b USING (zone_id)
""")
def g_mode_rules(s, d):
    px = R.pixels_of_boxes(X.zones(s, d), ["zone_id"], X.GRID, "all_touched").join(X.land_cover(s).filter("year = 2004 and value is not null"), ["row", "col"]).withColumn("seq", F.col("row") * 24 + F.col("col"))
    a = R.mode_by_rule(px, ["zone_id"], "value").withColumnRenamed("mode", "smallest")
    b = R.mode_by_rule(px, ["zone_id"], "value", "first", seq="seq").withColumnRenamed("mode", "first")
    return a.join(b, "zone_id").join(R.mode_by_rule(px, ["zone_id"], "value", "listed", [12, 3]).withColumnRenamed("mode", "listed"), "zone_id")


@query("SELECT tr::INT AS tr, tc::INT AS tc, count(*) FILTER (elev > 2000) AS high, count(*) FILTER (elev > 2000) = 0 AS is_empty, max(CASE WHEN elev > 2000 THEN elev ELSE -9999.0 END) AS top FROM (SELECT r // 6 AS tr, c // 6 AS tc, elev FROM dem) GROUP BY ALL")
def s_dem_threshold(s, d):
    t = X.elevation(s).select(F.floor(F.col("row") / 6).cast("int").alias("tr"), F.floor(F.col("col") / 6).cast("int").alias("tc"), "value")
    high = F.count_if(F.col("value") > 2000)
    return t.groupBy("tr", "tc").agg(high.alias("high"), (high == 0).alias("is_empty"), F.max(F.when(F.col("value") > 2000, F.col("value")).otherwise(-9999.0)).alias("top"))


@query("SELECT zone_id, greatest(1, round((maxx-minx)/(500/111320.0)))::BIGINT AS width, greatest(1, round((maxy-miny)/(500/111320.0)))::BIGINT AS height FROM zone WHERE maxx-minx >= 0.01 AND maxy-miny >= 0.01")
def s_pixel_dimensions(s, d):
    step = 500 / geo.METRES_PER_DEGREE
    side = lambda a, b: F.greatest(F.lit(1), F.round((F.col(b) - F.col(a)) / step)).cast("long")
    return X.zones(s, d).filter("maxx - minx >= 0.01 and maxy - miny >= 0.01").select("zone_id", side("minx", "maxx").alias("width"), side("miny", "maxy").alias("height"))


@query("SELECT r AS row, c AS col, " + ", ".join(f"max(CASE WHEN year = {y} THEN (value = 12)::INT ELSE 0 END)::INT AS y{y}" for y in range(2003, 2010)) + " FROM cls WHERE value IS NOT NULL AND -80.0+c*(20.0/24) >= -73 AND -80.0+c*(20.0/24) < -68 AND 1.0-r*(21.0/24) <= -8 GROUP BY r, c")
def k_aoi_class_stack(s, d):
    g = X.GRID
    aoi = (g.left(F.col("col")) >= -73) & (g.left(F.col("col")) < -68) & (g.top(F.col("row")) <= -8)
    is12 = F.when(F.col("value") == 12, 1).otherwise(0)
    cut = X.land_cover(s).filter(F.col("value").isNotNull() & aoi).withColumn("is12", is12)
    return cut.groupBy("row", "col").pivot("year", list(range(2003, 2010))).agg(F.max("is12")).na.fill(0).withColumnsRenamed({str(y): f"y{y}" for y in range(2003, 2010)})


@query("SELECT year, count(DISTINCT doy) AS days, count(DISTINCT r*24+c) AS cells, min(doy)::INT AS first_doy, max(doy)::INT AS last_doy FROM px GROUP BY year")
def g_distinct_days(s, d):
    px = X.burned_pixels(s, d)
    return px.groupBy("year").agg(F.countDistinct("doy").alias("days"), F.countDistinct("row", "col").alias("cells"), F.min("doy").alias("first_doy"), F.max("doy").alias("last_doy"))


# the other modules register theirs
from emberline.plans import catalog_queries, polygon_queries, product_queries  # noqa: E402, F401
