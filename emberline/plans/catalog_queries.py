"""Registered queries over scans, sinks, catalogs, scalar rules and raster exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions import geo, scalar
from emberline.operators import polygons as G
from emberline.operators import raster as R
from emberline.operators import spatial_join as J
from emberline.operators.components import connected_components
from emberline.plans import fixtures as X
from emberline.plans import products as P
from emberline.plans.registry import box_area_sql, query
from emberline.plans.scratch import scratch_path
from emberline.sources import tables as S

# --- scans and sinks


@query("SELECT det_id, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude, CASE WHEN det_id % 10 = 0 THEN NULL ELSE acq_date END AS acq_date, satellite, confidence, type FROM det")
def s_csv_scan(s, d):
    """Detections written as CSV with a byte-order mark and scanned with a schema; a date that isn't one is null."""
    path = scratch_path(s, "detections-csv")
    det = X.detections(s, d)
    day = F.when(F.col("det_id") % 10 == 0, F.lit("2024-13-45")).otherwise(F.date_format("acq_date", "yyyy-MM-dd"))
    S.write_csv(det.select(F.round("latitude", 6).alias("latitude"), F.round("longitude", 6).alias("longitude"), day.alias("acq_date"), F.lit("1200").alias("acq_time"), "satellite", "confidence", "type", "det_id", F.lit("x").alias("geometry")), path)
    return S.read_detections(s, path, S.DETECTION_SCHEMA + ", det_id long").drop("acq_time")


@query("SELECT count(*) AS files_without_mark, 'det_id,acq_date' AS header FROM det WHERE FALSE")
def k_csv_mark(s, d):
    """Every part file of a CSV starts with the byte-order mark and the header."""
    path = scratch_path(s, "marked-csv")
    S.write_csv(X.detections(s, d).select("det_id", "acq_date"), path)
    files = s.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(path)
    head = F.substring(F.decode(F.substring("content", 1, 64), "UTF-8"), 1, 16)
    return files.agg(F.count_if(~F.startswith(head, F.lit(S.BOM))).alias("files_without_mark"), F.max(F.replace(head, F.lit(S.BOM), F.lit(""))).alias("header"))


@query("SELECT year(start_date)::INT AS year, count(*) AS n, min(perim_id) AS first FROM perim GROUP BY 1")
def k_layer_append(s, d):
    """A layer written in two parts, the first over what was there and the second appended, in folders by year."""
    path = scratch_path(s, "events")
    p = X.perimeters(s, d).select("perim_id", F.year("start_date").alias("year"), "cx", "cy")
    S.write_layer(p.limit(10), path, ("year",))
    S.write_layer(p.filter("year > 1997"), path, ("year",))
    S.write_layer(p.filter("year <= 1997"), path, ("year",), append=True)
    return s.read.parquet(path).groupBy("year").agg(F.count("*").alias("n"), F.min("perim_id").alias("first"))


@query("SELECT printf('ba_%d_%02d', year, month) AS band_name, count(*) AS cells, max(doy)::INT AS last_doy FROM px WHERE year = 2005 GROUP BY 1")
def k_raster_bands(s, d):
    """A raster written with the names of its bands and read again."""
    path = scratch_path(s, "raster")
    R.write_raster(X.burned_pixels(s, d).filter("year = 2005"), path, F.format_string("ba_%d_%02d", "year", "month"))
    return s.read.parquet(path).groupBy("band_name").agg(F.count("*").alias("cells"), F.max("doy").alias("last_doy"))


@query("SELECT r AS row, c AS col, elev AS value FROM dem WHERE r BETWEEN 8 AND 14 AND c BETWEEN 8 AND 12")
def s_window_read(s, d):
    """The window of a stored raster that a box touches; rows and columns are ranges in the scan."""
    path = scratch_path(s, "dem")
    X.elevation(s).write.parquet(path)
    return R.read_window(s.read.parquet(path), X.GRID, -73.0, -12.0, -69.5, -6.5)


@query("SELECT tr::INT AS tr, tc::INT AS tc, -80.0+tc*8*(20.0/24) AS minx, 1.0-(tr+1)*8*(21.0/24) AS miny, -80.0+(tc+1)*8*(20.0/24) AS maxx, 1.0-tr*8*(21.0/24) AS maxy, 20.0/24 AS width, 21.0/24 AS height, bands, cells, nodata FROM (SELECT r // 8 AS tr, c // 8 AS tc, count(DISTINCT year) AS bands, count(*) AS cells, count(*) FILTER (value IS NULL) AS nodata FROM cls GROUP BY ALL)".replace("-80.0+tc*8", "-80.0+(tc*8)").replace("(tr+1)*8", "((tr+1)*8)").replace("(tc+1)*8", "((tc+1)*8)").replace("tr*8*", "(tr*8)*"))
def s_tile_meta(s, d):
    """Bounds, resolution, bands and missing cells of each tile."""
    return _meta(s)


def _meta(s: SparkSession) -> DataFrame:
    return R.tile_meta(X.land_cover(s), X.GRID, 8, ["year"], F.col("value").isNull())


@query("SELECT 8 AS tiles, TRUE AS first_built, FALSE AS second_built, round(sum(maxx-minx), 6) AS width FROM (SELECT DISTINCT r // 8 AS tr, c // 8 AS tc, -80.0+(c//8)*8*(20.0/24) AS minx, -80.0+(c//8+1)*8*(20.0/24) AS maxx FROM cls)")
def s_footprint_index(s, d):
    """The index of footprints is built once and reused."""
    path = scratch_path(s, "footprints")
    _, first = S.build_if_absent(s, path, lambda: _meta(s))
    index, second = S.build_if_absent(s, path, lambda: _meta(s))
    return index.agg(F.count("*").cast("int").alias("tiles"), F.lit(first).alias("first_built"), F.lit(second).alias("second_built"), F.round(F.sum(F.col("maxx") - F.col("minx")), 6).alias("width"))


@query("SELECT perim_id, tr::INT AS tr, tc::INT AS tc FROM perim p JOIN (SELECT DISTINCT r // 8 AS tr, c // 8 AS tc FROM cls) ON p.minx <= -80.0+((tc+1)*8)*(20.0/24) AND -80.0+(tc*8)*(20.0/24) <= p.maxx AND p.miny <= 1.0-(tr*8)*(21.0/24) AND 1.0-((tr+1)*8)*(21.0/24) <= p.maxy")
def j_tile_pruning(s, d):
    """The tiles that each event has to read, by bounds alone."""
    meta = _meta(s).withColumn("tile", F.struct("tr", "tc"))
    met = J.boxes_intersect(X.perimeters(s, d), meta, "perim_id", "tile", 5.0)
    return met.select("perim_id", "tile.tr", "tile.tc")


@query("SELECT count(*) FILTER (elev > 0) AS good, count(*) FILTER (elev <= 0) AS rejected, TRUE AS built, FALSE AS again FROM dem")
def s_build_if_absent(s, d):
    """A mosaic is built once; its bad tiles go to a table of their own."""
    path = scratch_path(s, "mosaic")
    _, built = S.build_if_absent(s, path, lambda: X.elevation(s), F.col("value") > 0)
    table, again = S.build_if_absent(s, path, lambda: X.elevation(s), F.col("value") > 0)
    bad = s.read.parquet(f"{path}_rejected").agg(F.count("*").alias("rejected"))
    return table.agg(F.count("*").alias("good")).join(F.broadcast(bad)).select("good", "rejected", F.lit(built).alias("built"), F.lit(again).alias("again"))


@query("SELECT r AS row, c AS col, arg_min(doy, month)::INT AS value FROM px WHERE year = 2007 AND r BETWEEN 8 AND 14 AND c BETWEEN 8 AND 12 GROUP BY r, c")
def s_clip_mosaic(s, d):
    """Tiles clipped to a box, then one mosaic of the first tile with a value."""
    tiles = X.burned_pixels(s, d).filter("year = 2007").select("row", "col", "month", F.col("doy").alias("value"))
    return R.mosaic_first(R.read_window(tiles, X.GRID, -73.0, -12.0, -69.5, -6.5), ["month"])


_NAMES = "CASE perim_id % 4 WHEN 0 THEN 'GFA_v20250411_perimeters_' || (1998 + perim_id % 31) || '.shp' WHEN 1 THEN 'x_Lat-' || (perim_id % 9 + 1) || 'to-' || (perim_id % 9) || '_Lon-7' || (perim_id % 9) || '.5to-70_T' || perim_id || '.tif' WHEN 2 THEN 'burn_2300_' || (1890 + perim_id % 200) || '_v1.tif' ELSE 'noyear.tif' END"


@query(f"""
+ f AS (SELECT perim_id, {_NAMES} AS n FROM perim),
g AS (SELECT *, regexp_extract(n, '(?i)perimeters[_-](\\d{{4}})', 1) AS a, list_filter(list_transform(regexp_extract_all(n, '(\\d{{4}})'), lambda y: y::INT), lambda y: y BETWEEN 1900 AND 2100) AS ys, list_filter(list_transform(regexp_extract_all(n, '(\\d{{4}})'), lambda y: y::INT), lambda y: y BETWEEN 2001 AND 2024) AS zs FROM f)
SELECT perim_id, CASE WHEN a <> '' THEN a::INT ELSE ys[len(ys)] END AS file_year, zs[1] AS data_year, CASE WHEN n LIKE '%\\_T%' ESCAPE '\\' THEN regexp_extract(n, '_T(\\d+)', 1)::INT END AS tile,
  CASE WHEN perim_id % 4 = 1 THEN -(perim_id % 9 + 1)::DOUBLE END AS south, CASE WHEN perim_id % 4 = 1 THEN -(perim_id % 9)::DOUBLE + 0.0 END AS north, CASE WHEN perim_id % 4 = 1 THEN -70.5 - (perim_id % 9) END AS west, CASE WHEN perim_id % 4 = 1 THEN -70.0 END AS east FROM g
""")
def s_file_names(s, d):
    """What names of files tell: the year of a partition, a year with data, a tile's number, and bounds."""
    k = F.col("perim_id")
    text = lambda c: c.cast("string")
    name = (
        F.when(k % 4 == 0, F.concat(F.lit("GFA_v20250411_perimeters_"), text(1998 + k % 31), F.lit(".shp")))
        .when(k % 4 == 1, F.concat(F.lit("x_Lat-"), text(k % 9 + 1), F.lit("to-"), text(k % 9), F.lit("_Lon-7"), text(k % 9), F.lit(".5to-70_T"), text(k), F.lit(".tif")))
        .when(k % 4 == 2, F.concat(F.lit("burn_2300_"), text(1890 + k % 200), F.lit("_v1.tif")))
        .otherwise("noyear.tif")
    )
    at = X.perimeters(s, d).select("perim_id", name.alias("n"))
    b = S.bounds_file(F.col("n"))
    return at.select("perim_id", scalar.partition_year(F.col("n")).alias("file_year"), scalar.year_in(F.col("n")).alias("data_year"), scalar.tile_number(F.col("n")).alias("tile"), *[(c + 0.0).alias(x) for x, c in b.items()])


# --- scalar rules


@query("SELECT det_id, zone_id FROM det LEFT JOIN zone ON longitude > minx AND longitude < maxx AND latitude > miny AND latitude < maxy WHERE zone_name = 'NATION_7'")
def p_country_after_join(s, d):
    """Equality after a left join: Catalyst makes an inner join of it."""
    return J.points_in_boxes(X.detections(s, d), X.zones(s, d), cell=5.0, how="left").filter(F.col("zone_name") == "NATION_7").select("det_id", "zone_id")


@query("SELECT zone_id, CASE WHEN name = 'Bolivia (Plurinational State of)' THEN 'Bolivia' ELSE name END AS country, name IS DISTINCT FROM 'Brazil' AS kept FROM (SELECT zone_id, CASE zone_id % 3 WHEN 0 THEN 'Bolivia (Plurinational State of)' WHEN 1 THEN 'Brazil' ELSE zone_name END AS name FROM zone)")
def p_country_rewrite(s, d):
    k = F.col("zone_id") % 3
    name = F.when(k == 0, "Bolivia (Plurinational State of)").when(k == 1, "Brazil").otherwise(F.col("zone_name"))
    return X.zones(s, d).select("zone_id", scalar.short_country(name).alias("country"), scalar.not_country(name).alias("kept"))


@query("SELECT det_id, elev > 2000 AS above, coalesce(elev >= 2000, FALSE) AS masked FROM (SELECT det_id, CAST(floor((longitude+80.0)/(20.0/24)) AS INT) AS c, CAST(floor((1.0-latitude)/(21.0/24)) AS INT) AS r FROM det) LEFT JOIN (SELECT r, c, nullif(elev, 0) AS elev FROM dem) USING (r, c) WHERE elev IS NULL OR elev >= 2000")
def p_altitude_filters(s, d):
    """Strictly above the limit on rows (null stays null), from the limit on in a mask (null is false)."""
    dem = X.elevation(s).withColumn("value", F.when(F.col("value") != 0, F.col("value")))
    at = R.warp_nearest(X.detections(s, d), dem, X.GRID, F.col("longitude"), F.col("latitude"))
    got = at.select("det_id", (F.col("value") > 2000).alias("above"), F.coalesce(F.col("value") >= 2000, F.lit(False)).alias("masked"))
    return got.filter(F.col("above").isNull() | F.col("masked"))


@query("SELECT zone_id, round(pct, 6) AS pct, round(pct/100*ha, 4) AS class_ha, round(pct/100*ha/nullif(ha, 0), 8) AS fraction FROM (SELECT zone_id, 100.0*count(*) FILTER (value = 12)/nullif(count(value), 0) AS pct FROM zone LEFT JOIN (SELECT * FROM cls WHERE year = 2005) k ON c >= floor((minx+80.0)/(20.0/24)) AND c <= floor((maxx+80.0)/(20.0/24)) AND r >= floor((1.0-maxy)/(21.0/24)) AND r <= floor((1.0-miny)/(21.0/24)) GROUP BY zone_id) JOIN (SELECT zone_id, CASE WHEN zone_id = 5 THEN 0.0 ELSE " + box_area_sql("minx", "miny", "maxx", "maxy") + "/1e4 END AS ha FROM zone) USING (zone_id)")
def p_percent_and_fraction(s, d):
    """Percent to area and area to fraction; no fraction without area or without cover."""
    z = X.zones(s, d).withColumn("ha", F.when(F.col("zone_id") == 5, 0.0).otherwise(geo.box_area_m2(*[F.col(c) for c in P.BOX]) / 1e4))
    px = R.pixels_of_boxes(z, ["zone_id"], X.GRID, "all_touched").join(X.land_cover(s).filter("year = 2005"), ["row", "col"])
    pct = px.groupBy("zone_id").agg((F.count_if(F.col("value") == 12) * 100.0 / F.nullif(F.count("value"), F.lit(0))).alias("pct"))
    area = scalar.share_to_area(F.col("pct"), F.col("ha"))
    return z.join(pct, "zone_id", "left").select("zone_id", F.round("pct", 6).alias("pct"), F.round(area, 4).alias("class_ha"), F.round(scalar.fraction(area / 100, F.col("ha")), 8).alias("fraction"))


@query("SELECT zone_id, round(a, 3) AS km2 FROM (SELECT zone_id, sum(CASE WHEN value = 3 AND r % 5 = 0 THEN 1.5 WHEN r IS NOT NULL THEN 0 END) AS a FROM zone LEFT JOIN (SELECT * FROM cls WHERE year = 2004) k ON (-80.0+(c+0.5)*(20.0/24)) > minx AND (-80.0+(c+0.5)*(20.0/24)) < maxx AND (1.0-(r+0.5)*(21.0/24)) > miny AND (1.0-(r+0.5)*(21.0/24)) < maxy GROUP BY zone_id) WHERE a IS NULL OR a <> 0")
def p_zero_area(s, d):
    """Zones without the class go, zones without cover stay."""
    px = R.pixels_of_boxes(X.zones(s, d), ["zone_id"], X.GRID, "center")
    got = R.class_area(px, X.land_cover(s).filter("year = 2004").withColumn("value", F.when(F.col("row") % 5 == 0, F.col("value"))), ["zone_id"], 3, F.lit(1.5))
    return got.filter(scalar.has_area(F.col("area"))).select("zone_id", F.round("area", 3).alias("km2"))


@query("SELECT count(*) FILTER (y BETWEEN 2001 AND 2024) AS kept, count(*) FILTER (y < 2001) AS before, count(*) FILTER (y > 2024) AS after, count(*) FILTER (y IS NULL) AS undated FROM (SELECT CASE WHEN perim_id % 11 <> 0 THEN year(start_date) + perim_id % 30 END AS y FROM perim)")
def p_year_range(s, d):
    """Events of the years of the product, and how many others are dropped for what reason."""
    y = X.perimeters(s, d).select(F.when(F.col("perim_id") % 11 != 0, F.year("start_date") + F.col("perim_id") % 30).alias("y"))
    y0, y1 = scalar.FIRST_YEAR, scalar.LAST_YEAR
    return y.agg(F.count_if(F.col("y").between(y0, y1)).alias("kept"), F.count_if(F.col("y") < y0).alias("before"), F.count_if(F.col("y") > y1).alias("after"), F.count_if(F.col("y").isNull()).alias("undated"))


@query("SELECT perim_id, round_even((perim_id * 5) / 10.0, 0)::DOUBLE AS half_even, round((perim_id * 5) / 10.0, 0)::DOUBLE AS half_up, round_even(perim_id / 8.0, 2)::DOUBLE AS cents FROM perim WHERE perim_id % 2 = 1")
def p_rounding(s, d):
    """Ties to the even digit, as in the older outputs, and away from 0."""
    k = F.col("perim_id").cast("decimal(20,4)")
    p = X.perimeters(s, d).filter("perim_id % 2 = 1")
    return p.select("perim_id", F.bround(k * 5 / 10, 0).cast("double").alias("half_even"), F.round(k * 5 / 10, 0).cast("double").alias("half_up"), F.bround(k / 8, 2).cast("double").alias("cents"))


@query("SELECT perim_id AS event_uid, year(start_date)::INT AS year, 'native' AS year_gfa, round(cx, 6) AS cx FROM perim")
def p_reserved_columns(s, d):
    """Native columns whose names are taken get a suffix; the standard columns come first."""
    native = X.perimeters(s, d).select(F.round("cx", 6).alias("cx"), F.lit("native").alias("year"), F.col("perim_id").alias("id"), F.col("start_date").alias("day"))
    out = S.rename_reserved(native, ["year", "event_uid"]).withColumns({"year": F.year("day"), "event_uid": F.col("id")}).drop("id", "day")
    return S.order_columns(out, ["event_uid", "year", "month"])


@query("SELECT i::INT AS i, CASE WHEN i >= 20 THEN 'vf' ELSE 'test_e' || lpad(((i * 5))::VARCHAR, 2, '0') || 'pct' END AS tag FROM range(1, 25) t(i)", ctes=False)
def p_run_tag(s, d):
    """The suffix of a run's files, by the share of events it takes in steps of 5 %."""
    return s.createDataFrame([(i, scalar.run_tag(round(i * 5 + 1e-6, 6) / 100)) for i in range(1, 25)], "i int, tag string")


@query("SELECT det_id, floor(longitude)::INT AS x, floor(latitude)::INT AS y, floor(longitude) <> longitude AND floor(latitude) <> latitude AS in_strict FROM (SELECT det_id, round(longitude, 2) AS longitude, round(latitude, 2) AS latitude FROM det)")
def j_tile_assignment(s, d):
    """The tile of a detection; by the strict rule one on a border has none."""
    det = X.detections(s, d).withColumns({c: scalar.round_scaled(F.col(c), 2) for c in ("longitude", "latitude")})
    at, strict = scalar.tile_of(F.col("longitude"), F.col("latitude")), scalar.tile_of(F.col("longitude"), F.col("latitude"), strict=True)
    return det.select("det_id", at["x"].alias("x"), at["y"].alias("y"), strict.isNotNull().alias("in_strict"))


@query("SELECT det_id, longitude-0.5 AS minx, latitude-0.5 AS miny, longitude+0.5 AS maxx, latitude+0.5 AS maxy FROM det")
def r_degree_buffer(s, d):
    b = geo.degree_buffer(F.col("longitude"), F.col("latitude"))
    return X.detections(s, d).select("det_id", *[c.alias(n) for n, c in b.items()])


_OFF = "(SELECT (i // 11 - 5) * 0.0011 AS dx, (i % 11 - 5) * 0.0011 AS dy FROM range(121) t(i))"
_M = "6378137.0*ln(tan(pi()/4+radians({})/2))"


@query(f"SELECT det_id, count(*) FILTER (sqrt(pow(6378137.0*radians(longitude+dx)-6378137.0*radians(longitude), 2) + pow({_M.format('(latitude+dy)')}-{_M.format('latitude')}, 2)) <= 500) AS inside FROM det, {_OFF} GROUP BY det_id")
def r_circular_buffer(s, d):
    """Of 121 points around a detection, those within 500 m of Mercator."""
    off = F.explode(F.array(*[F.struct(F.lit((i // 11 - 5) * 0.0011).alias("dx"), F.lit((i % 11 - 5) * 0.0011).alias("dy")) for i in range(121)]))
    at = X.detections(s, d).select("det_id", "longitude", "latitude", off.alias("o"))
    hit = geo.in_disc(F.col("longitude"), F.col("latitude"), F.col("longitude") + F.col("o.dx"), F.col("latitude") + F.col("o.dy"))
    return at.groupBy("det_id").agg(F.count_if(hit).alias("inside"))


# --- burned area: exports


@query("SELECT year, month, count(*) AS cells, count(*) FILTER (value = 12) AS cells12 FROM px JOIN (SELECT DISTINCT year, month FROM px WHERE r BETWEEN 8 AND 14 AND c BETWEEN 8 AND 12 AND doy % 3 = 0) USING (year, month) LEFT JOIN cls USING (year, r, c) GROUP BY year, month")
def j_event_months(s, d):
    """The months that have events in the area, with the rasters of their years."""
    px = X.burned_pixels(s, d)
    months = R.read_window(px, X.GRID, -73.0, -12.0, -69.5, -6.5).filter("doy % 3 = 0").select("year", "month").distinct()
    found = px.join(months, ["year", "month"]).join(X.land_cover(s), ["year", "row", "col"], "left")
    return found.groupBy("year", "month").agg(F.count("*").alias("cells"), F.count_if(F.col("value") == 12).alias("cells12"))


_AOI = "r BETWEEN 8 AND 14 AND c BETWEEN 8 AND 12"


@query(f"SELECT 'dem' AS layer, '' AS band, r AS row, c AS col, elev AS value FROM dem WHERE {_AOI} UNION ALL SELECT 'class', 'y' || year, r, c, value::DOUBLE FROM cls WHERE {_AOI} AND value IN (3, 12) UNION ALL SELECT 'burned', printf('ba_%d_%02d', year, month), r, c, doy::DOUBLE FROM px WHERE {_AOI} AND (year, month) IN (SELECT (year, month) FROM px WHERE {_AOI} AND doy % 3 = 0)")
def k_aoi_export(s, d):
    """What goes to the maps of an area: elevation, class rasters, and burned months that have events."""
    window = lambda raster: R.read_window(raster, X.GRID, -73.0, -12.0, -69.5, -6.5)
    row = lambda df, layer, band, value: df.select(F.lit(layer).alias("layer"), band.alias("band"), "row", "col", F.col(value).cast("double").alias("value"))
    burned = window(X.burned_pixels(s, d))
    months = burned.filter("doy % 3 = 0").select("year", "month").distinct()
    parts = [
        row(window(X.elevation(s)), "dem", F.lit(""), "value"),
        row(window(X.land_cover(s)).filter("value in (3, 12)"), "class", F.concat(F.lit("y"), F.col("year").cast("string")), "value"),
        row(burned.join(months, ["year", "month"], "left_semi"), "burned", F.format_string("ba_%d_%02d", "year", "month"), "doy"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _trace(key: str):
    """For applyInArrow: rings around a group's cells, of which the number and the plane area in cells is told."""

    def run(table):
        import numpy as np
        import pyarrow as pa

        rings = G.outline(table.column("row").to_numpy(), table.column("col").to_numpy(), X.GRID)
        area = sum(G.shoelace(r) for r in rings)  # holes turn the other way
        closed = all((r[0] == r[-1]).all() for r in rings)
        points = pa.array([[[{"x": float(x), "y": float(y)} for x, y in r] for r in rings]], pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))
        return pa.table({key: table.column(key).slice(0, 1), "n_pix": pa.array([table.num_rows]), "cells": pa.array([float(np.round(abs(area) / (X.GRID.width * X.GRID.height), 6))]), "closed": pa.array([closed]), "rings": points})

    return run


RING_TYPE = "array<array<struct<x:double,y:double>>>"


def vectorise(cells: DataFrame, key: str) -> DataFrame:
    """(key, n_pix, cells, closed, rings): rings around the cells of each group, and the area they enclose in cells."""
    return cells.select(key, "row", "col").groupBy(key).applyInArrow(_trace(key), f"`{key}` long, n_pix long, cells double, closed boolean, rings {RING_TYPE}")


_PATCHES = """
+ k AS MATERIALIZED (SELECT *, (year*100+month)::BIGINT*10000000000 + r::BIGINT*100000 + c AS pixel FROM px),
link AS MATERIALIZED (SELECT a.pixel AS a, b.pixel AS b FROM k a JOIN k b ON a.year = b.year AND a.month = b.month AND a.doy = b.doy AND abs(a.r-b.r) <= 1 AND abs(a.c-b.c) <= 1 AND a.pixel <> b.pixel),
reach AS (SELECT pixel AS a, pixel AS b FROM k UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b),
patch AS MATERIALIZED (SELECT k.*, m.patch FROM k JOIN (SELECT a AS pixel, min(b) AS patch FROM reach GROUP BY a) m USING (pixel))
"""


@query(f"{_PATCHES} SELECT patch, count(*) AS n_pix, count(*)::DOUBLE AS cells, TRUE AS closed FROM patch GROUP BY patch HAVING count(*) >= 3", recursive=True)
def r_vectorise_patches(s, d):
    """Rings around every patch of three cells or more; the area they enclose is that of the cells."""
    patches = P.burned_patches(X.burned_pixels(s, d))
    large = patches.groupBy("patch").agg(F.count("*").alias("n")).filter("n >= 3").select("patch")
    return vectorise(patches.join(large, "patch"), "patch").drop("rings")


@query(f"{_PATCHES} SELECT patch, min(r) = 0 OR max(r) = 23 OR min(c) = 0 OR max(c) = 23 AS touches_border FROM patch GROUP BY patch", recursive=True)
def r_touches_border(s, d):
    return R.touches_border(P.burned_patches(X.burned_pixels(s, d)), ["patch"], X.GRID.rows, X.GRID.cols)


_TWELVE = """
+ k AS MATERIALIZED (SELECT year, r, c, year::BIGINT*1000000 + r*1000 + c AS pixel FROM cls WHERE value = 12 AND r BETWEEN 4 AND 19 AND c BETWEEN 4 AND 19),
link AS MATERIALIZED (SELECT a.pixel AS a, b.pixel AS b FROM k a JOIN k b ON a.year = b.year AND abs(a.r-b.r) + abs(a.c-b.c) = 1),
reach AS (SELECT pixel AS a, pixel AS b FROM k UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b)
"""


@query(f"{_TWELVE} SELECT year, shape, count(*) AS n_pix, count(*)::DOUBLE AS cells, TRUE AS closed FROM (SELECT a AS pixel, min(b) AS shape FROM reach GROUP BY a) JOIN k USING (pixel) GROUP BY year, shape", recursive=True)
def k_class_vectorisation(s, d):
    """Class 12 within an area as polygons of each year; cells that share a side are one."""
    cut = X.land_cover(s).filter("value = 12 and row between 4 and 19 and col between 4 and 19").withColumn("pixel", F.col("year").cast("long") * 1_000_000 + F.col("row") * 1000 + F.col("col"))
    side = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 1), (1, 0))]))
    here = cut.withColumn("s", side).select("year", F.col("pixel").alias("a"), (F.col("row") + F.col("s.i")).alias("row"), (F.col("col") + F.col("s.j")).alias("col"))
    pairs = here.join(cut.select("year", "row", "col", F.col("pixel").alias("b")), ["year", "row", "col"]).select("a", "b")
    named = cut.join(connected_components(pairs, "a", "b").withColumnRenamed("node", "pixel"), "pixel", "left").withColumn("shape", F.coalesce("component", "pixel"))
    return vectorise(named, "shape").drop("rings").withColumn("year", F.floor(F.col("shape") / 1_000_000).cast("int"))
