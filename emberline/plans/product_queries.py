"""The three products from their inputs to their output rows, as registered queries with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberline.functions import geo, scalar
from emberline.operators import raster as R
from emberline.operators import spatial_join as J
from emberline.plans import fixtures as X
from emberline.plans import products as P
from emberline.plans import queries as Q
from emberline.plans.registry import box_area_sql, query

#: A fine elevation model of 0.005 degrees; its cells are read where pixels are asked for.
FINE = R.Grid(west=-80.0, north=1.0, width=0.005, height=0.005, rows=4200, cols=4000)
_FINE = "((row*97+col*61+(row%53)*(col%47)*13)%4001)::DOUBLE"

# --- thermal detections

_SQUARE = """sq AS MATERIALIZED (SELECT det_id, degrees((6378137.0*radians(longitude)-500)/6378137.0) AS minx, degrees((6378137.0*radians(longitude)+500)/6378137.0) AS maxx,
  degrees(2*atan(exp((6378137.0*ln(tan(pi()/4+radians(latitude)/2))-500)/6378137.0))-pi()/2) AS miny, degrees(2*atan(exp((6378137.0*ln(tan(pi()/4+radians(latitude)/2))+500)/6378137.0))-pi()/2) AS maxy FROM own)"""


@query(
    f"""{Q._CLUSTER},
own AS MATERIALIZED (SELECT s.*, clu.cluster, 2003 + dayofyear(acq_date) % 8 AS year FROM sel s JOIN clu USING (det_id) WHERE EXISTS (SELECT 1 FROM zone WHERE zone_id % 3 <> 1 AND {Q._IN})),
eco AS (SELECT det_id, coalesce(arg_min(zone_name, zone_id), 'sin_region') AS eco FROM (SELECT det_id, zone_id, zone_name FROM own LEFT JOIN (SELECT * FROM zone) z ON {Q._IN}) GROUP BY det_id),
{_SQUARE},
px AS (SELECT det_id, row, col FROM (SELECT det_id, minx, miny, maxx, maxy, unnest(range(floor((1.0-maxy)/0.005)::BIGINT, floor((1.0-miny)/0.005)::BIGINT+1)) AS row, floor((minx+80.0)/0.005)::BIGINT AS c0, floor((maxx+80.0)/0.005)::BIGINT AS c1 FROM sq), range(0, 4) g(k), LATERAL (SELECT c0 + k AS col) WHERE col <= c1
  AND -80.0+(col+0.5)*0.005 > minx AND -80.0+(col+0.5)*0.005 < maxx AND 1.0-(row+0.5)*0.005 > miny AND 1.0-(row+0.5)*0.005 < maxy AND row BETWEEN 0 AND 4199 AND col BETWEEN 0 AND 3999),
dm AS (SELECT det_id, median({_FINE}) AS dem_median FROM px GROUP BY det_id),
cc AS (SELECT det_id, sum(CASE WHEN value = 12 THEN m2 ELSE 0 END)/1e6 AS a, sum(CASE WHEN value = 3 THEN m2 ELSE 0 END)/1e6 AS b FROM (SELECT det_id, value, (20.0/24*111320.0*cos(radians(1.0-(r+0.5)*(21.0/24))))*(21.0/24*111320.0) AS m2 FROM sq JOIN (SELECT det_id, year FROM own) USING (det_id) JOIN cls USING (year) WHERE {Q._TOUCH}) GROUP BY det_id),
best AS (SELECT cluster, min(det_id) AS x, arg_min(det_id, (acq_date, det_id)) AS det_id FROM own GROUP BY cluster)
SELECT round(latitude, 6) AS latitude, round(longitude, 6) AS longitude, acq_date, satellite, confidence, type, eco AS "ECO_NAME", dem_median, year::INT AS year, round(a, 6) AS cl12, round(b, 6) AS cl3, cluster, det_id FROM best JOIN own USING (cluster, det_id) JOIN eco USING (det_id) LEFT JOIN dm USING (det_id) LEFT JOIN cc USING (det_id)""".replace("px AS (SELECT det_id, row", "fine AS (SELECT det_id, row").replace("FROM px GROUP BY det_id", "FROM fine GROUP BY det_id"),
    recursive=True,
)
def product_at(s, d):
    """Thermal detections: filter, country, ecoregion, square, elevation by centres, classes by touch, and the first event of each cluster.

    Clusters are found among all detections that pass the thematic filter; a
    country is several zones together, so a detection is kept once.
    """
    sel = P.select_detections(X.detections(s, d))
    of = P.clusters(sel)
    country = X.zones(s, d).filter("zone_id % 3 <> 1").select("zone_id", *P.BOX)
    own = J.points_in_boxes(sel, country, cell=5.0, how="left_semi").withColumn("year", 2003 + F.dayofyear("acq_date") % 8)
    square = own.select("det_id", "year", *[c.alias(n) for n, c in geo.square_buffer(F.col("longitude"), F.col("latitude")).items()])
    fine = R.pixels_of_boxes(square, ["det_id"], FINE, "center")
    height = fine.select("row", "col").distinct().withColumn("value", ((F.col("row") * 97 + F.col("col") * 61 + (F.col("row") % 53) * (F.col("col") % 47) * 13) % 4001).cast("double"))
    dem = R.zonal(fine, height, ["det_id"], F.median("value").alias("dem_median"))
    g = X.GRID
    m2 = geo.degree_pixel_area_m2(F.lit(g.width), F.lit(g.height), g.top(F.col("row") + 0.5))
    met = R.pixels_of_boxes(square, ["det_id", "year"], g, "all_touched").join(X.land_cover(s), ["year", "row", "col"])
    of_class = lambda k: (F.sum(F.when(F.col("value") == k, m2).otherwise(0.0)) / 1e6).alias(f"cl{k}")
    cover = met.groupBy("det_id").agg(of_class(12), of_class(3))
    eco = P.with_region(own, X.zones(s, d)).withColumnRenamed("region", "ECO_NAME")
    first = P.first_events(own, of).select("cluster", *own.columns)
    out = first.join(eco, "det_id").join(dem, "det_id", "left").join(cover, "det_id", "left")
    names = ["latitude", "longitude", "acq_date", "satellite", "confidence", "type", "ECO_NAME", "dem_median", "year", "cl12", "cl3", "cluster", "det_id"]
    return out.withColumns({c: F.round(c, 6) for c in ("latitude", "longitude", "cl12", "cl3")}).select(*names)


# --- burned patches

_REGION = "CASE zone_id % 3 WHEN 0 THEN 'Costa' WHEN 1 THEN 'Sierra' ELSE 'Selva' END"
_MERC = "(pow(6378137.0, 2)*radians(20.0/24)*(ln(tan(pi()/4+radians(1.0-r*(21.0/24))/2))-ln(tan(pi()/4+radians(1.0-(r+1)*(21.0/24))/2))))"


@query(
    f"""{Q._PATCH},
big AS MATERIALIZED (SELECT patch, year, month, min(doy)::INT AS "BurnDate", min(r*24+c) AS p FROM patch GROUP BY patch, year, month HAVING count(*) >= 2),
pt AS (SELECT *, -80.0+(p%24+0.5)*(20.0/24) AS longitude, 1.0-(p//24+0.5)*(21.0/24) AS latitude FROM big),
loc AS MATERIALIZED (SELECT patch, min(zone_id) AS zone_id FROM pt JOIN zone ON {Q._IN} WHERE zone_name IS NOT NULL GROUP BY patch),
st AS MATERIALIZED (SELECT patch, median(nullif(elev, 0)) AS dem_median, round(sum({_MERC})/1e4, 2) AS area_ha, sum(CASE WHEN value IS NULL AND NOT seen THEN NULL WHEN value = 12 THEN g ELSE 0 END) AS a, sum(CASE WHEN value IS NULL AND NOT seen THEN NULL WHEN value = 3 THEN g ELSE 0 END) AS b
  FROM (SELECT patch.*, elev, value, k.r IS NOT NULL AS seen, {box_area_sql('0.0', '1.0-(patch.r+1)*(21.0/24)', '20.0/24', '1.0-patch.r*(21.0/24)')} AS g FROM patch LEFT JOIN dem ON dem.r = patch.r AND dem.c = patch.c LEFT JOIN cls k ON k.year = patch.year AND k.r = patch.r AND k.c = patch.c) GROUP BY patch)
SELECT printf('BA_%d_M%02d_%d', year, month, row_number() OVER (PARTITION BY year, month ORDER BY patch)) AS event_uid, year::INT AS year, month::INT AS month, "BurnDate", dem_median, {_REGION} AS region_geo, CASE WHEN zone_id % 3 = 1 THEN round(a, 2) END AS cl12_m2, CASE WHEN zone_id % 3 = 2 THEN round(b, 2) END AS cl3_m2, zone_id AS gaul0_code, zone_name AS gaul0_name, area_ha
FROM big JOIN loc USING (patch) JOIN (SELECT zone_id, zone_name FROM zone) USING (zone_id) JOIN st USING (patch) WHERE zone_id % 3 > 0""",
    recursive=True,
)
def product_ba(s, d):
    """Burned patches: components of one day, country and region of a point on the patch, Mercator area, and one class in each region.

    Patches of two cells or more; the point is the centre of the first cell.
    Patches outside every named zone, and those of the third region, are dropped.
    """
    g = X.GRID
    cells = P.burned_patches(X.burned_pixels(s, d))
    at = F.min(F.struct("row", "col"))
    big = cells.groupBy("patch", "year", "month").agg(F.min("doy").alias("BurnDate"), at.alias("p"), F.count("*").alias("n")).filter("n >= 2")
    points = big.select("patch", g.left(F.col("p.col") + 0.5).alias("longitude"), g.top(F.col("p.row") + 0.5).alias("latitude"))
    zones = X.zones(s, d).filter("zone_name is not null")
    place = J.points_in_boxes(points, zones, cell=5.0, how="inner").groupBy("patch").agg(F.min_by(F.struct("zone_id", "zone_name"), "zone_id").alias("z"))
    k = F.col("z.zone_id") % 3
    place = place.select("patch", F.col("z.zone_id").alias("gaul0_code"), F.col("z.zone_name").alias("gaul0_name"), F.when(k == 0, "Costa").when(k == 1, "Sierra").otherwise("Selva").alias("region_geo")).filter("region_geo in ('Sierra', 'Selva')")
    cover = X.land_cover(s).withColumn("seen", F.lit(True))
    dem = X.elevation(s).select("row", "col", F.when(F.col("value") != 0, F.col("value")).alias("elev"))
    merc = (geo.mercator_x(F.lit(g.width)) - geo.mercator_x(F.lit(0.0))) * (geo.mercator_y(g.top(F.col("row"))) - geo.mercator_y(g.top(F.col("row") + 1)))
    rows = cells.join(big.select("patch"), "patch").join(dem, ["row", "col"], "left").join(cover, ["year", "row", "col"], "left")
    area = lambda c: F.sum(F.when(F.col("seen"), F.when(F.col("value") == c, g.cell_area_m2(F.col("row"))).otherwise(0.0)))
    stats = rows.groupBy("patch").agg(F.median("elev").alias("dem_median"), F.round(F.sum(merc) / 1e4, 2).alias("area_ha"), area(12).alias("a"), area(3).alias("b"))
    from pyspark.sql import Window

    found = big.join(place, "patch").join(stats, "patch")
    number = F.row_number().over(Window.partitionBy("year", "month").orderBy("patch"))
    return found.select(
        scalar.event_key("BA", ("_%d", F.col("year")), ("_M%02d", F.col("month")), ("_%d", number)).alias("event_uid"),
        "year",
        "month",
        "BurnDate",
        "dem_median",
        "region_geo",
        F.when(F.col("region_geo") == "Sierra", F.round("a", 2)).alias("cl12_m2"),
        F.when(F.col("region_geo") == "Selva", F.round("b", 2)).alias("cl3_m2"),
        "gaul0_code",
        "gaul0_name",
        "area_ha",
    )


# --- perimeters


@query(f"""{Q._ECO}{Q._CLASS},
land AS MATERIALIZED (SELECT perim_id, min(zone_id) AS gaul0_code FROM perim p JOIN zone z ON p.cx > z.minx AND p.cx < z.maxx AND p.cy > z.miny AND p.cy < z.maxy WHERE zone_id % 2 = 0 GROUP BY perim_id),
dm AS (SELECT perim_id, round(median(elev), 1) AS dem_median FROM perim JOIN dem ON {Q._TOUCH} WHERE elev <> 0 GROUP BY perim_id)
SELECT printf('GFA_%d_%06d', year(start_date) + 8, perim_id) AS event_uid, (year(start_date) + 8)::INT AS year, month(start_date)::INT AS month, start_date, dem_median, eco AS "ECO_NAME", eco_pt AS "ECO_NAME_pt", n_eco, round(ha_dom, 2) AS ha_dom, round(eco_resid_ha, 2) + 0.0 AS eco_resid_ha, cl12_km2, cl3_km2, cl_x_km2, gaul0_code, zone_name AS gaul0_name, round(dom.area_ha, 2) AS area_ha, round(cx, 6) AS cx
FROM perim JOIN land USING (perim_id) JOIN (SELECT zone_id AS gaul0_code, zone_name FROM zone) USING (gaul0_code) JOIN dom USING (perim_id) JOIN whole USING (perim_id) JOIN {Q._POINT_ECO} USING (perim_id) LEFT JOIN dm USING (perim_id) WHERE year(start_date) + 8 BETWEEN 2001 AND 2024""")
def product_gfa(s, d):
    """Perimeters: years of the product, country by centre, elevation by touch, ecoregions by area and by point, classes and their rest.

    The country filter comes before everything that is cut, as it needs centres only.
    """
    dated = X.perimeters(s, d).withColumn("year", F.year("start_date") + 8).filter(F.col("year").between(scalar.FIRST_YEAR, scalar.LAST_YEAR))
    zones = X.zones(s, d)
    held = J.points_in_boxes(dated.select("perim_id", "cx", "cy"), zones.filter("zone_id % 2 = 0"), "cx", "cy", 5.0, "inner")
    land = held.groupBy("perim_id").agg(F.min_by(F.struct("zone_id", "zone_name"), "zone_id").alias("z")).select("perim_id", F.col("z.zone_id").alias("gaul0_code"), F.col("z.zone_name").alias("gaul0_name"))
    events = dated.join(land, "perim_id")
    px = R.pixels_of_boxes(events, ["perim_id"], X.GRID, "all_touched")
    dem = R.zonal(px, X.elevation(s), ["perim_id"], F.round(F.median("value"), 1).alias("dem_median"), nodata=0.0)
    eco = P.dominant(events, P.decompose(events, zones)).withColumnRenamed("eco", "ECO_NAME")
    point = P.with_region(events.select("perim_id", F.col("cx").alias("longitude"), F.col("cy").alias("latitude")), zones, "perim_id").withColumnRenamed("region", "ECO_NAME_pt")
    classes = P.event_classes(events, X.land_cover(s), X.GRID).drop("area_ha")
    out = events.join(dem, "perim_id", "left").join(eco, "perim_id").join(point, "perim_id").join(classes, "perim_id")
    return out.select(
        scalar.event_key("GFA", ("_%d", F.col("year")), ("_%06d", F.col("perim_id"))).alias("event_uid"),
        "year",
        F.month("start_date").alias("month"),
        "start_date",
        "dem_median",
        "ECO_NAME",
        "ECO_NAME_pt",
        "n_eco",
        F.round("ha_dom", 2).alias("ha_dom"),
        (F.round("eco_resid_ha", 2) + 0.0).alias("eco_resid_ha"),
        "cl12_km2",
        "cl3_km2",
        "cl_x_km2",
        "gaul0_code",
        "gaul0_name",
        F.round("area_ha", 2).alias("area_ha"),
        F.round("cx", 6).alias("cx"),
    )
