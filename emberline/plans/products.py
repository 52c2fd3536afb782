"""The three products: thermal detections (AT), burned patches (BA), perimeters (GFA).

The latest rules are the defaults; older ones are parameters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions.geo import box_area_m2
from emberline.functions.scalar import NO_REGION, residual, thematic
from emberline.operators import raster as R
from emberline.operators.components import connected_components
from emberline.operators.spatial_join import boxes_intersect, first_match, nearest_box, points_in_boxes, radius_time_pairs
from emberline.plans.scratch import materialize

# fixed values
SLIVER_HA, SLIVER_SHARE = 0.5, 0.001
MIN_PIX = 5
BALANCE_MIN, BALANCE_SHARE = 1e-6, 0.005

# --- AT ------------------------------------------------------------------------


def select_detections(det: DataFrame) -> DataFrame:
    """The thematic filter; conditions on plain columns reach the scan."""
    return det.filter(thematic(F.col("confidence"), F.col("type"), F.col("latitude"), F.col("longitude")))


def with_region(points: DataFrame, zones: DataFrame, key: str = "det_id", missing: str | None = NO_REGION) -> DataFrame:
    """(key, region): the first zone by id that holds the point in its interior, else `missing`."""
    joined = points_in_boxes(points.select(key, "longitude", "latitude"), zones, cell=5.0)
    got = first_match(joined, [key], F.col("zone_name"), F.col("zone_id"))
    return got.select(key, (F.coalesce("value", F.lit(missing)) if missing is not None else F.col("value")).alias("region"))


def clusters(points: DataFrame, key: str = "det_id", day: str = "acq_date", radius_km: float = 1.0, days: int = 15) -> DataFrame:
    """(key, cluster): single-linkage clusters in space and time, named by their smallest key."""
    found = connected_components(radius_time_pairs(points, key, day, radius_km, days), "a", "b")
    return points.select(key).join(found.withColumnRenamed("node", key), key, "left").select(key, F.coalesce("component", key).alias("cluster"))


def first_events(points: DataFrame, of: DataFrame, key: str = "det_id", day: str = "acq_date") -> DataFrame:
    """The whole row of each cluster's earliest detection, ties by key, with the cluster's size."""
    rows = points.join(of, key)
    whole = F.struct(*[F.col(c) for c in points.columns])
    best = rows.groupBy("cluster").agg(F.min_by(whole, F.struct(day, key)).alias("e"), F.count("*").alias("n"))
    return best.select("cluster", "n", "e.*")


def first_non_null(rows: DataFrame, group: str, order: list[str], columns: list[str]) -> DataFrame:
    """The older rule: for each column its first non-null value, which may mix rows."""
    return rows.groupBy(group).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(c) for c in columns])


# --- BA ------------------------------------------------------------------------


def burned_patches(pixels: DataFrame, same: tuple[str, ...] = ("year", "month", "doy")) -> DataFrame:
    """pixels with `patch`, the smallest pixel key of its 8-connected patch of equal `same`."""
    keyed = pixels.withColumn("pixel", (((F.col("year") * 100 + F.col("month")).cast("long") * 100_000 + F.col("row")) * 100_000 + F.col("col")))
    found = connected_components(R.neighbour_pairs(keyed, list(same), "pixel"), "a", "b")
    return keyed.join(found.withColumnRenamed("node", "pixel"), "pixel", "left").withColumn("patch", F.coalesce("component", "pixel")).drop("component")


def patch_stats(patches: DataFrame, dem: DataFrame, nodata: float | None = None) -> DataFrame:
    """One row for each patch: place in time, pixels, median day and elevation (median and mean)."""
    clean = dem.withColumnRenamed("value", "elev")
    clean = clean if nodata is None else clean.withColumn("elev", F.when(F.col("elev") != nodata, F.col("elev")))
    rows = patches.join(clean, ["row", "col"], "left")
    return rows.groupBy("patch", "year", "month").agg(
        F.count("*").alias("n_pix"), F.median("doy").alias("burn_day"), F.median("elev").alias("dem_median"), F.avg("elev").alias("dem_mean"), F.min("row").alias("min_row"), F.max("row").alias("max_row"), F.min("col").alias("min_col"), F.max("col").alias("max_col")
    )


def reintegrate(patches: DataFrame, tile: int) -> DataFrame:
    """(patch, fire): patches of one year whose pixels touch across a tile seam become one fire; others stay themselves.

    `patch` holds row, col, year; tiles are squares of `tile` cells.
    """
    edge = (F.col("row") % tile == 0) | (F.col("row") % tile == tile - 1) | (F.col("col") % tile == 0) | (F.col("col") % tile == tile - 1)
    rim = patches.filter(edge).withColumn("t", F.floor(F.col("row") / tile) * 1_000_000 + F.floor(F.col("col") / tile))
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in R.FORWARD]))
    here = rim.withColumn("s", steps).select("year", F.col("patch").alias("a"), F.col("t").alias("ta"), (F.col("row") + F.col("s.i")).alias("row"), (F.col("col") + F.col("s.j")).alias("col"))
    there = rim.select("year", "row", "col", F.col("patch").alias("b"), F.col("t").alias("tb"))
    seams = here.join(there, ["year", "row", "col"]).filter("ta <> tb and a <> b").select("a", "b").distinct()
    found = connected_components(seams, "a", "b").withColumnRenamed("node", "patch")
    return patches.select("patch").distinct().join(found, "patch", "left").select("patch", F.coalesce("component", "patch").alias("fire"))


def country_cascade(boxes: DataFrame, zones: DataFrame, key: str) -> DataFrame:
    """(key, country, attempt): by intersection, else by the centre inside, else the nearest.

    Each attempt sees only what the one before left without a name.
    """
    named = zones.filter("zone_name is not null")
    met = boxes_intersect(boxes, zones.withColumnRenamed("zone_id", "_z"), key, "_z", cell=5.0).join(zones.select(F.col("zone_id").alias("_z"), "zone_name"), "_z")
    one = met.groupBy(key).agg(F.min_by("zone_name", F.when(F.col("zone_name").isNotNull(), F.col("_z"))).alias("country")).filter("country is not null").withColumn("attempt", F.lit(1))
    rest = boxes.join(one, key, "left_anti").select(key, ((F.col("minx") + F.col("maxx")) / 2).alias("longitude"), ((F.col("miny") + F.col("maxy")) / 2).alias("latitude"))
    two = points_in_boxes(rest, named, cell=5.0, how="inner").groupBy(key).agg(F.min_by("zone_name", "zone_id").alias("country")).withColumn("attempt", F.lit(2))
    rest = rest.join(two, key, "left_anti")
    three = nearest_box(rest, named, [key], F.col("zone_name"), F.col("zone_id")).select(key, F.col("value").alias("country"), F.lit(3).alias("attempt"))
    return one.unionByName(two).unionByName(three)


# --- GFA -----------------------------------------------------------------------


BOX = ("minx", "miny", "maxx", "maxy")


def event_area(events: DataFrame, key: str = "perim_id") -> DataFrame:
    """(key, area_ha) of box events."""
    return events.select(key, (box_area_m2(*[F.col(c) for c in BOX]) / 1e4).alias("area_ha"))


def zone_pieces(events: DataFrame, zones: DataFrame, key: str = "perim_id", cell: float = 1.0) -> DataFrame:
    """(key, zone_id, eco, fast, minx..maxy, ha): what events and zones have in common, with an area.

    An event that lies within a zone (borders may touch) is the piece of the
    first such zone by id and of no other (`fast`); only the others are cut.
    """
    met = boxes_intersect(events, zones, key, "zone_id", cell)
    inside = (F.col("a_minx") >= F.col("b_minx")) & (F.col("a_maxx") <= F.col("b_maxx")) & (F.col("a_miny") >= F.col("b_miny")) & (F.col("a_maxy") <= F.col("b_maxy"))
    met = met.withColumn("holder", F.min(F.when(inside, F.col("zone_id"))).over(Window.partitionBy(key)))
    met = met.filter(F.col("holder").isNull() | (F.col("holder") == F.col("zone_id")))
    cut = {"minx": F.greatest("a_minx", "b_minx"), "miny": F.greatest("a_miny", "b_miny"), "maxx": F.least("a_maxx", "b_maxx"), "maxy": F.least("a_maxy", "b_maxy")}
    out = met.select(key, "zone_id", F.col("holder").isNotNull().alias("fast"), *[c.alias(n) for n, c in cut.items()])
    names = zones.select("zone_id", F.coalesce("zone_name", F.lit(NO_REGION)).alias("eco"))
    return out.withColumn("ha", box_area_m2(*[F.col(c) for c in BOX]) / 1e4).filter("ha > 0").join(names, "zone_id")


def decompose(events: DataFrame, zones: DataFrame, key: str = "perim_id", cell: float = 1.0, cut: DataFrame | None = None) -> DataFrame:
    """(key, eco, ha, area_ha, residual): the rows of the long layer.

    Pieces of one name are added up; those below the limit, the larger of 0.5 ha
    and 0.1 % of the event, are dropped.  An event that no zone shares an area
    with is one residual row, whatever its size; another event has one where what
    its pieces leave reaches the limit.  So an event below the limit within a
    zone has no row, and overlapping zones give no row of negative area.  `cut` is
    zone_pieces() of the same events where the caller has it.
    """
    area = event_area(events, key)
    by_name = (zone_pieces(events, zones, key, cell) if cut is None else cut).groupBy(key, "eco").agg(F.sum("ha").alias("ha")).join(area, key)
    limit = F.greatest(F.lit(SLIVER_HA), F.col("area_ha") * SLIVER_SHARE)
    kept = by_name.filter(F.col("ha") >= limit).select(key, "eco", "ha", "area_ha", F.lit(False).alias("residual"))
    used = by_name.groupBy(key).agg(F.coalesce(F.sum(F.when(F.col("ha") >= limit, F.col("ha"))), F.lit(0.0)).alias("used"))
    rest = area.join(used, key, "left").withColumn("ha", F.col("area_ha") - F.coalesce("used", F.lit(0.0)))
    rest = rest.filter(F.when(F.col("used").isNull(), F.col("area_ha") > 0).otherwise(F.col("ha") >= limit))
    return kept.unionByName(rest.select(key, F.lit(NO_REGION).alias("eco"), "ha", "area_ha", F.lit(True).alias("residual")))


def dominant(events: DataFrame, pieces: DataFrame, key: str = "perim_id") -> DataFrame:
    """(key, area_ha, eco, n_eco, ha_dom, eco_resid_ha) of every event.

    eco is the largest piece, ties to the earlier name, `sin_region` and 0
    without pieces.  The residual keeps its sign: negative where zones overlap.
    """
    own = pieces.filter("not residual").groupBy(key).agg(
        F.min_by(F.struct("eco", "ha"), F.struct((-F.round("ha", 6)).alias("o"), "eco")).alias("d"), F.count("*").alias("n"), F.sum("ha").alias("used")
    )
    out = event_area(events, key).join(own, key, "left")
    return out.select(
        key, "area_ha", F.coalesce("d.eco", F.lit(NO_REGION)).alias("eco"), F.coalesce("n", F.lit(0)).cast("long").alias("n_eco"), F.coalesce("d.ha", F.lit(0.0)).alias("ha_dom"), (F.col("area_ha") - F.coalesce("used", F.lit(0.0))).alias("eco_resid_ha")
    )


def uncovered(events: DataFrame, boxes: DataFrame, key: str = "perim_id") -> DataFrame:
    """(key, minx..maxy): what the boxes of the same key leave of an event, as disjoint boxes.

    The borders of an event and of its boxes cut it into cells, of which those
    that no box covers are left.  Events without boxes are left whole.
    """
    own = events.select(key, *BOX)
    cut = boxes.select(key, *[F.col(c).alias(f"b_{c}") for c in BOX])
    lists = cut.groupBy(key).agg(F.collect_list(F.struct(*[f"b_{c}" for c in BOX])).alias("held"))  # a box for each zone of an event
    both = own.join(lists, key, "left").withColumn("held", F.coalesce("held", F.array().cast("array<struct<b_minx:double,b_miny:double,b_maxx:double,b_maxy:double>>")))

    def borders(low: str, high: str) -> Column:
        inner = F.flatten(F.transform("held", lambda b: F.array(b[f"b_{low}"], b[f"b_{high}"])))
        all_ = F.array_sort(F.array_distinct(F.concat(F.array(low, high), F.filter(inner, lambda v: (v > F.col(low)) & (v < F.col(high))))))
        return F.zip_with(F.slice(all_, 1, F.size(all_) - 1), F.slice(all_, 2, F.size(all_) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    cells = both.withColumns({"x": borders("minx", "maxx"), "y": borders("miny", "maxy")}).withColumn("x", F.explode("x")).withColumn("y", F.explode("y"))
    held = F.exists("held", lambda b: (b["b_minx"] <= F.col("x.a")) & (b["b_maxx"] >= F.col("x.b")) & (b["b_miny"] <= F.col("y.a")) & (b["b_maxy"] >= F.col("y.b")))
    return cells.filter(~held).select(key, F.col("x.a").alias("minx"), F.col("y.a").alias("miny"), F.col("x.b").alias("maxx"), F.col("y.b").alias("maxy"))


def event_classes(events: DataFrame, cover: DataFrame, grid: R.Grid, key: str = "perim_id") -> DataFrame:
    """(key, area_ha, cl12_km2, cl3_km2, cl_x_km2) of events: classes rounded to 6 places, the rest from the unrounded area."""
    sums = class_clip(events, cover, grid, (12, 3), key).select(key, *[F.round(f"cl{k}_km2", 6).alias(f"cl{k}_km2") for k in (12, 3)])
    rest = residual(F.col("area_ha") / 100, F.col("cl12_km2"), F.col("cl3_km2"))
    return event_area(events, key).join(sums, key).withColumn("cl_x_km2", F.round(rest, 6) + 0.0)


def long_layer(events: DataFrame, zones: DataFrame, cover: DataFrame, grid: R.Grid, key: str = "perim_id") -> DataFrame:
    """(key, eco, is_dominant, area_ha_eco, cl12_eco_km2, cl3_eco_km2, cl_x_eco_km2): a row for each piece of an event.

    The classes of an event's only piece, unless it is a residual or nameless,
    are those of the event; of others, those of the pixels cut to the piece.
    Null where the event's class is.  The rest is taken from the area already
    rounded to 2 places.  events hold key, year and the box.
    """
    parts_of = materialize(zone_pieces(events, zones, key), "zone-pieces")
    pieces = materialize(decompose(events, zones, key, cut=parts_of), "pieces")
    whole = event_classes(events, cover, grid, key).select(key, "cl12_km2", "cl3_km2")
    count = Window.partitionBy(key)
    rows = pieces.withColumn("only", (F.count("*").over(count) == 1) & (F.col("eco") != NO_REGION))
    cut = parts_of.join(pieces.filter("not residual").select(key, "eco"), [key, "eco"]).select(key, "eco", *BOX)
    left = uncovered(events.join(pieces.filter("residual").select(key), key, "left_semi"), cut, key).withColumn("residual", F.lit(True))
    parts = cut.withColumn("residual", F.lit(False)).unionByName(left.withColumn("eco", F.lit(NO_REGION)))
    parts = parts.join(events.select(key, "year"), key).withColumn("part", F.struct(key, "eco", "residual", *BOX))
    sums = class_clip(parts, cover, grid, (12, 3), "part").groupBy(F.col(f"part.{key}").alias(key), "part.eco", "part.residual").agg(F.sum("cl12_km2").alias("p12"), F.sum("cl3_km2").alias("p3"))
    best = dominant(events, pieces, key).select(key, F.col("eco").alias("best"))
    out = rows.join(sums, [key, "eco", "residual"], "left").join(whole, key).join(best, key)
    own = {k: F.when(F.col(f"cl{k}_km2").isNotNull(), F.when(F.col("only"), F.col(f"cl{k}_km2")).otherwise(F.round(F.coalesce(f"p{k}", F.lit(0.0)), 6))) for k in (12, 3)}
    out = out.select(key, "eco", "residual", (F.col("eco") == F.col("best")).alias("is_dominant"), F.round("ha", 2).alias("area_ha_eco"), *[c.alias(f"cl{k}_eco_km2") for k, c in own.items()])
    return out.withColumn("cl_x_eco_km2", F.round(residual(F.col("area_ha_eco") / 100, F.col("cl12_eco_km2"), F.col("cl3_eco_km2")), 6) + 0.0)


def balance(layer: DataFrame, whole: DataFrame, key: str = "perim_id") -> DataFrame:
    """(key, sum12, cl12_km2, ok12, sum3, cl3_km2, ok3): whether the pieces' classes add up to the event's.

    A sum without any value is null, as is then its verdict; the tolerance is
    the larger of 1e-6 and 0.5 %.  Slivers have no row, so their classes may be missing.
    """
    sums = layer.groupBy(key).agg(F.sum("cl12_eco_km2").alias("sum12"), F.sum("cl3_eco_km2").alias("sum3"))
    out = sums.join(whole.select(key, "cl12_km2", "cl3_km2"), key, "left")
    ok = lambda k: F.abs(F.col(f"sum{k}") - F.col(f"cl{k}_km2")) <= F.greatest(F.lit(BALANCE_MIN), F.col(f"cl{k}_km2") * BALANCE_SHARE)
    return out.select(key, "sum12", "cl12_km2", ok(12).alias("ok12"), "sum3", "cl3_km2", ok(3).alias("ok3"))


def class_clip(events: DataFrame, cover: DataFrame, grid: R.Grid, classes: tuple[int, ...], key: str = "perim_id") -> DataFrame:
    """(key, cl<k>_km2 for each class): ellipsoidal area of the classes inside each box event.

    Pixels are cut to the event, so their areas are exact; they are disjoint, so
    nothing is dissolved.  NULL where no pixel is covered, 0 where none has the class.
    """
    pixels = R.pixels_of_boxes(events, [key, "year", "minx", "miny", "maxx", "maxy"], grid, "all_touched")
    row, col = F.col("row"), F.col("col")
    piece = box_area_m2(F.greatest(F.col("minx"), grid.left(col)), F.greatest(F.col("miny"), grid.top(row + 1)), F.least(F.col("maxx"), grid.left(col + 1)), F.least(F.col("maxy"), grid.top(row)))
    met = pixels.withColumn("m2", F.greatest(piece, F.lit(0.0))).join(cover, ["year", "row", "col"])
    sums = met.groupBy(key).agg(*[(F.sum(F.when(F.col("value") == k, F.col("m2")).otherwise(0.0)) / 1e6).alias(f"cl{k}_km2") for k in classes])
    return events.select(key).join(sums, key, "left")
