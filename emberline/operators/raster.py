"""Rasters as relations of pixels: grids, pixel sets, zonal statistics, warps, mosaics.

A raster is rows (row, col, value), with band or tile columns where it has them.
Row 0 is the northernmost.  NULL is "no data"; NaN never enters.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions.geo import box_area_m2


@dataclass(frozen=True)
class Grid:
    """A north-up grid of degrees."""

    west: float
    north: float
    width: float
    height: float
    rows: int
    cols: int

    def left(self, col: Column) -> Column:
        return F.lit(self.west) + col * F.lit(self.width)

    def top(self, row: Column) -> Column:
        return F.lit(self.north) - row * F.lit(self.height)

    def col_of(self, x: Column) -> Column:
        return F.floor((x - F.lit(self.west)) / F.lit(self.width))

    def row_of(self, y: Column) -> Column:
        return F.floor((F.lit(self.north) - y) / F.lit(self.height))

    def cell_area_m2(self, row: Column) -> Column:
        """Ellipsoidal area of a cell, which depends on its row only."""
        return box_area_m2(F.lit(0.0), self.top(row + 1), F.lit(self.width), self.top(row))

    def window(self, minx: Column, miny: Column, maxx: Column, maxy: Column) -> dict[str, Column]:
        """First and last row and column whose cells the box touches, clamped to the grid."""
        lo = lambda c: F.greatest(c, F.lit(0))
        return {
            "c0": lo(self.col_of(minx)),
            "c1": F.least(self.col_of(maxx), F.lit(self.cols - 1)),
            "r0": lo(self.row_of(maxy)),
            "r1": F.least(self.row_of(miny), F.lit(self.rows - 1)),
        }


def pixels_of_boxes(boxes: DataFrame, key: list[str], grid: Grid, rule: str = "center") -> DataFrame:
    """(key, row, col): cells of the boxes, by cell centre inside or by any touch (`all_touched`)."""
    w = grid.window(F.col("minx"), F.col("miny"), F.col("maxx"), F.col("maxy"))
    cells = boxes.select(*key, "minx", "miny", "maxx", "maxy", *[c.alias(f"_{n}") for n, c in w.items()]).filter("_r0 <= _r1 and _c0 <= _c1")
    cells = cells.withColumn("row", F.explode(F.sequence("_r0", "_r1"))).withColumn("col", F.explode(F.sequence("_c0", "_c1")))
    if rule == "center":
        x, y = grid.left(F.col("col") + 0.5), grid.top(F.col("row") + 0.5)
        cells = cells.filter((x > F.col("minx")) & (x < F.col("maxx")) & (y > F.col("miny")) & (y < F.col("maxy")))
    elif rule != "all_touched":
        raise ValueError(f"no pixel rule {rule!r}")
    return cells.select(*key, F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"))


def zonal(pixels: DataFrame, raster: DataFrame, key: list[str], *aggs: Column, nodata: float | None = None, value: str = "value") -> DataFrame:
    """Aggregates of a raster over pixel sets; `nodata` values are dropped, a zone without values gets nulls."""
    clean = raster if nodata is None else raster.filter(F.col(value) != nodata)
    found = pixels.join(clean, ["row", "col"]).groupBy(*key).agg(*aggs)
    return pixels.select(*key).distinct().join(found, key, "left")


def zonal_majority(pixels: DataFrame, raster: DataFrame, key: list[str], value: str = "value") -> DataFrame:
    """(key, majority, n): the most frequent value, of tied ones the smallest."""
    counts = pixels.join(raster.filter(F.col(value).isNotNull()), ["row", "col"]).groupBy(*key, value).agg(F.count("*").alias("n"))
    return counts.groupBy(*key).agg(F.min_by(F.struct(F.col(value).alias("v"), "n"), F.struct((-F.col("n")).alias("o"), F.col(value))).alias("m")).select(*key, F.col("m.v").alias("majority"), F.col("m.n").alias("n"))


def mode_by_rule(rows: DataFrame, key: list[str], value: str, rule: str = "smallest", codes: list | None = None, seq: str | None = None) -> DataFrame:
    """(key, mode) with the tie rules of the product's versions.

    smallest: the smallest tied value.  listed: only values of `codes` count, the
    earlier listed wins, 0 if there is none.  first: the value seen first by `seq`.
    """
    if rule == "listed":
        rank = F.array_position(F.array(*[F.lit(c) for c in codes or []]), F.col(value))
        counts = rows.filter(F.col(value).isin(codes or [])).groupBy(*key, value).agg(F.count("*").alias("n"), F.max(rank).alias("o"))
    else:
        counts = rows.filter(F.col(value).isNotNull()).groupBy(*key, value).agg(F.count("*").alias("n"), (F.min(seq) if rule == "first" else F.min(value)).alias("o"))
    best = counts.groupBy(*key).agg(F.max_by(value, F.struct("n", (-F.col("o")).alias("o"))).alias("mode"))
    if rule != "listed":
        return best
    return rows.select(*key).distinct().join(best, key, "left").select(*key, F.coalesce("mode", F.lit(0)).alias("mode"))


def class_area(pixels: DataFrame, raster: DataFrame, key: list[str], cls: int, area: Column) -> DataFrame:
    """(key, area): area of class `cls` in pixel sets, added over tiles.

    NULL where no tile covers the set, 0 where a tile does but has no pixel of the
    class.  `raster` has a row for each covered cell, its value NULL or a class.
    """
    covered = pixels.join(raster, ["row", "col"]).groupBy(*key).agg(F.sum(F.when(F.col("value") == cls, area).otherwise(0.0)).alias("area"))
    return pixels.select(*key).distinct().join(covered, key, "left")


def weighted_percent(parts: DataFrame, key: list[str], hits: str, total: str) -> DataFrame:
    """(key, pct) over several tiles: sum of hits over sum of totals, null without totals."""
    return parts.groupBy(*key).agg((F.sum(hits) * 100.0 / F.nullif(F.sum(total), F.lit(0))).alias("pct"))


def stack(bands: DataFrame, cells: DataFrame, band: str, wanted: list[int], nodata: float = -9999.0) -> DataFrame:
    """All cells by all wanted bands; a missing band or cell holds `nodata`."""
    full = cells.withColumn(band, F.explode(F.array(*[F.lit(b) for b in wanted])))
    return full.join(bands, [*cells.columns, band], "left").withColumn("value", F.coalesce(F.col("value"), F.lit(nodata)))


def mosaic_first(tiles: DataFrame, order: list[str]) -> DataFrame:
    """One value for each cell: that of the first tile in order which has one."""
    return tiles.filter("value is not null").groupBy("row", "col").agg(F.min_by("value", F.struct(*order)).alias("value"))


def warp_nearest(target: DataFrame, raster: DataFrame, source: Grid, x: Column, y: Column) -> DataFrame:
    """The target rows with the value of the source cell that holds (x, y)."""
    at = target.withColumns({"_r": source.row_of(y).cast("int"), "_c": source.col_of(x).cast("int")})
    src = raster.select(F.col("row").alias("_r"), F.col("col").alias("_c"), F.col("value"))
    return at.join(src, ["_r", "_c"], "left").drop("_r", "_c")


def warp_bilinear(target: DataFrame, raster: DataFrame, source: Grid, key: list[str], x: Column, y: Column, nodata: float | None = None) -> DataFrame:
    """(key, value): weighted mean of the four cell centres around (x, y); missing ones leave their weight to the others."""
    fx, fy = (x - F.lit(source.west)) / F.lit(source.width) - 0.5, (F.lit(source.north) - y) / F.lit(source.height) - 0.5
    corners = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])
    at = target.select(*key, fx.alias("_x"), fy.alias("_y")).withColumn("_o", F.explode(corners))
    at = at.withColumns({"_r": (F.floor("_y") + F.col("_o.i")).cast("int"), "_c": (F.floor("_x") + F.col("_o.j")).cast("int")})
    w = (1 - F.abs(F.col("_y") - F.col("_r"))) * (1 - F.abs(F.col("_x") - F.col("_c")))
    src = raster.select(F.col("row").alias("_r"), F.col("col").alias("_c"), F.col("value").alias("_v")).filter("_v is not null")
    src = src if nodata is None else src.filter(F.col("_v") != nodata)
    return at.withColumn("_w", w).join(src, ["_r", "_c"], "left").groupBy(*key).agg((F.sum(F.when(F.col("_v").isNotNull(), F.col("_w") * F.col("_v"))) / F.nullif(F.sum(F.when(F.col("_v").isNotNull(), F.col("_w"))), F.lit(0.0))).alias("value"))


def warp_average(raster: DataFrame, factor: int) -> DataFrame:
    """Mean of the non-null values of factor x factor cells."""
    return raster.groupBy(F.floor(F.col("row") / factor).cast("int").alias("row"), F.floor(F.col("col") / factor).cast("int").alias("col")).agg(F.avg("value").alias("value"))


#: Half of the eight neighbours; the other half are the same pairs from the other end.
FORWARD = ((0, 1), (1, -1), (1, 0), (1, 1))


def neighbour_pairs(pixels: DataFrame, same: list[str], key: str) -> DataFrame:
    """(a, b): keys of 8-neighbouring pixels that agree in `same` (say year, month, day of burning)."""
    other = pixels.select(*same, F.col("row").alias("_r"), F.col("col").alias("_c"), F.col(key).alias("b"))
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in FORWARD]))
    at = pixels.withColumn("_s", steps).select(*same, F.col(key).alias("a"), (F.col("row") + F.col("_s.i")).alias("_r"), (F.col("col") + F.col("_s.j")).alias("_c"))
    return at.join(other, [*same, "_r", "_c"]).select("a", "b")


def touches_border(events: DataFrame, key: list[str], rows: int, cols: int) -> DataFrame:
    """(key, touches_border): whether a pixel lies in the first or last row or column of the tile."""
    edge = (F.min("row") == 0) | (F.max("row") == rows - 1) | (F.min("col") == 0) | (F.max("col") == cols - 1)
    return events.groupBy(*key).agg(edge.alias("touches_border"))


def read_window(raster: DataFrame, grid: Grid, minx: float, miny: float, maxx: float, maxy: float) -> DataFrame:
    """The cells of a raster that a box touches: plain ranges of row and col, which reach the scan."""
    import math

    c0, c1 = math.floor((minx - grid.west) / grid.width), math.floor((maxx - grid.west) / grid.width)
    r0, r1 = math.floor((grid.north - maxy) / grid.height), math.floor((grid.north - miny) / grid.height)
    return raster.filter(F.col("row").between(max(0, r0), min(grid.rows - 1, r1)) & F.col("col").between(max(0, c0), min(grid.cols - 1, c1)))


def crop(raster: DataFrame, pixels: DataFrame) -> DataFrame:
    """The cells of a raster that lie in a pixel set."""
    return raster.join(pixels.select("row", "col"), ["row", "col"], "left_semi")


def tile_meta(raster: DataFrame, grid: Grid, tile: int, bands: list[str], nodata: Column) -> DataFrame:
    """(tr, tc, minx, miny, maxx, maxy, width, height, bands, cells, nodata): what is known of each tile without its pixels."""
    at = raster.withColumns({"tr": F.floor(F.col("row") / tile).cast("int"), "tc": F.floor(F.col("col") / tile).cast("int")})
    got = at.groupBy("tr", "tc").agg(F.countDistinct(*bands).alias("bands"), F.count("*").alias("cells"), F.count_if(nodata).alias("nodata"))
    r1, c1 = F.least((F.col("tr") + 1) * tile, F.lit(grid.rows)), F.least((F.col("tc") + 1) * tile, F.lit(grid.cols))
    edge = {"minx": grid.left(F.col("tc") * tile), "miny": grid.top(r1), "maxx": grid.left(c1), "maxy": grid.top(F.col("tr") * tile)}
    return got.select("tr", "tc", *[c.alias(n) for n, c in edge.items()], F.lit(grid.width).alias("width"), F.lit(grid.height).alias("height"), "bands", "cells", "nodata")


def write_raster(raster: DataFrame, path: str, band_name: Column) -> None:
    """A raster as Parquet, a folder for each band, which carries its name."""
    raster.withColumn("band_name", band_name).write.mode("overwrite").partitionBy("band_name").parquet(path)
