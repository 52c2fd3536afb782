"""Scans and sinks: explicit schemas, checked layers, catalogs from file names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DETECTION_SCHEMA = "latitude double, longitude double, acq_date string, acq_time string, satellite string, confidence int, type int"


def read_detections(spark: SparkSession, path: str, schema: str = DETECTION_SCHEMA) -> DataFrame:
    """Detections from CSV with a header; a line that doesn't parse is kept as nulls, never guessed."""
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path).withColumn("acq_date", F.try_to_date("acq_date", "yyyy-MM-dd"))


POINT = "array<double>"
RINGS = f"array<array<{POINT}>>"


def read_geojson(spark: SparkSession, path: str, properties: str, keep: list[str] | None = None) -> DataFrame:
    """Features of newline-delimited GeoJSON: their properties, `geom_type` and `parts`.

    properties: their schema as DDL; keep: those that are wanted, the others
    aren't parsed.  Polygons and multi-polygons get parts, other geometries none.
    """
    wanted = [f.strip() for f in properties.split(",") if keep is None or f.split()[0] in keep]
    props = ", ".join(f"{n}: {t}" for n, t in (f.split(None, 1) for f in wanted))
    # coordinates are nested by one level more in a multi-polygon, so both readings are tried
    one = F.from_json("value", f"properties struct<{props}>, geometry struct<type: string, coordinates: {RINGS}>")
    many = F.from_json("value", f"geometry struct<coordinates: array<{RINGS}>>")
    lines = spark.read.text(path).filter(F.trim("value") != "").select(one.alias("one"), many.alias("many"))
    ring = lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    part = lambda p: F.struct(ring(p[0]).alias("shell"), F.transform(F.slice(p, 2, F.size(p)), ring).alias("holes"))
    kind = F.col("one.geometry.type")
    parts = F.when(kind == "Polygon", F.array(part(F.col("one.geometry.coordinates")))).when(kind == "MultiPolygon", F.transform("many.geometry.coordinates", part))
    return lines.select("one.properties.*", kind.alias("geom_type"), parts.alias("parts"))


def write_geojson(polygons: DataFrame, path: str, properties: list[str], parts: str = "parts") -> None:
    """Features as newline-delimited GeoJSON; one part is a Polygon, several are a MultiPolygon."""
    ring = lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"]))
    part = lambda p: F.concat(F.array(ring(p["shell"])), F.transform(F.coalesce(p["holes"], F.array().cast("array<array<struct<x:double,y:double>>>")), ring))
    every = F.transform(parts, part)
    props = F.struct(*properties).alias("properties")
    line = lambda kind, coordinates: F.to_json(F.struct(F.lit("Feature").alias("type"), props, F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates")).alias("geometry")))
    polygons.select(F.when(F.size(parts) == 1, line("Polygon", every[0])).otherwise(line("MultiPolygon", every)).alias("value")).write.mode("overwrite").text(path)


def read_layer(spark: SparkSession, path: str, required: list[str] = (), bbox: tuple[float, float, float, float] | None = None, limit: int | None = None, columns: list[str] | None = None) -> DataFrame:
    """A Parquet layer; KeyError for missing columns.

    The box becomes range predicates on minx..maxy that reach the scan; a layer
    without bounds is read in full and its bounds taken from `parts`.  columns:
    those that are wanted; the scan leaves out the others, the geometry too.
    """
    df = spark.read.parquet(path)
    if missing := sorted(set(required) - set(df.columns)):
        raise KeyError(f"{path} lacks {missing}")
    if bbox:
        w, s, e, n = bbox
        near = (F.col("maxx") >= w) & (F.col("minx") <= e) & (F.col("maxy") >= s) & (F.col("miny") <= n)
        if {"minx", "miny", "maxx", "maxy"} <= set(df.columns):
            df = df.filter(near)
        else:
            from emberline.operators.polygons import bounds

            df = bounds(df).filter(near).drop("minx", "miny", "maxx", "maxy")
    df = df.limit(limit) if limit is not None else df
    return df.select(*columns) if columns else df


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def build_if_absent(spark: SparkSession, path: str, build, ok: Column | None = None) -> tuple[DataFrame, bool]:  # noqa: ANN001
    """(table, built): the committed table at path, else build() written there.

    Rows for which `ok` isn't true go to `<path>_rejected` instead.  A table is
    committed when its _SUCCESS file is there, which Spark writes last, so a run
    that died midway is built anew.
    """
    done = exists(spark, f"{path}/_SUCCESS")
    if not done:
        rows = build()
        if ok is not None:
            rows, bad = quarantine(rows, ok)
            bad.write.mode("overwrite").parquet(f"{path}_rejected")
        rows.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path), not done


def order_columns(df: DataFrame, standard: list[str], last: str = "geometry") -> DataFrame:
    """Columns in the standard order, then the others as they come, then the geometry; none is dropped."""
    first = [c for c in standard if c in df.columns and c != last]
    tail = [last] if last in df.columns else []
    return df.select(*first, *[c for c in df.columns if c not in first and c != last], *tail)


def rename_reserved(df: DataFrame, reserved: list[str], suffix: str = "_gfa") -> DataFrame:
    """Native columns whose names the product generates itself get a suffix."""
    return df.withColumnsRenamed({c: f"{c}{suffix}" for c in df.columns if c in reserved})


def one_layer(names: list[str], pattern: str = "") -> str:
    """The only layer name that has the pattern; ValueError if there is none or several."""
    found = [n for n in names if pattern.lower() in n.lower()]
    if len(found) != 1:
        raise ValueError(f"{len(found)} layers match {pattern!r}: {names}")
    return found[0]


def tile_grid(spark: SparkSession, west: float, south: float, east: float, north: float, step: float) -> DataFrame:
    """(row, col, minx, miny, maxx, maxy): tiles of `step` degrees; the last ones end at the borders."""
    import math

    cols, rows = math.ceil((east - west) / step - 1e-9), math.ceil((north - south) / step - 1e-9)
    at = spark.range(rows * cols).select((F.floor(F.col("id") / cols)).cast("int").alias("row"), (F.col("id") % cols).cast("int").alias("col"))
    x, y = F.lit(west) + F.col("col") * step, F.lit(south) + F.col("row") * step
    return at.select("row", "col", x.alias("minx"), y.alias("miny"), F.least(x + step, F.lit(east)).alias("maxx"), F.least(y + step, F.lit(north)).alias("maxy"))


def month_file(name: Column) -> dict[str, Column]:
    """tile, year, month of names like <tile>_YYYY_MM.tif; nulls for others."""
    rx = r"^(.+)_(\d{4})_(\d{2})\.tif$"
    got = lambda i: F.when(F.regexp_like(name, F.lit(rx)), F.regexp_extract(name, rx, i))
    return {"tile": got(1), "year": got(2).cast("int"), "month": got(3).cast("int")}


def bounds_file(name: Column) -> dict[str, Column]:
    """south, north, west, east of names that hold LatAtoB_LonCtoD; nulls for others."""
    num = r"(-?\d+(?:\.\d+)?)"
    rx = rf"Lat{num}to{num}_Lon{num}to{num}"
    got = lambda i: F.when(F.regexp_like(name, F.lit(rx)), F.regexp_extract(name, rx, i).cast("double"))
    return {"south": F.least(got(1), got(2)), "north": F.greatest(got(1), got(2)), "west": F.least(got(3), got(4)), "east": F.greatest(got(3), got(4))}


def missing_tiles(expected: DataFrame, have: DataFrame, key: list[str]) -> DataFrame:
    return expected.join(have, key, "left_anti")


BOM = "\ufeff"


def write_csv(df: DataFrame, path: str, drop: tuple[str, ...] = ("geometry",)) -> None:
    """CSV without geometry columns; every part file starts with a byte-order mark and the header (utf-8-sig)."""
    out = df.drop(*drop)
    marked = out.withColumnRenamed(out.columns[0], BOM + out.columns[0])
    marked.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def write_layer(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), append: bool = False) -> None:
    """A layer as Parquet; one partitioned write replaces part files that are merged later."""
    w = df.write.mode("append" if append else "overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def quarantine(df: DataFrame, ok: Column) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows); a null verdict is bad."""
    sure = F.coalesce(ok, F.lit(False))
    return df.filter(sure), df.filter(~sure)
