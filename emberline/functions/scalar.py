"""Scalar rules of the three products as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values
LAT_BOX, LON_BOX = (-20.0, 1.0), (-80.0, -60.0)
FIRST_YEAR, LAST_YEAR = 2001, 2024
MIN_CONFIDENCE, TYPES = 80, (0, 2)
NO_REGION = "sin_region"


def thematic(confidence: Column, kind: Column, lat: Column, lon: Column) -> Column:
    """Confident detections of vegetation fires or other land sources within the box, borders included."""
    return (confidence >= MIN_CONFIDENCE) & kind.isin(*TYPES) & lat.between(*LAT_BOX) & lon.between(*LON_BOX)


def not_country(name: Column, country: str = "Brazil") -> Column:
    """True unless the name is the country; a missing name passes."""
    return ~name.eqNullSafe(F.lit(country))


def short_country(name: Column) -> Column:
    return F.when(name == "Bolivia (Plurinational State of)", F.lit("Bolivia")).otherwise(name)


def climate_zone(lat: Column, other: str = "Not_Specified") -> Column:
    return (
        F.when((lat >= -5) & (lat <= 1), "Zone_Equatorial").when((lat >= -8) & (lat < -5), "Transition_Zone").when((lat >= -20) & (lat < -8), "South_Zone").otherwise(other)
    )


def month_of_day(year: Column, doy: Column) -> Column:
    """Month of a day of the year; 0 for a day outside 1 to 366."""
    return F.when((doy <= 0) | (doy > 366), F.lit(0)).otherwise(F.month(F.date_add(F.make_date(year, F.lit(1), F.lit(1)), (doy - 1).cast("int"))))


def band_of_year(year: Column, bands: Column, anchor: str = "last") -> Column:
    """1-based band of a year: the last band is LAST_YEAR, the first FIRST_YEAR, or the first 1985. Null outside the bands."""
    band = {"last": year - LAST_YEAR + bands, "first": year - FIRST_YEAR + 1, "1985": year - 1985 + 1}[anchor]
    return F.when((band >= 1) & (band <= bands), band)


def lenient_date(text: Column) -> Column:
    """A date by the strict pattern, else by whatever parses as a timestamp, else null."""
    return F.coalesce(F.try_to_date(text, "yyyy-MM-dd"), F.try_to_timestamp(text).cast("date"))


def event_key(prefix: str, *parts: tuple[str, Column]) -> Column:
    """A key like BA_2004_M02_17 from printf pieces."""
    return F.format_string(prefix + "".join(f for f, _ in parts), *[c for _, c in parts])


def residual(area: Column, *classes: Column) -> Column:
    """What the classes leave of an area; null if any is, and not clipped at 0."""
    for c in classes:
        area = area - c
    return area


def sampled(key: Column, share: float, seed: int = 42) -> Column:
    """A reproducible Bernoulli draw by a digest of key and seed: the same rows on every run, each with probability `share`."""
    draw = F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}"))), 1, 8), 16, 10).cast("long")
    return F.pmod(draw, F.lit(1_000_000)) < round(share * 1_000_000)


def year_in(text: Column) -> Column:
    """The first year between FIRST_YEAR and LAST_YEAR in a name, else null."""
    years = F.transform(F.regexp_extract_all(text, F.lit(r"(\d{4})"), F.lit(1)), lambda y: y.cast("int"))
    return F.get(F.filter(years, lambda y: y.between(FIRST_YEAR, LAST_YEAR)), F.lit(0))


def partition_year(name: Column) -> Column:
    """Year of a perimeter file: the digits after `perimeters`, else the last group of four digits from 1900 to 2100, else null."""
    anchored = F.regexp_extract(name, r"(?i)perimeters[_-](\d{4})", 1)
    groups = F.filter(F.transform(F.regexp_extract_all(name, F.lit(r"(\d{4})"), F.lit(1)), lambda y: y.cast("int")), lambda y: y.between(1900, 2100))
    return F.when(anchored != "", anchored.cast("int")).otherwise(F.try_element_at(groups, F.lit(-1)))


def tile_number(name: Column) -> Column:
    """The index in names that hold _T<digits>, else null."""
    got = F.regexp_extract(name, r"_T(\d+)", 1)
    return F.when(got != "", got.cast("int"))


def run_tag(share: float | None) -> str:
    """Suffix of a run's files: `vf` for a whole run, `test_eNNpct` for a sample."""
    return "vf" if share is None or share >= 1 else f"test_e{int(share * 100):02d}pct"


def geometry_type(parts: Column) -> Column:
    """Polygon, MultiPolygon, or null for no parts."""
    n = F.coalesce(F.size(parts), F.lit(0))
    return F.when(n == 1, "Polygon").when(n > 1, "MultiPolygon")


def fraction(part_km2: Column, area_ha: Column) -> Column:
    """Share of an event that a class covers; null without cover or without area."""
    return part_km2 / F.when(area_ha > 0, area_ha / 100)


def share_to_area(percent: Column, area: Column) -> Column:
    """The area that a percentage is of."""
    return percent / 100 * area


def has_area(area: Column) -> Column:
    """Rows whose area isn't known or isn't 0."""
    return area.isNull() | (area != 0)


def round_scaled(value: Column, digits: int) -> Column:
    """A double times 10^digits, rounded half away from 0 and scaled back, as DuckDB's round; F.round goes by the shortest decimal text, which takes -8.995 to -9."""
    return F.round(value * 10.0**digits, 0) / 10.0**digits


def tile_of(lon: Column, lat: Column, size: float = 1.0, strict: bool = False) -> Column:
    """(x, y) of the tile that holds a point; strict: none for a point on a tile's border."""
    at = F.struct(F.floor(lon / size).cast("int").alias("x"), F.floor(lat / size).cast("int").alias("y"))
    on_border = (F.floor(lon / size) * size == lon) | (F.floor(lat / size) * size == lat)
    return F.when(~on_border, at) if strict else at
