"""Polygon kernels in numpy, one polygon at a time, and operators that run them on Arrow batches (polygon_batches.py) after bounds have pruned.

A polygon is a list of parts (shell, holes); a ring is an (n, 2) array that ends
where it starts.  Rings are read by the even-odd rule, so their orientation
doesn't matter.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.functions.geo import AUTHALIC_R2, E1, E2, Q_POLE
from emberline.operators import polygon_batches as B
from emberline.operators.raster import Grid
from emberline.operators.spatial_join import boxes_intersect, edges_of, nearest_box, points_in_polygons
from emberline.plans.scratch import materialize

Ring = np.ndarray
ROUNDING = B.ROUNDING
#: More countries than these are searched by cells, not compared with every centroid.
FEW_BOXES = 64
Part = tuple[Ring, list[Ring]]

RING_TYPE = "array<struct<x:double,y:double>>"
PARTS_TYPE = f"array<struct<shell:{RING_TYPE},holes:array<{RING_TYPE}>>>"


def to_parts(value) -> list[Part]:  # noqa: ANN001
    """Parts from what Spark hands to Python; rings are closed and cleaned, those without area are dropped."""
    out = []
    for p in [] if value is None else value:
        shell = clean(_ring(p["shell"]))
        if shell is not None:
            out.append((shell, [h for h in (clean(_ring(r)) for r in ([] if p["holes"] is None else p["holes"])) if h is not None]))
    return out


def _ring(points) -> Ring:  # noqa: ANN001
    return np.array([(q["x"], q["y"]) for q in points], float).reshape(-1, 2)


def clean(ring: Ring) -> Ring | None:
    """The ring closed and without repeated points; None for fewer than three points or no area."""
    if len(ring):
        ring = ring[np.r_[True, (np.diff(ring, axis=0) != 0).any(1)]]
    if len(ring) and (ring[0] != ring[-1]).any():
        ring = np.vstack([ring, ring[:1]])
    return ring if len(ring) >= 4 and abs(shoelace(ring)) > 0 else None


def crosses_itself(ring: Ring) -> bool:
    """Whether two edges cross properly: such a ring belongs in quarantine."""
    a, b = ring[:-1], ring[1:]

    def side(p: np.ndarray, q: np.ndarray, r: np.ndarray) -> np.ndarray:
        return np.sign((q[..., 0] - p[..., 0]) * (r[..., 1] - p[..., 1]) - (q[..., 1] - p[..., 1]) * (r[..., 0] - p[..., 0]))

    s1, s2 = side(a[:, None], b[:, None], a[None]), side(a[:, None], b[:, None], b[None])
    apart = s1 * s2 < 0
    return bool((apart & apart.T).any())


def shoelace(ring: Ring) -> float:
    x, y = (ring - ring[:1]).T  # near the origin, for precision
    return float(np.sum(x[:-1] * y[1:] - x[1:] * y[:-1]) / 2)


def geodesic_area(parts: list[Part]) -> float:
    """Ellipsoidal square metres: great-circle edges on the authalic sphere, holes taken off."""

    def one(ring: Ring) -> float:
        s = np.sin(np.radians(ring[:, 1]))
        q = (1 - E2) * (s / (1 - E2 * s * s) - np.log((1 - E1 * s) / (1 + E1 * s)) / (2 * E1)) / Q_POLE
        t, d = np.tan(np.arcsin(np.clip(q, -1, 1)) / 2), np.tan(np.radians(np.diff(ring[:, 0])) / 2)
        return AUTHALIC_R2 * abs(float(np.sum(2 * np.arctan2(d * (t[:-1] + t[1:]), 1 + t[:-1] * t[1:]))))

    return sum(one(s) - sum(one(h) for h in holes) for s, holes in parts)


def edges(parts: list[Part]) -> np.ndarray:
    """(n, 4) array of x1, y1, x2, y2 of all rings."""
    rings = [r for s, holes in parts for r in (s, *holes)]
    return np.concatenate([np.hstack([r[:-1], r[1:]]) for r in rings]) if rings else np.zeros((0, 4))


def inside(parts: list[Part], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Even-odd test of points; those on an edge may go either way."""
    odd = np.zeros(len(x), bool)
    e = edges(parts)
    e = e[e[:, 1] != e[:, 3]]
    for i in range(0, len(x), max(1, 2_000_000 // max(1, len(e)))):  # a block of points against all edges
        k = slice(i, i + max(1, 2_000_000 // max(1, len(e))))
        px, py = x[k, None], y[k, None]
        cut = ((e[:, 1] > py) != (e[:, 3] > py)) & (px < (e[:, 2] - e[:, 0]) * (py - e[:, 1]) / (e[:, 3] - e[:, 1]) + e[:, 0])
        odd[k] = cut.sum(axis=1) % 2 == 1
    return odd


def relate(a: list[Part], b: list[Part]) -> tuple[bool, bool]:
    """(a and b share an area, a lies within b); contact without area counts as neither."""
    if not a or not b:
        return False, False
    ea, eb = edges(a), edges(b)
    side = lambda p, q: (p[:, None, 2] - p[:, None, 0]) * (q[None, :, 1] - p[:, None, 1]) - (p[:, None, 3] - p[:, None, 1]) * (q[None, :, 0] - p[:, None, 0])
    ends = lambda p, q: side(p, q) * side(p, q[:, [2, 3, 0, 1]]) < 0
    cross = bool((ends(ea, eb) & ends(eb, ea).T).any())
    in_b, in_a = inside(b, ea[:, 0], ea[:, 1]), inside(a, eb[:, 0], eb[:, 1])
    return cross or bool(in_b.any()) or bool(in_a.any()), not cross and bool(in_b.all()) and not bool(in_a.any())


def plane_area(parts: list[Part]) -> float:
    """Plane area, holes taken off."""
    return sum(abs(shoelace(s)) - sum(abs(shoelace(h)) for h in holes) for s, holes in parts)


def clip_half_plane(ring: Ring, a: float, b: float, c: float) -> Ring | None:
    """The part of a ring where a*x + b*y <= c."""
    d = a * ring[:, 0] + b * ring[:, 1] - c
    out = []
    for i in range(len(ring) - 1):
        p, q, dp, dq = ring[i], ring[i + 1], d[i], d[i + 1]
        if dp <= 0:
            out.append(p)
        if (dp < 0 < dq) or (dq < 0 < dp):
            out.append(p + (q - p) * (dp / (dp - dq)))
    return clean(np.array(out)) if len(out) >= 3 else None


def clip_convex(ring: Ring, window: Ring) -> Ring | None:
    """A ring cut to a convex ring."""
    w = window if shoelace(window) > 0 else window[::-1]
    for (x1, y1), (x2, y2) in zip(w[:-1], w[1:], strict=True):
        ring = clip_half_plane(ring, y2 - y1, x1 - x2, (y2 - y1) * x1 - (x2 - x1) * y1)
        if ring is None:
            return None
    return ring


def clip_box(parts: list[Part], minx: float, miny: float, maxx: float, maxy: float) -> list[Part]:
    """Parts cut to a box."""
    box = np.array([(minx, miny), (maxx, miny), (maxx, maxy), (minx, maxy), (minx, miny)])
    out = []
    for shell, holes in parts:
        s = clip_convex(shell, box)
        if s is not None:
            out.append((s, [h for h in (clip_convex(h, box) for h in holes) if h is not None]))
    return out


def trapezoids(parts: list[Part], levels: np.ndarray) -> list[list[tuple[float, float, float, float]]]:
    """For each strip between consecutive levels: its intervals (left, right at the lower level, left, right at the upper)."""
    sloped = edges(parts)
    sloped = sloped[sloped[:, 1] != sloped[:, 3]]
    low, high = np.minimum(sloped[:, 1], sloped[:, 3]), np.maximum(sloped[:, 1], sloped[:, 3])
    out = []
    for lo, hi in zip(levels[:-1], levels[1:], strict=True):
        e = sloped[(low <= lo) & (high >= hi)]
        at = lambda y: e[:, 0] + (e[:, 2] - e[:, 0]) * (y - e[:, 1]) / (e[:, 3] - e[:, 1])  # noqa: E731, B023
        x1, x2 = at(lo), at(hi)
        order = np.argsort((x1 + x2) / 2, kind="stable")
        x1, x2 = x1[order], x2[order]
        out.append([(x1[i], x1[i + 1], x2[i], x2[i + 1]) for i in range(0, len(x1) - 1, 2)])
    return out


def _crossings(a: list[Part], b: list[Part]) -> np.ndarray:
    """Heights at which edges of a and b cross."""
    ea, eb = edges(a), edges(b)
    d1, d2 = ea[:, 2:] - ea[:, :2], eb[:, 2:] - eb[:, :2]
    den = d1[:, None, 0] * d2[None, :, 1] - d1[:, None, 1] * d2[None, :, 0]
    diff = eb[None, :, :2] - ea[:, None, :2]
    with np.errstate(divide="ignore", invalid="ignore"):
        t = (diff[..., 0] * d2[None, :, 1] - diff[..., 1] * d2[None, :, 0]) / den
        u = (diff[..., 0] * d1[:, None, 1] - diff[..., 1] * d1[:, None, 0]) / den
    ok = (den != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
    i, j = np.nonzero(ok)
    return ea[i, 1] + t[i, j] * d1[i, 1]


def intersection(a: list[Part], b: list[Part]) -> list[Part]:
    """a and b in common, as disjoint trapezoids between the heights of vertices and crossings."""
    if not a or not b:
        return []
    ys = np.concatenate([r[:, 1] for p in (a, b) for s, holes in p for r in (s, *holes)] + [_crossings(a, b)])
    levels = np.unique(ys)
    out = []
    for lo, hi, ta, tb in zip(levels[:-1], levels[1:], trapezoids(a, levels), trapezoids(b, levels), strict=True):
        for al, ar, bl, br in ta:
            for cl, cr, dl, dr in tb:
                l1, r1, l2, r2 = max(al, cl), min(ar, cr), max(bl, dl), min(br, dr)
                if r1 - l1 + r2 - l2 > 0 and r1 >= l1 - 1e-12 and r2 >= l2 - 1e-12:
                    ring = clean(np.array([(l1, lo), (max(r1, l1), lo), (max(r2, l2), hi), (l2, hi), (l1, lo)]))
                    if ring is not None:
                        out.append((ring, []))
    return out


def representative_point(parts: list[Part]) -> tuple[float, float] | None:
    """A point inside: the middle of the widest interval on the line halfway up the largest part."""
    if not parts:
        return None
    shell, holes = max(parts, key=lambda p: abs(shoelace(p[0])))
    ys = np.unique(np.concatenate([r[:, 1] for r in (shell, *holes)]))
    mid = (ys[0] + ys[-1]) / 2 - ROUNDING * max(abs(ys[0]), abs(ys[-1]))  # a vertex halfway up is not under it
    i = min(max(int(np.searchsorted(ys, mid)), 1), len(ys) - 1)
    y = (ys[i - 1] + ys[i]) / 2  # between vertices
    xs = []
    for r in (shell, *holes):
        for (x1, y1), (x2, y2) in zip(r[:-1], r[1:], strict=True):
            if (y1 > y) != (y2 > y):
                xs.append(x1 + (x2 - x1) * (y - y1) / (y2 - y1))
    if not xs:  # flatter than doubles can tell
        return None
    xs = np.sort(xs)
    k = int(np.argmax(xs[1::2] - xs[::2])) * 2
    return float((xs[k] + xs[k + 1]) / 2), float(y)


def touched_cells(parts: list[Part], g: Grid, rule: str = "all_touched") -> np.ndarray:
    """(row, col) of the grid's cells by centre inside, or by any touch of the polygon's area or border."""
    pts = np.concatenate([s for s, _ in parts]) if parts else np.zeros((0, 2))
    if not len(pts):
        return np.zeros((0, 2), np.int64)
    c0, c1 = max(0, math.floor((pts[:, 0].min() - g.west) / g.width)), min(g.cols - 1, math.floor((pts[:, 0].max() - g.west) / g.width))
    r0, r1 = max(0, math.floor((g.north - pts[:, 1].max()) / g.height)), min(g.rows - 1, math.floor((g.north - pts[:, 1].min()) / g.height))
    if c0 > c1 or r0 > r1:
        return np.zeros((0, 2), np.int64)
    rows, cols = np.meshgrid(np.arange(r0, r1 + 1), np.arange(c0, c1 + 1), indexing="ij")
    hit = inside(parts, g.west + (cols.ravel() + 0.5) * g.width, g.north - (rows.ravel() + 0.5) * g.height).reshape(rows.shape)
    if rule == "all_touched":
        for shell, holes in parts:
            for ring in (shell, *holes):
                for (x1, y1), (x2, y2) in zip(ring[:-1], ring[1:], strict=True):
                    # the cells an edge passes: cut it at every grid line, and take the cell of each piece's middle
                    t = [0.0, 1.0]
                    if x1 != x2:
                        k = np.arange(math.ceil((min(x1, x2) - g.west) / g.width), math.floor((max(x1, x2) - g.west) / g.width) + 1)
                        t += list((g.west + k * g.width - x1) / (x2 - x1))
                    if y1 != y2:
                        k = np.arange(math.ceil((g.north - max(y1, y2)) / g.height), math.floor((g.north - min(y1, y2)) / g.height) + 1)
                        t += list((g.north - k * g.height - y1) / (y2 - y1))
                    t = np.unique(np.clip(t, 0, 1))
                    m = (t[1:] + t[:-1]) / 2
                    r = np.floor((g.north - (y1 + m * (y2 - y1))) / g.height).astype(int) - r0
                    c = np.floor((x1 + m * (x2 - x1) - g.west) / g.width).astype(int) - c0
                    ok = (r >= 0) & (c >= 0) & (r <= r1 - r0) & (c <= c1 - c0)
                    hit[r[ok], c[ok]] = True
    elif rule != "center":
        raise ValueError(f"no pixel rule {rule!r}")
    return np.stack([rows[hit], cols[hit]], axis=1)


def outline(rows: np.ndarray, cols: np.ndarray, g: Grid) -> list[Ring]:
    """Rings around a set of cells: shared sides cancel, the others are joined end to end."""
    sides: dict[tuple, int] = {}
    for r, c in zip(rows.tolist(), cols.tolist(), strict=True):
        a, b, d, e = (c, r), (c + 1, r), (c + 1, r + 1), (c, r + 1)
        for p, q in ((a, e), (e, d), (d, b), (b, a)):
            if (q, p) in sides:
                del sides[q, p]
            else:
                sides[p, q] = 1
    after: dict[tuple, list[tuple]] = {}
    for p, q in sides:
        after.setdefault(p, []).append(q)
    rings = []
    while after:
        start = next(iter(after))
        path, at, came = [start], start, None
        while True:
            options = after[at]
            # where two corners meet, turn left to keep the rings apart
            nxt = options[0] if len(options) == 1 or came is None else max(options, key=lambda q: (came[0] * (q[1] - at[1]) - came[1] * (q[0] - at[0])) * -1)  # noqa: B023
            options.remove(nxt)
            if not options:
                del after[at]
            came, at = (nxt[0] - at[0], nxt[1] - at[1]), nxt
            path.append(at)
            if at == start:
                break
        xy = np.array(path, float)
        rings.append(np.stack([g.west + xy[:, 0] * g.width, g.north - xy[:, 1] * g.height], axis=1))
    return rings


# --- on DataFrames ----------------------------------------------------------------


def by_batch(df: DataFrame, run: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """The columns that `run` makes of each Arrow batch."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict(run(batch))

    return df.mapInArrow(each, schema)


def rasterise(polygons: DataFrame, key: str, grid: Grid, rule: str = "all_touched", parts: str = "parts") -> DataFrame:
    """(key, row, col) of the cells of polygons."""
    kind = polygons.schema[key].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> dict:
        poly, row, col = B.touched_cells(B.read(batch.column(parts)), grid, rule)
        return {key: batch.column(key).take(pa.array(poly)), "row": row.astype("int32"), "col": col.astype("int32")}

    return by_batch(polygons.select(key, parts), run, f"`{key}` {kind}, row int, col int")


def centroid(parts: list[Part]) -> tuple[float, float] | None:
    """Area-weighted plane centroid, holes taken off."""
    total, sx, sy = 0.0, 0.0, 0.0
    for shell, holes in parts:
        for i, r in enumerate((shell, *holes)):
            x0, y0 = r[0]
            x, y = r[:, 0] - x0, r[:, 1] - y0  # near the origin, for precision
            w = x[:-1] * y[1:] - x[1:] * y[:-1]
            sign = np.sign(w.sum()) * (1 if i == 0 else -1)
            a = sign * w.sum() / 2
            total += a
            sx += sign * float(((x[:-1] + x[1:]) * w).sum()) / 6 + a * x0
            sy += sign * float(((y[:-1] + y[1:]) * w).sum()) / 6 + a * y0
    return (sx / total, sy / total) if total > 0 else None


def measures(polygons: DataFrame, key: str, parts: str = "parts") -> DataFrame:
    """(key, area_m2, px, py, cx, cy, valid): ellipsoidal area, representative point, centroid, and whether no ring crosses itself.

    Not valid are also polygons of which nothing is left once repeated points
    and rings without area are dropped; with quarantine() they go apart.
    """
    kind = polygons.schema[key].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> dict:
        p = B.read(batch.column(parts))
        points = dict(zip(("px", "py", "cx", "cy"), (*B.representative_points(p), *B.centroids(p)), strict=True))
        found = {n: pa.array(v, mask=np.isnan(v)) for n, v in points.items()}
        some = np.bincount(p.row, minlength=p.rows) > 0
        return {key: batch.column(key), "area_m2": p.geodesic_area(), **found, "valid": some & ~B.crosses_itself(p)}

    return by_batch(polygons.select(key, parts), run, f"`{key}` {kind}, area_m2 double, px double, py double, cx double, cy double, valid boolean")


def bounds(polygons: DataFrame, parts: str = "parts") -> DataFrame:
    """The polygons with minx, miny, maxx, maxy."""
    xs, ys = (F.flatten(F.transform(parts, lambda p: F.transform(p["shell"], lambda q: q[c]))) for c in ("x", "y"))
    return polygons.withColumns({"minx": F.array_min(xs), "miny": F.array_min(ys), "maxx": F.array_max(xs), "maxy": F.array_max(ys)})


def _pairs(left: DataFrame, right: DataFrame, left_key: str, right_key: str, cell: float, keep: tuple[str, ...] = ()) -> tuple[DataFrame, str]:
    """Polygons whose bounds meet, with the parts of both and left columns, and the schema of the keys and those columns.

    The parts go along to the cells and are not joined by key afterwards: as a
    table that looks small to the planner all polygons would be sent through the driver.
    """
    a = bounds(left.select(left_key, *keep, F.col("parts").alias("p1")), "p1")
    b = bounds(right.select(right_key, F.col("parts").alias("p2")), "p2")
    both = boxes_intersect(a, b, left_key, right_key, cell, ["p1", "p2", *keep]).select(left_key, right_key, *keep, "p1", "p2")
    return both, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in both.schema if f.name not in ("p1", "p2"))


def overlay(left: DataFrame, right: DataFrame, left_key: str, right_key: str, cell: float = 1.0) -> DataFrame:
    """(left key, right key, area_m2, plane, rest, both) of every pair that shares an area.

    area_m2 is the ellipsoidal and plane the plane area of the intersection,
    rest the plane area of left without right, both that of their union.
    """
    found, keys = _pairs(left, right, left_key, right_key, cell)

    def run(batch: pa.RecordBatch) -> dict:
        p, q = B.read(batch.column("p1")), B.read(batch.column("p2"))
        area, plane = B.common_areas(p, q)
        of_p, of_q = p.plane_area(), q.plane_area()
        return {left_key: batch.column(left_key), right_key: batch.column(right_key), "area_m2": area, "plane": plane, "rest": of_p - plane, "both": of_p + of_q - plane}

    return by_batch(found, run, f"{keys}, area_m2 double, plane double, rest double, both double").filter("plane > 0")


def relations(left: DataFrame, right: DataFrame, left_key: str, right_key: str, cell: float = 1.0, keep: tuple[str, ...] = ()) -> DataFrame:
    """(left key, right key, left columns `keep`, within) of every pair that shares an area."""
    found, keys = _pairs(left, right, left_key, right_key, cell, keep)

    def run(batch: pa.RecordBatch) -> dict:
        meets, within = B.relate(B.read(batch.column("p1")), B.read(batch.column("p2")))
        return {**{c: batch.column(c) for c in (left_key, right_key, *keep)}, "meets": meets, "within": within}

    return by_batch(found, run, f"{keys}, meets boolean, within boolean").filter("meets").drop("meets")


def cut_to_cells(polygons: DataFrame, key: str, grid: Grid, parts: str = "parts", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, row, col, area_m2, plane) and the columns `keep`: what of each polygon lies in each cell."""
    own = (key, *keep)
    kinds = ", ".join(f"`{c}` {polygons.schema[c].dataType.simpleString()}" for c in own)

    def run(batch: pa.RecordBatch) -> dict:
        poly, row, col, area, plane = B.cut_to_cells(B.read(batch.column(parts)), grid)
        return {**{c: batch.column(c).take(pa.array(poly)) for c in own}, "row": row.astype("int32"), "col": col.astype("int32"), "area_m2": area, "plane": plane}

    return by_batch(polygons.select(*own, parts), run, f"{kinds}, row int, col int, area_m2 double, plane double").filter("plane > 0")


def class_cut(polygons: DataFrame, key: str, cover: DataFrame, grid: Grid, classes: tuple[int, ...]) -> DataFrame:
    """(key, cl<k>_km2, cl<k>_plane): area of the classes in each polygon; null where no cell is covered, 0 where none has the class.

    polygons hold key, year, parts; cover holds year, row, col, value.
    """
    met = cut_to_cells(polygons, key, grid, keep=("year",)).join(cover, ["year", "row", "col"])
    of = lambda k, v: F.sum(F.when(F.col("value") == k, F.col(v)).otherwise(0.0))
    sums = met.groupBy(key).agg(*[x for k in classes for x in ((of(k, "area_m2") / 1e6).alias(f"cl{k}_km2"), of(k, "plane").alias(f"cl{k}_plane"))])
    return polygons.select(key).join(sums, key, "left")


def dissolve(polygons: DataFrame, by: str, parts: str = "parts") -> DataFrame:
    """(by, parts): the parts of all polygons of a name together, which may overlap; a layer's names are few."""
    return polygons.filter(F.col(parts).isNotNull()).groupBy(by).agg(F.flatten(F.collect_list(parts)).alias("parts"))


def country_cascade(polygons: DataFrame, countries: DataFrame, key: str, code: str, cell: float = 1.0) -> DataFrame:
    """(key, code, name, attempt): by intersection, else by the centroid within, else the nearest country.

    countries: country_id (the table's order), code, name, parts.  Of several
    that a polygon shares an area with, one whose code equals the polygon's own
    (column `code`) comes first, then the table's order; code and name are each
    the first that isn't null, so they may come from two rows.  Polygons left
    without a name go to the next attempt, which knows named countries only; the
    last has no largest distance.
    """
    own = polygons.select(key, "parts", F.col(code).alias("own"))
    met = relations(own, countries, key, "country_id", cell, ("own",)).join(countries.select("country_id", "code", "name"), "country_id")
    order = F.struct((~F.coalesce(F.col("code") == F.col("own"), F.lit(False))).alias("other"), "country_id")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c)
    # each attempt is read several times
    one = materialize(met.groupBy(key).agg(first("code"), first("name")).filter("name is not null").withColumn("attempt", F.lit(1)), "met")
    rest = materialize(measures(polygons.join(one.select(key), key, "left_anti"), key).filter("cx is not null").select(key, "cx", "cy"), "unmet")
    inside_ = points_in_polygons(rest, key, edges_of(countries, "country_id"), "country_id", "cx", "cy", cell)
    two = inside_.join(countries.select("country_id", "code", "name").filter("name is not null"), "country_id").groupBy(key).agg(F.min_by(F.struct("code", "name"), "country_id").alias("c"))
    two = materialize(two.select(key, "c.code", "c.name", F.lit(2).alias("attempt")), "within")
    rest = materialize(rest.join(two.select(key), key, "left_anti"), "outside")
    box = bounds(countries.select("country_id", "code", "name", "parts")).filter("name is not null")
    near = nearest_box(rest, box, [key], F.struct("code", "name"), F.col("country_id"), "cx", "cy", FEW_BOXES)
    return one.unionByName(two).unionByName(near.select(key, "value.code", "value.name", F.lit(3).alias("attempt")))
