"""The kernels of polygons.py over whole Arrow batches: ragged arrays instead of a loop over polygons.

The rings of all polygons of a batch lie one after the other; what is decided
for one polygon there is decided here for all, by the same formulas.  Products
of lists (edges of one polygon with those of another) come in blocks, so that
memory doesn't grow with them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from emberline.functions.geo import AUTHALIC_R2, E1, E2, Q_POLE
from emberline.operators.raster import Grid

#: Pairs of edges that are held at once.
BLOCK = 1 << 16
#: What the middle of two coordinates may be off by, as a share of the larger.
ROUNDING = 2.0**-51


def spread(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(list, place in it) of every item of lists of these sizes."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def blocks(first: np.ndarray, many: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of each i with j from first[i] on, as many as many[i], some BLOCK at a time."""
    ends = np.cumsum(many)
    low = 0
    while low < len(many):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + BLOCK, side="right")))
        i, place = spread(many[low:high])
        if len(i):
            yield i + low, first[low:high][i] + place
        low = high


def _count(counts: np.ndarray, at: np.ndarray, of: np.ndarray) -> None:
    """Add to counts[at] where `of` holds."""
    at = at[of]
    if len(at):
        low = at.min()
        got = np.bincount(at - low)
        counts[low : low + len(got)] += got


@dataclass
class Rings:
    """Clean rings of `rows` polygons, in their order; a shell comes before its holes."""

    rows: int
    row: np.ndarray  # of each ring
    part: np.ndarray
    shell: np.ndarray
    size: np.ndarray  # points of each ring
    xy: np.ndarray  # points of all rings
    area: np.ndarray  # signed

    @cached_property
    def start(self) -> np.ndarray:
        return np.cumsum(self.size) - self.size

    @cached_property
    def ring(self) -> np.ndarray:
        """The ring of each point."""
        return np.repeat(np.arange(len(self.size)), self.size)

    @cached_property
    def edge_at(self) -> np.ndarray:
        """The point that each edge starts from."""
        return np.flatnonzero(self.ring[:-1] == self.ring[1:])

    @cached_property
    def edges(self) -> np.ndarray:
        """(4, n): x1, y1, x2, y2."""
        return np.ascontiguousarray(np.hstack([self.xy[self.edge_at], self.xy[self.edge_at + 1]]).T)

    @cached_property
    def edge_row(self) -> np.ndarray:
        return self.row[self.ring[self.edge_at]]

    @cached_property
    def sign(self) -> np.ndarray:
        """1 for shells, -1 for holes."""
        return np.where(self.shell, 1.0, -1.0)

    def total(self, of_rings: np.ndarray) -> np.ndarray:
        """Sums by polygon, holes taken off."""
        return np.bincount(self.row, self.sign * of_rings, minlength=self.rows)

    def plane_area(self) -> np.ndarray:
        return self.total(np.abs(self.area))

    def geodesic_area(self) -> np.ndarray:
        x1, y1, x2, y2 = self.edges
        t = _half_tangent(self.xy[:, 1])
        arcs = np.bincount(self.ring[self.edge_at], _arc(x2 - x1, t[self.edge_at], t[self.edge_at + 1]), minlength=len(self.size))
        return self.total(AUTHALIC_R2 * np.abs(arcs))

    def repeated(self, rows: np.ndarray) -> tuple[np.ndarray, ...]:
        """(row, part, shell, size, xy) of the rings of these polygons, which may come several times."""
        many = np.bincount(self.row, minlength=self.rows)
        new, place = spread(many[rows])
        ring = (np.cumsum(many) - many)[rows][new] + place
        at, step = spread(self.size[ring])
        part = np.cumsum(self.shell[ring]) - 1
        return new, part, self.shell[ring], self.size[ring], self.xy[self.start[ring][at] + step]


def _half_tangent(lat: np.ndarray) -> np.ndarray:
    s = np.sin(np.radians(lat))
    q = (1 - E2) * (s / (1 - E2 * s * s) - np.log((1 - E1 * s) / (1 + E1 * s)) / (2 * E1)) / Q_POLE
    return np.tan(np.arcsin(np.clip(q, -1, 1)) / 2)


def _arc(dx: np.ndarray, t1: np.ndarray, t2: np.ndarray) -> np.ndarray:
    return 2 * np.arctan2(np.tan(np.radians(dx) / 2) * (t1 + t2), 1 + t1 * t2)


def _tidy(rows: int, row: np.ndarray, part: np.ndarray, shell: np.ndarray, size: np.ndarray, xy: np.ndarray) -> Rings:
    """Rings closed and without repeated points; those without area are dropped, with a shell its holes."""
    ring, place = spread(size)
    new = place == 0
    new[1:] |= (xy[1:] != xy[:-1]).any(1)
    size, xy = np.bincount(ring[new], minlength=len(size)), xy[new]
    start = np.cumsum(size) - size
    some = np.flatnonzero(size)
    gaps = some[(xy[start[some]] != xy[start[some] + size[some] - 1]).any(1)]
    xy = np.insert(xy, (start + size)[gaps], xy[start[gaps]], axis=0)
    size[gaps] += 1
    ring = np.repeat(np.arange(len(size)), size)
    x, y = (xy - xy[(np.cumsum(size) - size)[ring]]).T  # near the origin, for precision
    side = ring[:-1] == ring[1:]
    area = np.bincount(ring[:-1][side], (x[:-1] * y[1:] - x[1:] * y[:-1])[side], minlength=len(size)) / 2
    ok = (size >= 4) & (np.abs(area) > 0)
    whole = np.zeros(int(part.max()) + 1 if len(part) else 0, bool)
    whole[part[ok & shell]] = True
    ok &= whole[part]
    return Rings(rows, row[ok], part[ok], shell[ok], size[ok], xy[ok[ring]], area[ok])


def _lists(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(sizes, items) of a column of lists; null is empty."""
    return pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64), column.flatten()


def read(column: pa.Array) -> Rings:
    """The polygons of a column of parts."""

    def points(rings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        size, items = _lists(rings)
        return size, np.stack([pc.struct_field(items, c).to_numpy(zero_copy_only=False).astype(float) for c in ("x", "y")], axis=1)

    parts_of, parts = _lists(column)
    shell_size, shell_xy = points(pc.struct_field(parts, "shell"))
    holes_of, holes = _lists(pc.struct_field(parts, "holes"))
    hole_size, hole_xy = points(holes)
    part = np.concatenate([np.arange(len(parts)), spread(holes_of)[0]])
    order = np.argsort(part, kind="stable")
    size, xy = np.concatenate([shell_size, hole_size]), np.concatenate([shell_xy, hole_xy])
    at, step = spread(size[order])
    xy = xy[(np.cumsum(size) - size)[order][at] + step]
    return _tidy(len(column), spread(parts_of)[0][part[order]], part[order], order < len(parts), size[order], xy)


def _by_row(row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, many) by polygon of items that are in its order."""
    many = np.bincount(row, minlength=rows)
    return np.cumsum(many) - many, many


def _left_of(px: np.ndarray, py: np.ndarray, x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray) -> np.ndarray:
    """Whether a ray from the point crosses the edge; horizontal ones never."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return ((y1 > py) != (y2 > py)) & (px < (x2 - x1) * (py - y1) / (y2 - y1) + x1)


def _apart(x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray, u1: np.ndarray, v1: np.ndarray, u2: np.ndarray, v2: np.ndarray) -> np.ndarray:
    """Whether the line of the first edge has the ends of the second on its two sides."""
    dx, dy = x2 - x1, y2 - y1
    return np.sign(dx * (v1 - y1) - dy * (u1 - x1)) * np.sign(dx * (v2 - y1) - dy * (u2 - x1)) < 0


def relate(a: Rings, b: Rings) -> tuple[np.ndarray, np.ndarray]:
    """relate() of polygons.py for each row."""
    cross, in_b, in_a = np.zeros(a.rows, bool), np.zeros(a.edges.shape[1], np.int64), np.zeros(b.edges.shape[1], np.int64)
    first, many = _by_row(b.edge_row, b.rows)
    for i, j in blocks(first[a.edge_row], many[a.edge_row]):
        p, q = a.edges[:, i], b.edges[:, j]
        met = _apart(*p, *q) & _apart(*q, *p)
        cross[a.edge_row[i[met]]] = True
        _count(in_b, i, _left_of(p[0], p[1], *q))
        _count(in_a, j, _left_of(q[0], q[1], *p))
    some = (np.bincount(a.edge_row, minlength=a.rows) > 0) & (many > 0)
    odd_a, odd_b = (np.bincount(r, n % 2, minlength=a.rows) for r, n in ((a.edge_row, in_b), (b.edge_row, in_a)))
    meets = some & (cross | (odd_a > 0) | (odd_b > 0))
    return meets, some & ~cross & (odd_a == np.bincount(a.edge_row, minlength=a.rows)) & (odd_b == 0)


def _crossings(a: Rings, b: Rings) -> tuple[np.ndarray, np.ndarray]:
    """(row, height) where edges of a and b cross."""
    first, many = _by_row(b.edge_row, b.rows)
    rows, heights = [np.zeros(0, np.int64)], [np.zeros(0)]
    for i, j in blocks(first[a.edge_row], many[a.edge_row]):
        x1, y1, x2, y2 = a.edges[:, i]
        u1, v1, u2, v2 = b.edges[:, j]
        dx, dy, du, dv = x2 - x1, y2 - y1, u2 - u1, v2 - v1
        den = dx * dv - dy * du
        with np.errstate(divide="ignore", invalid="ignore"):
            t = ((u1 - x1) * dv - (v1 - y1) * du) / den
            u = ((u1 - x1) * dy - (v1 - y1) * dx) / den
            k = np.flatnonzero((den != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1))
        rows.append(a.edge_row[i[k]])
        heights.append(y1[k] + t[k] * dy[k])
    return np.concatenate(rows), np.concatenate(heights)


def _intervals(a: Rings, row: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    """(strip, left and right at the lower level, left and right at the upper) of the polygons' intervals in strips."""
    sloped = a.edges[1] != a.edges[3]
    e, first, many = a.edges[:, sloped], *_by_row(a.edge_row[sloped], a.rows)
    below, above = np.minimum(e[1], e[3]), np.maximum(e[1], e[3])
    strips, edges = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for s, k in blocks(first[row], many[row]):
        on = (below[k] <= low[s]) & (above[k] >= high[s])
        strips.append(s[on])
        edges.append(k[on])
    s, k = np.concatenate(strips), np.concatenate(edges)
    x1, y1, x2, y2 = e[:, k]
    at1, at2 = (x1 + (x2 - x1) * (y - y1) / (y2 - y1) for y in (low[s], high[s]))
    order = np.lexsort(((at1 + at2) / 2, s))
    s, at1, at2 = s[order], at1[order], at2[order]
    many = np.bincount(s, minlength=len(row))
    place = spread(many)[1]
    k = np.flatnonzero((place % 2 == 0) & (place + 1 < many[s]))
    return s[k], at1[k], at1[k + 1], at2[k], at2[k + 1]


def common_areas(a: Rings, b: Rings) -> tuple[np.ndarray, np.ndarray]:
    """(ellipsoidal, plane) area of what a and b have in common, as the trapezoids of intersection() in polygons.py."""
    geodesic, plane = np.zeros(a.rows), np.zeros(a.rows)
    bottom, top = np.full(a.rows, -np.inf), np.full(a.rows, np.inf)
    for p in (a, b):
        low, high = np.full(a.rows, np.inf), np.full(a.rows, -np.inf)
        np.minimum.at(low, p.row[p.ring], p.xy[:, 1])
        np.maximum.at(high, p.row[p.ring], p.xy[:, 1])
        bottom, top = np.maximum(bottom, low), np.minimum(top, high)
    cut = _crossings(a, b)
    row = np.concatenate([a.row[a.ring], b.row[b.ring], cut[0]])
    y = np.concatenate([a.xy[:, 1], b.xy[:, 1], cut[1]])
    both = (y >= bottom[row]) & (y <= top[row])  # only one of the two is outside
    row, y = row[both], y[both]
    order = np.lexsort((y, row))
    row, y = row[order], y[order]
    strip = np.flatnonzero((row[:-1] == row[1:]) & (y[:-1] < y[1:]))
    row, low, high = row[strip], y[strip], y[strip + 1]
    s, al, ar, bl, br = _intervals(a, row, low, high)
    s2, cl, cr, dl, dr = _intervals(b, row, low, high)
    first, many = _by_row(s2, len(row))
    for i, j in blocks(first[s], many[s]):
        l1, r1, l2, r2 = np.maximum(al[i], cl[j]), np.minimum(ar[i], cr[j]), np.maximum(bl[i], dl[j]), np.minimum(br[i], dr[j])
        k = np.flatnonzero((r1 - l1 + r2 - l2 > 0) & (r1 >= l1 - 1e-12) & (r2 >= l2 - 1e-12))
        at, l1, l2 = s[i[k]], l1[k], l2[k]
        r1, r2 = np.maximum(r1[k], l1), np.maximum(r2[k], l2)
        t1, t2 = _half_tangent(low[at]), _half_tangent(high[at])
        arcs = _arc(r1 - l1, t1, t1) + _arc(r2 - r1, t1, t2) + _arc(l2 - r2, t2, t2) + _arc(l1 - l2, t2, t1)
        np.add.at(plane, row[at], (r1 - l1 + r2 - l2) / 2 * (high[at] - low[at]))
        np.add.at(geodesic, row[at], AUTHALIC_R2 * np.abs(arcs))
    return geodesic, plane


def clip_boxes(a: Rings, rows: np.ndarray, minx: np.ndarray, miny: np.ndarray, maxx: np.ndarray, maxy: np.ndarray) -> Rings:
    """Polygons, by their rows, each cut to its box; the result has one polygon for each box."""
    got = _tidy(len(rows), *a.repeated(rows))
    corners = ((minx, miny), (maxx, miny), (maxx, maxy), (minx, maxy), (minx, miny))
    for (x1, y1), (x2, y2) in zip(corners[:-1], corners[1:], strict=True):
        of = got.row[got.ring]
        d = ((y2 - y1)[of] * got.xy[:, 0] + (x1 - x2)[of] * got.xy[:, 1]) - ((y2 - y1) * x1 - (x2 - x1) * y1)[of]
        if not (d > 0).any():
            continue
        k = got.edge_at
        p, q, dp, dq = got.xy[k], got.xy[k + 1], d[k], d[k + 1]
        cut = ((dp < 0) & (dq > 0)) | ((dq < 0) & (dp > 0))
        share = np.divide(dp, dp - dq, out=np.zeros(len(dp)), where=cut)
        some = np.stack([dp <= 0, cut], axis=1)
        xy = np.stack([p, p + (q - p) * share[:, None]], axis=1)[some]
        size = np.bincount(np.repeat(got.ring[k], 2)[some.ravel()], minlength=len(got.size))
        got = _tidy(len(rows), got.row, got.part, got.shell, size, xy)
    return got


def touched_cells(a: Rings, g: Grid, rule: str = "all_touched") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(polygon, row, col) of touched_cells() of polygons.py."""
    if rule not in ("all_touched", "center"):
        raise ValueError(f"no pixel rule {rule!r}")
    outer = a.shell[a.ring]
    x, y, of = a.xy[outer, 0], a.xy[outer, 1], a.row[a.ring[outer]]
    low, high = np.full((2, a.rows), np.inf), np.full((2, a.rows), -np.inf)
    for i, v in enumerate((x, y)):
        np.minimum.at(low[i], of, v)
        np.maximum.at(high[i], of, v)
    some = np.flatnonzero(np.isfinite(low[0]))
    c0, c1, r0, r1 = np.zeros((4, a.rows), np.int64)
    c1 -= 1
    c0[some], c1[some] = np.maximum(0, np.floor((low[0, some] - g.west) / g.width)), np.minimum(g.cols - 1, np.floor((high[0, some] - g.west) / g.width))
    r0[some], r1[some] = np.maximum(0, np.floor((g.north - high[1, some]) / g.height)), np.minimum(g.rows - 1, np.floor((g.north - low[1, some]) / g.height))
    wide, tall = np.maximum(c1 - c0 + 1, 0), np.maximum(r1 - r0 + 1, 0)
    poly, place = spread(wide * tall)
    base = np.cumsum(wide * tall) - wide * tall
    row, col = r0[poly] + place // np.maximum(wide[poly], 1), c0[poly] + place % np.maximum(wide[poly], 1)
    cx, cy = g.west + (col + 0.5) * g.width, g.north - (row + 0.5) * g.height
    count = np.zeros(len(poly), np.int64)
    first, many = _by_row(a.edge_row, a.rows)
    for i, j in blocks(first[poly], many[poly]):
        _count(count, i, _left_of(cx[i], cy[i], *a.edges[:, j]))
    hit = count % 2 == 1
    if rule == "all_touched":
        x1, y1, x2, y2 = a.edges
        # the cells an edge passes: cut it at every grid line, and take the cell of each piece's middle
        t, of = [np.zeros(len(x1)), np.ones(len(x1))], [np.arange(len(x1))] * 2
        for p, q, lo, hi, at in (
            (x1, x2, (np.minimum(x1, x2) - g.west) / g.width, (np.maximum(x1, x2) - g.west) / g.width, lambda k: g.west + k * g.width),
            (y1, y2, (g.north - np.maximum(y1, y2)) / g.height, (g.north - np.minimum(y1, y2)) / g.height, lambda k: g.north - k * g.height),
        ):
            lines = np.where(p != q, np.maximum(np.floor(hi) - np.ceil(lo) + 1, 0), 0).astype(np.int64)
            e, k = spread(lines)
            t.append((at(np.ceil(lo)[e] + k) - p[e]) / (q[e] - p[e]))
            of.append(e)
        t, of = np.clip(np.concatenate(t), 0, 1), np.concatenate(of)
        order = np.lexsort((t, of))
        t, of = t[order], of[order]
        k = np.flatnonzero((of[:-1] == of[1:]) & (t[:-1] < t[1:]))
        m, e = (t[k + 1] + t[k]) / 2, of[k]
        poly_of = a.edge_row[e]
        r = np.floor((g.north - (y1[e] + m * (y2[e] - y1[e]))) / g.height).astype(np.int64) - r0[poly_of]
        c = np.floor((x1[e] + m * (x2[e] - x1[e]) - g.west) / g.width).astype(np.int64) - c0[poly_of]
        ok = (r >= 0) & (c >= 0) & (r < tall[poly_of]) & (c < wide[poly_of])
        hit[(base[poly_of] + r * wide[poly_of] + c)[ok]] = True
    return poly[hit], row[hit], col[hit]


def cut_to_cells(a: Rings, g: Grid) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(polygon, row, col, ellipsoidal area, plane area) of what lies in each touched cell."""
    poly, row, col = touched_cells(a, g)
    x, y = g.west + col * g.width, g.north - row * g.height
    piece = clip_boxes(a, poly, x, y - g.height, x + g.width, y)
    return poly, row, col, piece.geodesic_area(), piece.plane_area()


def crosses_itself(a: Rings) -> np.ndarray:
    """Whether two edges of one ring cross properly, for each polygon."""
    out = np.zeros(a.rows, bool)
    ring = a.ring[a.edge_at]
    first, many = _by_row(ring, len(a.size))
    own = np.arange(len(ring))
    for i, j in blocks(own + 1, (first + many)[ring] - own - 1):
        p, q = a.edges[:, i], a.edges[:, j]
        met = _apart(*p, *q) & _apart(*q, *p)
        out[a.edge_row[i[met]]] = True
    return out


def centroids(a: Rings) -> tuple[np.ndarray, np.ndarray]:
    """Area-weighted plane centroids, holes taken off; NaN without area."""
    x0, y0 = a.xy[a.start].T if len(a.start) else np.zeros((2, 0))
    ring = a.ring[a.edge_at]
    x1, y1, x2, y2 = a.edges - np.stack([x0, y0, x0, y0])[:, ring]  # near the origin, for precision
    w = x1 * y2 - x2 * y1
    sums = [np.bincount(ring, v, minlength=len(a.size)) for v in (w, (x1 + x2) * w, (y1 + y2) * w)]
    sign = np.sign(sums[0])
    area = sign * sums[0] / 2
    total = a.total(area)
    with np.errstate(divide="ignore", invalid="ignore"):
        return tuple(np.where(total > 0, a.total(sign * s / 6 + area * o) / total, np.nan) for s, o in ((sums[1], x0), (sums[2], y0)))


def representative_points(a: Rings) -> tuple[np.ndarray, np.ndarray]:
    """representative_point() of polygons.py for each polygon; NaN for none."""
    size = np.where(a.shell, np.abs(a.area), -1.0)
    best = np.full(a.rows, -1.0)
    np.maximum.at(best, a.row, size)
    ring = np.flatnonzero(a.shell & (size == best[a.row]))[::-1]
    largest = np.full(a.rows, -1)
    largest[a.row[ring]] = a.part[ring]  # the first of equals, written last
    on = (a.part == largest[a.row])[a.ring]
    y, row = a.xy[on, 1], a.row[a.ring[on]]

    def end(of: np.ufunc, y: np.ndarray, row: np.ndarray) -> np.ndarray:
        out = np.full(a.rows, np.inf if of is np.minimum else -np.inf)
        of.at(out, row, y)
        return out

    bottom, top = end(np.minimum, y, row), end(np.maximum, y, row)
    with np.errstate(invalid="ignore"):
        mid = (bottom + top) / 2 - ROUNDING * np.maximum(np.abs(bottom), np.abs(top))  # a vertex halfway up is not under it
    under = y < mid[row]
    below, above = end(np.maximum, y[under], row[under]), end(np.minimum, y[~under], row[~under])
    flat = np.isinf(below) & np.isfinite(bottom)  # the middle is rounded to the bottom
    over = y > bottom[row]
    below, above = np.where(flat, bottom, below), np.where(flat, end(np.minimum, y[over], row[over]), above)
    with np.errstate(invalid="ignore"):
        at = (below + above) / 2  # between vertices
    e = a.edges[:, on[a.edge_at]]
    row = a.edge_row[on[a.edge_at]]
    k = np.flatnonzero((e[1] > at[row]) != (e[3] > at[row]))
    (x1, y1, x2, y2), row = e[:, k], row[k]
    x = x1 + (x2 - x1) * (at[row] - y1) / (y2 - y1)
    order = np.lexsort((x, row))
    x, row = x[order], row[order]
    many = np.bincount(row, minlength=a.rows)
    k = np.flatnonzero((spread(many)[1] % 2 == 0) & (spread(many)[1] + 1 < many[row]))
    width = x[k + 1] - x[k]
    widest = end(np.maximum, width, row[k])
    k = k[width == widest[row[k]]][::-1]
    px = np.full(a.rows, np.nan)
    px[row[k]] = (x[k] + x[k + 1]) / 2
    return px, np.where(np.isnan(px), np.nan, at)
