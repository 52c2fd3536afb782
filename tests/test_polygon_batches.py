"""The kernels over batches against those over single polygons."""

import numpy as np
import pyarrow as pa
import pytest

from emberline.operators import polygon_batches as B
from emberline.operators import polygons as G
from emberline.operators.raster import Grid

RING = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
PARTS = pa.list_(pa.struct([("shell", RING), ("holes", pa.list_(RING))]))


def ring(rng, n, x, y, size):
    angle = np.sort(rng.uniform(0, 2 * np.pi, n))
    r = size * rng.uniform(0.3, 1, n)
    pts = np.stack([x + r * np.cos(angle), y + r * np.sin(angle)], axis=1)
    if rng.random() < 0.3:
        pts = np.round(pts, 1)  # repeated points, level edges, shared borders
    return [{"x": float(p), "y": float(q)} for p, q in (np.vstack([pts, pts[:1]]) if rng.random() < 0.7 else pts)]


def layer(seed, n=300):
    """Stars with holes, several parts, bow-ties, rings without area, nothing."""
    rng, out = np.random.default_rng(seed), [None, [], [{"shell": [], "holes": None}]]
    while len(out) < n:
        parts = []
        for _ in range(rng.integers(1, 4)):
            x, y = rng.uniform(0, 5, 2)
            shell = ring(rng, rng.integers(2, 9), x, y, 2.0)
            if rng.random() < 0.1:
                rng.shuffle(shell)
            parts.append({"shell": shell, "holes": [ring(rng, rng.integers(2, 6), x, y, 0.4) for _ in range(rng.integers(0, 3))] if rng.random() < 0.8 else None})
        out.append(parts)
    return out


A, C = layer(1), layer(2)[::-1]


@pytest.fixture(scope="module", params=[B.BLOCK, 7])
def batches(request):
    """Both layers, with the slices and the nulls that Arrow may have, and with small blocks."""
    whole, B.BLOCK = B.BLOCK, request.param
    yield [B.read(pa.array([None, *v, None], PARTS)[1:-1]) for v in (A, C)]
    B.BLOCK = whole


def test_areas_and_points(batches):
    a = batches[0]
    parts = [G.to_parts(v) for v in A]
    assert a.plane_area() == pytest.approx([G.plane_area(p) for p in parts], abs=1e-12)
    assert a.geodesic_area() == pytest.approx([G.geodesic_area(p) for p in parts], rel=1e-9)
    none = (np.nan, np.nan)
    assert np.stack(B.representative_points(a), axis=1).tolist() == pytest.approx([pytest.approx(G.representative_point(p) or none, nan_ok=True, abs=1e-12) for p in parts])
    assert np.stack(B.centroids(a), axis=1).tolist() == [pytest.approx(G.centroid(p) or none, nan_ok=True, rel=1e-6) for p in parts]
    assert B.crosses_itself(a).tolist() == [any(G.crosses_itself(r) for s, h in p for r in (s, *h)) for p in parts]


def test_pairs(batches):
    a, c = batches
    parts = [(G.to_parts(v), G.to_parts(w)) for v, w in zip(A, C, strict=True)]
    assert list(zip(*(x.tolist() for x in B.relate(a, c)), strict=True)) == [G.relate(p, q) for p, q in parts]
    area, plane = B.common_areas(a, c)
    met = [G.intersection(p, q) for p, q in parts]
    assert plane == pytest.approx([G.plane_area(m) for m in met], abs=1e-12)
    assert area == pytest.approx([G.geodesic_area(m) for m in met], rel=1e-9, abs=1e-3)


@pytest.mark.parametrize("rule", ["all_touched", "center"])
def test_cells(batches, rule):
    grid = Grid(0.0, 5.0, 0.5, 0.7, 8, 8)  # a part of the layer is outside
    want = [(i, r, c) for i, v in enumerate(A) for r, c in G.touched_cells(G.to_parts(v), grid, rule).tolist()]
    assert list(zip(*(x.tolist() for x in B.touched_cells(batches[0], grid, rule)), strict=True)) == want
    if rule == "all_touched":
        *_, area, plane = B.cut_to_cells(batches[0], grid)
        boxes = [(i, c * 0.5, 5 - (r + 1) * 0.7, (c + 1) * 0.5, 5 - r * 0.7) for i, r, c in want]
        cut = [G.clip_box(G.to_parts(A[i]), *box) for i, *box in boxes]
        assert plane == pytest.approx([G.plane_area(p) for p in cut], abs=1e-12)
        assert area == pytest.approx([G.geodesic_area(p) for p in cut], rel=1e-6, abs=1e-3)  # rings flatter than the sums tell may stay or go


def test_nothing():
    none = B.read(pa.array([], PARTS))
    assert none.rows == 0 and [len(x) for x in B.relate(none, none)] == [0, 0] and len(B.common_areas(none, none)[1]) == 0
    null = B.read(pa.array([None], PARTS))
    assert np.isnan(B.representative_points(null)).all() and not B.relate(null, null)[0][0] and null.geodesic_area().tolist() == [0]
    assert [len(x) for x in B.cut_to_cells(null, Grid(0.0, 5.0, 0.5, 0.7, 8, 8))] == [0] * 5


def test_point_of_a_vertex_halfway_up():
    for k in range(1999):  # at some heights, as -15.99, the middle of top and bottom is rounded above the vertex between them
        cy, hy = -19.5 + k / 100, 0.002 + 0.003 * 12
        star = [{"x": x * 0.05 - 70, "y": cy + hy * y} for x, y in ((1, 0), (0.25, 0.25), (0, 1), (-0.25, 0.25), (-1, 0), (-0.25, -0.25), (0, -1), (0.25, -0.25), (1, 0))]
        parts = [{"shell": star, "holes": None}]
        assert G.representative_point(G.to_parts(parts))[1] == pytest.approx(cy - hy / 8, abs=1e-9)
        assert B.representative_points(B.read(pa.array([parts], PARTS)))[1][0] == pytest.approx(cy - hy / 8, abs=1e-9)
