"""Borders, growth and detection against versions that share no code with the library."""

from __future__ import annotations

import math

import numpy as np
import pytest

from docweave.operators import detect
from docweave.sources.config import Detection


def flood(on: np.ndarray, steps) -> list[set]:
    """Connected sets of pixels (x, y), by their first pixel by row."""
    left, out = {(int(x), int(y)) for y, x in np.argwhere(on)}, []
    for x, y in sorted(left, key=lambda p: (p[1], p[0])):
        if (x, y) not in left:
            continue
        todo, own = [(x, y)], set()
        left.discard((x, y))
        while todo:
            a, b = todo.pop()
            own.add((a, b))
            for dx, dy in steps:
                if (a + dx, b + dy) in left:
                    left.discard((a + dx, b + dy))
                    todo.append((a + dx, b + dy))
        out.append(own)
    return out


FOUR = [(1, 0), (-1, 0), (0, 1), (0, -1)]
EIGHT = FOUR + [(1, 1), (1, -1), (-1, 1), (-1, -1)]


def borders(mask: np.ndarray) -> set:
    """(is a hole, its border's pixels) of each region and hole: pixels with background of the right side as a 4-neighbour."""
    wide = np.pad(mask, 1)
    regions, gaps = flood(wide, EIGHT), flood(~wide, FOUR)
    touch = lambda region, gap: frozenset((x - 1, y - 1) for x, y in region if any((x + dx, y + dy) in gap for dx, dy in FOUR))
    out = set()
    for gap in gaps:
        around = [r for r in regions if touch(r, gap)]
        if (0, 0) in gap:
            out |= {(False, touch(r, gap)) for r in around}
            continue
        first = min(gap, key=lambda p: (p[1], p[0]))
        owner = next(r for r in regions if (first[0] - 1, first[1]) in r)  # left of a hole's first pixel lies what encloses it
        out |= {(False, touch(r, gap)) for r in around if r is not owner}
        out.add((True, touch(owner, gap)))
    return out


@pytest.mark.parametrize("seed", range(30))
def test_borders_of_random_masks(seed):
    rng = np.random.default_rng(seed)
    mask = rng.random((rng.integers(1, 14), rng.integers(1, 14))) < rng.choice([0.3, 0.5, 0.7, 0.9])
    found = detect.contours(mask)
    assert {(c.hole, frozenset(map(tuple, c.points.tolist()))) for c in found} == borders(mask)
    assert len(found) == len(borders(mask))
    starts = [(int(c.points[0][1]), int(c.points[0][0])) for c in found]
    assert starts == sorted(starts)
    for c in found:  # each step goes to a neighbour, and the last back to the first
        steps = np.abs(np.diff(np.vstack((c.points, c.points[:1])), axis=0)).max(axis=1)
        assert len(c.points) == 1 or set(steps) == {1}


def test_order_of_a_ring_in_a_ring():
    mask = np.ones((9, 9), bool)
    mask[1:8, 1:8] = False
    mask[3:6, 3:6] = True
    mask[4, 4] = False
    got = [(c.hole, len(c.points), tuple(c.points[0])) for c in detect.contours(mask)]
    assert got == [(False, 32, (0, 0)), (True, 28, (0, 1)), (False, 8, (3, 3)), (True, 4, (3, 4))]


@pytest.mark.parametrize("polygon", [[(0, 0), (8, 0), (8, 5), (0, 5)], [(0, 0), (4, -3), (9, 1), (7, 6), (1, 5)], [(1, 5), (7, 6), (9, 1), (4, -3), (0, 0)], [(2, 2), (6, 4)], [(3, 3)]])
@pytest.mark.parametrize("distance", [0.005, 1.0, 7.5])
def test_growth_keeps_its_distance(polygon, distance):
    def away(p):
        """From the polygon, by its sides; 0 within."""
        near = math.inf
        for a, b in zip(polygon, polygon[1:] + polygon[:1], strict=True):
            d = (b[0] - a[0], b[1] - a[1])
            size = d[0] ** 2 + d[1] ** 2
            t = min(1, max(0, ((p[0] - a[0]) * d[0] + (p[1] - a[1]) * d[1]) / size)) if size else 0
            near = min(near, math.dist(p, (a[0] + t * d[0], a[1] + t * d[1])))
        return near

    out = detect.grown([(float(x), float(y)) for x, y in polygon], distance)
    assert all(abs(away(p) - distance) < 1e-9 for p in out)
    middles = [((a[0] + b[0]) / 2, (a[1] + b[1]) / 2) for a, b in zip(out, out[1:] + out[:1], strict=True)]
    assert all(distance - 0.0101 <= away(m) <= distance + 1e-9 for m in middles)
    shoelace = lambda p: abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, p[1:] + p[:1], strict=True))) / 2
    around = sum(math.dist(a, b) for a, b in zip(polygon, polygon[1:] + polygon[:1], strict=True))
    exact = shoelace(polygon) + around * distance + math.pi * distance**2
    assert exact - 0.0101 * (around + 2 * math.pi * distance) <= shoelace(out) <= exact + 1e-9


def test_detection_with_holes_and_concave_borders():
    """Whole boxes from a frame and a bracket, worked out by hand: sides grow by area * ratio / perimeter on each side."""
    values = np.zeros((40, 60), np.float32)
    values[2:22, 2:22] = 0.9
    values[8:16, 8:16] = 0.05  # a hole, whose border has a box of its own with a lower score
    values[2:32, 30:36] = values[26:32, 30:56] = 0.8  # a bracket
    got = detect.detect(values, (60, 40), (60, 40), Detection(threshold=0.3, box_threshold=0.15, unclip_ratio=1.0))
    frame, hole, bracket = (19 * 19, 76), (9 * 9, 36), (25 * 29, 108)
    grow = lambda lo, hi, size: (lo - size[0] / size[1], hi + size[0] / size[1])
    want = [(*grow(2, 21, frame), *grow(2, 21, frame)), (*grow(30, 55, bracket), *grow(2, 31, bracket)), (*grow(7, 16, hole), *grow(7, 16, hole))]
    half_up = lambda v, top: min(max(math.floor(v + 0.5), 0), top)
    boxes = sorted((half_up(a, 60), half_up(b, 60), half_up(c, 40), half_up(d, 40)) for a, b, c, d in want)
    assert sorted((min(x for x, _ in q), max(x for x, _ in q), min(y for _, y in q), max(y for _, y in q)) for q, _ in got) == boxes
    inner = values[7:17, 7:17].mean()
    assert any(abs(score - inner) < 1e-6 for _, score in got) and inner < 0.5


def test_every_mask_has_its_borders(spark, sf):
    from docweave.plans.streams import mask_borders

    rows: dict[int, list] = {}
    for r in mask_borders(spark, sf).collect():
        rows.setdefault(r.slot, []).append(r)
    assert any(r.hole for own in rows.values() for r in own)
    for e in spark.read.parquet(f"{sf}/embeddings.parquet").limit(40).collect():
        y, x = np.mgrid[0:24, 0:24]
        ring = np.minimum(np.minimum(x, y), np.minimum(23 - x, 23 - y)) % 4
        mask = (ring == 0) | (np.kron(np.array(e.embedding).reshape(8, 8), np.ones((3, 3))) > 0.05)
        want = borders(mask)
        assert sorted(r.hole for r in rows[e.vec_id]) == sorted(h for h, _ in want)
        assert sorted((r.hole, r.first_x, r.first_y) for r in rows[e.vec_id]) == sorted((c.hole, *map(int, c.points[0])) for c in detect.contours(mask))
