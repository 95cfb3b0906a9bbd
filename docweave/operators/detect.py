"""Detection maps to boxes: binary mask, borders, least-area rectangles, scores and inflation, in numpy."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docweave.sources.config import Detection

#: Fixed limits: sides of a box before and after inflation.
MIN_SIDE, MIN_INFLATED = 3.0, 5.0
Point = tuple[float, float]


def components(mask: np.ndarray) -> list[np.ndarray]:
    """(n, 2) arrays of (x, y) of the 8-connected regions, in order of their first pixel by row.

    Rows are cut into runs in numpy; only runs, not pixels, are linked one by one.
    """
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, lo = np.nonzero(edge == 1)
    hi = np.nonzero(edge == -1)[1]
    root = list(range(len(row)))

    def top(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    first = np.searchsorted(row, np.arange(mask.shape[0] + 1))
    for y in range(1, mask.shape[0]):
        i, j, end_i, end_j = first[y - 1], first[y], first[y], first[y + 1]
        while i < end_i and j < end_j:
            if lo[i] <= hi[j] and lo[j] <= hi[i]:  # ends are exclusive, so runs that meet at a corner touch
                a, b = sorted((top(i), top(j)))
                root[b] = a
            if hi[i] < hi[j]:
                i += 1
            else:
                j += 1
    out: dict[int, list[int]] = {}
    for k in range(len(row)):
        out.setdefault(top(k), []).append(k)
    return [np.concatenate([np.stack([np.arange(lo[k], hi[k]), np.full(hi[k] - lo[k], row[k])], axis=1) for k in runs]) for runs in out.values()]


#: Neighbours (row, column), clockwise from the left one.
AROUND = ((0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1))


@dataclass(frozen=True)
class Contour:
    """A border as it is followed from its first pixel by row: (x, y) points, which repeat where the border turns back."""

    points: np.ndarray
    hole: bool


def contours(mask: np.ndarray) -> list[Contour]:
    """Outer borders of 8-connected regions and the borders of their holes, in order of the pixel where a scan by row meets them.

    Border following after Suzuki and Abe: pixels get the number of the border
    that passes them, negative where the pixel to the right is background, and a scan starts
    a border only where none has passed. Start pixels come from numpy; only border pixels are walked.
    """
    f = np.pad(mask.astype(np.int32), 1)
    off, on = f == 0, f != 0
    outer, inner = np.zeros_like(on), np.zeros_like(on)
    outer[:, 1:], inner[:, :-1] = on[:, 1:] & off[:, :-1], on[:, :-1] & off[:, 1:]
    out: list[Contour] = []
    number = 1
    for y, x in np.argwhere(outer | inner).tolist():
        if outer[y, x] and f[y, x] == 1:
            hole, at = False, 0
        elif inner[y, x] and f[y, x] >= 1:
            hole, at = True, 4
        else:
            continue
        number += 1
        out.append(Contour(np.array(_followed(f, y, x, at, number)) - 1, hole))
    return out


def _followed(f: np.ndarray, y: int, x: int, at: int, number: int) -> list[tuple[int, int]]:
    """The border that starts at (y, x), whose neighbour ``at`` is background."""
    first = next((k % 8 for k in range(at, at + 8) if f[y + AROUND[k % 8][0], x + AROUND[k % 8][1]]), None)
    if first is None:
        f[y, x] = -number
        return [(x, y)]
    end = (y + AROUND[first][0], x + AROUND[first][1])
    here, back, points = (y, x), first, []
    while True:
        right = False
        for k in range(back - 1, back - 9, -1):  # the other way round, from the one that the border came from
            dy, dx = AROUND[k % 8]
            if f[here[0] + dy, here[1] + dx]:
                break
            right |= k % 8 == 4
        points.append((here[1], here[0]))
        if right:
            f[here] = -number
        elif f[here] == 1:
            f[here] = number
        there = (here[0] + dy, here[1] + dx)
        if there == (y, x) and here == end:
            return points
        here, back = there, (k + 4) % 8


def grown(polygon: list[Point], distance: float, tolerance: float = 0.01) -> list[Point]:
    """A convex polygon's outline moved out by a distance, with round corners: arcs in chords that leave them by the tolerance at most."""
    area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(polygon, polygon[1:] + polygon[:1], strict=True))
    p = polygon if area >= 0 else polygon[::-1]
    p = [a for a, b in zip(p, p[-1:] + p[:-1], strict=True) if a != b] or p[:1]
    step = 2 * math.acos(max(0.0, 1 - tolerance / distance)) if distance > tolerance else math.pi / 2
    out: list[Point] = []
    for before, here, after in zip(p[-1:] + p[:-1], p, p[1:] + p[:1], strict=True):
        if len(p) == 1:
            start, turn = 0.0, 2 * math.pi
        else:
            normal = lambda a, b: math.atan2(a[0] - b[0], b[1] - a[1])  # noqa: E731  to the right of the side
            start = normal(before, here)
            turn = (normal(here, after) - start) % (2 * math.pi)
        n = max(1, math.ceil(turn / step))
        out += [(here[0] + distance * math.cos(start + turn * k / n), here[1] + distance * math.sin(start + turn * k / n)) for k in range(n + 1)]
    return out


def hull(points: np.ndarray) -> list[Point]:
    """Counter-clockwise convex hull (monotone chain)."""
    p = sorted(set(map(tuple, points.tolist())))
    if len(p) < 3:
        return p
    cross = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])

    def half(seq):
        out: list[Point] = []
        for q in seq:
            while len(out) >= 2 and cross(out[-2], out[-1], q) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return half(p) + half(p[::-1])


def least_rectangle(points: list[Point]) -> list[Point]:
    """Corners of the rectangle of least area around a hull: one side lies along a side of the hull."""
    if len(points) == 1:
        return points * 4
    best, corners = math.inf, []
    p = np.array(points, float)
    for a, b in zip(points, points[1:] + points[:1], strict=True):
        t = math.atan2(b[1] - a[1], b[0] - a[0])
        turn = np.array([[math.cos(t), math.sin(t)], [-math.sin(t), math.cos(t)]])
        q = p @ turn.T
        lo, hi = q.min(axis=0), q.max(axis=0)
        size = float(np.prod(hi - lo))
        if size < best - 1e-9:
            best, corners = size, [tuple(np.array(c) @ turn) for c in ((lo[0], lo[1]), (hi[0], lo[1]), (hi[0], hi[1]), (lo[0], hi[1]))]
    return corners


def sides(quad: list[Point]) -> tuple[float, float]:
    return math.dist(quad[0], quad[1]), math.dist(quad[1], quad[2])


def inside(quad: list[Point], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inside or on the border; a quad without area holds every point."""
    signs = [(b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) for a, b in zip(quad, quad[1:] + quad[:1], strict=True)]
    return np.all([s >= 0 for s in signs], axis=0) | np.all([s <= 0 for s in signs], axis=0)


def box_score(values: np.ndarray, quad: list[Point]) -> float:
    """Mean of the map inside the quad, 0 where it holds no pixel."""
    xs, ys = [p[0] for p in quad], [p[1] for p in quad]
    x0, x1 = max(0, math.floor(min(xs))), min(values.shape[1] - 1, math.ceil(max(xs)))
    y0, y1 = max(0, math.floor(min(ys))), min(values.shape[0] - 1, math.ceil(max(ys)))
    if x1 < x0 or y1 < y0:
        return 0.0
    y, x = np.mgrid[y0 : y1 + 1, x0 : x1 + 1]
    own = inside(quad, x, y)
    return float(values[y0 : y1 + 1, x0 : x1 + 1][own].mean()) if own.any() else 0.0


def inflated(quad: list[Point], ratio: float) -> list[Point]:
    """The least rectangle around the quad grown by area * ratio / perimeter with round corners: each side moves out by that distance."""
    w, h = sides(quad)
    d = w * h * ratio / (2 * (w + h))
    ux, uy = ((quad[1][0] - quad[0][0]) / w, (quad[1][1] - quad[0][1]) / w)
    vx, vy = ((quad[2][0] - quad[1][0]) / h, (quad[2][1] - quad[1][1]) / h)
    return [(p[0] + d * (a * ux + b * vx), p[1] + d * (a * uy + b * vy)) for p, (a, b) in zip(quad, ((-1, -1), (1, -1), (1, 1), (-1, 1)), strict=True)]


def detect(values: np.ndarray, content: tuple[int, int], source: tuple[int, int], settings: Detection) -> list[tuple[list[tuple[int, int]], float]]:
    """Quads in source pixels with their scores, a region's or a hole's border each. content: (width, height) of the map that shows the image."""
    cw, ch = content
    mask = np.zeros(values.shape, bool)
    mask[:ch, :cw] = values[:ch, :cw] > settings.threshold
    out = []
    for border in contours(mask)[: settings.max_candidates]:
        if len(border.points) < 3:
            continue
        quad = least_rectangle(hull(border.points))
        if min(sides(quad)) < MIN_SIDE:
            continue
        score = box_score(values, quad)
        if score < settings.box_threshold:
            continue
        quad = inflated(quad, settings.unclip_ratio)
        if min(sides(quad)) < MIN_INFLATED:
            continue
        half_up = lambda v: math.floor(v + 0.5)
        out.append(([(min(max(half_up(x * source[0] / cw), 0), source[0]), min(max(half_up(y * source[1] / ch), 0), source[1])) for x, y in quad], score))
    return out


FOUND = pa.schema([("slot", pa.int64()), ("ordinal", pa.int64()), ("score", pa.float64()), ("quad", pa.list_(pa.int64()))])


def detected(maps: DataFrame, settings: Detection) -> DataFrame:
    """slot, ordinal, score and quad (8 numbers) from maps (slot, width, height, values, content_width, content_height, source_width, source_height)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in FOUND}
            for m in batch.to_pylist():
                values = np.array(m["values"], np.float32).reshape(m["height"], m["width"])
                for k, (quad, score) in enumerate(detect(values, (m["content_width"], m["content_height"]), (m["source_width"], m["source_height"]), settings)):
                    for name, v in (("slot", m["slot"]), ("ordinal", k), ("score", score), ("quad", [c for p in quad for c in p])):
                        out[name].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in FOUND], schema=FOUND)

    return maps.mapInArrow(run, "slot bigint, ordinal bigint, score double, quad array<bigint>")


BORDERS = pa.schema([("slot", pa.int64()), ("ordinal", pa.int64()), ("hole", pa.bool_()), ("points", pa.int64()), ("first_x", pa.int64()), ("first_y", pa.int64()), ("area", pa.float64()), ("grown_area", pa.float64())])


def bordered(masks: DataFrame, ratio: float) -> DataFrame:
    """Every border of masks (slot, width, height, values: 0 or 1): points, first pixel, its hull's area, and that of the hull grown by area * ratio / perimeter."""

    def shoelace(p: list[Point]) -> float:
        return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, p[1:] + p[:1], strict=True))) / 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in BORDERS}
            for m in batch.to_pylist():
                for k, c in enumerate(contours(np.array(m["values"]).reshape(m["height"], m["width"]) != 0)):
                    h = hull(c.points)
                    area, around = shoelace(h), sum(math.dist(a, b) for a, b in zip(h, h[1:] + h[:1], strict=True))
                    wide = shoelace(grown(h, area * ratio / around)) if area else 0.0
                    for name, v in zip(out, (m["slot"], k, c.hole, len(c.points), int(c.points[0][0]), int(c.points[0][1]), area, wide), strict=True):
                        out[name].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in BORDERS], schema=BORDERS)

    return masks.mapInArrow(run, "slot bigint, ordinal bigint, hole boolean, points bigint, first_x bigint, first_y bigint, area double, grown_area double")
