"""Boxes, polygons and resize arithmetic as column expressions.

A box is a struct (x, y, width, height) of bigint; a point a struct (x, y).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed limits.
MAX_COORDINATE = 4_294_967_295
MAX_CANVAS = 100_000
STRIDE = 32
FAST_SIDE, QUALITY_SIDE, MIN_SIDE = 896, 4000, 64
REC_HEIGHT, REC_MAX_WIDTH = 48, 3200


def box(x: Column, y: Column, width: Column, height: Column) -> Column:
    return F.struct(*(c.cast("bigint").alias(n) for c, n in ((x, "x"), (y, "y"), (width, "width"), (height, "height"))))


def box_ok(b: Column) -> Column:
    return (b["x"] >= 0) & (b["y"] >= 0) & (b["width"] > 0) & (b["height"] > 0) & (b["x"] + b["width"] <= MAX_COORDINATE) & (b["y"] + b["height"] <= MAX_COORDINATE)


def box_key(b: Column) -> Column:
    return F.concat_ws(",", b["x"], b["y"], b["width"], b["height"])


def envelope_of_boxes(boxes: Column) -> Column:
    lo = lambda n: F.array_min(F.transform(boxes, lambda b: b[n]))
    hi = lambda n, size: F.array_max(F.transform(boxes, lambda b: b[n] + b[size]))
    return box(lo("x"), lo("y"), hi("x", "width") - lo("x"), hi("y", "height") - lo("y"))


def envelope_of_points(points: Column) -> Column:
    lo = lambda n: F.array_min(F.transform(points, lambda p: p[n]))
    hi = lambda n: F.array_max(F.transform(points, lambda p: p[n]))
    return box(lo("x"), lo("y"), hi("x") - lo("x"), hi("y") - lo("y"))


def contains(outer: Column, inner: Column) -> Column:
    return (
        (inner["x"] >= outer["x"])
        & (inner["y"] >= outer["y"])
        & (inner["x"] + inner["width"] <= outer["x"] + outer["width"])
        & (inner["y"] + inner["height"] <= outer["y"] + outer["height"])
    )


def iou(a: Column, b: Column) -> Column:
    side = lambda n, size: F.greatest(F.lit(0), F.least(a[n] + a[size], b[n] + b[size]) - F.greatest(a[n], b[n]))
    both = side("x", "width") * side("y", "height")
    return both / (a["width"] * a["height"] + b["width"] * b["height"] - both)


def overlap_ratio(lo1: Column, hi1: Column, lo2: Column, hi2: Column) -> Column:
    """Shared length over the shorter segment's, ends inclusive."""
    shared = F.greatest(F.lit(0), F.least(hi1, hi2) - F.greatest(lo1, lo2) + 1)
    return shared / F.least(hi1 - lo1 + 1, hi2 - lo2 + 1)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt((a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"]))


def perimeter(quad: Column) -> Column:
    return sum((distance(quad[k], quad[(k + 1) % 4]) for k in range(1, 4)), distance(quad[0], quad[1]))


def area(quad: Column) -> Column:
    """Shoelace."""
    terms = [quad[k]["x"] * quad[(k + 1) % 4]["y"] - quad[(k + 1) % 4]["x"] * quad[k]["y"] for k in range(4)]
    return F.abs(terms[0] + terms[1] + terms[2] + terms[3]) / 2


def ordered_quad(points: Column) -> Column:
    """Top left, top right, bottom right, bottom left: the two leftmost by x, then each pair by y."""
    s = F.array_sort(F.transform(points, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))))
    left_low, right_low = s[0]["y"] <= s[1]["y"], s[2]["y"] <= s[3]["y"]
    pick = lambda c, a, b: F.when(c, s[a]).otherwise(s[b])
    return F.array(pick(left_low, 0, 1), pick(right_low, 2, 3), pick(right_low, 3, 2), pick(left_low, 1, 0))


def in_convex(px: Column, py: Column, quad: Column, degenerate: bool) -> Column:
    """Inside or on a convex quad, by the signs of cross products; ``degenerate`` says what no area gives."""
    cross = [(quad[(k + 1) % 4]["x"] - quad[k]["x"]) * (py - quad[k]["y"]) - (quad[(k + 1) % 4]["y"] - quad[k]["y"]) * (px - quad[k]["x"]) for k in range(4)]
    plus = (cross[0] >= 0) & (cross[1] >= 0) & (cross[2] >= 0) & (cross[3] >= 0)
    minus = (cross[0] <= 0) & (cross[1] <= 0) & (cross[2] <= 0) & (cross[3] <= 0)
    return F.when(area(quad) == 0, F.lit(degenerate)).otherwise(plus | minus)


def half_even(c: Column) -> Column:
    return F.rint(c)


def detector_side(side: Column, factor: Column) -> Column:
    return F.greatest(half_even(side * factor / STRIDE) * STRIDE, F.lit(STRIDE)).cast("bigint")


def detector_dims(width: Column, height: Column, max_side: int = FAST_SIDE) -> Column:
    """(width, height) for the detector: the shorter side at least 64, the cap on the longer wins, multiples of 32."""
    up = F.greatest(F.lit(1.0), F.lit(float(MIN_SIDE)) / F.least(width, height))
    longest = F.greatest(width, height) * up
    factor = F.when(longest > max_side, F.lit(float(max_side)) / F.greatest(width, height)).otherwise(up)
    return F.struct(detector_side(width, factor).alias("width"), detector_side(height, factor).alias("height"))


def recognition_width(width: Column, height: Column, default: int = 320) -> Column:
    """Canvas width at a height of 48; null without an area."""
    natural = F.least(F.greatest(F.ceil(F.lit(REC_HEIGHT) * width / height), F.lit(1)), F.lit(REC_MAX_WIDTH))
    return F.when((width > 0) & (height > 0), F.greatest(natural, F.lit(default))).cast("bigint")


def contained(width: Column, height: Column, side: int) -> Column:
    """Size scaled into a square, ties to even; null where a side vanishes."""
    scale = F.least(F.lit(float(side)) / width, F.lit(float(side)) / height)
    w, h = half_even(width * scale).cast("bigint"), half_even(height * scale).cast("bigint")
    return F.when((w > 0) & (h > 0), F.struct(w.alias("width"), h.alias("height")))
