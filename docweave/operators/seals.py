"""Page views, seal projection and boundary fragments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values.
STRIP_MIN, STRIP_MAX, NARROW_PAGE = 64, 160, 128
ADJACENT_MIN, ADJACENT_MAX = 320, 512
CONTACT = 0.15


def _view(kind: str, x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), *(c.cast("bigint").alias(n) for c, n in ((x, "x"), (y, "y"), (w, "width"), (h, "height"))))


def page_views(width: Column, height: Column) -> Column:
    """The full page and, from a width of 128 on, a strip at each side a twelfth wide, within 64 to 160."""
    strip = F.least(F.greatest(F.ceil(width / 12), F.lit(STRIP_MIN)), F.lit(STRIP_MAX))
    zero = F.lit(0)
    full = _view("full", zero, zero, width, height)
    sides = F.array(full, _view("left", zero, zero, strip, height), _view("right", width - strip, zero, strip, height))
    return F.when(width < NARROW_PAGE, F.array(full)).otherwise(sides)


def adjacent_view(width: Column, height: Column, edge: Column, box: Column) -> Column:
    """The window to look at on a page beside a candidate: its edge strip, around the candidate's middle, twice its height within 320 and 512."""
    w = F.least(F.greatest(box["width"], F.lit(STRIP_MIN)), width)
    h = F.least(F.least(F.greatest(box["height"] * 2, F.lit(ADJACENT_MIN)), F.lit(ADJACENT_MAX)), height)
    middle = box["y"] + F.floor(box["height"] / 2)
    y = F.least(F.greatest(middle - F.floor(h / 2), F.lit(0)), height - h)
    x = F.when(edge == "left", F.lit(0)).otherwise(width - w)
    return _view("adjacent", x, y, w, h)


def projected(head: Column, view: Column, canvas_width: Column, canvas_height: Column, side: int = 640, snap: int = 2) -> Column:
    """Corners on a square view to a canvas box: outwards to whole pixels, onto an edge within ``snap``, within the canvas; null if nothing is left."""
    sx, sy = view["width"] / side, view["height"] / side
    lo = lambda v, scale, origin: F.floor(v * scale).cast("bigint") + origin
    hi = lambda v, scale, origin: F.ceil(v * scale).cast("bigint") + origin
    near = lambda c, edge: F.when(F.abs(c - edge) <= snap, edge).otherwise(c)
    clamp = lambda c, top: F.least(F.greatest(c, F.lit(0)), top)
    x1, y1 = clamp(near(lo(head["x1"], sx, view["x"]), F.lit(0)), canvas_width), clamp(near(lo(head["y1"], sy, view["y"]), F.lit(0)), canvas_height)
    x2, y2 = clamp(near(hi(head["x2"], sx, view["x"]), canvas_width), canvas_width), clamp(near(hi(head["y2"], sy, view["y"]), canvas_height), canvas_height)
    box = F.struct(x1.alias("x"), y1.alias("y"), (x2 - x1).alias("width"), (y2 - y1).alias("height"))
    return F.when((x2 > x1) & (y2 > y1), box)


def fused(fragments: DataFrame, keys: list[str]) -> DataFrame:
    """Boundary fragments (x, y, width, height): two or more narrow ones, at most a quarter as wide as the broadest and within its height, become one.

    The fused box keeps the narrow ones' x range and the broadest one's y range;
    other groups keep their fragments.
    """
    broadest = fragments.groupBy(*keys).agg(F.max(F.struct("width", "height", "x", "y")).alias("b"))
    f = fragments.join(broadest, keys)
    inside = (F.col("y") >= F.col("b.y")) & (F.col("y") + F.col("height") <= F.col("b.y") + F.col("b.height"))
    f = f.withColumn("narrow", (F.col("width") * 4 <= F.col("b.width")) & inside)
    g = f.groupBy(*keys).agg(F.count_if("narrow").alias("n"), F.min(F.when(F.col("narrow"), F.col("x"))).alias("lo"), F.max(F.when(F.col("narrow"), F.col("x") + F.col("width"))).alias("hi"), F.first("b").alias("b"))
    fuse = g.where("n >= 2").select(*keys, F.col("lo").alias("x"), F.col("b.y").alias("y"), (F.col("hi") - F.col("lo")).alias("width"), F.col("b.height").alias("height"))
    left = fragments.join(fuse.select(*keys), keys, "left_anti").select(*keys, "x", "y", "width", "height")
    return left.unionByName(fuse)
