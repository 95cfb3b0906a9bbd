"""Index arithmetic of tensors as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
MIN_TILES, MAX_TILES = 2, 32


def closest_grid(width: Column, height: Column, tile: int) -> Column:
    """Tile grid (cols, rows) whose ratio is nearest to the image's; of equals, a later larger one if the image fills over half of it."""
    ratios = sorted(((c, r) for c in range(1, MAX_TILES + 1) for r in range(1, MAX_TILES + 1) if MIN_TILES <= c * r <= MAX_TILES), key=lambda g: (g[0] * g[1], *g))
    grids = F.array(*(F.struct(F.lit(c).cast("bigint").alias("cols"), F.lit(r).cast("bigint").alias("rows")) for c, r in ratios))
    aspect = width / height
    start = F.struct(F.lit(float("inf")).alias("d"), F.lit(0).cast("bigint").alias("cols"), F.lit(0).cast("bigint").alias("rows"))

    def step(best: Column, g: Column) -> Column:
        d = F.abs(aspect - g["cols"] / g["rows"])
        better = (d < best["d"]) | ((d == best["d"]) & (2 * width * height > tile * tile * g["cols"] * g["rows"]))
        return F.when(better, F.struct(d.alias("d"), g["cols"].alias("cols"), g["rows"].alias("rows"))).otherwise(best)

    return F.aggregate(grids, start, step)


def window_of(y: Column, x: Column, width: int, side: int) -> Column:
    """Window number and place within it of a position, row by row; the last windows are padded."""
    per_row = -(-width // side)
    win = F.floor(y / side) * per_row + F.floor(x / side)
    return F.struct(win.cast("bigint").alias("win"), (y % side * side + x % side).cast("bigint").alias("slot"))


def unwindow(win: Column, slot: Column, width: int, side: int) -> Column:
    """The position (y, x) that window_of came from."""
    per_row = -(-width // side)
    y = F.floor(win / per_row) * side + F.floor(slot / side)
    x = win % per_row * side + slot % side
    return F.struct(y.cast("bigint").alias("y"), x.cast("bigint").alias("x"))


def resampled(values: Column, source: int, target: int) -> Column:
    """Linear interpolation at pixel centres, ends clamped."""

    def at(i: Column) -> Column:
        p = F.greatest(F.lit(0.0), F.least(F.lit(float(source - 1)), (i + 0.5) * source / target - 0.5))
        lo = F.floor(p)
        value = lambda k: F.get(values, k.cast("int")).cast("double")
        return value(lo) * (F.lit(1.0) - (p - lo)) + value(F.least(lo + 1, F.lit(source - 1))) * (p - lo)

    return F.transform(F.sequence(F.lit(0), F.lit(target - 1)), at)


def cubic(x: float) -> float:
    """The cubic kernel of A = -0.5, which is 0 from 2 on."""
    x, a = abs(x), -0.5
    if x < 1:
        return (a + 2) * x**3 - (a + 3) * x**2 + 1
    return a * (x**3 - 5 * x**2 + 8 * x - 4) if x < 2 else 0.0


def cubic_weights(source: int, target: int) -> list[list[float]]:
    """For each target the weights of all sources: the kernel, widened when it shrinks, over those within reach, that sum to 1."""
    scale = source / target
    wide = max(scale, 1.0)
    out = []
    for t in range(target):
        center = scale * (t + 0.5)
        first, end = max(0, int(center - 2 * wide + 0.5)), min(source, int(center + 2 * wide + 0.5))
        row = [cubic((s + 0.5 - center) / wide) if first <= s < end else 0.0 for s in range(source)]
        total = sum(row)
        out.append([w / total for w in row] if total else row)
    return out


def resized(values: Column, side: int, target: int) -> Column:
    """A square grid, row by row, as one of side ``target``: antialiased cubic along its rows, then its columns. Sides are a model's, so the weights are literals."""
    if min(side, target) < 1:
        raise ValueError("sides must be positive")
    if side == target:
        return F.transform(values, lambda v: v.cast("double"))
    taps = F.array(*(F.array(*(F.struct(F.lit(s).alias("s"), F.lit(w).alias("w")) for s, w in enumerate(row) if w)) for row in cubic_weights(side, target)))
    total = lambda of, value: F.aggregate(of, F.lit(0.0), lambda a, p: a + p["w"] * value(p["s"]))
    across = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(side - 1)), lambda y: F.transform(taps, lambda of: total(of, lambda s: F.get(values, y * side + s).cast("double")))))
    column = lambda grid: F.flatten(F.transform(taps, lambda of: F.transform(F.sequence(F.lit(0), F.lit(target - 1)), lambda x: total(of, lambda s: F.get(grid, s * target + x)))))
    # One grid, bound once: the second pass reads it many times.
    return F.get(F.transform(F.array(across), column), 0)


def rope_angle(position: Column, pair: Column, dim: int, base: float = 10_000.0) -> Column:
    return position / F.pow(F.lit(base), F.lit(2) * pair / dim)


def packing(q: Column, rows: Column, cols: Column) -> Column:
    """Parts of a packed image in order: the local mosaic and the global view, each row with a line end, then the separator."""
    local = (q * rows * (q * cols + 1)).cast("bigint")
    whole = (q * (q + 1)).cast("bigint")
    part = lambda name, n, first: F.struct(F.lit(name).alias("part"), n.alias("n"), first.cast("bigint").alias("first"))
    return F.array(part("local", local, F.lit(0)), part("global", whole, local), part("separator", F.lit(1).cast("bigint"), local + whole))
