"""Ruling lines, cell claims, structure tokens and grids."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from docweave.functions import geometry as G
from docweave.functions.text import span_attribute

#: Fixed values.
RUN_GAP, SNAP, MIN_OVERLAP = 2, 2, 0.7
MIN_LINES, MIN_CROSSINGS = 2, 4
START, END_TOKEN = "sos", "eos"
MAX_REPEAT = 96

#: A cell's row and column span, from its number and the spans that it states.
Spans = Callable[[int, int | None, int | None], tuple[int, int]]


def runs(points: DataFrame, keys: list[str], place: str, gap: int = RUN_GAP, minimum: int = 1) -> DataFrame:
    """keys, lo, hi and n of runs of points whose neighbours leave out at most ``gap`` places."""
    w = Window.partitionBy(*keys).orderBy(place)
    first = F.coalesce(F.col(place) - F.lag(place).over(w) > gap + 1, F.lit(True))
    marked = points.withColumn("__first", first.cast("int"))
    marked = marked.withColumn("__run", F.sum("__first").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = marked.groupBy(*keys, "__run").agg(F.min(place).alias("lo"), F.max(place).alias("hi"), F.count("*").alias("n"))
    return out.drop("__run").where(F.col("hi") - F.col("lo") + 1 >= minimum)


def clustered(segments: Column) -> Column:
    """Fold of segments (fixed, lo, hi), sorted: one that lies close to the last cluster and overlaps it widens that cluster.

    The decision depends on the merged cluster, so this is a fold, not a lag. For
    a page's bounded number of lines.
    """
    empty = F.slice(segments, 1, 0)

    def step(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        close = (s["fixed"] <= last["fixed"] + SNAP) & (G.overlap_ratio(last["lo"], last["hi"], s["lo"], s["hi"]) >= MIN_OVERLAP)
        wide = F.struct(
            F.floor((last["fixed"] + s["fixed"]) / 2).cast("bigint").alias("fixed"), F.least(last["lo"], s["lo"]).alias("lo"), F.greatest(last["hi"], s["hi"]).alias("hi")
        )
        return F.when(F.coalesce(close, F.lit(False)), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(wide))).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(segments, empty, step)


def claims(blocks: DataFrame, cells: DataFrame, keys: list[str], bucket: int) -> DataFrame:
    """blocks (keys, px, py) with the first cell, in cell order, whose convex quad holds the point; blocks without one go.

    Cells are listed under the square buckets that they touch, so the join is an
    equality on buckets and only true neighbours are tested.
    """
    lo = lambda n: F.floor(F.array_min(F.transform("quad", lambda p: p[n])) / bucket)
    hi = lambda n: F.floor(F.array_max(F.transform("quad", lambda p: p[n])) / bucket)
    # A quad's sides become plain columns, a point and a direction each, so that the test below is arithmetic only.
    point = lambda k, n: F.col("quad")[k % 4][n]
    sides = [c for k in range(4) for c in (point(k, "x").alias(f"x{k}"), point(k, "y").alias(f"y{k}"), (point(k + 1, "x") - point(k, "x")).alias(f"dx{k}"), (point(k + 1, "y") - point(k, "y")).alias(f"dy{k}"))]
    listed = cells.where(G.area(F.col("quad")) > 0).select("cell", *sides, F.explode(F.sequence(lo("x"), hi("x"))).alias("bx"), F.sequence(lo("y"), hi("y")).alias("bys")).withColumn("by", F.explode("bys")).drop("bys")
    placed = blocks.withColumn("bx", F.floor(F.col("px") / bucket)).withColumn("by", F.floor(F.col("py") / bucket))
    cross = [F.expr(f"dx{k} * (py - y{k}) - dy{k} * (px - x{k})") for k in range(4)]
    near = placed.join(listed, ["bx", "by"]).where((F.least(*cross) >= 0) | (F.greatest(*cross) <= 0))
    return near.groupBy(*keys).agg(F.min("cell").alias("cell"))


def per_group(rows: DataFrame, keys: list[str], fields: list[str], fn: Callable[[list[dict]], list], result: str) -> DataFrame:
    """keys, fields and ``result`` (a long for each row of a group, from a function of the group's rows in the order of fields).

    A group is one array column, so a Python worker sees Arrow batches of many
    groups and pays nothing for each; groups are a page's or a table's bounded rows.
    """
    grouped = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("rows"))
    schema = T.StructType([*grouped.schema.fields, T.StructField("out", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [fn(group) for group in batch.column(len(keys)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int64()))], names=[*batch.schema.names, "out"])

    each = grouped.mapInArrow(run, schema).select(*keys, F.explode(F.arrays_zip("rows", "out")).alias("z"))
    return each.select(*keys, *(F.col(f"z.rows.{f}").alias(f) for f in fields), F.col("z.out").alias(result))


def components_of_lines(crossings: DataFrame) -> DataFrame:
    """(page, h, v, root) of crossings (page, h, v): the smallest line number that a crossing's lines are linked with.

    Links never leave a page, so union-find within each page replaces rounds of joins.
    """

    def roots(rows: list[dict]) -> list[int]:
        above: dict[int, int] = {}

        def top(x: int) -> int:
            while above.setdefault(x, x) != x:
                above[x] = x = above[above[x]]
            return x

        for r in rows:
            a, b = top(r["h"]), top(r["v"])
            above[max(a, b)] = min(a, b)
        return [top(r["h"]) for r in rows]

    fields = [c for c in crossings.columns if c not in ("page", "h", "v")]
    return per_group(crossings, ["page"], ["h", "v", *fields], roots, "root")


def admitted_components(crossings: DataFrame) -> DataFrame:
    """Components of crossings (page, h, v, x, y) with lines and crossings enough: their counts and extents by page and root."""
    g = components_of_lines(crossings).groupBy("page", "root").agg(
        F.countDistinct("h").alias("horizontal"), F.countDistinct("v").alias("vertical"), F.count("*").alias("crossings"),
        F.min("x").alias("left"), F.min("y").alias("top"), F.max("x").alias("right"), F.max("y").alias("bottom"),
    )
    return g.where((F.col("horizontal") >= MIN_LINES) & (F.col("vertical") >= MIN_LINES) & (F.col("crossings") >= MIN_CROSSINGS))


def stopped(tokens: DataFrame, keys: list[str], position: str, token: str) -> DataFrame:
    """Tokens before the end mark and before the 96th identical token in a row, which ends the stream; the start mark is skipped, but counts in a row."""
    w = Window.partitionBy(*keys).orderBy(position)
    new = F.coalesce(F.col(token) != F.lag(token).over(w), F.lit(True)).cast("int")
    t = tokens.withColumn("__new", new).withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    t = t.withColumn("__nth", F.row_number().over(Window.partitionBy(*keys, "__run").orderBy(position)))
    stop = F.min(F.when((F.col(token) == END_TOKEN) | (F.col("__nth") >= MAX_REPEAT), F.col(position))).over(Window.partitionBy(*keys))
    t = t.withColumn("__stop", stop).where((F.col("__stop").isNull() | (F.col(position) < F.col("__stop"))) & (F.col(token) != START))
    return t.drop("__new", "__run", "__nth", "__stop")


def cell_tokens(tokens: DataFrame, keys: list[str], position: str, token: str) -> DataFrame:
    """Cells of a structure token stream: row (0-based), order, row_span and col_span; spans are null where out of range.

    ``<tr>`` opens a row; ``<td></td>`` is a plain cell; ``<td`` takes the
    attribute tokens up to ``</td>``.
    """
    w = Window.partitionBy(*keys).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    t = tokens.withColumn("row", F.count_if(F.col(token) == "<tr>").over(w) - 1)
    t = t.withColumn("cell", F.count_if(F.col(token).isin("<td></td>", "<td")).over(w))
    inside = t.where((F.col("cell") > 0) & (F.col("row") >= 0) & ~F.col(token).isin("<tr>", "</tr>"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(position), F.col(token).alias("t")))), lambda x: x["t"]), "")
    cells = inside.groupBy(*keys, "row", "cell").agg(joined.alias("attrs"))
    return cells.select(*keys, "row", "cell", span_attribute(F.col("attrs"), "rowspan").alias("row_span"), span_attribute(F.col("attrs"), "colspan").alias("col_span"))


def placed(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``column`` to cells (row, cell, row_span, col_span): the next column whose whole span is free, given what earlier row spans hold."""

    def place(rows: list[dict]) -> list[int]:
        taken: set[tuple[int, int]] = set()
        free: dict[int, int] = {}
        columns = []
        for r in rows:
            row, width, column = r["row"], r["col_span"], free.get(r["row"], 0)
            while any((row, column + k) in taken for k in range(width)):
                column += 1
            taken.update((row + down, column + k) for down in range(r["row_span"]) for k in range(width))
            free[row] = column + width
            columns.append(column)
        return columns

    return per_group(cells, keys, ["row", "cell", "row_span", "col_span"], place, "column")


def reading_order(blocks: DataFrame, keys: list[str], tolerance: int = 10) -> DataFrame:
    """Adds ``rank`` to blocks (y, x, seq): by y then x, then each block moves ahead of neighbours at most ``tolerance`` away in y that lie to its right.

    The rule is not transitive, so the order is built by insertion within a page.
    """

    def order(rows: list[dict]) -> list[int]:
        out: list[int] = []
        for k, r in enumerate(rows):
            at = len(out)
            while at and abs(rows[out[at - 1]]["y"] - r["y"]) <= tolerance and r["x"] < rows[out[at - 1]]["x"]:
                at -= 1
            out.insert(at, k)
        rank = [0] * len(rows)
        for place, k in enumerate(out):
            rank[k] = place
        return rank

    return per_group(blocks, keys, ["y", "x", "seq"], order, "rank")


def grid_extent(cells: DataFrame, keys: list[str], rows: str) -> DataFrame:
    """Rows and columns that cells cover, at least the parsed row count; overlap if spans claim a slot twice."""
    slot = F.explode(F.sequence(F.col("row"), F.col("row") + F.col("row_span") - 1))
    slots = cells.withColumn("r", slot).withColumn("c", F.explode(F.sequence(F.col("column"), F.col("column") + F.col("col_span") - 1)))
    return slots.groupBy(*keys).agg(
        F.greatest(F.max("r") + 1, F.max(rows)).alias("rows"), (F.max("c") + 1).alias("columns"), (F.count("*") > F.countDistinct("r", "c")).alias("overlap"), F.countDistinct("r", "c").alias("slots")
    )


@lru_cache(maxsize=4096)
def _spans(attrs: str) -> tuple[int | None, int | None]:
    """Row and column span of a cell's joined tokens, by the rule of ``span_attribute``."""
    found = (re.search(rf' {name}="([0-9]+)"', attrs) for name in ("rowspan", "colspan"))
    row, col = (int(m[1].lstrip("0")[:3] or 0) if m else 1 for m in found)  # three digits are out of range already
    return row if 1 <= row <= 20 else None, col if 1 <= col <= 20 else None


def _cells(tokens: list[str | None]) -> Iterator[tuple[int, int, str]]:
    """Row, number and joined tokens of a stream's cells, as ``cell_tokens`` has them."""
    row, cell, attrs = -1, 0, []
    for t in tokens:
        if t == "</tr>" or t is None:
            continue
        if t in ("<td></td>", "<td", "<tr>"):
            if attrs:
                yield row, cell, "".join(attrs)
                attrs = []
            if t == "<tr>":
                row += 1
                continue
            cell += 1
        if cell and row >= 0:
            attrs.append(t)
    if attrs:
        yield row, cell, "".join(attrs)


def _extent(tokens: list[str | None], spans: Spans) -> tuple[int, int, int]:
    """Rows, columns and slots of a stream's grid, its cells placed as by ``placed``; no rows where it has no cell."""
    rows = columns = slots = 0
    held: dict[int, list[tuple[int, int]]] = {}  # by row, the columns from and to that earlier rows' spans hold
    at, column, ahead, k = -1, 0, [], 0
    for row, cell, attrs in _cells(tokens):
        down, width = spans(cell, *_spans(attrs))
        if row != at:
            at, column, ahead, k = row, 0, sorted(held.pop(row, ())), 0
        while k < len(ahead) and ahead[k][0] < column + width:
            if ahead[k][1] > column:
                column = ahead[k][1]
            k += 1
        for r in range(row + 1, row + down):
            held.setdefault(r, []).append((column, column + width))
        column += width
        slots += down * width
        if row + down > rows:
            rows = row + down
        if column > columns:
            columns = column
    return rows, columns, slots


def stream_extent(streams: DataFrame, keys: list[str], tokens: str, spans: Spans) -> DataFrame:
    """What ``cell_tokens``, ``placed`` and ``grid_extent`` say of token streams, each an array in order, without a row for a token, a cell or a slot.

    ``spans`` gives a cell's row and column span from its number and the spans that
    it states (null where out of range). A cell takes columns that are free in its
    row; what cells before it hold further down they hold in its row too. So no
    slot is claimed twice, and slots are the sum of the cells' areas.
    """
    held = streams.select(*keys, tokens)
    schema = T.StructType([*held.schema.fields[:-1], *(T.StructField(n, T.BooleanType() if n == "overlap" else T.LongType()) for n in ("rows", "columns", "overlap", "slots"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *names, stream = batch.columns
            each = stream.flatten().dictionary_encode()
            words = np.array([*each.dictionary.to_pylist(), None], object)
            told = words[each.indices.fill_null(-1).to_numpy(zero_copy_only=False)].tolist()
            found, at = [], 0
            for n in stream.value_lengths().fill_null(0).to_pylist():
                found.append(_extent(told[at : at + n], spans))
                at += n
            rows, columns, slots = (pa.array([f[k] for f in found], pa.int64()) for k in range(3))
            out = pa.RecordBatch.from_arrays([*names, rows, columns, pa.array([False] * len(found), pa.bool_()), slots], names=schema.names)
            yield out.filter(pc.greater(rows, 0))

    return held.mapInArrow(run, schema)
