"""The structure-token transducer: a table's token stream to rows of cells, or the first error and its place.

A finite-state fold by table. Outside, in a row, or in an open cell, each kind of
token leads to a next state or to an error; the tables below say which. Cell tokens
also take the next geometry placeholder, which must stand at their place. The
stream must end outside a row with every placeholder taken.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OUTSIDE, ROW, CELL = range(3)
#: Largest span, most cells of a table, and the numbers that a span may be written as.
MAX_SPAN, MAX_CELLS, LARGEST = 20, 4096, (1 << 32) - 1
NUMBER = re.compile(r"\+?[0-9]+")
SPAN = re.compile(r' (colspan|rowspan)="(.*)"', re.DOTALL)

#: Next state, or error, of each kind of token in the states outside, row and cell.
TRANSITIONS: dict[str, tuple[int | str, int | str, int | str]] = {
    "<tr>": (ROW, "nested_row", "nested_row"),
    "</tr>": ("row_unopened", OUTSIDE, "row_end_in_cell"),
    "<td></td>": ("cell_outside_row", ROW, CELL),
    "<td": ("cell_start_invalid", CELL, "cell_start_invalid"),
    ">": ("delimiter_without_cell", "delimiter_without_cell", CELL),
    "</td>": ("cell_unopened", "cell_unopened", ROW),
    "colspan": ("span_outside_cell", "span_outside_cell", CELL),
    "rowspan": ("span_outside_cell", "span_outside_cell", CELL),
}


def parsed(tokens: list[tuple[int, str]], places: list[int]) -> tuple[list[dict], int, str | None, int | None]:
    """Cells in order of their ends, rows, the first error and the position of its token (null at the stream's end). Tokens are (position, token); places, the geometry's positions in order."""
    cells: list[dict] = []
    if len(set(places)) != len(places):
        return [], 0, "geometry_repeated", None
    state, row, taken = OUTSIDE, 0, 0
    spans, place = {"colspan": 1, "rowspan": 1}, 0
    for at, token in tokens:
        kind, value = token, None
        if m := SPAN.fullmatch(token):
            kind, text = m[1], m[2]
            if not NUMBER.fullmatch(text) or int(text) > LARGEST:
                return [], row, "span_not_numeric", at
            value = int(text)
            if not 1 <= value <= MAX_SPAN:
                return [], row, "span_out_of_range", at
        if kind not in TRANSITIONS:
            continue
        after = TRANSITIONS[kind][state]
        if isinstance(after, str):
            return [], row, after, at
        if kind in ("<td></td>", "<td"):
            if taken == len(places):
                return [], row, "geometry_missing", at
            if places[taken] != at:
                return [], row, "geometry_misaligned", at
            taken += 1
        if kind == "<td></td>":
            cells.append({"row": row, "row_span": 1, "col_span": 1, "place": at})
        elif kind == "<td":
            spans, place = {"colspan": 1, "rowspan": 1}, at
        elif kind == "</td>":
            cells.append({"row": row, "row_span": spans["rowspan"], "col_span": spans["colspan"], "place": place})
        elif kind == "</tr>":
            row += 1
        elif value is not None:
            spans[kind] = value
        state = after
    if state != OUTSIDE or taken != len(places):
        return [], row, "incomplete", None
    if len(cells) > MAX_CELLS:
        return [], row, "too_many_cells", None
    return cells, row, None, None


CELLS = "cells array<struct<row:bigint,row_span:bigint,col_span:bigint,place:bigint>>, rows bigint, error string, error_at bigint"
ARROW = pa.schema(
    [("cells", pa.list_(pa.struct([(n, pa.int64()) for n in ("row", "row_span", "col_span", "place")]))), ("rows", pa.int64()), ("error", pa.string()), ("error_at", pa.int64())]
)


def structures(tokens: DataFrame, geometry: DataFrame, keys: list[str]) -> DataFrame:
    """keys, cells, rows, error and error_at of each table of tokens (keys, pos, token); geometry: keys, ordinal and pos of its placeholders.

    A table's tokens are bounded by what a model may emit, so they are one array row; tables share Arrow batches.
    """
    t = tokens.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("pos").cast("bigint").alias("pos"), "token"))).alias("tokens"))
    g = geometry.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", F.col("pos").cast("bigint").alias("pos")))), lambda x: x["pos"]).alias("places"))
    each = t.join(g, keys, "left").select(*keys, "tokens", F.coalesce("places", F.array().cast("array<bigint>")).alias("places"))
    out = T.StructType([*each.select(*keys).schema.fields, *T.StructType.fromDDL(CELLS).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [parsed([(x["pos"], x["token"]) for x in ts if x["token"] is not None], ps) for ts, ps in zip(batch.column("tokens").to_pylist(), batch.column("places").to_pylist(), strict=True)]
            values = [pa.array([r[k] for r in rows], f.type) for k, f in enumerate(ARROW)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *values], names=out.names)

    return each.mapInArrow(run, out)


def cell_quad(logits: Column, x: Column, y: Column, width: Column, height: Column) -> Column:
    """Eight logits as four corners (x, y, ...) in a crop's page: sigmoid times the longer side, cut to whole pixels, within the crop. Null without area."""
    sigmoid = lambda v: F.lit(1.0) / (F.lit(1.0) + F.exp(-v.cast("double")))
    even = lambda i: i % 2 == 0
    at = lambda v, i: F.least(F.greatest((sigmoid(v) * F.greatest(width, height)).cast("bigint"), F.lit(0)), F.when(even(i), width).otherwise(height)) + F.when(even(i), x).otherwise(y)
    quad = F.transform(logits, lambda v, i: at(v, i).cast("bigint"))
    axis = lambda k: F.filter(quad, lambda _, i: i % 2 == k)
    return F.when((F.array_max(axis(0)) > F.array_min(axis(0))) & (F.array_max(axis(1)) > F.array_min(axis(1))), quad)
