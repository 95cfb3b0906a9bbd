"""Grids of whole token streams: the same as cell by cell and slot by slot, and without rows for cells and slots."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from docweave.operators import tables
from docweave.plans.catalog import REGISTRY

TOKENS = ["<tr>", "</tr>", "<td></td>", "<td", "</td>", ">", ' rowspan="2"', ' rowspan="3"', ' colspan="2"', ' colspan="05"', ' colspan="20"', ' colspan="21"', ' rowspan="0"', ' colspan="x"', f' colspan="{"9" * 30}"', f' rowspan="{"0" * 30}4"', None]
SPANS = lambda cell, row_span, col_span: (row_span or 1, col_span or 1 + cell % 2)


def streams(seed: int, n: int) -> list[tuple[int, list[str | None]]]:
    rng = np.random.default_rng(seed)
    weights = np.array([4, 3, 6, 4, *[1] * (len(TOKENS) - 4)], float)
    return [(k, [TOKENS[t] for t in rng.choice(len(TOKENS), rng.integers(0, 60), p=weights / weights.sum())]) for k in range(n)]


def test_streams_extent_is_that_of_cells_and_slots(spark):
    df = spark.createDataFrame([*streams(3, 300), (300, None), (301, ["<td", "<tr>", ' colspan="2"', "</td>"])], "tbl bigint, tokens array<string>")
    got = tables.stream_extent(df, ["tbl"], "tokens", SPANS)
    each = df.select("tbl", F.posexplode("tokens").alias("pos", "token"))
    cells = tables.cell_tokens(each, ["tbl"], "pos", "token").select("tbl", "row", "cell", F.coalesce("row_span", F.lit(1)).cast("bigint").alias("row_span"), F.coalesce("col_span", 1 + F.col("cell") % 2).cast("bigint").alias("col_span"))
    grid = tables.placed(cells, ["tbl"])
    want = tables.grid_extent(grid.withColumn("parsed", F.col("row") + 1), ["tbl"], "parsed")
    assert got.dtypes == want.dtypes
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(map(tuple, want.collect())) and len(rows) > 200
    assert rows[-1] == (301, 1, 2, False, 2)  # a cell opened before any row: what follows in the row counts


def test_placement_deals_lines_once_and_makes_no_rows_of_slots(spark, sf):
    plan = REGISTRY["grid_placement"].run(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Generate" not in plan


def test_a_large_order_is_placed_whole(spark, tmp_path):
    """Every line of an order many times over, and an order without an opened row."""
    lines = [(1, k % 7 + 1, float(k % 50 + 1)) for k in range(700)] + [(2, 2, 5.0)]
    kinds = "l_orderkey bigint, l_linenumber int, l_quantity double"
    spark.createDataFrame(lines * 3, kinds).repartition(5).write.parquet(str(tmp_path / "lineitem.parquet"))
    (r,) = REGISTRY["grid_placement"].run(spark, str(tmp_path)).collect()
    widths = [w if 1 <= (w := q % 23) <= 20 else 1 for q in range(1, 51)] * 7
    assert r.tbl == 1 and r.slots == sum(2 + w for w in widths) and not r.overlap
    assert r.rows == 201  # lines 1, 3, 5 and 7 open 50 rows each; the last row's cells reach down
