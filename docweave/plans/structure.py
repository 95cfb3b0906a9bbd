"""Structure tokens with every error state, as a query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.operators import structure
from docweave.registry import Registry, table

REGISTRY = Registry()

#: Token and geometry streams, said once and read by both engines: a table for each order, 1 to 4 rows of two cells, one fault by the order's key.
_FAULTS = {
    (1, 2): "'<tr>'", (2, 6): "'</tr>'", (3, 1): "'</tr>'", (4, 1): "'<tbody>'", (5, 2): "'<td'", (6, 3): "'x'", (7, 3): "'x'", (7, 4): "'y'", (8, 3): "'x'", (8, 4): "'y'", (8, 5): "'z'",
    (9, 4): "' colspan=\"a2\"'", (10, 4): "' colspan=\"21\"'", (11, 4): "' rowspan=\"0\"'", (12, 7): "''", (17, 4): "' rowspan=\"4294967296\"'", (18, 4): "' rowspan=\"3\"'", (19, 1): "'<thead>'",
}
_FAULT = "CASE " + " ".join(f"WHEN m = {m} AND j = {j} THEN {token}" for (m, j), token in _FAULTS.items()) + " ELSE base END"
_BASE = "CASE j WHEN 1 THEN '<tr>' WHEN 2 THEN '<td></td>' WHEN 3 THEN '<td' WHEN 4 THEN concat(' colspan=\"', CAST(1 + (tbl + r) % 20 AS {text}), '\"') WHEN 5 THEN '>' WHEN 6 THEN '</td>' ELSE '</tr>' END"


def _said(text: str, tables: str, rows: str, places: str) -> str:
    token = f"CASE WHEN r = n - 1 THEN {_FAULT} ELSE base END"
    return f"""o AS (SELECT o_orderkey AS tbl, o_orderkey % 20 AS m, 1 + o_orderkey % 4 AS n FROM {tables}),
    b AS (SELECT tbl, m, n, r, j, r * 10 + j AS pos, {_BASE.format(text=text)} AS base FROM (SELECT tbl, m, n, {rows} AS r FROM o) x CROSS JOIN {places}),
    tok AS (SELECT tbl, pos, {token} AS token FROM b),
    geo AS (SELECT tbl, pos + CASE WHEN m = 15 AND r = n - 1 AND j = 3 THEN 1 WHEN m = 16 AND r = n - 1 AND j = 3 THEN -1 ELSE 0 END AS pos, pos AS ordinal FROM (SELECT b.*, tok.token FROM b JOIN tok USING (tbl, pos)) y WHERE token IN ('<td></td>', '<td') AND NOT (m = 13 AND r = n - 1 AND j = 3)
      UNION ALL SELECT tbl, 900, 900 FROM o WHERE m = 14)"""


_DUCK = _said("VARCHAR", "orders", "unnest(range(n))", "(SELECT unnest(range(1, 8)) AS j) v")
_SPARK = _said("STRING", "{orders}", "explode(sequence(0L, n - 1))", "(SELECT explode(sequence(1L, 7L)) AS j) v")


def streams(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Tokens (tbl, pos, token) and geometry (tbl, pos, ordinal)."""
    orders = table(spark, sf_dir, "orders")
    part = lambda name: spark.sql(f"WITH {_SPARK} SELECT * FROM {name}", orders=orders)
    return part("tok"), part("geo")


@REGISTRY.query(
    "structure_states",
    rf"""WITH RECURSIVE {_DUCK},
    k AS (SELECT tbl, pos, token, row_number() OVER (PARTITION BY tbl ORDER BY pos) AS k, regexp_extract(token, '^ (colspan|rowspan)="(.*)"$', 1) AS span, regexp_extract(token, '^ (colspan|rowspan)="(.*)"$', 2) AS v FROM tok),
    p AS (SELECT tbl, list(pos ORDER BY ordinal) AS places, count(DISTINCT pos) < count(*) AS repeated FROM geo GROUP BY tbl),
    f AS (SELECT tbl, 0 AS k, 0 AS st, 0 AS taken, 0 AS row, 0 AS cells, 0 AS area, 1 AS cs, 1 AS rs, CASE WHEN repeated THEN 'geometry_repeated' END AS error, CAST(NULL AS BIGINT) AS error_at, coalesce(places, []) AS places FROM o LEFT JOIN p USING (tbl) UNION ALL
      SELECT f.tbl, k.k, CASE WHEN e.error IS NOT NULL THEN f.st WHEN token = '<tr>' THEN 1 WHEN token = '</tr>' THEN 0 WHEN token = '<td' THEN 2 WHEN token = '</td>' THEN 1 ELSE f.st END,
        f.taken + CASE WHEN token IN ('<td></td>', '<td') THEN 1 ELSE 0 END, f.row + CASE WHEN token = '</tr>' THEN 1 ELSE 0 END, f.cells + CASE WHEN token IN ('<td></td>', '</td>') THEN 1 ELSE 0 END,
        f.area + CASE WHEN token = '<td></td>' THEN 1 WHEN token = '</td>' THEN f.cs * f.rs ELSE 0 END,
        CASE WHEN token = '<td' THEN 1 WHEN span = 'colspan' AND e.error IS NULL THEN CAST(v AS INTEGER) ELSE f.cs END, CASE WHEN token = '<td' THEN 1 WHEN span = 'rowspan' AND e.error IS NULL THEN CAST(v AS INTEGER) ELSE f.rs END, e.error, CASE WHEN e.error IS NOT NULL THEN k.pos END, f.places
      FROM f JOIN k ON k.tbl = f.tbl AND k.k = f.k + 1 AND f.error IS NULL CROSS JOIN LATERAL (SELECT CASE
        WHEN span <> '' AND (NOT regexp_full_match(v, '\+?[0-9]+') OR TRY_CAST(v AS BIGINT) > 4294967295) THEN 'span_not_numeric' WHEN span <> '' AND NOT TRY_CAST(v AS BIGINT) BETWEEN 1 AND 20 THEN 'span_out_of_range' WHEN span <> '' AND f.st <> 2 THEN 'span_outside_cell'
        WHEN token = '<tr>' AND f.st <> 0 THEN 'nested_row' WHEN token = '</tr>' AND f.st = 2 THEN 'row_end_in_cell' WHEN token = '</tr>' AND f.st = 0 THEN 'row_unopened' WHEN token = '<td></td>' AND f.st = 0 THEN 'cell_outside_row'
        WHEN token = '<td' AND f.st <> 1 THEN 'cell_start_invalid' WHEN token = '>' AND f.st <> 2 THEN 'delimiter_without_cell' WHEN token = '</td>' AND f.st <> 2 THEN 'cell_unopened'
        WHEN token IN ('<td></td>', '<td') AND f.taken >= len(f.places) THEN 'geometry_missing' WHEN token IN ('<td></td>', '<td') AND f.places[f.taken + 1] <> k.pos THEN 'geometry_misaligned' END AS error) e),
    l AS (SELECT *, coalesce(error, CASE WHEN st <> 0 OR taken <> len(places) THEN 'incomplete' END) AS ended FROM f QUALIFY row_number() OVER (PARTITION BY tbl ORDER BY k DESC) = 1)
    SELECT tbl, CASE WHEN ended IS NULL THEN CAST(row AS BIGINT) END AS rows, CASE WHEN ended IS NULL THEN CAST(cells AS BIGINT) END AS cells, CASE WHEN ended IS NULL THEN CAST(area AS BIGINT) END AS area, ended AS error, error_at FROM l""",
)
def structure_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, cells and covered slots of each table, or the first error and where it is."""
    found = structure.structures(*streams(spark, sf_dir), ["tbl"])
    fine = F.col("error").isNull()
    area = F.aggregate("cells", F.lit(0).cast("bigint"), lambda n, c: n + c["row_span"] * c["col_span"])
    return found.select("tbl", F.when(fine, F.col("rows")).alias("rows"), F.when(fine, F.size("cells").cast("bigint")).alias("cells"), F.when(fine, area).alias("area"), "error", "error_at")
