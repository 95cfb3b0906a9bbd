"""Evidence joins, gates and malformed markup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.operators import evidence as E
from docweave.operators import grounding
from docweave.registry import Registry, table

REGISTRY = Registry()


@REGISTRY.query(
    "seal_gate",
    """WITH s AS (SELECT l_orderkey, l_linenumber, (['full', 'left', 'right'])[l_partkey % 3 + 1] AS view, l_discount AS score, l_partkey % 640 AS x0, l_partkey % 640 + l_suppkey % 80 AS x1, l_quantity <> 7 AS finite FROM lineitem),
    v AS (SELECT *, CASE WHEN score < CASE WHEN view = 'full' THEN 0.10 ELSE 0.025 END THEN NULL WHEN NOT finite THEN 'provider_output_invalid' WHEN view = 'full' THEN 'confirmed'
        WHEN view = 'left' AND x0 <= 96 OR view = 'right' AND x1 >= 544 THEN 'boundary-candidate' END AS verdict FROM s)
    SELECT view, verdict, count(*) AS n FROM v GROUP BY view, verdict""",
)
def seal_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = F.array(*map(F.lit, ("full", "left", "right")))[(F.col("l_partkey") % 3).cast("int")]
    x = F.col("l_partkey") % 640
    s = table(spark, sf_dir, "lineitem").select(view.alias("view"), E.seal_gate(view, F.col("l_discount"), x, x + F.col("l_suppkey") % 80, F.col("l_quantity") != 7).alias("verdict"))
    return s.groupBy("view", "verdict").agg(F.count("*").alias("n"))


@REGISTRY.query(
    "block_centers",
    """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN (p_size + p_size * 2 + p_size * 3 + p_partkey) / 4.0 WHEN p_partkey % 3 = 1 THEN p_size + p_partkey % 7 / 2.0 END AS x,
    CASE WHEN p_partkey % 3 = 0 THEN (1 + 2 + p_size + 4) / 4.0 WHEN p_partkey % 3 = 1 THEN 5 + p_size / 2.0 END AS y FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS p_size FROM part)""",
)
def block_centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda c: (F.lit(c) if isinstance(c, int) else c).cast("bigint")
    point = lambda x, y: F.struct(n(x).alias("x"), n(y).alias("y"))
    s, k = F.col("p_size"), F.col("p_partkey")
    polygon = F.when(k % 3 == 0, F.array(point(s, 1), point(s * 2, 2), point(s * 3, s), point(k, 4)))
    box = F.when(k % 3 == 1, F.struct(n(s).alias("x"), n(5).alias("y"), n(k % 7).alias("width"), n(s).alias("height")))
    return table(spark, sf_dir, "part").select("p_partkey", E.block_center(polygon, box).alias("c")).select("p_partkey", "c.x", "c.y")


@REGISTRY.query(
    "aligned_geometry",
    """WITH c AS (SELECT DISTINCT l_orderkey AS tbl, l_linenumber AS pos FROM lineitem WHERE l_partkey % 17 <> 0), g AS (SELECT DISTINCT l_orderkey AS tbl, CASE WHEN l_suppkey % 19 = 0 THEN l_linenumber + 100 ELSE l_linenumber END AS pos FROM lineitem)
    SELECT tbl, pos, CASE WHEN c.tbl IS NULL OR g.tbl IS NULL THEN 'unaligned' END AS verdict FROM (SELECT tbl, pos FROM c UNION SELECT tbl, pos FROM g) LEFT JOIN c USING (tbl, pos) LEFT JOIN g USING (tbl, pos)""",
)
def aligned_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    c = line.where("l_partkey % 17 <> 0").selectExpr("l_orderkey as tbl", "l_linenumber as pos").distinct()
    g = line.selectExpr("l_orderkey as tbl", "case when l_suppkey % 19 = 0 then l_linenumber + 100 else l_linenumber end as pos").distinct()
    return E.aligned_geometry(c, g, ["tbl"], "pos").select("tbl", "pos", "verdict")


@REGISTRY.query(
    "zip_guard",
    """WITH a AS (SELECT conv_id, count(turn) AS images, count(turn) FILTER (conv_id % 4 > 0 OR turn > 0) AS detections, count(turn) FILTER (conv_id % 6 > 0 OR turn <> 1) AS receipts FROM conversations GROUP BY conv_id)
    SELECT *, CASE WHEN images <> detections OR images <> receipts THEN 'provider_output_invalid' END AS violation FROM a""",
)
def zip_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    return E.zipped(c, c.where("conv_id % 4 > 0 or turn > 0"), c.where("conv_id % 6 > 0 or turn <> 1"), "conv_id", "turn")


@REGISTRY.query(
    "scattered_results",
    """WITH w AS (SELECT event_id AS item, user_id AS image, event_id AS detection, CASE WHEN event_id % 97 = 0 THEN 'recognition_failed' WHEN event_id % 101 = 0 THEN 'provider_output_invalid' END AS error FROM events),
    g AS (SELECT image, arg_min(error, item) FILTER (error IS NOT NULL) AS error, string_agg('t' || item, '|' ORDER BY detection) AS texts, count(DISTINCT item // 32) FILTER (error IS NULL) AS receipts FROM w GROUP BY image)
    SELECT image, error, CASE WHEN error IS NULL THEN texts END AS texts, CASE WHEN error IS NULL THEN receipts ELSE 0 END AS receipts FROM g""",
)
def scattered_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items failed by the recognizer, and items whose result is missing."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id")
    work = e.selectExpr("event_id as item", "user_id as image", "event_id as detection")
    failed = F.col("event_id") % 97 == 0
    results = e.where(failed | (F.col("event_id") % 101 != 0)).select(
        F.col("event_id").alias("item"), F.expr("event_id div 32").alias("batch"), F.when(~failed, F.concat(F.lit("t"), F.col("event_id").cast("string"))).alias("text"), F.when(failed, F.lit("recognition_failed")).alias("error")
    )
    return E.scattered(work, results, "item", "image", "detection")


@REGISTRY.query(
    "expert_prefetch",
    """SELECT o_custkey, count(*) AS items, CAST(sum(o_orderkey % 1000 * 1024) AS BIGINT) AS bytes, max(o_custkey % 3 * 4096) > 0 AND count(*) <= 12 AND sum(o_orderkey % 1000 * 1024) <= 6000000 AS prefetch FROM orders GROUP BY o_custkey""",
)
def expert_prefetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", (F.col("o_orderkey") % 1000 * 1024).alias("size"))
    return E.prefetched(o, "o_custkey", "size", F.col("o_custkey") % 3 * 4096, 12, 6_000_000)


@REGISTRY.query(
    "grid_rules",
    """WITH l AS (SELECT DISTINCT l_orderkey AS slot, l_linenumber AS k, l_partkey, l_suppkey FROM lineitem), f AS (SELECT slot, k, min(l_partkey * 100000 + l_suppkey) AS m FROM l GROUP BY slot, k),
    c AS (SELECT slot, k, CASE WHEN slot % 23 = 0 AND k = 2 THEN 't' WHEN slot % 29 = 0 AND k = 3 THEN 'c1' ELSE 'c' || k END AS id, k - 1 AS r, 0 AS c, CASE WHEN m % 41 = 0 THEN 0 WHEN m % 43 = 0 THEN 2 ELSE 1 END AS rs, 1 + m % 3 AS cs, CASE WHEN m % 5 > 0 THEN m % 50 + CASE WHEN m % 47 = 0 THEN 60 ELSE 0 END END AS x FROM f),
    t AS (SELECT slot, CASE WHEN slot % 13 = 0 THEN NULL ELSE 7 END AS nr, CASE WHEN slot % 31 = 0 THEN 2 WHEN slot % 13 = 0 THEN NULL ELSE 3 END AS nc FROM (SELECT DISTINCT slot FROM f)),
    i AS (SELECT slot, count(*) AS n, count(DISTINCT id) AS d FROM (SELECT slot, id FROM c UNION ALL SELECT slot, 't' FROM t) GROUP BY slot),
    j AS (SELECT c.*, nr, nc, rs > 0 AND cs > 0 AS spans, r + rs <= coalesce(nr, 0) AND c + cs <= coalesce(nc, 0) AS inside, x IS NULL OR x + 50 <= 100 AS box FROM c JOIN t USING (slot)),
    o AS (SELECT slot, count(*) = count(DISTINCT (r + a, c + b)) AS apart FROM j, range(2) u(a), range(3) v(b) WHERE spans AND inside AND a < rs AND b < cs GROUP BY slot)
    SELECT slot, CASE WHEN any_value(i.n) <> any_value(i.d) THEN 'ids' WHEN NOT bool_and(nr IS NOT NULL AND nc IS NOT NULL) THEN 'dimensions' WHEN NOT bool_and(spans) THEN 'spans' WHEN NOT bool_and(inside) THEN 'grid' WHEN NOT any_value(coalesce(apart, true)) THEN 'overlap' WHEN NOT bool_and(box) THEN 'region' END AS violation
    FROM j JOIN i USING (slot) LEFT JOIN o USING (slot) GROUP BY slot""",
)
def grid_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table for each order, a cell for each of its lines; repeated ids, missing dimensions, bad spans, cells beyond the grid or the table, and overlaps."""
    f = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("slot"), F.col("l_linenumber").cast("bigint").alias("k")).agg(F.min(F.col("l_partkey") * 100_000 + F.col("l_suppkey")).alias("m"))
    n = lambda c: (F.lit(c) if isinstance(c, int) else c).cast("bigint")
    box = lambda x, width: F.struct(n(x).alias("x"), n(0).alias("y"), n(width).alias("width"), n(10).alias("height"))
    s, k, m = F.col("slot"), F.col("k"), F.col("m")
    name = F.when((s % 23 == 0) & (k == 2), F.lit("t")).when((s % 29 == 0) & (k == 3), F.lit("c1")).otherwise(F.concat(F.lit("c"), k.cast("string")))
    x = m % 50 + F.when(m % 47 == 0, 60).otherwise(0)
    cells = f.select(
        "slot", name.alias("id"), F.lit("t").alias("table"), (k - 1).alias("row"), n(0).alias("column"), n(F.when(m % 41 == 0, 0).when(m % 43 == 0, 2).otherwise(1)).alias("row_span"), n(1 + m % 3).alias("col_span"), F.when(m % 5 > 0, box(x, 50)).alias("box")
    )
    rows, columns = F.when(s % 13 != 0, n(7)), F.when(s % 31 == 0, n(2)).when(s % 13 != 0, n(3))
    tables = f.select("slot").distinct().select("slot", F.lit("t").alias("id"), rows.alias("rows"), columns.alias("columns"), box(0, 100).alias("box"))
    return E.grid_violations(tables, cells, "slot")


@REGISTRY.query(
    "grounding_recovery",
    """WITH d AS (SELECT doc_id, source AS s, doc_id % 8 AS k FROM documents)
    SELECT doc_id, CASE k WHEN 0 THEN 'a one two' WHEN 1 THEN 'y <|ref|>t<|/ref|><|det|>[[1,2' WHEN 2 THEN 'x <|ref|>open ' || s WHEN 3 THEN s WHEN 4 THEN 'z w' WHEN 5 THEN 'q<|det|>' || s WHEN 6 THEN 'fine' ELSE 'many' END AS said,
    CAST(CASE WHEN k IN (0, 1, 5, 6) THEN 1 ELSE 0 END AS BIGINT) AS blocks, k <> 6 AS warned, CASE WHEN k = 7 THEN 'grounding_limit' END AS error FROM d""",
)
def grounding_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markup that models break: a ref alone, marks that never close, no mark at all, numbers that run together, too many boxes; and one in good form."""
    s, wide = F.col("source"), F.lit("[" + ",".join(["[1,2,30,40]"] * 129) + "]")
    forms = (
        F.lit("a <|ref|>t<|/ref|><|det|>[[1,2,30,40]]<|/det|>one <|ref|>lone<|/ref|>two"), F.lit("<|det|>text [1,2,30,40]<|/det|>y <|ref|>t<|/ref|><|det|>[[1,2"), F.concat(F.lit("x <|ref|>open "), s), s,
        F.lit("<|det|>[1,2,30,40]<|/det|>z <|det|>t [1 2, 3, 40, 50]<|/det|>w"), F.concat(F.lit("<|ref|>a<|/ref|><|ref|>b<|/ref|><|det|> [ 1 ,2, 30,40 ] <|/det|>q<|det|>"), s), F.lit("<|det|>text [1,2,30,40]<|/det|>fine"), F.concat(F.lit("<|det|>text "), wide, F.lit("<|/det|>many")),
    )
    m = F.array(*forms)[(F.col("doc_id") % 8).cast("int")]
    d = table(spark, sf_dir, "documents").select("doc_id", m.alias("m"))
    d = d.select("doc_id", "m", F.explode(F.array(grounding.blocks(F.col("m"), F.lit(1000), F.lit(1000)))).alias("b"))
    return d.select("doc_id", grounding.scanned(F.col("m"))["text"].alias("said"), F.size("b").cast("bigint").alias("blocks"), grounding.warned(F.col("m"), F.col("b")).alias("warned"), grounding.limit_error(F.col("m")).alias("error"))
