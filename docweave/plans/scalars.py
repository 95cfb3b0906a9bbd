"""Scalar geometry, markup, parsing and tensor index arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions import binary as B
from docweave.functions import geometry as G
from docweave.functions import text as T
from docweave.functions import vectors as X
from docweave.operators import grounding, seals, tensors
from docweave.registry import Registry, table

REGISTRY = Registry()

_PREFIXES = ("89504E470D0A1A0A", "FFD8FFE0", "474946383761", "474946383961", "424D", "49492A00", "4D4D002A", "524946460000000057454250", "00")


@REGISTRY.query(
    "sniff_signature",
    f"""WITH s AS (SELECT page_id, hex(unhex({list(_PREFIXES)}[page_id % 9 + 1]) || encode(html)) AS h FROM pages)
    SELECT page_id, CASE WHEN h LIKE '52494646________57454250%' THEN 'image/webp' WHEN h LIKE '89504E470D0A1A0A%' THEN 'image/png' WHEN h LIKE 'FFD8FF%' THEN 'image/jpeg' WHEN h LIKE '474946383761%' OR h LIKE '474946383961%' THEN 'image/gif'
      WHEN h LIKE '424D%' THEN 'image/bmp' WHEN h LIKE '49492A00%' OR h LIKE '4D4D002A%' THEN 'image/tiff' END AS media_type FROM s""",
)
def sniff_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefix = F.array(*map(F.lit, _PREFIXES))[(F.col("page_id") % 9).cast("int")]
    return table(spark, sf_dir, "pages").select("page_id", B.media_type(F.concat(F.unhex(prefix), F.col("html").cast("binary"))).alias("media_type"))


@REGISTRY.query(
    "parse_scales",
    """WITH s AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN p_brand WHEN p_partkey % 5 = 1 THEN CAST(p_size AS VARCHAR) ELSE '1./' || (p_size % 4) || '.' END AS t FROM part)
    SELECT p_partkey, round(CASE WHEN t LIKE '%/%' THEN TRY_CAST(split_part(t, '/', 1) AS DOUBLE) / nullif(TRY_CAST(split_part(t, '/', 2) AS DOUBLE), 0) ELSE TRY_CAST(t AS DOUBLE) END, 9) AS scale FROM s""",
)
def parse_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.when(F.col("p_partkey") % 5 == 0, F.col("p_brand")).when(F.col("p_partkey") % 5 == 1, F.col("p_size").cast("string")).otherwise(F.concat(F.lit("1./"), (F.col("p_size") % 4).cast("string"), F.lit(".")))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(T.parse_scale(t), 9).alias("scale"))


@REGISTRY.query(
    "asset_precedence",
    """SELECT s_suppkey, coalesce(CASE WHEN s_suppkey % 5 = 0 THEN 'env:' || s_name END, CASE WHEN s_suppkey % 3 = 0 THEN 'managed:' || s_name END, CASE WHEN s_suppkey % 2 = 0 THEN 'packaged:' || s_name END) AS asset,
    CASE WHEN s_suppkey % 5 = 0 OR s_suppkey % 3 = 0 OR s_suppkey % 2 = 0 THEN 'ready' ELSE 'model_missing' END AS status FROM supplier""",
)
def asset_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docweave.sources.config import resolved

    k = F.col("s_suppkey")
    candidates = [F.when(k % n == 0, F.concat(F.lit(f"{name}:"), F.col("s_name"))) for name, n in (("env", 5), ("managed", 3), ("packaged", 2))]
    return table(spark, sf_dir, "supplier").select("s_suppkey", *resolved(candidates))


@REGISTRY.query(
    "structure_dictionary",
    """WITH l AS (SELECT DISTINCT p_type AS token FROM part UNION SELECT '<td>' UNION SELECT ''), k AS (SELECT token FROM l WHERE token NOT IN ('', '<td>') UNION SELECT '<td></td>'),
    n AS (SELECT token, row_number() OVER (ORDER BY token) AS i FROM k)
    SELECT token, i FROM n UNION ALL SELECT 'sos', 0 UNION ALL SELECT 'eos', (SELECT count(*) + 1 FROM k)""",
)
def structure_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docweave.sources.config import dictionary

    lines = [r[0] for r in table(spark, sf_dir, "part").select("p_type").distinct().orderBy("p_type").toLocalIterator()]  # a dictionary: bounded like the file it stands for
    tokens = dictionary([*lines, "<td>", ""])
    return spark.createDataFrame(list(zip(tokens, range(len(tokens)), strict=True)), "token string, i bigint")


@REGISTRY.query(
    "tensor_inventory",
    """WITH t AS (SELECT p_brand, 'block.' || p_partkey || '.weight' AS name, p_size * 4 AS bytes FROM part)
    SELECT p_brand, count(*) AS n, count(DISTINCT name) = count(*) AS is_unique, CAST(sum(bytes) AS BIGINT) AS bytes,
    sha256(unhex(string_agg(hex(unhex(array_to_string(list_reverse(regexp_extract_all(lpad(hex(CAST(strlen(name) AS BIGINT)), 16, '0'), '..')), '')) || encode(name)), '' ORDER BY name))) AS digest FROM t GROUP BY p_brand""",
)
def tensor_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("block."), F.col("p_partkey").cast("string"), F.lit(".weight"))
    t = table(spark, sf_dir, "part").select("p_brand", name.alias("name"), (F.col("p_size") * 4).cast("bigint").alias("bytes"))
    g = t.groupBy("p_brand").agg(F.count("*").alias("n"), F.countDistinct("name").alias("d"), F.sum("bytes").alias("bytes"), F.array_sort(F.collect_list("name")).alias("names"))
    return g.select("p_brand", "n", (F.col("d") == F.col("n")).alias("is_unique"), "bytes", B.digest(B.fold(F.transform("names", B.prefixed))).alias("digest"))


@REGISTRY.query(
    "envelope_json",
    """SELECT o_orderkey, '{"schemaVersion":"v1","ok":' || CASE WHEN o_orderstatus = 'F' THEN 'false,"error":{"code":"runtime_failed"}}' ELSE 'true,"data":{"orderKey":' || o_orderkey || ',"priority":"' || o_orderpriority || '"}}' END AS envelope FROM orders""",
)
def envelope_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docweave.sources.sinks import envelope

    failed = F.col("o_orderstatus") == "F"
    data = F.when(~failed, F.struct(F.col("o_orderkey").alias("orderKey"), F.col("o_orderpriority").alias("priority")))
    error = F.when(failed, F.struct(F.lit("runtime_failed").alias("code")))
    return table(spark, sf_dir, "orders").select("o_orderkey", envelope("v1", data, error).alias("envelope"))


@REGISTRY.query(
    "canonical_digest",
    """SELECT page_id, sha256('{"pageId":' || page_id || ',"bytes":' || strlen(html) || '}') AS digest FROM pages""",
)
def canonical_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docweave.sources.sinks import canonical_digest as digest

    return table(spark, sf_dir, "pages").select("page_id", digest(F.struct(F.col("page_id").alias("pageId"), F.octet_length("html").alias("bytes"))).alias("digest"))


@REGISTRY.query(
    "detection_dims",
    """WITH s AS (SELECT p_partkey, p_size * 37 AS w, 20 + p_partkey % 1500 AS h FROM part), u AS (SELECT *, greatest(1.0::DOUBLE, 64.0::DOUBLE / least(w, h)) AS up FROM s), f AS (SELECT *, CASE WHEN greatest(w, h) * up > 896 THEN 896.0::DOUBLE / greatest(w, h) ELSE up END AS f FROM u)
    SELECT p_partkey, CAST(greatest(round_even(w * f / 32, 0) * 32, 32) AS BIGINT) AS width, CAST(greatest(round_even(h * f / 32, 0) * 32, 32) AS BIGINT) AS height FROM f""",
)
def detection_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "part").selectExpr("p_partkey", "cast(p_size * 37 as double) as w", "cast(20 + p_partkey % 1500 as double) as h")
    return s.select("p_partkey", G.detector_dims(F.col("w"), F.col("h")).alias("d")).select("p_partkey", "d.*")


@REGISTRY.query(
    "recognition_width",
    """WITH s AS (SELECT p_partkey, p_size * 20 AS w, p_partkey % 60 AS h FROM part) SELECT p_partkey, CASE WHEN w > 0 AND h > 0 THEN CAST(greatest(least(greatest(ceil(48 * w / h), 1), 3200), 320) AS BIGINT) END AS width FROM s""",
)
def recognition_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "part").selectExpr("p_partkey", "cast(p_size * 20 as bigint) as w", "p_partkey % 60 as h")
    h = F.nullif(F.col("h"), F.lit(0))
    return s.select("p_partkey", G.recognition_width(F.col("w"), h).alias("width"))


@REGISTRY.query(
    "contain_size",
    """WITH s AS (SELECT p_partkey, CAST(p_size * 40 AS DOUBLE) AS w, CAST(1 + p_partkey % 900 AS DOUBLE) AS h FROM part), k AS (SELECT *, least(640.0::DOUBLE / w, 640.0::DOUBLE / h) AS f FROM s), r AS (SELECT p_partkey, CAST(round_even(w * f, 0) AS BIGINT) AS w, CAST(round_even(h * f, 0) AS BIGINT) AS h FROM k)
    SELECT p_partkey, CASE WHEN w > 0 AND h > 0 THEN w END AS width, CASE WHEN w > 0 AND h > 0 THEN h END AS height FROM r""",
)
def contain_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "part").selectExpr("p_partkey", "cast(p_size * 40 as double) as w", "cast(1 + p_partkey % 900 as double) as h")
    return s.select("p_partkey", G.contained(F.col("w"), F.col("h"), 640).alias("c")).select("p_partkey", "c.width", "c.height")


@REGISTRY.query(
    "quad_geometry",
    """WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_partkey % 100 AS DOUBLE) AS x, CAST(l_suppkey % 100 AS DOUBLE) AS y, l_quantity AS w, CAST(l_linenumber AS DOUBLE) * 4 AS h FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem))
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(max(w * h), 6) AS area, round(max(2 * (w + h)), 6) AS perimeter, round(max(w * h * 1.5 / (2 * (w + h))), 6) AS unclip, max(x) AS left_x, max(y + h) AS bottom_y FROM s GROUP BY ALL""",
)
def quad_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners are given out of order and ordered first; the unclip distance is area times 1.5 over the perimeter."""
    s = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity").distinct()
    s = s.selectExpr("*", "cast(l_partkey % 100 as double) as x", "cast(l_suppkey % 100 as double) as y", "l_quantity as w", "cast(l_linenumber as double) * 4 as h")
    point = lambda a, b: F.struct(F.expr(a).alias("x"), F.expr(b).alias("y"))
    q = G.ordered_quad(F.array(point("x + w", "y + h"), point("x", "y"), point("x", "y + h"), point("x + w", "y")))
    s = s.withColumn("q", q)
    a, p = G.area(F.col("q")), G.perimeter(F.col("q"))
    keys = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return s.groupBy(*keys).agg(
        F.round(F.max(a), 6).alias("area"), F.round(F.max(p), 6).alias("perimeter"), F.round(F.max(a * 1.5 / p), 6).alias("unclip"), F.max(F.col("q")[0]["x"]).alias("left_x"), F.max(F.col("q")[3]["y"]).alias("bottom_y")
    )


@REGISTRY.query(
    "iou_pairs",
    """WITH b AS (SELECT DISTINCT l_orderkey AS page, l_linenumber AS n, l_partkey % 40 AS x, l_suppkey % 40 AS y, 10 + CAST(l_quantity AS BIGINT) AS w FROM lineitem), p AS (SELECT a.page, a.n AS n1, c.n AS n2, greatest(0, least(a.x + a.w, c.x + c.w) - greatest(a.x, c.x)) * greatest(0, least(a.y + 20, c.y + 20) - greatest(a.y, c.y)) AS i, a.w * 20 + c.w * 20 AS s FROM b a JOIN b c ON a.page = c.page AND c.n = a.n + 1)
    SELECT page, n1, n2, round(max(i / (s - i)), 6) AS best FROM p GROUP BY page, n1, n2""",
)
def iou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of each page's boxes with those of the next line: an equality join on page and line, never all pairs."""
    b = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as page", "l_linenumber as n", "struct(l_partkey % 40 as x, l_suppkey % 40 as y, 10 + cast(l_quantity as bigint) as width, 20L as height) as b").distinct()
    after = b.select("page", (F.col("n") - 1).alias("n"), F.col("b").alias("c"))
    return b.join(after, ["page", "n"]).groupBy("page", F.col("n").alias("n1"), (F.col("n") + 1).alias("n2")).agg(F.round(F.max(G.iou(F.col("b"), F.col("c"))), 6).alias("best"))


@REGISTRY.query(
    "page_views",
    """WITH s AS (SELECT p_partkey, p_size * 30 AS w, 200 + p_partkey % 900 AS h FROM part), v AS (SELECT *, CAST(least(greatest(ceil(w / 12), 64), 160) AS BIGINT) AS s FROM s)
    SELECT p_partkey, kind, CASE WHEN kind = 'right' THEN w - s ELSE 0 END AS x, CASE WHEN kind = 'full' THEN w ELSE s END AS width, h AS height FROM v CROSS JOIN (VALUES ('full'), ('left'), ('right')) t(kind) WHERE kind = 'full' OR w >= 128""",
)
def page_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "part").selectExpr("p_partkey", "cast(p_size * 30 as bigint) as w", "200 + p_partkey % 900 as h")
    return s.select("p_partkey", F.explode(seals.page_views(F.col("w"), F.col("h"))).alias("v")).select("p_partkey", "v.kind", "v.x", "v.width", "v.height")


@REGISTRY.query(
    "adjacent_views",
    """WITH s AS (SELECT p_partkey, 1190 AS w, 1684 AS h, CASE WHEN p_partkey % 2 = 0 THEN 'left' ELSE 'right' END AS edge, p_size * 30 AS top, 20 + p_size * 2 AS bw, 100 + p_partkey % 300 AS bh FROM part),
    v AS (SELECT *, least(greatest(bw, 64), w) AS vw, least(least(greatest(bh * 2, 320), 512), h) AS vh FROM s)
    SELECT p_partkey, CAST(CASE WHEN edge = 'left' THEN 0 ELSE w - vw END AS BIGINT) AS x, CAST(least(greatest(top + bh // 2 - vh // 2, 0), h - vh) AS BIGINT) AS y, CAST(vw AS BIGINT) AS width, CAST(vh AS BIGINT) AS height FROM v""",
)
def adjacent_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "part").selectExpr("p_partkey", "if(p_partkey % 2 = 0, 'left', 'right') as edge", "struct(0L as x, p_size * 30L as y, 20L + p_size * 2 as width, 100 + p_partkey % 300 as height) as box")
    return s.select("p_partkey", seals.adjacent_view(F.lit(1190), F.lit(1684), F.col("edge"), F.col("box")).alias("v")).select("p_partkey", "v.x", "v.y", "v.width", "v.height")


@REGISTRY.query(
    "seal_projection",
    """WITH s AS (SELECT vec_id, abs(CAST(embedding[1] AS DOUBLE)) * 900 AS x1, abs(CAST(embedding[2] AS DOUBLE)) * 900 AS y1, abs(CAST(embedding[3] AS DOUBLE)) * 2500 AS x2, abs(CAST(embedding[4] AS DOUBLE)) * 2500 AS y2 FROM embeddings),
    c AS (SELECT vec_id, CAST(floor(x1 * 100 / 640) AS BIGINT) + 1100 AS x1, CAST(floor(y1 * 1600 / 640) AS BIGINT) AS y1, CAST(ceil(x2 * 100 / 640) AS BIGINT) + 1100 AS x2, CAST(ceil(y2 * 1600 / 640) AS BIGINT) AS y2 FROM s),
    n AS (SELECT vec_id, least(greatest(CASE WHEN abs(x1) <= 2 THEN 0 ELSE x1 END, 0), 1200) AS x1, least(greatest(CASE WHEN abs(y1) <= 2 THEN 0 ELSE y1 END, 0), 1600) AS y1, least(greatest(CASE WHEN abs(x2 - 1200) <= 2 THEN 1200 ELSE x2 END, 0), 1200) AS x2, least(greatest(CASE WHEN abs(y2 - 1600) <= 2 THEN 1600 ELSE y2 END, 0), 1600) AS y2 FROM c)
    SELECT vec_id, CASE WHEN x2 > x1 AND y2 > y1 THEN x1 END AS x, CASE WHEN x2 > x1 AND y2 > y1 THEN y1 END AS y, CASE WHEN x2 > x1 AND y2 > y1 THEN x2 - x1 END AS width, CASE WHEN x2 > x1 AND y2 > y1 THEN y2 - y1 END AS height FROM n""",
)
def seal_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda k, f: F.abs(F.col("embedding")[k].cast("double")) * f
    head = F.struct(at(0, 900).alias("x1"), at(1, 900).alias("y1"), at(2, 2500).alias("x2"), at(3, 2500).alias("y2"))
    view = F.struct(*(F.lit(v).cast("bigint").alias(n) for n, v in (("x", 1100), ("y", 0), ("width", 100), ("height", 1600))))
    s = table(spark, sf_dir, "embeddings").select("vec_id", head.alias("h"), view.alias("v"))
    # Scales are applied as value * extent / 640.
    box = seals.projected(F.struct(*((F.col(f"h.{n}")).alias(n) for n in ("x1", "y1", "x2", "y2"))), F.col("v"), F.lit(1200).cast("bigint"), F.lit(1600).cast("bigint"))
    return s.select("vec_id", box.alias("b")).select("vec_id", "b.x", "b.y", "b.width", "b.height")


@REGISTRY.query(
    "fragment_fusion",
    """WITH f AS (SELECT DISTINCT l_orderkey AS page, l_partkey % 30 AS x, l_suppkey % 30 AS y, 2 + CAST(l_quantity AS BIGINT) AS width, CAST(5 + l_linenumber * 10 AS BIGINT) AS height FROM lineitem),
    b AS (SELECT page, arg_max({'w': width, 'h': height, 'y': y}, [width, height, x, y]) AS b FROM f GROUP BY page),
    n AS (SELECT f.*, b.b, f.width * 4 <= b.b.w AND f.y >= b.b.y AND f.y + f.height <= b.b.y + b.b.h AS narrow FROM f JOIN b USING (page)),
    g AS (SELECT page, min(x) FILTER (narrow) AS lo, max(x + width) FILTER (narrow) AS hi, any_value(b) AS b FROM n GROUP BY page HAVING count(*) FILTER (narrow) >= 2)
    SELECT page, x, y, width, height FROM f WHERE page NOT IN (SELECT page FROM g) UNION ALL SELECT page, lo, b.y, hi - lo, b.h FROM g""",
)
def fragment_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as page", "l_partkey % 30 as x", "l_suppkey % 30 as y", "2 + cast(l_quantity as bigint) as width", "5 + l_linenumber * 10L as height").distinct()
    return seals.fused(f, ["page"])


@REGISTRY.query(
    "crop_plans",
    """WITH s AS (SELECT p_partkey, p_size * 3.7::DOUBLE AS w, (p_partkey % 300) * 1.3::DOUBLE AS h FROM part), t AS (SELECT p_partkey, CAST(trunc(w) AS BIGINT) AS w, CAST(trunc(h) AS BIGINT) AS h FROM s)
    SELECT p_partkey, w, h, w > 0 AND h / w >= 1.5 AS rotated, w * h BETWEEN 1 AND 67108864 AS ok FROM t""",
)
def crop_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "part").selectExpr("p_partkey", "cast(p_size * 3.7D as bigint) as w", "cast((p_partkey % 300) * 1.3D as bigint) as h")
    return s.select("p_partkey", "w", "h", ((F.col("w") > 0) & (F.col("h") / F.nullif("w", F.lit(0)) >= 1.5)).alias("rotated"), (F.col("w") * F.col("h")).between(1, 64 << 20).alias("ok"))


_MARKUP_SQL = """'<|ref|>' || (['title', 'text', 'image', 'page-number', 'odd'])[doc_id % 5 + 1] || '<|/ref|><|det|>[[' || doc_id % 500 || ', ' || n_chars % 500 || ', ' || (doc_id % 500 + 200) || ', ' || (n_chars % 600 + 1) || ']]<|/det|> ' || source || chr(10) || '<|det|>formula [10, 20, 300, 400]<|/det|>' || lang || ' \\coloneqq x'"""


def _markup() -> F.Column:
    label = F.array(*map(F.lit, ("title", "text", "image", "page-number", "odd")))[(F.col("doc_id") % 5).cast("int")]
    s = lambda c: c.cast("string")
    d, n = F.col("doc_id"), F.col("n_chars")
    return F.concat(
        F.lit("<|ref|>"), label, F.lit("<|/ref|><|det|>[["), s(d % 500), F.lit(", "), s(n % 500), F.lit(", "), s(d % 500 + 200), F.lit(", "), s(n % 600 + 1), F.lit("]]<|/det|> "), F.col("source"),
        F.lit("\n<|det|>formula [10, 20, 300, 400]<|/det|>"), F.col("lang"), F.lit(" \\coloneqq x"),
    )


@REGISTRY.query(
    "grounding_blocks",
    """WITH s AS (SELECT doc_id, source, lang, (['title', 'text', 'image', 'page-number', 'odd'])[doc_id % 5 + 1] AS label, (['title', 'paragraph', 'figure', 'page-number', 'unknown'])[doc_id % 5 + 1] AS role, doc_id % 500 AS l, n_chars % 500 AS t, doc_id % 500 + 200 AS r, n_chars % 600 + 1 AS b FROM documents),
    a AS (SELECT doc_id, 0 AS pos, role, source AS text, l * 1000 // 999 AS x, t * 500 // 999 AS y, r * 1000 // 999 - l * 1000 // 999 AS w, b * 500 // 999 - t * 500 // 999 AS h FROM s WHERE label <> 'image' AND t < b)
    SELECT doc_id, CAST(0 AS BIGINT) AS pos, role, text, x || ',' || y || ',' || w || ',' || h AS box FROM a WHERE w > 0 AND h > 0
    UNION ALL SELECT s.doc_id, CASE WHEN EXISTS (SELECT 1 FROM a WHERE a.doc_id = s.doc_id AND w > 0 AND h > 0) THEN 1 ELSE 0 END, 'equation-block', lang || ' := x', '10,10,290,190' FROM s""",
)
def grounding_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", grounding.blocks(_markup(), F.lit(1000), F.lit(500)).alias("blocks"))
    b = d.select("doc_id", F.posexplode("blocks").alias("pos", "b"))
    return b.select("doc_id", F.col("pos").cast("bigint").alias("pos"), "b.role", T.normalized(F.col("b.text"), "</s>").alias("text"), G.box_key(G.envelope_of_boxes(F.col("b.parts"))).alias("box"))


@REGISTRY.query(
    "canonical_roles",
    """SELECT label, count(*) AS n, CASE translate(lower(label), '-', '_') WHEN 'doc_title' THEN 'title' WHEN 'list_item' THEN 'list' WHEN 'figure' THEN 'figure' ELSE 'unknown' END AS role FROM (SELECT (['Doc-Title', 'list_item', 'FIGURE', 'chart'])[l_orderkey % 4 + 1] AS label FROM lineitem) GROUP BY label""",
)
def canonical_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.array(*map(F.lit, ("Doc-Title", "list_item", "FIGURE", "chart")))[(F.col("l_orderkey") % 4).cast("int")]
    g = table(spark, sf_dir, "lineitem").groupBy(label.alias("label")).agg(F.count("*").alias("n"))
    return g.select("label", "n", T.canonical_role(F.col("label")).alias("role"))


@REGISTRY.query(
    "prompt_encoding",
    """SELECT p_partkey, 3 + p_size % 7 + 2 AS n, 3 AS lo, 3 + p_size % 7 AS hi, array_to_string(list_concat(list_concat([1, 5, 6], list_transform(range(p_size % 7), lambda i: 99)), [7, 2]), ',') AS ids FROM (SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size FROM part)""",
)
def prompt_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = lambda *v: F.array(*(F.lit(x).cast("bigint") for x in v))
    s = table(spark, sf_dir, "part").select("p_partkey", grounding.prompt(ids(1, 5, 6), (F.col("p_size") % 7).cast("bigint"), ids(7, 2), 99).alias("p"))
    return s.select("p_partkey", F.size("p.ids").cast("bigint").alias("n"), F.col("p.lo").cast("int").alias("lo"), "p.hi", F.array_join("p.ids", ",").alias("ids"))


@REGISTRY.query(
    "generated_ids",
    """SELECT l_orderkey, l_linenumber, printf('table-%04d', l_orderkey % 10000) AS table_id, printf('table-%04d:cell-%04d', l_orderkey % 10000, l_linenumber - 1) AS cell_id, printf('seal-%d', l_linenumber) AS seal_id FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)""",
)
def generated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    tid = F.format_string("table-%04d", F.col("l_orderkey") % 10000)
    return s.select("l_orderkey", "l_linenumber", tid.alias("table_id"), F.concat(tid, F.format_string(":cell-%04d", F.col("l_linenumber") - 1)).alias("cell_id"), F.format_string("seal-%d", "l_linenumber").alias("seal_id"))


@REGISTRY.query(
    "parity_text",
    r"""SELECT doc_id, sha256(replace(regexp_replace(text, '\s+', '', 'g'), ',', '.')) AS digest FROM documents""",
)
def parity_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = F.replace(F.regexp_replace("text", r"\s+", ""), F.lit(","), F.lit("."))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(bare.cast("binary"), 256).alias("digest"))


@REGISTRY.query(
    "closest_grid",
    """WITH RECURSIVE g AS (SELECT c, r, row_number() OVER (ORDER BY c * r, c, r) AS k FROM range(1, 33) a(c), range(1, 33) b(r) WHERE c * r BETWEEN 2 AND 32), p AS (SELECT p_partkey, CAST(p_size * 40 AS DOUBLE) AS w, CAST(30 + p_partkey % 900 AS DOUBLE) AS h FROM part),
    f AS (SELECT p_partkey, w, h, k, c, r, abs(w / h - c / r) AS d FROM p JOIN g ON k = 1 UNION ALL
      SELECT f.p_partkey, w, h, g.k, CASE WHEN b THEN g.c ELSE f.c END, CASE WHEN b THEN g.r ELSE f.r END, CASE WHEN b THEN e ELSE d END FROM f JOIN g ON g.k = f.k + 1 CROSS JOIN LATERAL (SELECT abs(w / h - g.c / g.r) AS e) CROSS JOIN LATERAL (SELECT e < d OR (e = d AND 2 * w * h > 640 * 640 * g.c * g.r) AS b))
    SELECT p_partkey, c AS cols, r AS rows FROM f WHERE k = (SELECT max(k) FROM g)""",
)
def closest_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "part").selectExpr("p_partkey", "cast(p_size * 40 as double) as w", "cast(30 + p_partkey % 900 as double) as h")
    return s.select("p_partkey", tensors.closest_grid(F.col("w"), F.col("h"), 640).alias("g")).select("p_partkey", "g.cols", "g.rows")


@REGISTRY.query(
    "window_partition",
    """SELECT event_id, (event_id % 40) // 14 * 3 + (event_id // 40 % 40) // 14 AS win, (event_id % 40) % 14 * 14 + (event_id // 40 % 40) % 14 AS slot FROM events""",
)
def window_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    y, x = F.col("event_id") % 40, F.expr("event_id div 40 % 40")
    return table(spark, sf_dir, "events").select("event_id", tensors.window_of(y, x, 40, 14).alias("w")).select("event_id", "w.win", "w.slot")


@REGISTRY.query(
    "linear_resample",
    """WITH e AS (SELECT vec_id, embedding AS a FROM embeddings), t AS (SELECT e.vec_id, i, a, greatest(0.0::DOUBLE, least(63.0::DOUBLE, (i + 0.5) * 64 / 24 - 0.5)) AS p FROM e, range(24) r(i))
    SELECT vec_id, i, round(CAST(a[CAST(floor(p) AS INT) + 1] AS DOUBLE) * (1 - (p - floor(p))) + CAST(a[CAST(least(floor(p) + 1, 63) AS INT) + 1] AS DOUBLE) * (p - floor(p)), 6) AS v FROM t""",
)
def linear_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(tensors.resampled(F.col("embedding"), 64, 24)).alias("i", "v"))
    return e.select("vec_id", F.col("i").cast("bigint").alias("i"), F.round("v", 6).alias("v"))


@REGISTRY.query(
    "rope_tables",
    """SELECT event_id % 64 AS pos, k, round(cos((event_id % 64) / pow(10000, 2 * k / 16)), 9) AS c, round(sin((event_id % 64) / pow(10000, 2 * k / 16)), 9) AS s, count(*) AS n FROM events, range(8) r(k) GROUP BY ALL""",
)
def rope_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    pos = table(spark, sf_dir, "events").groupBy((F.col("event_id") % 64).alias("pos")).agg(F.count("*").alias("n"))
    r = pos.select("pos", "n", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k"))
    angle = tensors.rope_angle(F.col("pos"), F.col("k"), 16)
    return r.select("pos", F.col("k").cast("bigint").alias("k"), F.round(F.cos(angle), 9).alias("c"), F.round(F.sin(angle), 9).alias("s"), "n")


@REGISTRY.query(
    "causal_mask",
    """WITH q AS (SELECT conv_id, turn FROM conversations) SELECT a.conv_id, a.turn, count(*) AS visible FROM q a JOIN q b ON a.conv_id = b.conv_id AND b.turn <= a.turn GROUP BY a.conv_id, a.turn""",
)
def causal_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions a token attends to: those up to itself, by a running count and no self join."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("conv_id").orderBy("turn").rangeBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.count("*").over(w).alias("visible"))


@REGISTRY.query(
    "packing_order",
    """SELECT p_partkey, part, n, CAST(sum(n) OVER (PARTITION BY p_partkey ORDER BY k ROWS UNBOUNDED PRECEDING) - n AS BIGINT) AS first FROM (SELECT p_partkey, 'local' AS part, 0 AS k, CAST(4 * (p_size % 3 + 1) * (4 * (p_size % 2 + 1) + 1) AS BIGINT) AS n FROM part UNION ALL SELECT p_partkey, 'global', 1, 4 * 5 FROM part UNION ALL SELECT p_partkey, 'separator', 2, 1 FROM part)""",
)
def packing_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "part").select("p_partkey", F.explode(tensors.packing(F.lit(4), F.col("p_size") % 3 + 1, F.col("p_size") % 2 + 1)).alias("p"))
    return s.select("p_partkey", "p.part", "p.n", "p.first")


@REGISTRY.query(
    "expert_heat",
    """WITH h AS (SELECT event_type AS layer, user_id % 16 AS expert, count(*) AS n FROM events GROUP BY ALL) SELECT layer, expert, n, rank() OVER (PARTITION BY layer ORDER BY n DESC, expert) AS place FROM h QUALIFY place <= 5""",
)
def expert_heat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    h = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("layer"), (F.col("user_id") % 16).alias("expert")).agg(F.count("*").alias("n"))
    return h.withColumn("place", F.rank().over(Window.partitionBy("layer").orderBy(F.desc("n"), "expert")).cast("bigint")).where("place <= 5")


@REGISTRY.query(
    "second_pass",
    """SELECT user_id, event_type, 'fast' AS pass, max(value) AS value FROM events GROUP BY ALL HAVING max(value) > 300 UNION ALL SELECT user_id, event_type, 'quality', max(value) FROM events GROUP BY ALL HAVING max(value) <= 300""",
)
def second_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups that a fast pass leaves empty are looked at again; both passes are united."""
    g = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max("value").alias("value"))
    fast, again = g.where("value > 300"), g.where("value <= 300")
    label = lambda df, name: df.select("user_id", "event_type", F.lit(name).alias("pass"), "value")
    return label(fast, "fast").unionByName(label(again, "quality"))


@REGISTRY.query(
    "cell_quads",
    """WITH e AS (SELECT vec_id, list_transform(embedding[1:8], lambda x: CAST(x AS DOUBLE) * 20) AS a FROM embeddings), q AS (SELECT vec_id, list_transform(a, lambda x, i: least(greatest(CAST(trunc(200 / (1 + exp(-x))) AS BIGINT), 0), CASE WHEN i % 2 = 1 THEN 200 ELSE 100 END) + CASE WHEN i % 2 = 1 THEN 10 ELSE 20 END) AS q FROM e)
    SELECT vec_id, array_to_string(q, ',') AS quad FROM q""",
)
def cell_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight logits to four corners on a crop of 200 by 100 at (10, 20): sigmoid times the longer side, cut to whole pixels, within the crop."""
    limit = lambda i: F.when(i % 2 == 0, F.lit(200)).otherwise(F.lit(100))
    shift = lambda i: F.when(i % 2 == 0, F.lit(10)).otherwise(F.lit(20))
    q = F.transform(F.slice("embedding", 1, 8), lambda x, i: F.least(F.greatest((F.lit(200) * X.sigmoid(x.cast("double") * 20)).cast("bigint"), F.lit(0)), limit(i)) + shift(i))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(q, ",").alias("quad"))


@REGISTRY.query(
    "map_projection",
    """SELECT l_orderkey, l_linenumber, l_partkey, CAST(max(least(greatest(round(l_partkey % 224 * 1000 / 224.0::DOUBLE), 0), 1000)) AS BIGINT) AS x, CAST(max(least(greatest(round(l_suppkey % 320 * 777 / 320.0::DOUBLE), 0), 777)) AS BIGINT) AS y FROM lineitem GROUP BY ALL""",
)
def map_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda c, size, side: F.least(F.greatest(F.round(F.col(c) % size * side / float(size)), F.lit(0)), F.lit(side)).cast("bigint")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.max(at("l_partkey", 224, 1000)).alias("x"), F.max(at("l_suppkey", 320, 777)).alias("y"))
