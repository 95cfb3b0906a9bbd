"""Contract predicates over columns derived from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docweave.functions import geometry as G
from docweave.functions import text as T
from docweave.operators import validate as V
from docweave.registry import Registry, table

REGISTRY = Registry()

_BOX = "struct(l_partkey % 900 as x, l_suppkey % 70 as y, cast(l_quantity as bigint) - 2 as width, cast(l_linenumber as bigint) as height) as box"
_LINE = ["l_orderkey", "l_partkey", "l_suppkey", "cast(l_linenumber as bigint) as l_linenumber", "cast(l_quantity as bigint) as q"]
_BOX_SQL = "l_partkey % 900 AS x, l_suppkey % 70 AS y, CAST(l_quantity AS BIGINT) - 2 AS w, CAST(l_linenumber AS BIGINT) AS h"


@REGISTRY.query(
    "slot_ids",
    r"""WITH s AS (SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, substr(url, 8, 12) AS piece FROM pages)
    SELECT page_id, host, regexp_full_match(host, '[A-Za-z0-9][A-Za-z0-9._:-]{0,127}') AS host_ok, piece, regexp_full_match(piece, '[A-Za-z0-9][A-Za-z0-9._:-]{0,127}') AS piece_ok FROM s""",
)
def slot_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.substring("url", 8, 12).alias("piece"))
    return s.select("page_id", "host", T.matches(F.col("host"), T.SLOT_ID).alias("host_ok"), "piece", T.matches(F.col("piece"), T.SLOT_ID).alias("piece_ok"))


@REGISTRY.query(
    "provider_descriptors",
    r"""WITH s AS (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN s_name ELSE lower(replace(s_name, '#', '-')) END AS pid,
        CASE WHEN s_suppkey % 7 = 0 THEN '  ' ELSE 'engine ' || s_nationkey END AS engine,
        CASE WHEN s_suppkey % 5 = 0 THEN [] WHEN s_suppkey % 5 = 1 THEN ['text', 'table'] WHEN s_suppkey % 5 = 2 THEN ['table', 'table'] WHEN s_suppkey % 5 = 3 THEN ['seal', 'text'] WHEN s_suppkey % 2 = 0 THEN ['layout', 'table', 'seal'] ELSE ['text', 'vision'] END AS stages FROM supplier)
    SELECT s_suppkey, pid, CASE WHEN NOT regexp_full_match(pid, '[a-z0-9][a-z0-9._-]{0,63}') THEN 'provider_id'
        WHEN NOT (strlen(engine) BETWEEN 1 AND 128 AND regexp_matches(engine, '\S')) THEN 'engine'
        WHEN NOT (len(tags) > 0 AND len(list_filter(tags, lambda t: t IS NULL)) = 0 AND list_sort(list_distinct(tags)) = tags) THEN 'stages' END AS violation
    FROM (SELECT *, list_transform(stages, lambda s: list_position(['orientation', 'preprocessing', 'layout', 'text', 'table', 'formula', 'seal'], s)) AS tags FROM s)""",
)
def provider_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    stages = F.when(k % 5 == 0, F.array().cast("array<string>")).when(k % 5 == 1, F.array(F.lit("text"), F.lit("table"))).when(k % 5 == 2, F.array(F.lit("table"), F.lit("table"))).when(k % 5 == 3, F.array(F.lit("seal"), F.lit("text"))).when(k % 2 == 0, F.array(F.lit("layout"), F.lit("table"), F.lit("seal"))).otherwise(F.array(F.lit("text"), F.lit("vision")))
    pid = F.when(k % 3 == 0, F.col("s_name")).otherwise(F.lower(F.replace("s_name", F.lit("#"), F.lit("-"))))
    engine = F.when(k % 7 == 0, F.lit("  ")).otherwise(F.concat(F.lit("engine "), F.col("s_nationkey").cast("string")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", pid.alias("pid"), V.provider_violation(pid, engine, stages).alias("violation"))


@REGISTRY.query(
    "label_shapes",
    r"""WITH s AS (SELECT p_partkey, p_type, replace(p_type, ' ', '_') AS label FROM part)
    SELECT p_partkey, label, coalesce(regexp_full_match(label, '[A-Za-z_][A-Za-z0-9_-]{0,127}'), false) AS label_ok, coalesce(regexp_full_match(p_type, '[A-Za-z_][A-Za-z0-9_-]{0,127}'), false) AS raw_ok FROM s""",
)
def label_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.replace("p_type", F.lit(" "), F.lit("_"))
    return table(spark, sf_dir, "part").select("p_partkey", label.alias("label"), T.matches(label, T.LABEL).alias("label_ok"), T.matches(F.col("p_type"), T.LABEL).alias("raw_ok"))


@REGISTRY.query(
    "digest_shapes",
    """WITH s AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN upper(sha256(text)) WHEN doc_id % 3 = 1 THEN sha256(text) ELSE substr(sha256(text), 1, 40) END AS d FROM documents)
    SELECT doc_id, d, regexp_full_match(d, '[0-9A-Fa-f]{64}') AS any_case, regexp_full_match(d, '[0-9a-f]{64}') AS lower_only, regexp_full_match(d, '([0-9a-f]{40}|[0-9a-f]{64})') AS revision FROM s""",
)
def digest_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sha = F.sha2(F.col("text").cast("binary"), 256)
    d = F.when(F.col("doc_id") % 3 == 0, F.upper(sha)).when(F.col("doc_id") % 3 == 1, sha).otherwise(F.substring(sha, 1, 40))
    s = table(spark, sf_dir, "documents").select("doc_id", d.alias("d"))
    return s.select("doc_id", "d", *(T.matches(F.col("d"), p).alias(n) for n, p in (("any_case", T.SHA256_ANY), ("lower_only", T.SHA256_LOWER), ("revision", T.GIT_REVISION))))


@REGISTRY.query(
    "confidences",
    """WITH s AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 13 = 0 THEN CAST('nan' AS DOUBLE) ELSE value / 300 END AS c FROM events)
    SELECT event_id, c IS NULL OR (NOT isnan(c) AND c BETWEEN 0 AND 1) AS ok FROM s""",
)
def confidences(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.when(F.col("event_id") % 11 == 0, None).when(F.col("event_id") % 13 == 0, F.lit(float("nan"))).otherwise(F.col("value") / 300)
    return table(spark, sf_dir, "events").select("event_id", V.confidence_ok(c).alias("ok"))


@REGISTRY.query(
    "bounded_texts",
    r"""SELECT doc_id, strlen(text) <= 4096 AND NOT regexp_matches(text, '\p{Cc}') AS item_ok,
    strlen(replace(text, chr(10), ' ')) <= 4096 AND NOT regexp_matches(replace(text, chr(10), ' '), '\p{Cc}') AS flat_ok FROM documents""",
)
def bounded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = F.replace("text", F.lit("\n"), F.lit(" "))
    return table(spark, sf_dir, "documents").select("doc_id", V.T.bounded_text(F.col("text"), V.MAX_ITEM_TEXT).alias("item_ok"), V.T.bounded_text(flat, V.MAX_ITEM_TEXT).alias("flat_ok"))


@REGISTRY.query(
    "batch_shape",
    """SELECT conv_id, count(*) AS slots, count(DISTINCT turn) AS ids, count(DISTINCT role) AS stages,
    CASE WHEN count(DISTINCT role) = 0 THEN 'stages' WHEN count(*) NOT BETWEEN 1 AND 256 THEN 'slots' WHEN count(DISTINCT turn) <> count(*) THEN 'slot_ids' END AS violation FROM conversations GROUP BY conv_id""",
)
def batch_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("slots"), F.countDistinct("turn").alias("ids"), F.countDistinct("role").alias("stages"))
    rules = (("stages", F.col("stages") > 0), ("slots", F.col("slots").between(1, V.MAX_SLOTS)), ("slot_ids", F.col("ids") == F.col("slots")))
    return g.withColumn("violation", V.first_violation(*rules))


@REGISTRY.query(
    "adjacency",
    """SELECT conv_id, turn, predecessor, predecessor IS NULL OR predecessor IS NOT DISTINCT FROM lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS ok
    FROM (SELECT conv_id, turn, CASE WHEN turn = 0 THEN NULL WHEN turn % 5 = 4 THEN turn ELSE turn - 1 END AS predecessor FROM conversations)""",
)
def adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    pred = F.when(F.col("turn") == 0, None).when(F.col("turn") % 5 == 4, F.col("turn")).otherwise(F.col("turn") - 1)
    before = F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn"))
    s = table(spark, sf_dir, "conversations").select("conv_id", "turn", pred.alias("predecessor"))
    return s.select("conv_id", "turn", "predecessor", (F.col("predecessor").isNull() | F.col("predecessor").eqNullSafe(before)).alias("ok"))


@REGISTRY.query(
    "outcome_invariants",
    """WITH s AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'text' WHEN 1 THEN 'table' WHEN 2 THEN 'seal' ELSE 'layout' END AS stage,
      CASE o_orderkey % 3 WHEN 0 THEN 'completed' WHEN 1 THEN 'failed' ELSE 'skipped' END AS status, o_orderkey % 5 = 0 AS has_error,
      CASE o_orderkey % 7 WHEN 0 THEN 'table' WHEN 1 THEN 'seal' END AS evidence FROM orders)
    SELECT o_orderkey, CASE WHEN (status IN ('failed', 'skipped')) <> has_error THEN 'error' WHEN (status = 'completed' AND stage IN ('table', 'seal')) <> (evidence IS NOT NULL) THEN 'evidence'
      WHEN NOT coalesce(evidence = stage, true) THEN 'evidence_type' END AS violation FROM s""",
)
def outcome_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    stage = F.when(k % 4 == 0, "text").when(k % 4 == 1, "table").when(k % 4 == 2, "seal").otherwise("layout")
    status = F.when(k % 3 == 0, "completed").when(k % 3 == 1, "failed").otherwise("skipped")
    evidence = F.when(k % 7 == 0, "table").when(k % 7 == 1, "seal")
    return table(spark, sf_dir, "orders").select("o_orderkey", V.outcome_violation(stage, status, k % 5 == 0, evidence).alias("violation"))


@REGISTRY.query(
    "provider_output",
    rf"""WITH s AS (SELECT *, {_BOX_SQL}, CASE WHEN l_orderkey % 9 = 0 THEN '' ELSE 'model-' || l_suppkey END AS model, l_linenumber % 6 AS receipts, l_linenumber - 1 AS page,
      l_discount * 12 AS confidence, CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE l_returnflag || CASE WHEN l_partkey % 5 = 0 THEN ' x' ELSE '_x' END END AS label FROM lineitem)
    SELECT violation, count(*) AS n FROM (SELECT CASE WHEN NOT (strlen(model) BETWEEN 1 AND 256) THEN 'model' WHEN NOT receipts > 0 THEN 'receipts' WHEN NOT page >= 1 THEN 'page'
      WHEN NOT confidence BETWEEN 0 AND 1 THEN 'confidence' WHEN NOT (label IS NULL OR regexp_full_match(label, '[A-Za-z_][A-Za-z0-9_-]{{0,127}}')) THEN 'category'
      WHEN NOT (w > 0 AND h > 0) THEN 'geometry' END AS violation FROM s) GROUP BY violation""",
)
def provider_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "lineitem").selectExpr("*", _BOX)
    model = F.when(F.col("l_orderkey") % 9 == 0, F.lit("")).otherwise(F.concat(F.lit("model-"), F.col("l_suppkey").cast("string")))
    label = F.when(F.col("l_partkey") % 4 != 0, F.concat("l_returnflag", F.when(F.col("l_partkey") % 5 == 0, F.lit(" x")).otherwise(F.lit("_x"))))
    violation = V.output_violation(model, F.col("l_linenumber") % 6, F.col("l_linenumber") - 1, F.col("l_discount") * 12, label, F.col("box"))
    return s.groupBy(violation.alias("violation")).agg(F.count("*").alias("n"))


@REGISTRY.query(
    "receipts",
    """WITH s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN 4 ELSE 1 END AS schema_no, CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE o_orderpriority END AS family, sha256(o_orderpriority) AS weights,
      CASE WHEN o_orderkey % 7 = 0 THEN 'zz' ELSE sha256(o_orderstatus) END AS input, upper(sha256(CAST(o_custkey AS VARCHAR))) AS output,
      CASE o_orderkey % 5 WHEN 0 THEN 'f32-tensor' WHEN 1 THEN 'token-ids' WHEN 2 THEN 'utf8-text' WHEN 3 THEN 'image-request' ELSE 'pixels' END AS representation,
      CASE WHEN o_orderkey % 4 = 0 THEN o_custkey % 4 END AS mi FROM orders)
    SELECT o_orderkey, CASE WHEN NOT strlen(family) BETWEEN 1 AND 256 THEN 'family' WHEN NOT regexp_full_match(weights, '[0-9A-Fa-f]{64}') THEN 'weights_digest' WHEN NOT regexp_full_match(input, '[0-9A-Fa-f]{64}') THEN 'input_digest'
      WHEN NOT regexp_full_match(output, '[0-9A-Fa-f]{64}') THEN 'output_digest' WHEN representation = 'pixels' THEN 'representation' WHEN (schema_no = 4) <> (mi IS NOT NULL) THEN 'microbatch'
      WHEN NOT (mi IS NULL OR mi < 3) THEN 'microbatch_range' END AS violation FROM s""",
)
def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rep = F.when(k % 5 == 0, "f32-tensor").when(k % 5 == 1, "token-ids").when(k % 5 == 2, "utf8-text").when(k % 5 == 3, "image-request").otherwise("pixels")
    micro = F.when(k % 4 == 0, F.col("o_custkey") % 4)
    sha = lambda c: F.sha2(c.cast("string").cast("binary"), 256)
    r = F.struct(
        F.when(k % 6 == 0, 4).otherwise(1).alias("schema"),
        F.when(k % 10 == 0, F.lit("")).otherwise(F.col("o_orderpriority")).alias("family"),
        sha(F.col("o_orderpriority")).alias("weights"),
        F.when(k % 7 == 0, F.lit("zz")).otherwise(sha(F.col("o_orderstatus"))).alias("input"),
        F.upper(sha(F.col("o_custkey"))).alias("output"),
        rep.alias("representation"),
        micro.alias("micro_index"),
        F.lit(3).alias("micro_count"),
        F.lit(2).alias("micro_slots"),
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", r.alias("r")).select("o_orderkey", V.receipt_violation(F.col("r")).alias("violation"))


@REGISTRY.query(
    "regions",
    f"""WITH s AS (SELECT p_partkey, 40 + p_size * 4 AS cw, 300 AS ch, p_size * 3 AS x, p_size AS y, p_size % 7 * 10 AS w, p_size % 9 * 30 AS h, p_partkey % 4 AS form FROM part),
    t AS (SELECT *, CASE form WHEN 0 THEN [] WHEN 1 THEN [[x, y], [x + w, y], [x + w, y + h], [x, y + h]] WHEN 2 THEN [[x, y], [x + w, y + h]] ELSE [[x, y], [x + w, y], [x + w - 1, y + h]] END AS p FROM s)
    SELECT p_partkey, cw BETWEEN 1 AND 100000 AND ch BETWEEN 1 AND 100000 AS canvas_ok, CASE WHEN NOT (w > 0 AND h > 0) THEN 'area' WHEN NOT (x >= 0 AND y >= 0 AND x + w <= cw AND y + h <= ch) THEN 'canvas'
      WHEN NOT (len(p) = 0 OR len(p) BETWEEN 3 AND 64) THEN 'polygon_size' WHEN form = 1 OR form = 3 THEN NULL END AS violation FROM t""",
)
def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "part").selectExpr("p_partkey", "cast(40 + p_size * 4 as bigint) as cw", "300L as ch", "p_size * 3L as x", "cast(p_size as bigint) as y", "p_size % 7 * 10L as w", "p_size % 9 * 30L as h", "p_partkey % 4 as form")
    pt = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    x, y, w, h = (F.col(c) for c in "xywh")
    none = F.slice(F.array(pt(x, y)), 1, 0)
    polygon = F.when(F.col("form") == 0, none).when(F.col("form") == 1, F.array(pt(x, y), pt(x + w, y), pt(x + w, y + h), pt(x, y + h))).when(F.col("form") == 2, F.array(pt(x, y), pt(x + w, y + h))).otherwise(F.array(pt(x, y), pt(x + w, y), pt(x + w - 1, y + h)))
    s = s.withColumn("polygon", polygon).withColumn("box", G.box(x, y, w, h))
    return s.select("p_partkey", V.canvas_ok(F.col("cw"), F.col("ch")).alias("canvas_ok"), V.region_violation(F.col("cw"), F.col("ch"), F.col("box"), F.col("polygon")).alias("violation"))


@REGISTRY.query(
    "seal_evidence",
    """WITH s AS (SELECT p_partkey, p_size % 3 AS x, p_size % 4 * 10 AS y, 100 - p_size % 3 - p_size % 2 AS w, 50 AS h, CASE WHEN p_partkey % 3 = 0 THEN 'boundary-candidate' ELSE 'confirmed' END AS status, p_partkey % 5 AS form, p_partkey % 7 = 0 AS no_text FROM part),
    t AS (SELECT *, CASE form WHEN 0 THEN [] WHEN 1 THEN ['left'] WHEN 2 THEN ['left', 'right'] WHEN 3 THEN ['right', 'left'] ELSE ['bottom'] END AS e FROM s)
    SELECT p_partkey, CASE WHEN form = 3 THEN 'edge_order' WHEN (list_contains(e, 'left') AND x <> 0) OR (list_contains(e, 'right') AND x + w <> 100) OR (list_contains(e, 'bottom') AND y + h <> 80) THEN 'edge_touch'
      WHEN status = 'boundary-candidate' AND len(e) = 0 THEN 'boundary' WHEN no_text THEN 'confidence' END AS violation FROM t""",
)
def seal_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "part").selectExpr("p_partkey", "p_size % 3 as x", "p_size % 4 * 10 as y", "100 - p_size % 3 - p_size % 2 as w", "50 as h", "if(p_partkey % 3 = 0, 'boundary-candidate', 'confirmed') as status", "p_partkey % 5 as form", "if(p_partkey % 7 = 0, null, 'seal') as seal_text")
    names = lambda *e: F.array(*map(F.lit, e)).cast("array<string>")
    edges = F.when(F.col("form") == 0, names()).when(F.col("form") == 1, names("left")).when(F.col("form") == 2, names("left", "right")).when(F.col("form") == 3, names("right", "left")).otherwise(names("bottom"))
    box = G.box(*(F.col(c) for c in "xywh"))
    return s.select("p_partkey", V.seal_violation(F.col("status"), edges, box, F.lit(100), F.lit(80), F.col("seal_text"), F.lit(0.5)).alias("violation"))


@REGISTRY.query(
    "text_budget",
    """SELECT conv_id, turn, CAST(sum(strlen(text)) OVER w AS BIGINT) AS running_bytes, sum(strlen(text)) OVER w <= 1500 AS within FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)""",
)
def text_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    s = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sum(F.octet_length("text")).over(w).cast("bigint").alias("running_bytes"))
    return s.withColumn("within", F.col("running_bytes") <= 1500)


@REGISTRY.query(
    "quality_retry",
    """SELECT user_id, event_type, max(value) - min(value) >= 32 AND count(*) FILTER (value > 489) = 0 AS retry FROM events GROUP BY user_id, event_type""",
)
def quality_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg((F.max("value") - F.min("value")).alias("r"), F.count_if(F.col("value") > 489).alias("found"))
    return g.select("user_id", "event_type", V.quality_retry(F.col("found"), F.array("r")).alias("retry"))


@REGISTRY.query(
    "pixel_filters",
    """SELECT count(*) FILTER (77 * (l_partkey % 256) + 150 * (l_suppkey % 256) + 29 * (l_orderkey % 256) < 160 * 256) AS dark, count(*) FILTER (l_discount > 0.05 AND l_partkey % 64 < 32 AND l_suppkey % 64 < 48) AS masked,
    count(*) FILTER (l_quantity >= 3 AND l_tax >= 0.02) AS sized FROM lineitem""",
)
def pixel_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return table(spark, sf_dir, "lineitem").agg(
        F.count_if(V.dark(c("l_partkey") % 256, c("l_suppkey") % 256, c("l_orderkey") % 256)).alias("dark"),
        F.count_if(V.mask(c("l_discount"), 0.05, c("l_partkey") % 64, c("l_suppkey") % 64, F.lit(32), F.lit(48))).alias("masked"),
        F.count_if((c("l_quantity") >= 3) & (c("l_tax") >= 0.02)).alias("sized"),
    )


@REGISTRY.query(
    "blank_recognitions",
    r"""WITH s AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN '' WHEN turn % 3 = 1 THEN ' ' || chr(9) || ' ' ELSE text END AS t FROM conversations) SELECT conv_id, turn, t FROM s WHERE regexp_matches(t, '\S')""",
)
def blank_recognitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.when(F.col("turn") % 3 == 0, F.lit("")).when(F.col("turn") % 3 == 1, F.lit(" \t ")).otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", t.alias("t")).where(F.col("t").rlike(r"\S"))


@REGISTRY.query(
    "ctc_rows",
    """WITH s AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 1.5 ELSE CAST(user_id % 9 AS DOUBLE) END AS i, CASE WHEN event_id % 17 = 0 THEN CAST('nan' AS DOUBLE) ELSE value END AS v, CASE WHEN event_id % 7 = 0 THEN 0 ELSE 1 END AS f FROM events)
    SELECT event_id, CASE WHEN f <> 1 THEN 'finite' WHEN NOT (i >= 0 AND i = floor(i) AND i < 8) THEN 'index' WHEN isnan(v) THEN 'score' END AS violation FROM s""",
)
def ctc_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    index = F.when(k % 5 == 0, F.lit(1.5)).otherwise((F.col("user_id") % 9).cast("double"))
    value = F.when(k % 17 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    return table(spark, sf_dir, "events").select("event_id", V.ctc_violation(index, value, F.when(k % 7 == 0, 0).otherwise(1), F.lit(8)).alias("violation"))


@REGISTRY.query(
    "generation_budget",
    """SELECT doc_id, CASE WHEN NOT (n_chars % 9000 BETWEEN 1 AND least(8192, 32767)) THEN 'cap' WHEN NOT n_chars + n_chars % 9000 <= 20000 THEN 'context' END AS violation,
    CASE WHEN n_chars % 2 = 1 AND n_chars > 1000 THEN 'exclusive' WHEN NOT CASE WHEN n_chars > 1000 THEN n_chars ELSE 0 END <= 6000 THEN 'budget' END AS cache_violation FROM (SELECT doc_id, n_chars FROM documents)""",
)
def generation_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars")
    manual = F.when(n > 1000, n).otherwise(F.lit(0))
    # The context stands in for the model's limit less one.
    rules = V.budget_violation(n, n % 9000, F.lit(8192), F.lit(20000))
    return table(spark, sf_dir, "documents").select("doc_id", rules.alias("violation"), V.cache_violation(manual, n % 2 == 1, F.lit(6000)).alias("cache_violation"))


@REGISTRY.query(
    "tensor_contract",
    """SELECT vec_id, CASE WHEN label % 3 = 0 THEN 'length' END AS violation FROM embeddings""",
)
def tensor_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape = F.when(F.col("label") % 3 == 0, F.array(F.lit(7), F.lit(9))).otherwise(F.array(F.lit(8), F.lit(8)))
    return table(spark, sf_dir, "embeddings").select("vec_id", V.tensor_violation(shape, F.col("embedding")).alias("violation"))


@REGISTRY.query(
    "report_invariants",
    """SELECT event_type, count(*) AS samples, count(*) BETWEEN 1 AND 100000 AND min(value) <= max(value) AND count(*) FILTER (value < 0) = 0 AS ok FROM events GROUP BY event_type""",
)
def report_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("samples"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.count_if(F.col("value") < 0).alias("bad"))
    return g.select("event_type", "samples", (F.col("samples").between(1, 100000) & (F.col("lo") <= F.col("hi")) & (F.col("bad") == 0)).alias("ok"))


@REGISTRY.query(
    "download_rules",
    r"""WITH s AS (SELECT o_orderkey, o_orderkey % 600 AS code, 'bytes ' || (o_custkey % 50) || '-' || (o_orderkey % 90) || '/' || CASE WHEN o_orderkey % 11 = 0 THEN '*' ELSE '80' END AS header FROM orders),
    t AS (SELECT *, TRY_CAST(regexp_extract(header, '^bytes ([0-9]{1,18})-([0-9]{1,18})/([0-9]{1,18})$', 1) AS BIGINT) AS a, TRY_CAST(regexp_extract(header, '^bytes ([0-9]{1,18})-([0-9]{1,18})/([0-9]{1,18})$', 2) AS BIGINT) AS b, TRY_CAST(regexp_extract(header, '^bytes ([0-9]{1,18})-([0-9]{1,18})/([0-9]{1,18})$', 3) AS BIGINT) AS c FROM s)
    SELECT o_orderkey, code IN (408, 429) OR code BETWEEN 500 AND 599 AS retryable, CASE WHEN a <= b AND b < c THEN a END AS first, CASE WHEN a <= b AND b < c THEN b END AS last FROM t""",
)
def download_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    header = F.concat(F.lit("bytes "), (F.col("o_custkey") % 50).cast("string"), F.lit("-"), (k % 90).cast("string"), F.lit("/"), F.when(k % 11 == 0, F.lit("*")).otherwise(F.lit("80")))
    s = table(spark, sf_dir, "orders").select("o_orderkey", T.retryable(k % 600).alias("retryable"), T.content_range(header).alias("r"))
    return s.select("o_orderkey", "retryable", F.col("r.first").alias("first"), F.col("r.last").alias("last"))


@REGISTRY.query(
    "box_checks",
    f"""WITH s AS (SELECT l_orderkey, {_BOX_SQL} FROM lineitem)
    SELECT l_orderkey, count(*) AS boxes, count(*) FILTER (w > 0 AND h > 0) AS valid, count(*) FILTER (x >= 100 AND y >= 5 AND x + w <= 700 AND y + h <= 60) AS inside FROM s GROUP BY l_orderkey""",
)
def box_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", _BOX)
    outer = G.box(F.lit(100), F.lit(5), F.lit(600), F.lit(55))
    return s.groupBy("l_orderkey").agg(F.count("*").alias("boxes"), F.count_if(G.box_ok(F.col("box"))).alias("valid"), F.count_if(G.contains(outer, F.col("box"))).alias("inside"))


@REGISTRY.query(
    "box_envelopes",
    f"""WITH s AS (SELECT l_orderkey, {_BOX_SQL} FROM lineitem)
    SELECT l_orderkey, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS width, max(y + h) - min(y) AS height, min(x) = 0 OR count(*) = 1 AS flagged FROM s GROUP BY l_orderkey""",
)
def box_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", _BOX).groupBy("l_orderkey").agg(F.collect_list("box").alias("boxes"))
    e = s.select("l_orderkey", G.envelope_of_boxes(F.col("boxes")).alias("e"), F.size("boxes").alias("n"))
    return e.select("l_orderkey", "e.*", ((F.col("e.x") == 0) | (F.col("n") == 1)).alias("flagged"))
