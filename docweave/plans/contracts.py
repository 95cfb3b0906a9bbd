"""Provider contract, assets, error isolation and wire projection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions import geometry as G
from docweave.functions import text as T
from docweave.operators import stages as S
from docweave.operators import validate as V
from docweave.registry import Registry, table

REGISTRY = Registry()


@REGISTRY.query(
    "asset_checks",
    """SELECT page_id, CASE WHEN NOT (url LIKE 'http%' AND url NOT LIKE '%/../%') THEN 'containment' WHEN NOT strlen(html) > 0 THEN 'empty' WHEN NOT strlen(html) <= 2000 THEN 'too_large' END AS violation FROM pages""",
)
def asset_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files must lie under their root, not be empty and keep to a size cap."""
    inside = F.col("url").startswith("http") & ~F.col("url").contains("/../")
    n = F.octet_length("html")
    return table(spark, sf_dir, "pages").select("page_id", V.asset_violation(inside, n, 2000).alias("violation"))


@REGISTRY.query(
    "capability_contract",
    """WITH cap(stage) AS (VALUES ('user'), ('assistant')) SELECT conv_id, turn, CASE WHEN role NOT IN (SELECT stage FROM cap) THEN 'stage_unsupported' WHEN strlen(text) = 0 THEN 'text_missing' END AS violation FROM conversations""",
)
def capability_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A completed stage must be one that the provider has, and completed text must come with output."""
    able = F.array(F.lit("user"), F.lit("assistant"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", V.completed_violation(able, F.col("role"), F.octet_length("text")).alias("violation"))


@REGISTRY.query(
    "structure_floor",
    """WITH t AS (SELECT l_orderkey AS tbl, avg(1 - l_discount * 8) AS confidence FROM lineitem GROUP BY l_orderkey) SELECT tbl, round(confidence, 9) AS confidence, CASE WHEN round(confidence, 9) < 0.5 THEN 'table_model_output_invalid' END AS error FROM t""",
)
def structure_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean token probability by table; below a half is an error, not a dropped row."""
    t = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("tbl")).agg(F.round(F.avg(1 - F.col("l_discount") * 8), 9).alias("confidence"))
    return t.withColumn("error", F.when(F.col("confidence") < 0.5, "table_model_output_invalid"))


@REGISTRY.query(
    "crops_in_canvas",
    """WITH s AS (SELECT p_partkey, p_size * 20 AS x, p_partkey % 400 AS y, 100 AS w, 50 AS h FROM part) SELECT p_partkey, x + w <= 1000 AND y + h <= 400 AS ok FROM s""",
)
def crops_in_canvas(spark: SparkSession, sf_dir: str) -> DataFrame:
    crop = G.box(F.col("p_size") * 20, F.col("p_partkey") % 400, F.lit(100), F.lit(50))
    canvas = G.box(F.lit(0), F.lit(0), F.lit(1000), F.lit(400))
    return table(spark, sf_dir, "part").select("p_partkey", G.contains(canvas, crop).alias("ok"))


@REGISTRY.query(
    "error_isolation",
    """WITH s AS (SELECT doc_id, doc_id % 5 = 0 AS bad_decode, doc_id % 7 = 0 AS bad_batch, doc_id % 2 = 0 AS with_preprocessing FROM documents)
    SELECT doc_id, CASE WHEN NOT with_preprocessing THEN NULL WHEN bad_decode THEN 'failed' ELSE 'completed' END AS preprocessing, CASE WHEN bad_decode AND with_preprocessing THEN 'skipped' WHEN bad_decode OR bad_batch THEN 'failed' ELSE 'completed' END AS text_status FROM s""",
)
def error_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bad decode fails preprocessing and skips text, or fails text where preprocessing isn't asked for; a failed microbatch fails text alone."""
    k = F.col("doc_id")
    outcome = S.isolated(k % 5 == 0, k % 7 == 0, k % 2 == 0)
    return table(spark, sf_dir, "documents").select("doc_id", outcome["preprocessing"].alias("preprocessing"), outcome["text"].alias("text_status"))


@REGISTRY.query(
    "wire_projection",
    """SELECT doc_id, '{"docId":' || d.doc_id || ',"nChars":' || n_chars || CASE WHEN quality IS NULL THEN '' ELSE ',"qualityLabel":' || quality END || '}' AS wire FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def wire_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Camel-cased names; what is missing is left out."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return d.select("doc_id", F.to_json(F.struct(F.col("doc_id").alias("docId"), F.col("n_chars").alias("nChars"), F.col("quality").alias("qualityLabel"))).alias("wire"))


@REGISTRY.query(
    "payload_split",
    """WITH s AS (SELECT event_id, event_type || ' ' || props || '[1,' || event_id % 9 || ']' AS raw FROM events) SELECT event_id, trim(substr(raw, 1, strpos(raw, '[') - 1)) AS label, substr(raw, strpos(raw, '[')) AS coordinates FROM s""",
)
def payload_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.col("event_type"), F.lit(" "), F.col("props"), F.lit("[1,"), (F.col("event_id") % 9).cast("string"), F.lit("]"))
    s = table(spark, sf_dir, "events").select("event_id", raw.alias("raw")).withColumn("at", F.locate("[", "raw"))
    return s.select("event_id", F.trim(F.expr("substring(raw, 1, at - 1)")).alias("label"), F.expr("substring(raw, at)").alias("coordinates"))


@REGISTRY.query(
    "normalized_texts",
    r"""SELECT conv_id, turn, sha256(regexp_replace(replace(replace(text, '\coloneqq', ':='), '\eqqcolon', '=:'), '^\s+|\s+$', '', 'g')) AS digest FROM conversations""",
)
def normalized_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stop tokens are added to the text and stripped again with the white space around it."""
    marked = F.concat(F.lit(" "), F.col("text"), F.lit(" </s></s> "))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(T.normalized(marked, "</s>").cast("binary"), 256).alias("digest"))


@REGISTRY.query(
    "cohort_trace",
    """SELECT batch, count(DISTINCT width) AS widths, max(width) AS widest, count(*) FILTER (width > 400) AS wide FROM (SELECT doc_id // 256 AS batch, n_chars % 500 AS width FROM documents) GROUP BY batch""",
)
def cohort_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.expr("doc_id div 256").alias("batch"), (F.col("n_chars") % 500).alias("width"))
    return d.groupBy("batch").agg(F.countDistinct("width").alias("widths"), F.max("width").alias("widest"), F.count_if(F.col("width") > 400).alias("wide"))
