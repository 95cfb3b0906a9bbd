"""Source admission, stage matrix and slot roll-up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.registry import Registry, table

REGISTRY = Registry()

#: Fixed limit: bytes of one source.
MAX_SOURCE_BYTES = 32 * 1024 * 1024


@REGISTRY.query(
    "admit_sources",
    f"""SELECT doc_id, strlen(text) AS size_bytes, sha256(text) AS sha256,
    CASE WHEN text IS NULL THEN 'source_unreadable' WHEN strlen(text) = 0 THEN 'source_invalid'
         WHEN strlen(text) > {MAX_SOURCE_BYTES} THEN 'source_too_large' END AS error_code FROM documents""",
)
def admit_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.octet_length("text").cast("bigint").alias("size_bytes"),
        F.sha2(F.col("text").cast("binary"), 256).alias("sha256"),
        F.when(F.col("text").isNull(), "source_unreadable")
        .when(F.octet_length("text") == 0, "source_invalid")
        .when(F.octet_length("text") > MAX_SOURCE_BYTES, "source_too_large")
        .alias("error_code"),
    )


@REGISTRY.query(
    "admission_rollup",
    f"""WITH stages(stage, tag) AS (VALUES ('preprocessing', 1), ('text', 3), ('table', 4)),
    slots AS (SELECT doc_id, source, coalesce(strlen(text), 0) AS n FROM documents),
    outcomes AS (SELECT doc_id, source, n, stage,
        CASE WHEN NOT n BETWEEN 1 AND {MAX_SOURCE_BYTES} THEN 'failed' WHEN stage = 'table' THEN 'unsupported' ELSE 'completed' END AS status
        FROM slots CROSS JOIN stages),
    rolled AS (SELECT doc_id, source, max(n) AS n, CASE WHEN count(*) FILTER (status = 'completed') = count(*) THEN 'completed'
        WHEN count(*) FILTER (status = 'completed') = 0 THEN 'failed' ELSE 'partial' END AS slot_status FROM outcomes GROUP BY doc_id, source)
    SELECT source, slot_status, count(*) AS slots, CAST(sum(n) AS BIGINT) AS bytes FROM rolled GROUP BY source, slot_status""",
)
def admission_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = table(spark, sf_dir, "documents").select("doc_id", "source", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n"))
    stages = F.array(F.lit("preprocessing"), F.lit("text"), F.lit("table"))
    status = lambda stage: (
        F.when(~F.col("n").between(1, MAX_SOURCE_BYTES), "failed").when(stage == "table", "unsupported").otherwise("completed")
    )
    # The stage list is a constant, so each slot's matrix row stays an array: no explode, no shuffle by slot.
    rolled = slots.withColumn("statuses", F.transform(stages, status)).withColumn("done", F.size(F.filter("statuses", lambda s: s == "completed")))
    slot_status = F.when(F.col("done") == F.size("statuses"), "completed").when(F.col("done") == 0, "failed").otherwise("partial")
    return (
        rolled.groupBy("source", slot_status.alias("slot_status"))
        .agg(F.count("*").alias("slots"), F.sum("n").alias("bytes"))
    )
