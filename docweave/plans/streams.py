"""Streams, detection maps, pixels and the facade as queries."""

from __future__ import annotations

import math
import re
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.facade import EchoProvider, Engine
from docweave.operators import detect, pixels
from docweave.registry import Registry, table
from docweave.sources.config import Detection
from docweave.sources.images import decode
from docweave.streaming import slots

REGISTRY = Registry()


def _scratch(spark: SparkSession) -> str:
    """A folder that the driver and all executors see. Only a local master may do without spark.checkpoint.dir."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    base = base or "/tmp/docweave-shared"
    return f"{base.rstrip('/')}/docweave-stream-{uuid.uuid4().hex}"


@REGISTRY.query(
    "stream_admission",
    "SELECT doc_id, coalesce(strlen(text), 0) AS size_bytes, CASE WHEN coalesce(strlen(text), 0) = 0 THEN 'source_invalid' WHEN strlen(text) > 33554432 THEN 'source_too_large' END AS error_code FROM documents",
)
def stream_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = _scratch(spark)
    stream = slots.files(spark, f"{sf_dir}/documents.parque[t]", table(spark, sf_dir, "documents").schema)
    return slots.run_to_end(slots.admitted(stream), f"{scratch}/out", f"{scratch}/state")


_ARRIVALS = """t AS (SELECT conv_id, turn, strlen(coalesce(text, '')) AS size, (conv_id * 3 + turn * 5) % 17 = 5 AS lost, (conv_id + turn) % 3 = 0 AS early, row_number() OVER (PARTITION BY conv_id, turn ORDER BY text) AS nth FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL)"""


def arrivals(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Turns as they come: most, those that were held up and some once more, a clock that ends the wait, and those that come too late."""
    t = table(spark, sf_dir, "conversations").where("conv_id is not null and turn is not null")
    turns = t.select("conv_id", "turn", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("size"), F.timestamp_seconds(F.col("turn") * 60 + 1_000_000_000).alias("at"))
    i, k = F.col("conv_id"), F.col("turn")
    lost, held, again = (i * 3 + k * 5) % 17 == 5, (i + k) % 3 == 0, (i + k) % 5 == 2
    clock = spark.range(1).select(F.lit(-1).cast("bigint").alias("conv_id"), F.lit(0).cast("bigint").alias("turn"), F.lit(0).cast("bigint").alias("size"), F.timestamp_seconds(F.lit(4_000_000_000)).alias("at"))
    return [turns.where(~lost & ~held), turns.where(~lost & (held | again)), clock, turns.where(lost)]


@REGISTRY.query(
    "stream_predecessors",
    f"""WITH {_ARRIVALS}, k AS (SELECT * FROM t WHERE NOT lost AND nth = 1),
    o AS (SELECT conv_id, turn, CASE WHEN turn = 0 OR coalesce(turn = lag(turn) OVER w + 1, false) THEN 'followed' ELSE 'orphan' END AS status, CAST(sum(size) OVER (PARTITION BY conv_id ORDER BY turn ROWS 3 PRECEDING) AS BIGINT) AS recent FROM k WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
    SELECT * FROM o UNION ALL SELECT conv_id, turn, 'repeated', NULL FROM t WHERE NOT lost AND (nth > 1 OR ((conv_id + turn) % 5 = 2 AND NOT early))""",
)
def stream_predecessors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four arrivals, each a microbatch of a stream that is started anew on the state that the one before has left."""
    scratch = _scratch(spark)
    for batch in arrivals(spark, sf_dir):
        batch.write.mode("append").parquet(f"{scratch}/in")
        turns = slots.files(spark, f"{scratch}/in", batch.schema, per_trigger=1_000_000)
        out = slots.run_to_end(slots.followed(turns, 24 * 3_600_000, "2 days"), f"{scratch}/out", f"{scratch}/state", partitions=spark.sparkContext.defaultParallelism)
    return out.where("conv_id >= 0")


@REGISTRY.query("stream_batches", "SELECT doc_id, doc_id % 4 AS batch, coalesce(strlen(text), 0) AS size_bytes, CASE WHEN coalesce(strlen(text), 0) = 0 THEN 'source_invalid' WHEN strlen(text) > 33554432 THEN 'source_too_large' END AS error_code FROM documents")
def stream_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in four arrivals, each admitted and committed as a batch; the second breaks off after its write and is played again."""
    scratch, docs = _scratch(spark), table(spark, sf_dir, "documents")
    sink = slots.BatchSink(f"{scratch}/out")

    def breaks_off(frame: DataFrame, batch_id: int) -> None:
        sink(frame, batch_id)
        raise RuntimeError("lost after the write")

    for k in range(4):
        docs.where(F.col("doc_id") % 4 == k).write.mode("append").parquet(f"{scratch}/in")
        stream = slots.admitted(slots.files(spark, f"{scratch}/in", docs.schema, per_trigger=1_000_000))
        if k == 1:
            try:
                slots.microbatches(stream, breaks_off, f"{scratch}/state")
            except StreamingQueryException:
                pass
        slots.microbatches(stream, sink, f"{scratch}/state")
    return sink.read(spark, stream.schema)


@REGISTRY.query(
    "extract_batch",
    """WITH s AS (SELECT doc_id // 256 AS batch_id, doc_id AS slot_pos, doc_id % 4 AS k, text FROM documents), e AS (SELECT *, CASE WHEN k = 3 THEN 'source_type_unsupported' WHEN k = 2 THEN 'image_invalid' END AS error FROM s)
    SELECT batch_id, slot_pos, stage, CASE WHEN stage = 'table' THEN 'unsupported' WHEN error IS NULL THEN 'completed' WHEN stage = 'preprocessing' THEN 'failed' ELSE 'skipped' END AS status, CASE WHEN error IS NULL THEN 'partial' ELSE 'failed' END AS slot_status, error AS error_code
    FROM e CROSS JOIN (VALUES ('preprocessing'), ('text'), ('table')) t(stage)""",
)
def extract_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents under an image signature: every fourth has none, and every fourth can't be decoded."""
    k = F.col("doc_id") % 4
    prefix = F.when(k == 3, F.lit(b"?")).when(k == 2, F.lit(b"BM-")).otherwise(F.lit(b"\xff\xd8\xff"))
    s = table(spark, sf_dir, "documents").select(F.expr("doc_id div 256").alias("batch_id"), F.col("doc_id").alias("slot_pos"), F.concat(prefix, F.col("text").cast("binary")).alias("content"))
    out = Engine(spark, EchoProvider()).extract_batch(s, ["text", "preprocessing", "table"])
    return out.select("batch_id", "slot_pos", "stage", "status", "slot_status", "error_code")


@REGISTRY.query(
    "engine_batches",
    """WITH d AS (SELECT doc_id, doc_id // 200 AS b FROM documents),
    s AS (SELECT CASE WHEN b % 5 < 2 THEN b // 5 * 10 ELSE b * 10 + 1 END AS batch_id, doc_id AS slot_pos, CASE WHEN b % 5 = 2 THEN doc_id // 2 ELSE doc_id END AS slot_id, CASE WHEN b % 5 = 3 AND doc_id % 50 = 7 THEN doc_id - 2 WHEN doc_id % 200 > 0 AND b % 5 <> 2 THEN doc_id - 1 END AS predecessor FROM d),
    a AS (SELECT *, predecessor IS NULL OR predecessor IS NOT DISTINCT FROM lag(slot_id) OVER (PARTITION BY batch_id ORDER BY slot_pos) AS adjacent FROM s)
    SELECT batch_id, count(*) AS slots, CASE WHEN count(*) > 256 THEN 'slots' WHEN count(DISTINCT slot_id) <> count(*) THEN 'slot_ids' WHEN NOT bool_and(adjacent) THEN 'predecessor' END AS violation,
    CASE WHEN count(*) > 256 OR count(DISTINCT slot_id) <> count(*) OR NOT bool_and(adjacent) THEN count(*) ELSE 0 END AS rejected FROM a GROUP BY batch_id""",
)
def engine_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches that are too long, repeat an id, name a wrong predecessor, or are fine; and the slots that the engine rejects with them."""
    b, i = F.expr("doc_id div 200"), F.col("doc_id")
    d = table(spark, sf_dir, "documents").select("doc_id", b.alias("b"))
    s = d.select(
        F.when(F.col("b") % 5 < 2, F.expr("b div 5 * 10")).otherwise(F.col("b") * 10 + 1).alias("batch_id"), i.alias("slot_pos"), F.when(F.col("b") % 5 == 2, F.expr("doc_id div 2")).otherwise(i).alias("slot_id"),
        F.when((F.col("b") % 5 == 3) & (i % 50 == 7), i - 2).when((i % 200 > 0) & (F.col("b") % 5 != 2), i - 1).alias("predecessor"), F.lit(b"BM").alias("content"),
    )
    engine = Engine(spark, EchoProvider())
    rejected = engine.admit(s).groupBy("batch_id").agg(F.count_if(F.coalesce(F.col("error_code") == "batch_invalid", F.lit(False))).alias("rejected"))
    return engine.violations(s).join(rejected, "batch_id").select("batch_id", "slots", "violation", "rejected")


@REGISTRY.query("detection_maps")
def detection_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 64 by 64 map from each embedding: bright where its value, spread over an 8 by 8 block, exceeds a tenth."""
    flat = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(4095)), lambda i: F.array(F.abs(F.get("embedding", (F.floor(i / 512) * 8 + F.floor(i % 64 / 8)).cast("int"))) * 5)))
    n = lambda v: F.lit(v).cast("bigint")
    maps = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("slot"), n(64).alias("width"), n(64).alias("height"), flat.alias("values"), n(64).alias("content_width"), n(56).alias("content_height"), n(640).alias("source_width"), n(560).alias("source_height")
    )
    found = detect.detected(maps, Detection(threshold=0.5, box_threshold=0.5))
    return found.select("slot", "ordinal", F.round("score", 6).alias("score"), F.array_join("quad", ",").alias("quad"))


@REGISTRY.query("mask_borders")
def mask_borders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Borders and holes of a 24 by 24 mask of each embedding: every other ring of blocks is cut by its values."""
    cell = lambda i: F.get("embedding", (F.floor(i / 72) * 8 + F.floor(i % 24 / 3)).cast("int"))
    ring = lambda i: F.least(F.floor(i / 24), i % 24, 23 - F.floor(i / 24), 23 - i % 24) % 4
    values = F.transform(F.sequence(F.lit(0), F.lit(575)), lambda i: ((ring(i) == 0) | (cell(i) > 0.05)).cast("int"))
    n = lambda v: F.lit(v).cast("bigint")
    masks = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("slot"), n(24).alias("width"), n(24).alias("height"), values.alias("values"))
    found = detect.bordered(masks, 1.5)
    return found.select("slot", "ordinal", "hole", "points", "first_x", "first_y", "area", F.round("grown_area", 6).alias("grown_area"))


def bitmap(content: bytes, least: int = 16) -> bytes:
    """A square BMP that shows all the content's bytes, repeated to fill it; its side is a multiple of 4, so rows need no padding."""
    side = max(least, 4 * math.ceil(math.sqrt(len(content) / 3) / 4))
    body = (content * (3 * side * side // max(1, len(content)) + 1))[: 3 * side * side]
    head = b"BM" + struct.pack("<IHHIIiiHHIIiiII", 54 + len(body), 0, 0, 54, 40, side, side, 1, 24, 0, len(body), 0, 0, 0, 0)
    return head + body


TENSORS = pa.schema([("doc_id", pa.int64()), *((n, pa.float64()) for n in ("detector", "recognition", "table_mean", "seal", "tile", "crop"))])


@REGISTRY.query("pixel_tensors")
def pixel_tensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of every tensor that providers take, of a small bitmap of each item's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in TENSORS}
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                image = decode(bitmap(text or b" "))
                values = (
                    key, pixels.detector_tensor(image, 32, 32, (64, 32)).mean(), pixels.recognition_tensor(image, 64).mean(), pixels.table_tensor(image, 32).mean(), pixels.seal_tensor(image, 24).mean(),
                    pixels.tiles(pixels.square(image), 2, 1, 8)[1].mean(), pixels.crop(image, [(1, 1), (9, 2), (9, 14), (1, 13)]).mean(),
                )
                for name, v in zip(out, values, strict=True):
                    out[name].append(v if name == "doc_id" else round(float(v), 5))
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in TENSORS], schema=TENSORS)

    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return items.mapInArrow(run, "doc_id bigint, detector double, recognition double, table_mean double, seal double, tile double, crop double")
