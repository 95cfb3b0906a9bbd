"""Tensor containers, record blobs and cubic resampling as queries."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions import binary as B
from docweave.operators import tensors as X
from docweave.registry import Registry, table
from docweave.sources import records, tensors

REGISTRY = Registry()
DOMAIN = b"inventory\0"


def containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A container for each embedding: its integers, its first 16 as a matrix, and its id; one fault by the id."""
    i = F.col("vec_id")
    k = i % 16
    le32 = lambda n: F.substring(B.u64_le(n), 1, 4)
    whole = F.transform("embedding", lambda x: le32(F.floor(x * 1024)))
    name = F.concat(F.lit("e."), i.cast("string"))
    t = lambda n, dtype, shape, data: F.struct(n.alias("name"), F.lit(dtype).alias("dtype"), F.array(*(F.lit(d).cast("bigint") for d in shape)).cast("array<bigint>").alias("shape"), data.alias("data"))
    good = tensors.packed(F.array(t(F.concat(name, F.lit(".weight")), "I32", (64,), B.fold(whole)), t(F.concat(name, F.lit(".head")), "I32", (4, 4), B.fold(F.slice(whole, 1, 16))), t(F.concat(name, F.lit(".id")), "I64", (), B.u64_le(i))))
    header = lambda text: F.concat(F.lit(text.split("@")[0]), *(x for part in text.split("@")[1:] for x in (name, F.lit(part))))
    with_header = lambda text, size: tensors.container(header(text), F.repeat(F.lit("x"), size).cast("binary"))
    two = '{"@.a":{"dtype":"%s","shape":[%s],"data_offsets":[%s]},"@.b":{"dtype":"U8","shape":[4],"data_offsets":[%s]}}'
    content = (
        F.when(k == 1, F.lit(b"short").cast("binary")).when(k == 2, F.concat(B.u64_le(F.lit(200_000_000)), F.lit(b"{}"))).when(k == 3, F.concat(B.u64_le(F.lit(99)), F.lit(b"{}"))).when(k == 4, tensors.container(F.lit("[1, 2"), F.lit(b"")))
        .when(k == 5, with_header(two % ("F7", "2", "0,8", "8,12"), 12)).when(k == 6, with_header(two % ("F32", "3", "0,8", "8,12"), 12)).when(k == 7, with_header(two % ("F32", "2", "0,8", "7,11"), 11))
        .when(k == 8, with_header(two % ("F32", "2", "0,8", "9,13"), 13)).when(k == 9, with_header(two % ("F32", "2", "0,8", "8,12"), 15)).when(k == 10, with_header(two % ("F32", "2", "0,8", "8,12"), 12))
        .when(k == 11, with_header(two % ("F32", "2", "8,0", "8,12"), 12)).when(k == 12, with_header(two % ("F32", "-2", "0,8", "8,12"), 12)).when(k == 13, with_header('{"":{"dtype":"U8","shape":[1],"data_offsets":[0,1]}}', 1)).otherwise(good)
    )
    made, path = table(spark, sf_dir, "embeddings").select("vec_id", content.alias("content")), _scratch(spark)
    made.write.parquet(path)
    return spark.read.schema(made.schema).parquet(path)


_FAULT = """CASE vec_id % 16 WHEN 1 THEN 'prefix_short' WHEN 2 THEN 'header_too_long' WHEN 3 THEN 'header_short' WHEN 4 THEN 'header_invalid' WHEN 5 THEN 'dtype_unknown' WHEN 6 THEN 'size_mismatch' WHEN 7 THEN 'range_overlap' WHEN 8 THEN 'range_gap'
    WHEN 9 THEN 'data_length' WHEN 10 THEN 'tensor_count' WHEN 11 THEN 'range_invalid' WHEN 12 THEN 'shape_invalid' WHEN 13 THEN 'name_invalid' END"""


@REGISTRY.query(
    "container_faults",
    f"""WITH d AS (SELECT vec_id, {_FAULT} AS fault, 'e.' || vec_id || '.' AS n FROM embeddings),
    le AS (SELECT vec_id, x, unhex(array_to_string(list_reverse(regexp_extract_all(lpad(hex(x), 16, '0'), '..')), '')) AS b FROM (SELECT DISTINCT vec_id, unnest([0, 1, 2, 3, 4, 8, 16, 64, 256, strlen(n || 'id'), strlen(n || 'head'), strlen(n || 'weight')]::BIGINT[]) AS x FROM d)),
    p AS (SELECT d.vec_id, string_agg(hex(CASE WHEN s.t IS NOT NULL THEN encode(replace(s.t, '@', n)) ELSE le.b END), '' ORDER BY s.k) AS h
      FROM d CROSS JOIN (VALUES (1, 'inventory', NULL), (2, NULL, 'zero'), (3, NULL, '3'), (4, NULL, 'lh'), (5, '@head', NULL), (6, NULL, '3'), (7, 'I32', NULL), (8, NULL, '2'), (9, NULL, '4'), (10, NULL, '4'), (11, NULL, '64'), (12, NULL, 'li'), (13, '@id', NULL), (14, NULL, '3'), (15, 'I64', NULL), (16, NULL, '0'), (17, NULL, '8'), (18, NULL, 'lw'), (19, '@weight', NULL), (20, NULL, '3'), (21, 'I32', NULL), (22, NULL, '1'), (23, NULL, '64'), (24, NULL, '256')) s(k, t, v)
      LEFT JOIN le ON le.vec_id = d.vec_id AND s.t IS NULL AND le.x = CASE s.v WHEN 'zero' THEN -1 WHEN 'lh' THEN strlen(n || 'head') WHEN 'li' THEN strlen(n || 'id') WHEN 'lw' THEN strlen(n || 'weight') ELSE CAST(s.v AS BIGINT) END GROUP BY d.vec_id)
    SELECT vec_id, fault, CASE WHEN fault IS NULL THEN sha256(unhex('696E76656E746F727900' || substr(h, 19))) END AS digest FROM d JOIN p USING (vec_id)""",
)
def container_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule that each container breaks, or else its inventory's digest."""
    found = tensors.inventory(containers(spark, sf_dir), "content", F.when(F.col("vec_id") % 16 == 10, 3).otherwise(F.size("tensors")))
    return found.select("vec_id", "fault", F.when(F.col("fault").isNull(), tensors.inventory_digest(F.col("tensors"), DOMAIN)).alias("digest"))


@REGISTRY.query(
    "container_tensors",
    """WITH d AS (SELECT vec_id, 'e.' || vec_id AS n FROM embeddings WHERE vec_id % 16 NOT BETWEEN 1 AND 13),
    t AS (SELECT vec_id, n || '.weight' AS name, 'I32' AS dtype, '64' AS shape, 0 AS b, 256 AS e FROM d UNION ALL SELECT vec_id, n || '.head', 'I32', '4x4', 256, 320 FROM d UNION ALL SELECT vec_id, n || '.id', 'I64', '', 320, 328 FROM d)
    SELECT vec_id, name, dtype, shape, CAST(e - b AS BIGINT) AS bytes, CASE WHEN name LIKE '%.id' THEN vec_id ELSE CAST(floor(CAST(embedding[1] AS DOUBLE) * 1024) AS BIGINT) END AS first FROM t JOIN embeddings USING (vec_id)""",
)
def container_tensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tensor of the sound containers, with the first component read from its byte range."""
    found = tensors.inventory(containers(spark, sf_dir), "content", F.lit(3)).where("fault is null")
    t = found.select("vec_id", "content", "data_at", F.explode("tensors").alias("t"))
    width = F.when(F.col("t.dtype") == "I64", 8).otherwise(4)
    raw = tensors.le_number(F.substring("content", (F.col("data_at") + F.col("t.begin") + 1).cast("int"), width))
    first = F.when((F.col("t.dtype") == "I32") & (raw >= 1 << 31), raw - (1 << 32)).otherwise(raw)
    return t.select("vec_id", "t.name", "t.dtype", F.array_join("t.shape", "x").alias("shape"), (F.col("t.end") - F.col("t.begin")).alias("bytes"), first.alias("first"))


def _scratch(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{(base or '/tmp/docweave-shared').rstrip('/')}/docweave-blob-{uuid.uuid4().hex}"


@REGISTRY.query("record_blobs", "SELECT vec_id, CAST(label AS INTEGER) AS label, round(list_sum(list_transform(embedding, lambda x, i: CAST(x AS DOUBLE) * i)), 6) AS s FROM embeddings")
def record_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings written as blobs of fixed-size records and read back in ranges of 64 KB."""
    records.register(spark)
    path, layout = _scratch(spark), "vec_id:i8,label:i4,embedding:f4*64"
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    e.write.format("records").option("layout", layout).mode("append").save(path)
    back = spark.read.format("records").option("layout", layout).option("partitionBytes", 1 << 16).option("records", e.count()).load(path)
    weighted = F.aggregate(F.transform("embedding", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return back.select("vec_id", "label", F.round(weighted, 6).alias("s"))


@REGISTRY.query(
    "cubic_resample",
    """WITH RECURSIVE sizes AS (SELECT 5 AS n UNION ALL SELECT 11), c AS (SELECT n, t, 8.0::DOUBLE / n AS scale, greatest(8.0::DOUBLE / n, 1) AS wide, 8.0::DOUBLE / n * (t + 0.5) AS center FROM sizes, LATERAL (SELECT unnest(range(n)) AS t)),
    k AS (SELECT n, t, s, abs((s + 0.5 - center) / wide) AS x FROM c, range(8) r(s) WHERE s >= greatest(0, trunc(center - 2 * wide + 0.5)) AND s < least(8, trunc(center + 2 * wide + 0.5))),
    w AS (SELECT n, t, s, CASE WHEN x < 1 THEN 1.5 * x * x * x - 2.5 * x * x + 1 WHEN x < 2 THEN -0.5 * x * x * x + 2.5 * x * x - 4 * x + 2 ELSE 0 END AS w FROM k),
    z AS (SELECT n, t, s, w / sum(w) OVER (PARTITION BY n, t) AS w FROM w),
    v AS (SELECT vec_id, i // 8 AS y, i % 8 AS x, CAST(embedding[i + 1] AS DOUBLE) AS v FROM embeddings, range(64) r(i)),
    h AS (SELECT vec_id, n, y, t AS tx, sum(w * v) AS v FROM v JOIN z ON z.s = v.x GROUP BY ALL)
    SELECT vec_id, CAST(n AS BIGINT) AS side, CAST(t AS BIGINT) AS y, CAST(tx AS BIGINT) AS x, round(sum(w * v), 6) + 0.0 AS v FROM h JOIN z USING (n) WHERE z.s = h.y GROUP BY vec_id, n, t, tx""",
)
def cubic_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding as an 8 by 8 grid, made smaller and larger."""
    sides = F.explode(F.array(*(F.struct(F.lit(n).cast("bigint").alias("side"), X.resized(F.col("embedding"), 8, n).alias("grid")) for n in (5, 11))))
    g = table(spark, sf_dir, "embeddings").select("vec_id", sides.alias("r")).select("vec_id", "r.side", F.posexplode("r.grid").alias("i", "v"))
    place = F.col("i").cast("bigint")
    return g.select("vec_id", "side", F.floor(place / F.col("side")).alias("y"), (place % F.col("side")).alias("x"), (F.round("v", 6) + 0.0).alias("v"))
