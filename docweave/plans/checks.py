"""Reports, branches, quads, hosts, passes and whitelists as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions import text as T
from docweave.functions import vectors as X
from docweave.operators import planning, report, structure
from docweave.operators import stages as S
from docweave.registry import Registry, table

REGISTRY = Registry()


def report_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON report of each order with at least two lines, its samples the lines; one field is tampered with by the order's key."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct((1_000_000 + F.col("l_partkey") * 977 + F.col("l_linenumber")).cast("bigint").alias("t"), (F.col("l_suppkey") + 1_000).cast("bigint").alias("m")).alias("s"))
    g = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("s")).alias("s")).where(F.size("s") >= 2)
    k, sha = F.col("l_orderkey") % 12, F.sha2(F.col("l_orderkey").cast("string").cast("binary"), 256)
    big = lambda c: c.cast("bigint")
    sample = lambda s, i: F.struct(
        F.when(i == 0, "cold").otherwise("warm").alias("phase"), big(i + F.when((k == 1) & (i == 1), 1).otherwise(0)).alias("index"), s["t"].alias("elapsed_nanos"), big(s["t"] + F.when((k == 2) & (i == 0), 1).otherwise(0)).alias("first_result_nanos"),
        F.lit(None).cast("bigint").alias("images_per_second_milli"), s["m"].alias("resident_before"), big(s["m"] + F.when((k == 3) & (i == 1), -1).otherwise(5)).alias("peak_resident_bytes"), big(s["m"] + 1).alias("resident_after"),
        F.when((k == 4) & (i == 1), F.sha2(F.lit(b"other"), 256)).otherwise(sha).alias("output_sha256"), F.lit(77).cast("bigint").alias("output_bytes"),
    )
    prints = F.array_sort(F.array(*(F.sha2(F.lit(x), 256) for x in (b"a", b"b"))))
    whole = F.struct(
        F.lit(report.SCHEMA).alias("schema"), F.when(k == 5, "HEAD").otherwise(F.substring(sha, 1, 40)).alias("revision"), F.when(k == 6, F.reverse(prints)).otherwise(prints).alias("fingerprints"), F.transform("s", sample).alias("samples"),
        F.when(k == 11, F.upper(sha)).otherwise(sha).alias("output_sha256"), F.lit(77).cast("bigint").alias("output_bytes"),
    )
    # Each step is a column of its own, so that none is worked out again for each mention.
    g = g.select("l_orderkey", whole.alias("r")).select("l_orderkey", report.derived(F.col("r")).alias("r"))
    r = F.col("r")
    spoilt = r["samples"][1].withField("images_per_second_milli", r["samples"][1]["images_per_second_milli"] + 1)
    r = F.when(k == 7, r.withField("samples", F.concat(F.slice(r["samples"], 1, 1), F.array(spoilt), F.slice(r["samples"], 3, 200)))).when(k == 8, r.withField("summary.elapsed_nanos.p50", r["summary"]["elapsed_nanos"]["p50"] + 1)).when(k == 9, r.withField("summary.peak_resident_bytes.p95", r["summary"]["peak_resident_bytes"]["p95"] - 1)).when(k == 10, r.withField("samples", F.slice(r["samples"], 1, 1))).otherwise(r)
    return g.select("l_orderkey", F.to_json(r).alias("document"))


@REGISTRY.query(
    "report_checks",
    """WITH o AS (SELECT l_orderkey, count(*) AS n, l_orderkey % 12 AS k FROM lineitem GROUP BY l_orderkey HAVING count(*) >= 2)
    SELECT l_orderkey, CASE WHEN k IN (1, 2, 3, 7) THEN 'sample' WHEN k IN (4, 11) THEN 'determinism' WHEN k = 5 THEN 'header' WHEN k = 6 THEN 'fingerprints' WHEN k IN (8, 9) THEN 'summary' WHEN k = 10 THEN 'sample_count' END AS violation FROM o""",
)
def report_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports read from their JSON; every derived field is computed anew and compared."""
    read = report_documents(spark, sf_dir).select("l_orderkey", F.from_json("document", report.REPORT).alias("r"))
    return read.select("l_orderkey", report.report_violation(F.col("r")).alias("violation"))


@REGISTRY.query(
    "report_summaries",
    """WITH s AS (SELECT l_orderkey, 1000000 + l_partkey * 977 + l_linenumber AS t, l_suppkey + 1000 AS m, row_number() OVER (PARTITION BY l_orderkey ORDER BY 1000000 + l_partkey * 977 + l_linenumber, l_suppkey) AS i FROM lineitem),
    w AS (SELECT l_orderkey, list_sort(list(t)) AS t, list_sort(list(1000000000000 // t)) AS q FROM s WHERE i > 1 GROUP BY l_orderkey)
    SELECT l_orderkey, CAST(len(t) AS BIGINT) AS samples, t[1] AS fastest, t[(len(t) * 50 + 99) // 100] AS median, t[(len(t) * 95 + 99) // 100] AS p95, t[len(t)] AS slowest, q[(len(q) * 50 + 99) // 100] AS throughput FROM w WHERE l_orderkey % 12 = 0""",
)
def report_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What sound reports say of their warm samples."""
    r = report_documents(spark, sf_dir).where(F.col("l_orderkey") % 12 == 0).select("l_orderkey", F.from_json("document", report.REPORT).alias("r"))
    t = F.col("r.summary.elapsed_nanos")
    return r.select("l_orderkey", (F.size("r.samples") - 1).cast("bigint").alias("samples"), t["minimum"].alias("fastest"), t["p50"].alias("median"), t["p95"].alias("p95"), t["maximum"].alias("slowest"), F.col("r.summary.images_per_second_milli.p50").alias("throughput"))


@REGISTRY.query("observed_report", """SELECT '{"first":' || min(event_id) || ',"kinds":' || count(DISTINCT event_type) || ',"last":' || max(event_id) || ',"rows":' || count(*) || '}' AS report FROM events""")
def observed_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events measured as they are written to nowhere; the report has no second pass over them."""
    kinds = F.size(F.collect_set("event_type")).cast("bigint")
    df, seen = report.observed(table(spark, sf_dir, "events").select("event_id", "event_type"), "events", first=F.min("event_id"), last=F.max("event_id"), kinds=kinds)
    df.write.format("noop").mode("overwrite").save()
    return report.report_row(df, seen)


@REGISTRY.query(
    "branch_support",
    """SELECT d.doc_id, coalesce(CASE WHEN quality = 1 THEN 'completed' WHEN quality = 0 THEN 'failed' END, 'failed') AS text, CASE WHEN n_chars > 1000 THEN 'completed' WHEN d.doc_id % 3 = 1 THEN 'failed' ELSE 'unsupported' END AS "table",
    CASE WHEN lang = 'en' THEN 'completed' WHEN d.doc_id % 3 = 2 THEN 'failed' ELSE 'unsupported' END AS seal FROM documents d LEFT JOIN labels USING (doc_id)""",
)
def branch_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three branches of each document; what is missing failed only where the document's provider has the stage."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    able = F.when(F.col("doc_id") % 3 == 1, F.array(F.lit("text"), F.lit("table"))).when(F.col("doc_id") % 3 == 2, F.array(F.lit("text"), F.lit("seal"))).otherwise(F.array(F.lit("text")))
    text = table(spark, sf_dir, "labels").where("quality is not null").select("doc_id", F.when(F.col("quality") == 1, "completed").otherwise("failed").alias("status"))
    done = F.lit("completed").alias("status")
    branches = {"text": text, "table": docs.where("n_chars > 1000").select("doc_id", done), "seal": docs.where("lang = 'en'").select("doc_id", done)}
    return S.branch_results(docs.select("doc_id", able.alias("able")), branches, "doc_id", F.col("able")).drop("able")


@REGISTRY.query(
    "cell_regions",
    """WITH e AS (SELECT vec_id, 40 + vec_id % 200 AS w, 30 + vec_id % 90 AS h, vec_id % 50 AS x, vec_id % 70 AS y, list_transform(embedding[1:8], lambda v: CAST(v AS DOUBLE) * CASE WHEN vec_id % 4 = 0 THEN 0.01 ELSE 30 END) AS a FROM embeddings),
    q AS (SELECT vec_id, list_transform(a, lambda v, i: least(greatest(CAST(trunc(greatest(w, h) / (1 + exp(-v))) AS BIGINT), 0), CASE WHEN i % 2 = 1 THEN w ELSE h END) + CASE WHEN i % 2 = 1 THEN x ELSE y END) AS q FROM e)
    SELECT vec_id, CASE WHEN greatest(q[1], q[3], q[5], q[7]) > least(q[1], q[3], q[5], q[7]) AND greatest(q[2], q[4], q[6], q[8]) > least(q[2], q[4], q[6], q[8]) THEN array_to_string(q, ',') END AS quad FROM q""",
)
def cell_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quads in crops of all sizes; flat ones are null."""
    i = F.col("vec_id")
    logits = F.transform(F.slice("embedding", 1, 8), lambda v: v.cast("double") * F.when(i % 4 == 0, 0.01).otherwise(30.0))
    quad = structure.cell_quad(logits, i % 50, i % 70, 40 + i % 200, 30 + i % 90)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(quad, ",").alias("quad"))


HOSTS = ("example.com", "cdn.example.org")


@REGISTRY.query(
    "download_hosts",
    """WITH p AS (SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'https://example.com/' WHEN 1 THEN 'http://example.com/' WHEN 2 THEN 'https://cdn.example.org' WHEN 3 THEN 'https://example.com.evil.net/' WHEN 4 THEN 'https://user@example.com/' WHEN 5 THEN 'https://EXAMPLE.com?' WHEN 6 THEN 'https://example.com:8443/' ELSE 'https://' END AS u FROM pages)
    SELECT page_id, page_id % 8 IN (0, 2, 5) AS approved FROM p""",
)
def download_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses on approved hosts, on others, and on hosts that look like approved ones."""
    k = F.col("page_id") % 8
    starts = ("https://example.com/", "http://example.com/", "https://cdn.example.org", "https://example.com.evil.net/", "https://user@example.com/", "https://EXAMPLE.com?", "https://example.com:8443/", "https://")
    start = F.get(F.array(*map(F.lit, starts)), k.cast("int"))
    url = F.when(k == 2, start).otherwise(F.concat(start, F.col("url")))
    return table(spark, sf_dir, "pages").select("page_id", T.approved_url(url, HOSTS).alias("approved"))


_IOU = "(greatest(0, least(o[2] + o[4], b[2] + b[4]) - greatest(o[2], b[2])) * greatest(0, least(o[3] + o[5], b[3] + b[5]) - greatest(o[3], b[3])))"


@REGISTRY.query(
    "pass_union",
    f"""WITH RECURSIVE b AS (SELECT l_orderkey AS page, l_linenumber % 2 AS pass, [CAST(round(l_discount * 100) AS BIGINT), l_partkey % 30, l_suppkey % 30, 10 + CAST(l_quantity AS BIGINT), 40] AS b FROM lineitem),
    r AS (SELECT page, pass, b, row_number() OVER (PARTITION BY page, pass ORDER BY b) AS k FROM b),
    f AS (SELECT page, pass, k, [b] AS kept FROM r WHERE k = 1 UNION ALL
      SELECT r.page, r.pass, r.k, CASE WHEN len(list_filter(kept, lambda o: {_IOU} / (o[4] * o[5] + b[4] * b[5] - {_IOU}) >= 0.5)) = 0 AND len(kept) < 64 THEN list_append(kept, b) ELSE kept END FROM f JOIN r ON r.page = f.page AND r.pass = f.pass AND r.k = f.k + 1),
    u AS (SELECT page, unnest(arg_max(kept, k)) AS b FROM f GROUP BY page, pass), v AS (SELECT page, b, row_number() OVER (PARTITION BY page ORDER BY b) AS k FROM u),
    g AS (SELECT page, k, [b] AS kept FROM v WHERE k = 1 UNION ALL
      SELECT v.page, v.k, CASE WHEN len(list_filter(kept, lambda o: {_IOU} / (o[4] * o[5] + b[4] * b[5] - {_IOU}) >= 0.5)) = 0 AND len(kept) < 64 THEN list_append(kept, b) ELSE kept END FROM g JOIN v ON v.page = g.page AND v.k = g.k + 1)
    SELECT page, len(arg_max(kept, k)) AS n, CAST(list_sum(list_transform(arg_max(kept, k), lambda o: o[2] * 7 + o[3] * 3 + o[4])) AS BIGINT) AS mark FROM g GROUP BY page""",
)
def pass_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two passes over a page, each suppressed by itself, then suppressed together."""
    box = "struct(cast(round(l_discount * 100) as bigint) as d, l_partkey % 30 as x, l_suppkey % 30 as y, 10 + cast(l_quantity as bigint) as width, 40L as height)"
    b = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as page", "l_linenumber % 2 as pass", f"{box} as b")
    of = lambda n: F.array_sort(F.collect_list(F.when(F.col("pass") == n, F.col("b"))))
    g = b.groupBy("page").agg(of(0).alias("first"), of(1).alias("second")).select("page", planning.merged_passes(F.col("first"), F.col("second")).alias("kept"))
    mark = F.aggregate("kept", F.lit(0).cast("bigint"), lambda a, o: a + o["x"] * 7 + o["y"] * 3 + o["width"])
    return g.select("page", F.size("kept").cast("bigint").alias("n"), mark.alias("mark"))


@REGISTRY.query(
    "ngram_allowed",
    r"""WITH t AS (SELECT conv_id, turn, regexp_extract_all(text, '[^ .,\n]{1,2}') AS a FROM conversations), r AS (SELECT conv_id, turn, CASE WHEN len(a) > 40 THEN a[len(a) - 39:len(a)] ELSE a END AS a FROM t)
    SELECT conv_id, turn, CASE WHEN len(a) < 2 THEN '' ELSE coalesce(array_to_string(list_sort(list_filter(list_distinct(list_transform(list_filter(range(1, len(a)), lambda i: a[i] = a[len(a)]), lambda i: a[i + 1])), lambda x: x NOT IN ('th', 'er', 'en', 'ie'))), ','), '') END AS banned FROM r""",
)
def ngram_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Banned tokens less those that may always come."""
    tokens = F.regexp_extract_all("text", F.lit(r"[^ .,\n]{1,2}"), F.lit(0))
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", tokens.alias("t"))
    allowed = F.array(*map(F.lit, ("th", "er", "en", "ie")))
    return t.select("conv_id", "turn", F.array_join(F.array_sort(X.banned_tokens(F.col("t"), n=2, window=40, allowed=allowed)), ",").alias("banned"))
