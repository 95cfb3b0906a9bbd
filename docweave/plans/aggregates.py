"""Aggregations and digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docweave.functions import geometry as G
from docweave.functions import vectors as X
from docweave.operators import fingerprint as P
from docweave.registry import Registry, table

REGISTRY = Registry()

_LE = "unhex(array_to_string(list_reverse(regexp_extract_all(lpad(hex(CAST({0} AS BIGINT)), 16, '0'), '..')), ''))"


def _prefixed(expr: str) -> str:
    return f"({_LE.format(f'strlen({expr})')} || encode({expr}))"


@REGISTRY.query(
    "provider_fingerprint",
    f"""SELECT n_nationkey, sha256({_prefixed("'docweave.provider.v1'")} || {_prefixed("lower(n_name)")} || {_prefixed("'engine ' || n_regionkey")} || unhex(CASE WHEN n_nationkey % 2 = 0 THEN '01' ELSE '00' END) || {_LE.format("2")} || unhex('0304')) AS fingerprint FROM nation""",
)
def provider_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = F.concat(F.lit("engine "), F.col("n_regionkey").cast("string"))
    stages = F.array(F.lit("text"), F.lit("table"))
    return table(spark, sf_dir, "nation").select("n_nationkey", P.provider(F.lower("n_name"), engine, F.col("n_nationkey") % 2 == 0, stages).alias("fingerprint"))


@REGISTRY.query(
    "model_fingerprint",
    f"""WITH m AS (SELECT DISTINCT s_nationkey, 'family-' || s_suppkey % 3 AS family, CASE WHEN s_suppkey % 2 = 0 THEN 'r' || s_suppkey % 5 END AS revision FROM supplier),
    b AS (SELECT s_nationkey, count(*) AS n, string_agg(hex(unhex('01') || {_prefixed("family")} || CASE WHEN revision IS NULL THEN unhex('00') ELSE unhex('01') || {_prefixed("revision")} END || unhex('00')), '' ORDER BY family, revision NULLS FIRST) AS h FROM m GROUP BY s_nationkey)
    SELECT s_nationkey, sha256({_prefixed("'docweave.model.v1'")} || {_LE.format("n")} || unhex(h)) AS fingerprint FROM b""",
)
def model_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    model = F.struct(
        F.concat(F.lit("family-"), (k % 3).cast("string")).alias("family"),
        F.when(k % 2 == 0, F.concat(F.lit("r"), (k % 5).cast("string"))).alias("revision"),
        F.lit(None).cast("string").alias("weights"),
    )
    g = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.collect_set(model).alias("models"))
    return g.select("s_nationkey", P.model(F.col("models")).alias("fingerprint"))


@REGISTRY.query(
    "batch_digest",
    f"""WITH b AS (SELECT conv_id, count(*) AS n, string_agg(hex({_prefixed("text")}), '' ORDER BY turn) AS h FROM conversations GROUP BY conv_id)
    SELECT conv_id, sha256({_prefixed("'docweave.batch.v1'")} || {_LE.format("n")} || unhex(h)) AS digest FROM b""",
)
def batch_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("rows"))
    return g.select("conv_id", P.ordered(P.BATCH_DOMAIN, F.transform("rows", lambda r: r["text"])).alias("digest"))


@REGISTRY.query(
    "join_text",
    r"""SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS joined, string_agg(array_to_string(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''), ' '), ' ' ORDER BY turn) AS cell FROM conversations GROUP BY conv_id""",
)
def join_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docweave.functions.text import collapsed

    g = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("rows"))
    return g.select("conv_id", F.array_join(F.transform("rows", lambda r: r["text"]), "\n").alias("joined"), F.array_join(F.transform("rows", lambda r: collapsed(r["text"])), " ").alias("cell"))


def nearest_ranks(rows: DataFrame, key: str, value: str, ranks: dict[str, float], bucket: int = 1 << 16) -> DataFrame:
    """Exact nearest-rank percentiles, lo, hi, n and total of a long column by key, without gathering a key's values.

    Counts by value bucket find the bucket that holds each rank; only those
    buckets' values are then counted one by one. Both counts combine before their
    shuffle, and a bucket holds at most ``bucket`` distinct values.
    """
    b = F.floor(F.col(value) / bucket)
    counts = rows.groupBy(key, b.alias("b")).agg(F.count("*").alias("c"), F.min(value).alias("lo"), F.max(value).alias("hi"), F.sum(value).alias("s"))
    whole = Window.partitionBy(key)
    of_key = [F.min("lo").over(whole).alias("lo"), F.max("hi").over(whole).alias("hi"), F.sum("c").over(whole).alias("n"), F.sum("s").over(whole).alias("total")]
    upto = counts.select(key, "b", "c", F.sum("c").over(whole.orderBy("b")).alias("upto"), *of_key)
    targets = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.greatest(F.ceil(F.col("n") * p), F.lit(1)).alias("rank")) for name, p in ranks.items()]))
    held = upto.select("*", targets.alias("t")).where((F.col("t.rank") <= F.col("upto")) & (F.col("t.rank") > F.col("upto") - F.col("c")))
    held = held.select(key, "b", F.col("t.name").alias("name"), (F.col("t.rank") - F.col("upto") + F.col("c")).alias("rank"), "lo", "hi", "n", "total")
    values = rows.withColumn("b", b).join(held, [key, "b"]).groupBy(key, "name", "rank", "lo", "hi", "n", "total", value).agg(F.count("*").alias("c"))
    values = values.withColumn("upto", F.sum("c").over(Window.partitionBy(key, "name").orderBy(value)))
    found = values.where((F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("c")))
    same = [F.first(c).alias(c) for c in ("lo", "hi", "n", "total")]
    return found.groupBy(key).agg(*[F.max(F.when(F.col("name") == name, F.col(value))).alias(name) for name in ranks], *same)


@REGISTRY.query(
    "latency_percentiles",
    """WITH s AS (SELECT event_type, CAST(round(value * 1000000) AS BIGINT) AS ns FROM events)
    SELECT event_type, quantile_disc(ns, 0.5) AS p50, quantile_disc(ns, 0.95) AS p95, min(ns) AS lo, max(ns) AS hi, CAST(count(*) * 1000000000000 // sum(ns) AS BIGINT) AS milli_per_s FROM s GROUP BY event_type""",
)
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "events").select("event_type", F.round(F.col("value") * 1_000_000).cast("bigint").alias("ns"))
    g = nearest_ranks(s, "event_type", "ns", {"p50": 0.5, "p95": 0.95})
    return g.select("event_type", "p50", "p95", "lo", "hi", F.expr("cast(n * 1000000000000 div total as bigint)").alias("milli_per_s"))


@REGISTRY.query(
    "determinism",
    """SELECT o_custkey, count(*) AS runs, count(DISTINCT sha256(o_orderstatus || ':' || o_orderpriority)) AS prints, count(DISTINCT sha256(o_orderstatus || ':' || o_orderpriority)) = 1 AS stable, count(DISTINCT o_orderstatus) = 2 AS two_prints FROM orders GROUP BY o_custkey""",
)
def determinism(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as runs of one input: whether all have the same digest, and whether two statuses make two prints."""
    print_ = F.sha2(F.concat_ws(":", "o_orderstatus", "o_orderpriority").cast("binary"), 256)
    return P.determinism(table(spark, sf_dir, "orders"), ["o_custkey"], print_, F.col("o_orderstatus")).select("o_custkey", "runs", "prints", "stable", (F.col("others") == 2).alias("two_prints"))


@REGISTRY.query(
    "shared_canvas",
    """SELECT p_brand, CAST(max(p_size * 16) AS BIGINT) AS width, CAST(max(p_partkey % 700) AS BIGINT) AS height, CAST(sum(p_size * 16 * (p_partkey % 700) * 3 + p_size * 1024 + 4096) AS BIGINT) AS memory, count(DISTINCT p_size) AS widths FROM part GROUP BY p_brand""",
)
def shared_canvas(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = (F.col("p_size") * 16).cast("bigint"), F.col("p_partkey") % 700
    memory = w * h * 3 + F.col("p_size") * 1024 + 4096  # decoded, raw and scratch
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.max(w).alias("width"), F.max(h).alias("height"), F.sum(memory).alias("memory"), F.countDistinct("p_size").alias("widths"))


@REGISTRY.query(
    "box_score",
    """WITH c AS (SELECT l_orderkey, l_partkey % 20 AS x, l_suppkey % 20 AS y, CAST(l_quantity AS BIGINT) AS v FROM lineitem)
    SELECT l_orderkey, coalesce(avg(v) FILTER (abs(x - 10) + abs(y - 10) <= 8), 0) AS score FROM c GROUP BY l_orderkey""",
)
def box_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the values inside a diamond, its border included; 0 without any."""
    c = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "cast(l_partkey % 20 as double) as x", "cast(l_suppkey % 20 as double) as y", "cast(l_quantity as bigint) as v")
    point = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    diamond = F.array(point(10, 2), point(18, 10), point(10, 18), point(2, 10))
    inside = G.in_convex(F.col("x"), F.col("y"), diamond, degenerate=True)
    return c.groupBy("l_orderkey").agg(F.coalesce(F.avg(F.when(inside, F.col("v"))), F.lit(0.0)).alias("score"))


@REGISTRY.query(
    "image_tokens",
    """SELECT p_partkey, CAST((p_size + 1) // 2 * ((p_size + 1) // 2 + 1) + 1 AS BIGINT) AS global_tokens, CAST((p_size + 1) // 2 * (p_partkey % 6 + 1) * ((p_size + 1) // 2 * (p_partkey % 5 + 1) + 1) AS BIGINT) AS local_tokens FROM part""",
)
def image_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.expr("cast((p_size + 1) div 2 as bigint)")
    rows, cols = F.col("p_partkey") % 6 + 1, F.col("p_partkey") % 5 + 1
    return table(spark, sf_dir, "part").select("p_partkey", (q * (q + 1) + 1).alias("global_tokens"), (q * rows * (q * cols + 1)).alias("local_tokens"))


@REGISTRY.query(
    "token_f1",
    r"""WITH d AS (SELECT doc_id, doc_id % (SELECT count(*) FROM benchmark) AS item_id, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM documents), b AS (SELECT item_id, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM benchmark),
    dc AS (SELECT doc_id, item_id, lower(w) AS w, count(*) AS n FROM d GROUP BY ALL), bc AS (SELECT item_id, lower(w) AS w, count(*) AS n FROM b GROUP BY ALL),
    hit AS (SELECT doc_id, sum(least(dc.n, bc.n)) AS h FROM dc JOIN bc USING (item_id, w) GROUP BY doc_id), dn AS (SELECT doc_id, item_id, sum(n) AS n FROM dc GROUP BY ALL), bn AS (SELECT item_id, sum(n) AS n FROM bc GROUP BY item_id)
    SELECT dn.doc_id, CAST(coalesce(h, 0) AS BIGINT) AS shared, round(2.0 * coalesce(h, 0) / (dn.n + bn.n), 9) AS f1 FROM dn JOIN bn USING (item_id) LEFT JOIN hit USING (doc_id)""",
)
def token_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multiset token overlap of each document with the benchmark item that its id points at."""
    words = lambda df, *keys: df.select(*keys, F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("w")).groupBy(*keys, F.lower("w").alias("w")).agg(F.count("*").alias("n"))
    n_items = table(spark, sf_dir, "benchmark").agg(F.count("*").alias("n_items"))  # one row
    d = words(table(spark, sf_dir, "documents").join(F.broadcast(n_items)).withColumn("item_id", F.col("doc_id") % F.col("n_items")), "doc_id", "item_id")
    b = words(table(spark, sf_dir, "benchmark"), "item_id").withColumnRenamed("n", "m")
    size = b.groupBy("item_id").agg(F.sum("m").alias("bn"))
    # least() ignores nulls, so words the item lacks must not count.
    shared = F.coalesce(F.sum(F.when(F.col("m").isNotNull(), F.least("n", "m"))), F.lit(0))
    x = d.join(b, ["item_id", "w"], "left").groupBy("doc_id", "item_id").agg(F.sum("n").alias("dn"), shared.alias("shared"))
    return x.join(size, "item_id").select("doc_id", "shared", F.round(F.lit(2.0) * F.col("shared") / (F.col("dn") + F.col("bn")), 9).alias("f1"))


@REGISTRY.query(
    "ctc_confidence",
    """WITH s AS (SELECT user_id, event_id, CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 0 WHEN 'signup' THEN 3 ELSE 4 END AS c, value / 500 AS v FROM events),
    t AS (SELECT *, lag(c) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM s)
    SELECT user_id, round(least(1, greatest(0, coalesce(avg(v) FILTER (c <> 0 AND c IS DISTINCT FROM before), 0))), 9) AS confidence FROM t GROUP BY user_id""",
)
def ctc_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docweave.operators import ctc

    return ctc.collapse(ctc_rows(spark, sf_dir), ["user_id"], "event_id", CTC_CHARACTERS).select("user_id", F.round("confidence", 9).alias("confidence"))


CTC_CHARACTERS = "ABC"


def ctc_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class 0 is blank, 1 to 3 are characters, 4 the space after them."""
    c = F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "error", 2).when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "signup", 3).otherwise(4)
    return table(spark, sf_dir, "events").select("user_id", "event_id", c.alias("class_index"), (F.col("value") / 500).alias("score"))


@REGISTRY.query(
    "softmax_top",
    """WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: exp(CAST(x AS DOUBLE) * 1 - list_max(embedding))) AS e, embedding AS v FROM embeddings)
    SELECT vec_id, round(list_max(e) / list_sum(e), 9) AS top, round(list_sum(list_transform(list_zip(e, v), lambda p: p[1] * p[2])) / list_sum(e), 7) AS context FROM s""",
)
def softmax_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    context = F.aggregate(F.zip_with("p", "embedding", lambda a, b: a * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return X.with_softmax(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding", "p").select("vec_id", F.round(F.array_max("p"), 9).alias("top"), F.round(context, 7).alias("context"))


@REGISTRY.query(
    "token_rank",
    """WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: round(CAST(x AS DOUBLE), 1)) AS a FROM embeddings)
    SELECT vec_id, CAST(len(list_filter(a, lambda x, i: x > a[label + 1] OR (x = a[label + 1] AND i < label + 1))) + 1 AS BIGINT) AS rank FROM e""",
)
def token_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.transform("embedding", lambda x: F.round(x.cast("double"), 1))
    return table(spark, sf_dir, "embeddings").select("vec_id", X.rank_of(a, F.col("label")).alias("rank"))
