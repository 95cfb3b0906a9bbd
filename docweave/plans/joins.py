"""Outcome matrices, join-shaped operators and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docweave.functions import geometry as G
from docweave.operators import stages as S
from docweave.operators.tables import claims
from docweave.registry import Registry, table

REGISTRY = Registry()

_STAGES_SQL = "(VALUES ('orientation', 0), ('preprocessing', 1), ('layout', 2), ('text', 3), ('table', 4), ('formula', 5), ('seal', 6)) AS t(stage, tag)"


@REGISTRY.query(
    "stage_matrix",
    f"""WITH d AS (SELECT d.doc_id, coalesce(l.quality = 0, false) AS failed, CAST(substr(source, 4) AS INTEGER) % 3 AS p FROM documents d LEFT JOIN labels l USING (doc_id)),
    m AS (SELECT doc_id, stage, tag, failed, CASE p WHEN 0 THEN stage IN ('preprocessing', 'text') WHEN 1 THEN stage IN ('text', 'table', 'seal') ELSE stage = 'text' END AS able FROM d CROSS JOIN {_STAGES_SQL}),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, able ORDER BY tag) AS k FROM m)
    SELECT doc_id, stage, CASE WHEN NOT able THEN 'unsupported' WHEN NOT failed THEN 'completed' WHEN k = 1 THEN 'failed' ELSE 'skipped' END AS status FROM r""",
)
def stage_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    d = docs.join(labels, "doc_id", "left")
    p = F.substring("source", 4, 9).cast("int") % 3
    names = lambda *s: F.array(*map(F.lit, s))
    supported = F.when(p == 0, names("preprocessing", "text")).when(p == 1, names("text", "table", "seal")).otherwise(names("text"))
    return S.outcomes(d, names(*S.STAGES), supported, F.coalesce(F.col("quality") == 0, F.lit(False))).select("doc_id", "stage", "status")


@REGISTRY.query(
    "slot_status",
    f"""WITH d AS (SELECT d.doc_id, coalesce(l.quality = 0, false) AS failed, CAST(substr(source, 4) AS INTEGER) % 3 AS p FROM documents d LEFT JOIN labels l USING (doc_id)),
    m AS (SELECT doc_id, stage, failed, CASE p WHEN 0 THEN stage IN ('preprocessing', 'text') WHEN 1 THEN stage IN ('text', 'table', 'seal') ELSE stage = 'text' END AS able FROM d CROSS JOIN {_STAGES_SQL} WHERE stage IN ('text', 'preprocessing')),
    r AS (SELECT doc_id, count(*) FILTER (able AND NOT failed) AS done, count(*) AS n FROM m GROUP BY doc_id)
    SELECT status, count(*) AS slots FROM (SELECT CASE WHEN done = n THEN 'completed' WHEN done = 0 THEN 'failed' ELSE 'partial' END AS status FROM r) GROUP BY status""",
)
def slot_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stage_matrix(spark, sf_dir).where(F.col("stage").isin("text", "preprocessing"))
    slots = rows.groupBy("doc_id").agg(F.collect_list("status").alias("statuses"))
    return slots.groupBy(S.slot_status(F.col("statuses")).alias("status")).agg(F.count("*").alias("slots"))


@REGISTRY.query(
    "text_only_adapter",
    """SELECT doc_id, stage, CASE WHEN stage <> 'text' THEN 'unsupported' WHEN doc_id % 10 = 0 THEN 'failed' ELSE 'completed' END AS status FROM documents CROSS JOIN (VALUES ('text'), ('table')) AS t(stage)""",
)
def text_only_adapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return S.outcomes(docs, F.array(F.lit("text"), F.lit("table")), F.array(F.lit("text")), F.col("doc_id") % 10 == 0)


@REGISTRY.query(
    "canonical_stages",
    f"""WITH s AS (SELECT conv_id, list_distinct(list(CASE WHEN role = 'user' THEN 'text' WHEN role = 'system' THEN 'seal' ELSE 'layout' END)) AS l FROM conversations GROUP BY conv_id)
    SELECT conv_id, string_agg(stage, ',' ORDER BY tag) AS stages FROM (SELECT conv_id, unnest(l) AS stage FROM s) JOIN {_STAGES_SQL} USING (stage) GROUP BY conv_id""",
)
def canonical_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = F.when(F.col("role") == "user", "text").when(F.col("role") == "system", "seal").otherwise("layout")
    g = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_set(stage).alias("s"))
    # By tag, text comes before seal; by name it would come after.
    return g.select("conv_id", F.array_join(S.canonical(F.col("s")), ",").alias("stages"))


@REGISTRY.query(
    "positional_check",
    """WITH e AS (SELECT conv_id, turn, conv_id || ':' || turn AS id FROM conversations),
    g AS (SELECT conv_id, CASE WHEN conv_id % 7 = 0 THEN turn + 1 ELSE turn END AS turn, id FROM e WHERE NOT (conv_id % 5 = 0 AND turn = 0))
    SELECT conv_id, turn, CASE WHEN g.id IS NULL THEN 'missing' WHEN e.id IS NULL THEN 'unexpected' WHEN e.id <> g.id THEN 'mismatch' END AS verdict FROM e FULL JOIN g USING (conv_id, turn)""",
)
def positional_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat_ws(":", "conv_id", "turn").alias("id"))
    g = e.where(~((F.col("conv_id") % 5 == 0) & (F.col("turn") == 0))).withColumn("turn", F.when(F.col("conv_id") % 7 == 0, F.col("turn") + 1).otherwise(F.col("turn")))
    return S.positional(e, g, ["conv_id"], "turn", "id").select("conv_id", "turn", "verdict")


@REGISTRY.query(
    "branch_join",
    """WITH t AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'completed' ELSE 'failed' END AS status FROM labels), b AS (SELECT doc_id, 'completed' AS status FROM documents WHERE n_chars > 1000), s AS (SELECT doc_id, 'completed' AS status FROM documents WHERE lang = 'en')
    SELECT d.doc_id, coalesce(t.status, 'failed') AS text, coalesce(b.status, 'failed') AS "table", coalesce(s.status, 'failed') AS seal FROM documents d LEFT JOIN t USING (doc_id) LEFT JOIN b USING (doc_id) LEFT JOIN s USING (doc_id)""",
)
def branch_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    text = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "completed").otherwise("failed").alias("status"))
    done = F.lit("completed").alias("status")
    branches = {"text": text, "table": docs.where("n_chars > 1000").select("doc_id", done), "seal": docs.where("lang = 'en'").select("doc_id", done)}
    return S.branch_results(docs.select("doc_id"), branches, "doc_id")


@REGISTRY.query(
    "order_restore",
    """SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pos, event_id, event_type FROM events""",
)
def order_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("bigint")
    return table(spark, sf_dir, "events").select("user_id", place.alias("pos"), "event_id", "event_type")


_SEGMENTS = "SELECT l_orderkey AS page, CAST(l_partkey % 40 AS BIGINT) AS fixed, CAST(l_suppkey % 40 AS BIGINT) AS lo, CAST(l_suppkey % 40 + l_quantity AS BIGINT) AS hi, l_linenumber % 2 AS axis FROM lineitem"


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ruling lines by page: axis 0 horizontal, 1 vertical."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey as page", "cast(l_partkey % 40 as bigint) as fixed", "cast(l_suppkey % 40 as bigint) as lo", "cast(l_suppkey % 40 + l_quantity as bigint) as hi", "l_linenumber % 2 as axis"
    )


@REGISTRY.query(
    "intersections",
    f"""WITH s AS (SELECT DISTINCT * FROM ({_SEGMENTS})), h AS (SELECT * FROM s WHERE axis = 0), v AS (SELECT * FROM s WHERE axis = 1)
    SELECT h.page, count(*) AS crossings FROM h JOIN v ON h.page = v.page AND v.fixed BETWEEN h.lo - 3 AND h.hi + 3 AND h.fixed BETWEEN v.lo - 3 AND v.hi + 3 GROUP BY h.page""",
)
def intersections(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The page is an equality key: the range condition is only evaluated within a page.
    s = segments(spark, sf_dir).distinct()
    h, v = s.where("axis = 0").alias("h"), s.where("axis = 1").alias("v")
    near = F.col("v.fixed").between(F.col("h.lo") - 3, F.col("h.hi") + 3) & F.col("h.fixed").between(F.col("v.lo") - 3, F.col("v.hi") + 3)
    return h.join(v, (F.col("h.page") == F.col("v.page")) & near).groupBy(F.col("h.page").alias("page")).agg(F.count("*").alias("crossings"))


@REGISTRY.query(
    "nested_antijoin",
    """WITH b AS (SELECT DISTINCT l_orderkey AS page, l_partkey % 50 AS x, l_suppkey % 50 AS y, CAST(l_quantity AS BIGINT) AS w, l_linenumber * 5 AS h FROM lineitem)
    SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM b o WHERE o.page = b.page AND o.x <= b.x AND o.y <= b.y AND o.x + o.w >= b.x + b.w AND o.y + o.h >= b.y + b.h AND NOT (o.x = b.x AND o.y = b.y AND o.w = b.w AND o.h = b.h))""",
)
def nested_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as page", "l_partkey % 50 as x", "l_suppkey % 50 as y", "cast(l_quantity as bigint) as w", "l_linenumber * 5 as h").distinct()
    box = lambda a: G.box(*(F.col(f"{a}.{c}") for c in "xywh"))
    inside = (F.col("o.page") == F.col("b.page")) & G.contains(box("o"), box("b")) & (G.box_key(box("o")) != G.box_key(box("b")))
    return b.alias("b").join(b.alias("o"), inside, "left_anti")


@REGISTRY.query(
    "cell_claims",
    """WITH c AS (SELECT t.k AS cell, (t.k % 10) * 20 AS x, (t.k // 10) * 12 AS y FROM (SELECT unnest(range(50)) AS k) t),
    b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_partkey % 210 AS DOUBLE) AS px, CAST(l_suppkey % 70 AS DOUBLE) AS py FROM lineitem),
    j AS (SELECT b.*, min(cell) AS cell FROM b JOIN c ON px BETWEEN x AND x + 24 AND py BETWEEN y AND y + 14 GROUP BY ALL)
    SELECT cell, count(*) AS blocks, CAST(sum(px) AS DOUBLE) AS sx FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, px, cell FROM j) GROUP BY cell""",
)
def cell_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each block goes to the first cell, in cell order, whose quad holds its centre."""
    b = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "cast(l_partkey % 210 as double) as px", "cast(l_suppkey % 70 as double) as py").distinct()
    corner = "struct(cast(x as double) as x, cast(y as double) as y), struct(cast(x + 24 as double) as x, cast(y as double) as y), struct(cast(x + 24 as double) as x, cast(y + 14 as double) as y), struct(cast(x as double) as x, cast(y + 14 as double) as y)"
    cells = spark.range(50).selectExpr("id as cell", "id % 10 * 20 as x", "id div 10 * 12 as y").selectExpr("cell", f"array({corner}) as quad")
    claimed = claims(b, cells, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "px", "py"], bucket=32)
    return claimed.groupBy("cell").agg(F.count("*").alias("blocks"), F.sum("px").alias("sx"))


@REGISTRY.query(
    "adjacent_candidates",
    """WITH p AS (SELECT conv_id, turn, length(text) AS n, lag(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS before, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS bt FROM conversations)
    SELECT conv_id, turn, edge, n - before AS delta FROM p CROSS JOIN (VALUES ('left', 0), ('right', 1)) AS e(edge, k) WHERE bt = turn - 1 AND (n + k) % 2 = 0""",
)
def adjacent_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    n = F.length("text").cast("bigint")
    p = table(spark, sf_dir, "conversations").select("conv_id", "turn", n.alias("n"), F.lag(n).over(w).alias("before"), F.lag("turn").over(w).alias("bt"))
    edges = F.array(*(F.struct(F.lit(e).alias("edge"), F.lit(k).alias("k")) for k, e in enumerate(("left", "right"))))
    x = p.where("bt = turn - 1").withColumn("e", F.explode(edges)).where("(n + e.k) % 2 = 0")
    return x.select("conv_id", "turn", "e.edge", (F.col("n") - F.col("before")).alias("delta"))


@REGISTRY.query(
    "expert_gather",
    """WITH e AS (SELECT event_id, user_id % 8 AS expert, CAST(round(value * 100) AS BIGINT) AS v FROM events), g AS (SELECT expert, sum(v) AS total, count(*) AS n FROM e GROUP BY expert)
    SELECT event_id, e.expert, CAST(g.total AS BIGINT) AS total, g.n AS tokens FROM e JOIN g USING (expert)""",
)
def expert_gather(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 8).alias("expert"), F.round(F.col("value") * 100).cast("bigint").alias("v"))
    g = e.groupBy("expert").agg(F.sum("v").alias("total"), F.count("*").alias("tokens"))
    return e.join(F.broadcast(g), "expert").select("event_id", "expert", "total", "tokens")  # eight experts


@REGISTRY.query(
    "positional_splice",
    """WITH s AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(round(CAST(x AS DOUBLE) * 1000) AS BIGINT)) AS a FROM embeddings)
    SELECT vec_id, array_to_string(list_concat(list_concat(a[1:label], [-7, -8, -9]), a[label + 4:64]), ',') AS spliced FROM s""",
)
def positional_splice(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.transform("embedding", lambda x: F.round(x.cast("double") * 1000).cast("bigint"))
    s = table(spark, sf_dir, "embeddings").select("vec_id", "label", a.alias("a"))
    rows = F.array(*(F.lit(k).cast("bigint") for k in (-7, -8, -9)))
    out = F.concat(F.slice("a", F.lit(1), F.col("label")), rows, F.slice("a", F.col("label") + 4, F.lit(64)))
    return s.select("vec_id", F.array_join(out, ",").alias("spliced"))


@REGISTRY.query(
    "supported_slots",
    """SELECT source, count(*) AS supported FROM documents WHERE CAST(substr(source, 4) AS INTEGER) % 3 IN (0, 2) GROUP BY source""",
)
def supported_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", (F.substring("source", 4, 9).cast("int") % 3).alias("p"))
    able = spark.createDataFrame([(0,), (2,)], "p int")
    return docs.join(F.broadcast(able), "p", "left_semi").groupBy("source").agg(F.count("*").alias("supported"))


@REGISTRY.query(
    "receipt_union",
    """SELECT stage, count(*) AS n, count(DISTINCT id) AS ids FROM (SELECT 'text' AS stage, doc_id AS id FROM documents UNION ALL SELECT 'table', doc_id FROM labels UNION ALL SELECT 'seal', page_id FROM pages) GROUP BY stage""",
)
def receipt_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda t, stage, key: table(spark, sf_dir, t).select(F.lit(stage).alias("stage"), F.col(key).alias("id"))
    all_rows = part("documents", "text", "doc_id").unionByName(part("labels", "table", "doc_id")).unionByName(part("pages", "seal", "page_id"))
    return all_rows.groupBy("stage").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"))


@REGISTRY.query(
    "required_set",
    """WITH r(name) AS (VALUES ('click'), ('error'), ('view'), ('scroll')), o AS (SELECT DISTINCT event_type AS name FROM events)
    SELECT name, 'missing' AS verdict FROM (SELECT name FROM r EXCEPT SELECT name FROM o) UNION ALL SELECT name, 'unexpected' FROM (SELECT name FROM o EXCEPT SELECT name FROM r)""",
)
def required_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    required = spark.createDataFrame([("click",), ("error",), ("view",), ("scroll",)], "name string")
    seen = table(spark, sf_dir, "events").select(F.col("event_type").alias("name"))
    return required.subtract(seen).withColumn("verdict", F.lit("missing")).unionByName(seen.subtract(required).withColumn("verdict", F.lit("unexpected")))


@REGISTRY.query(
    "consumed_fragments",
    """WITH f AS (SELECT DISTINCT l_orderkey AS page, l_linenumber AS id, l_partkey % 90 AS x FROM lineitem), c AS (SELECT page, max(x) AS x FROM f GROUP BY page HAVING count(*) > 3)
    SELECT page, x, count(*) AS n FROM (SELECT f.page, f.x FROM f WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.page = f.page AND f.x < c.x) UNION ALL SELECT page, x + 1000 FROM c) GROUP BY page, x""",
)
def consumed_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as page", "l_linenumber as id", "l_partkey % 90 as x").distinct()
    c = f.groupBy("page").agg(F.max("x").alias("x"), F.count("*").alias("n")).where("n > 3").select("page", "x")
    gone = (F.col("f.page") == F.col("c.page")) & (F.col("f.x") < F.col("c.x"))
    left = f.alias("f").join(c.alias("c"), gone, "left_anti").select("page", "x")
    return left.unionByName(c.select("page", (F.col("x") + 1000).alias("x"))).groupBy("page", "x").agg(F.count("*").alias("n"))
