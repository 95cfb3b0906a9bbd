"""Ordered-sequence operators, folds and selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docweave.functions import vectors as X
from docweave.operators import ctc, planning, tables
from docweave.plans.aggregates import CTC_CHARACTERS, ctc_rows
from docweave.plans.joins import _SEGMENTS, segments
from docweave.registry import Registry, table

REGISTRY = Registry()


@REGISTRY.query(
    "ctc_collapse",
    """WITH s AS (SELECT user_id, event_id, CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 0 WHEN 'signup' THEN 3 ELSE 4 END AS c FROM events),
    t AS (SELECT *, lag(c) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM s)
    SELECT user_id, coalesce(string_agg(CASE c WHEN 1 THEN 'A' WHEN 2 THEN 'B' WHEN 3 THEN 'C' ELSE ' ' END, '' ORDER BY event_id) FILTER (c <> 0 AND c IS DISTINCT FROM before), '') AS decoded FROM t GROUP BY user_id""",
)
def ctc_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctc.collapse(ctc_rows(spark, sf_dir), ["user_id"], "event_id", CTC_CHARACTERS).select("user_id", "decoded")


@REGISTRY.query(
    "runs_gap2",
    """WITH p AS (SELECT DISTINCT user_id AS page, event_id // 150 AS y FROM events), m AS (SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY page ORDER BY y) <= 3 THEN 0 ELSE 1 END AS f FROM p),
    g AS (SELECT *, sum(f) OVER (PARTITION BY page ORDER BY y ROWS UNBOUNDED PRECEDING) AS run FROM m)
    SELECT page, min(y) AS lo, max(y) AS hi, count(*) AS n FROM g GROUP BY page, run HAVING max(y) - min(y) + 1 >= 4""",
)
def runs_gap2(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "events").selectExpr("user_id as page", "event_id div 150 as y").distinct()
    return tables.runs(points, ["page"], "y", minimum=4)


@REGISTRY.query(
    "cluster_segments",
    f"""WITH RECURSIVE s AS (SELECT page, fixed, lo, hi, row_number() OVER (PARTITION BY page ORDER BY fixed, lo, hi) AS k FROM (SELECT DISTINCT page, fixed, lo, hi FROM ({_SEGMENTS}))),
    f AS (SELECT page, k, 1 AS c, fixed, lo, hi FROM s WHERE k = 1 UNION ALL
      SELECT s.page, s.k, CASE WHEN j THEN c ELSE c + 1 END, CASE WHEN j THEN CAST(floor((f.fixed + s.fixed) / 2) AS BIGINT) ELSE s.fixed END, CASE WHEN j THEN least(f.lo, s.lo) ELSE s.lo END, CASE WHEN j THEN greatest(f.hi, s.hi) ELSE s.hi END
      FROM f JOIN s ON s.page = f.page AND s.k = f.k + 1 CROSS JOIN LATERAL (SELECT s.fixed <= f.fixed + 2 AND greatest(0, least(f.hi, s.hi) - greatest(f.lo, s.lo) + 1) / least(f.hi - f.lo + 1, s.hi - s.lo + 1) >= 0.7 AS j))
    SELECT page, fixed, lo, hi FROM (SELECT *, row_number() OVER (PARTITION BY page, c ORDER BY k DESC) AS r FROM f) WHERE r = 1""",
)
def cluster_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir).select("page", "fixed", "lo", "hi").distinct()
    pages = s.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("fixed", "lo", "hi"))).alias("s"))
    return pages.select("page", F.explode(tables.clustered(F.col("s"))).alias("c")).select("page", "c.*")


@REGISTRY.query(
    "line_components",
    f"""WITH RECURSIVE s AS (SELECT page, axis, fixed, lo, hi, row_number() OVER (PARTITION BY page ORDER BY axis, fixed, lo, hi) AS line FROM (SELECT DISTINCT * FROM ({_SEGMENTS}))),
    x AS (SELECT h.page, h.line AS h, v.line AS v, v.fixed AS px, h.fixed AS py FROM s h JOIN s v ON h.page = v.page AND h.axis = 0 AND v.axis = 1 AND v.fixed BETWEEN h.lo - 3 AND h.hi + 3 AND h.fixed BETWEEN v.lo - 3 AND v.hi + 3),
    arcs AS (SELECT page, h AS a, v AS b FROM x UNION SELECT page, v, h FROM x), reach AS (SELECT page, a, a AS b FROM arcs UNION SELECT reach.page, reach.a, arcs.b FROM reach JOIN arcs ON arcs.page = reach.page AND arcs.a = reach.b),
    root AS (SELECT page, a AS line, min(b) AS root FROM reach GROUP BY page, a)
    SELECT x.page, root, count(DISTINCT h) AS horizontal, count(DISTINCT v) AS vertical, count(*) AS crossings, min(px) AS "left", min(py) AS top, max(px) AS "right", max(py) AS bottom
    FROM x JOIN root ON x.page = root.page AND x.h = root.line GROUP BY x.page, root HAVING count(DISTINCT h) >= 2 AND count(DISTINCT v) >= 2 AND count(*) >= 4""",
)
def line_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir).distinct()
    s = s.withColumn("line", F.row_number().over(Window.partitionBy("page").orderBy("axis", "fixed", "lo", "hi")).cast("bigint"))
    h, v = s.where("axis = 0").alias("h"), s.where("axis = 1").alias("v")
    near = (F.col("h.page") == F.col("v.page")) & F.col("v.fixed").between(F.col("h.lo") - 3, F.col("h.hi") + 3) & F.col("h.fixed").between(F.col("v.lo") - 3, F.col("v.hi") + 3)
    x = h.join(v, near).select(F.col("h.page").alias("page"), F.col("h.line").alias("h"), F.col("v.line").alias("v"), F.col("v.fixed").alias("x"), F.col("h.fixed").alias("y"))
    return tables.admitted_components(x)


@REGISTRY.query(
    "reading_order",
    """WITH RECURSIVE b AS (SELECT page, x, y, seq, row_number() OVER (PARTITION BY page ORDER BY y, x, seq) AS k FROM (SELECT DISTINCT l_orderkey AS page, l_linenumber AS seq, l_partkey % 200 AS x, l_suppkey % 60 AS y FROM lineitem)),
    f AS (SELECT page, k, [{'y': y, 'x': x, 'seq': seq}] AS o FROM b WHERE k = 1 UNION ALL
      SELECT b.page, b.k, list_concat(list_concat(o[1:len(o) - m], [{'y': b.y, 'x': b.x, 'seq': b.seq}]), o[len(o) - m + 1:])
      FROM f JOIN b ON b.page = f.page AND b.k = f.k + 1 CROSS JOIN LATERAL (SELECT coalesce(nullif(list_position(list_transform(list_reverse(o), lambda q: abs(q.y - b.y) <= 10 AND b.x < q.x), false), 0) - 1, len(o)) AS m)),
    l AS (SELECT page, arg_max(o, k) AS o FROM f GROUP BY page), u AS (SELECT page, unnest(o) AS q, generate_subscripts(o, 1) - 1 AS rank FROM l)
    SELECT page, q.y AS y, q.x AS x, q.seq AS seq, CAST(rank AS BIGINT) AS rank FROM u""",
)
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as page", "l_linenumber as seq", "l_partkey % 200 as x", "l_suppkey % 60 as y").distinct()
    return tables.reading_order(blocks, ["page"])


@REGISTRY.query(
    "width_batches",
    """WITH RECURSIVE i AS (SELECT doc_id // 256 AS b, doc_id AS idx, n_chars % 500 AS w, row_number() OVER (PARTITION BY doc_id // 256 ORDER BY n_chars % 500, doc_id) AS k FROM documents),
    f AS (SELECT b, k, idx, w, w AS least, 1 AS n, 1 AS g FROM i WHERE k = 1 UNION ALL
      SELECT i.b, i.k, i.idx, i.w, CASE WHEN j THEN f.least ELSE i.w END, CASE WHEN j THEN n + 1 ELSE 1 END, CASE WHEN j THEN g ELSE g + 1 END FROM f JOIN i ON i.b = f.b AND i.k = f.k + 1 CROSS JOIN LATERAL (SELECT i.w <= f.least + 16 AND n < 8 AS j)),
    gs AS (SELECT b, g, max(w) AS most, count(*) AS n, min(least) AS least, sum(idx) AS ids FROM f GROUP BY b, g),
    m AS (SELECT b, g, most, n, least, ids, 1 AS c FROM gs WHERE g = 1 UNION ALL
      SELECT gs.b, gs.g, gs.most, CASE WHEN j THEN m.n + gs.n ELSE gs.n END, CASE WHEN j THEN m.least ELSE gs.least END, CASE WHEN j THEN m.ids + gs.ids ELSE gs.ids END, CASE WHEN j THEN c ELSE c + 1 END
      FROM m JOIN gs ON gs.b = m.b AND gs.g = m.g + 1 CROSS JOIN LATERAL (SELECT m.most = gs.most AND m.n + gs.n <= 32 AS j))
    SELECT b AS batch, least, most, CAST(n AS BIGINT) AS n, CAST(ids AS BIGINT) AS ids FROM (SELECT *, row_number() OVER (PARTITION BY b, c ORDER BY g DESC) AS r FROM m) WHERE r = 1""",
)
def width_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = table(spark, sf_dir, "documents").select(F.expr(f"doc_id div {planning.BATCH_SLOTS}").alias("batch"), F.struct((F.col("n_chars") % 500).alias("width"), F.col("doc_id").alias("idx")).alias("i"))
    g = i.groupBy("batch").agg(F.collect_list("i").alias("items")).select("batch", F.explode(planning.width_groups(F.col("items"))).alias("g"))
    total = F.aggregate("g.members", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return g.select("batch", "g.least", "g.most", F.size("g.members").cast("bigint").alias("n"), total.alias("ids"))


@REGISTRY.query(
    "detection_cohorts",
    """WITH RECURSIVE i AS (SELECT doc_id // 256 AS b, doc_id AS idx, 288 + doc_id % 3 * 16 AS w, 320 + n_chars % 2 * 8 AS h, row_number() OVER (PARTITION BY doc_id // 256 ORDER BY doc_id) AS k FROM documents),
    f AS (SELECT b, k, idx, 1 AS c, CAST(1 AS BIGINT) AS n, w, h, w * h AS least FROM i WHERE k = 1 UNION ALL
      SELECT i.b, i.k, i.idx, CASE WHEN j THEN c ELSE c + 1 END, CASE WHEN j THEN n + 1 ELSE 1 END, CASE WHEN j THEN greatest(f.w, i.w) ELSE i.w END, CASE WHEN j THEN greatest(f.h, i.h) ELSE i.h END, CASE WHEN j THEN least(f.least, i.w * i.h) ELSE i.w * i.h END
      FROM f JOIN i ON i.b = f.b AND i.k = f.k + 1 CROSS JOIN LATERAL (SELECT n + 1 <= 16 AND least(f.least, i.w * i.h) >= 0.9 * (greatest(f.w, i.w) * greatest(f.h, i.h)) AND greatest(f.w, i.w) * greatest(f.h, i.h) * 12 * (n + 1) <= 16000000 AS j))
    SELECT b AS batch, min(idx) AS lo, max(n) AS n, max(w) AS width, max(h) AS height FROM f GROUP BY b, c""",
)
def detection_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.struct(F.col("doc_id").alias("idx"), (288 + F.col("doc_id") % 3 * 16).alias("w"), (320 + F.col("n_chars") % 2 * 8).alias("h"))
    i = table(spark, sf_dir, "documents").select(F.expr(f"doc_id div {planning.BATCH_SLOTS}").alias("batch"), size.alias("i"))
    g = i.groupBy("batch").agg(F.array_sort(F.collect_list("i")).alias("images")).select("batch", F.explode(planning.cohorts(F.col("images"), 16_000_000)).alias("c"))
    return g.select("batch", "c.lo", "c.n", F.col("c.w").alias("width"), F.col("c.h").alias("height"))


@REGISTRY.query(
    "greedy_admission",
    """WITH RECURSIVE s AS (SELECT doc_id // 256 AS b, doc_id, strlen(text) AS n, row_number() OVER (PARTITION BY doc_id // 256 ORDER BY doc_id) AS k FROM documents),
    f AS (SELECT b, k, doc_id, n <= 200000 AS ok, CASE WHEN n <= 200000 THEN n ELSE 0 END AS used FROM s WHERE k = 1 UNION ALL
      SELECT s.b, s.k, s.doc_id, used + n <= 200000, CASE WHEN used + n <= 200000 THEN used + n ELSE used END FROM f JOIN s ON s.b = f.b AND s.k = f.k + 1)
    SELECT doc_id, ok FROM f""",
)
def greedy_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "documents").select(F.expr(f"doc_id div {planning.BATCH_SLOTS}").alias("batch"), F.struct(F.col("doc_id").alias("pos"), F.octet_length("text").cast("bigint").alias("size")).alias("s"))
    g = s.groupBy("batch").agg(F.array_sort(F.collect_list("s")).alias("slots")).select(F.explode(planning.admitted(F.col("slots"), 200_000)).alias("a"))
    return g.select(F.col("a.pos").alias("doc_id"), "a.ok")


@REGISTRY.query(
    "ngram_ban",
    r"""WITH t AS (SELECT conv_id, turn, regexp_extract_all(text, '[^ .,\n]{1,2}') AS a FROM conversations), r AS (SELECT conv_id, turn, CASE WHEN len(a) > 40 THEN a[len(a) - 39:len(a)] ELSE a END AS a FROM t)
    SELECT conv_id, turn, CASE WHEN len(a) < 2 THEN '' ELSE coalesce(array_to_string(list_sort(list_distinct(list_transform(list_filter(range(1, len(a)), lambda i: a[i] = a[len(a)]), lambda i: a[i + 1]))), ','), '') END AS banned FROM r""",
)
def ngram_ban(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = F.regexp_extract_all("text", F.lit(r"[^ .,\n]{1,2}"), F.lit(0))
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", tokens.alias("t"))
    return t.select("conv_id", "turn", F.array_join(F.array_sort(X.banned_tokens(F.col("t"), n=2, window=40)), ",").alias("banned"))


@REGISTRY.query(
    "kv_window",
    """WITH e AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pos FROM events)
    SELECT user_id, event_id, count(*) OVER w + CASE WHEN pos > 12 THEN least(pos - 12, 4) ELSE 0 END AS kept, round(sum(value) OVER w, 4) AS recent FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)""",
)
def kv_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a cache holds at each token: the whole prefill of 4 and the 12 most recent."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    recent = w.rowsBetween(-11, 0)
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.row_number().over(w).alias("pos"), F.count("*").over(recent).alias("n"), F.round(F.sum("value").over(recent), 4).alias("recent"))
    return e.select("user_id", "event_id", (F.col("n") + F.when(F.col("pos") > 12, F.least(F.col("pos") - 12, F.lit(4))).otherwise(0)).cast("bigint").alias("kept"), "recent")


@REGISTRY.query(
    "chunking",
    """SELECT user_id, chunk, count(*) AS n, min(event_id) AS first FROM (SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 16 AS chunk FROM events) GROUP BY user_id, chunk""",
)
def chunking(spark: SparkSession, sf_dir: str) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    e = table(spark, sf_dir, "events").select("user_id", "event_id", nth.alias("nth")).withColumn("chunk", F.expr("cast((nth - 1) div 16 as bigint)"))
    return e.groupBy("user_id", "chunk").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


@REGISTRY.query(
    "receipts_once",
    """SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY user_id, event_type""",
)
def receipts_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))


@REGISTRY.query(
    "first_error",
    """SELECT conv_id, arg_min(role, turn) AS code, min(turn) AS turn FROM conversations WHERE length(text) % 3 = 0 GROUP BY conv_id""",
)
def first_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").where(F.length("text") % 3 == 0).groupBy("conv_id").agg(F.min_by("role", "turn").alias("code"), F.min("turn").alias("turn"))


_TOKENS = """tok AS (SELECT o.l_orderkey AS tbl, rn * 10 + k AS pos, token FROM (SELECT l_orderkey, l_linenumber, q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, q) AS rn FROM (SELECT DISTINCT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS q FROM lineitem)) o,
    (VALUES (1, '<tr>'), (2, '<td></td>'), (3, '<td'), (4, ' colspan="'), (5, '</td>'), (6, '</tr>')) v(k, base) CROSS JOIN LATERAL (SELECT CASE WHEN k = 1 AND o.l_linenumber % 2 = 0 THEN NULL WHEN k = 6 AND o.l_linenumber % 2 = 1 THEN NULL WHEN k = 4 THEN base || (o.q % 23) || '">' ELSE base END AS token) WHERE token IS NOT NULL)"""


def _line_tokens(number: Column, q: Column) -> list[Column]:
    """The six places of a line's tokens: odd lines open a row, even ones close it, so rows hold several cells; null where nothing stands."""
    odd = number % 2 == 1
    return [F.when(odd, F.lit("<tr>")), F.lit("<td></td>"), F.lit("<td"), F.concat(F.lit(' colspan="'), (q % 23).cast("string"), F.lit('">')), F.lit("</td>"), F.when(~odd, F.lit("</tr>"))]


def structure_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A token stream for each order, a row for each token."""
    line = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as tbl", "l_linenumber", "cast(l_quantity as bigint) as q").distinct()
    line = line.withColumn("rn", F.row_number().over(Window.partitionBy("tbl").orderBy("l_linenumber", "q")))
    cell = _line_tokens(F.col("l_linenumber"), F.col("q"))
    each = F.array(*(F.struct((F.col("rn") * 10 + k).cast("bigint").alias("pos"), t.alias("token")) for k, t in enumerate(cell, 1)))
    return line.select("tbl", F.explode(each).alias("e")).select("tbl", "e.pos", "e.token").where("token is not null")


def structure_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same streams, each an array: an order's distinct lines meet in one exchange and become tokens behind it."""
    line = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as tbl", "struct(l_linenumber as number, cast(l_quantity as bigint) as q) as line")
    orders = line.groupBy("tbl").agg(F.array_sort(F.collect_set("line")).alias("lines"))
    tokens = F.flatten(F.transform("lines", lambda x: F.array(*_line_tokens(x["number"], x["q"]))))
    return orders.select("tbl", F.array_compact(tokens).alias("tokens"))


@REGISTRY.query(
    "grid_parse",
    f"""WITH {_TOKENS}, t AS (SELECT *, count(*) FILTER (token = '<tr>') OVER w - 1 AS r, count(*) FILTER (token IN ('<td></td>', '<td')) OVER w AS c FROM tok WINDOW w AS (PARTITION BY tbl ORDER BY pos ROWS UNBOUNDED PRECEDING)),
    g AS (SELECT tbl, r, c, string_agg(token, '' ORDER BY pos) AS a FROM t WHERE c > 0 AND r >= 0 AND token NOT IN ('<tr>', '</tr>') GROUP BY ALL), n AS (SELECT *, CASE WHEN regexp_extract(a, ' colspan="([0-9]+)"', 1) = '' THEN 1 ELSE CAST(regexp_extract(a, ' colspan="([0-9]+)"', 1) AS BIGINT) END AS s FROM g)
    SELECT tbl, r AS "row", c AS cell, CAST(1 AS BIGINT) AS row_span, CASE WHEN s BETWEEN 1 AND 20 THEN s END AS col_span FROM n""",
)
def grid_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.cell_tokens(structure_tokens(spark, sf_dir), ["tbl"], "pos", "token").select("tbl", "row", "cell", F.col("row_span").cast("bigint").alias("row_span"), F.col("col_span").cast("bigint").alias("col_span"))


@REGISTRY.query(
    "grid_placement",
    f"""WITH RECURSIVE {_TOKENS}, t AS (SELECT *, count(*) FILTER (token = '<tr>') OVER w - 1 AS r, count(*) FILTER (token IN ('<td></td>', '<td')) OVER w AS c FROM tok WINDOW w AS (PARTITION BY tbl ORDER BY pos ROWS UNBOUNDED PRECEDING)),
    g AS (SELECT tbl, r, c, string_agg(token, '' ORDER BY pos) AS a FROM t WHERE c > 0 AND r >= 0 AND token NOT IN ('<tr>', '</tr>') GROUP BY ALL),
    s AS (SELECT tbl, r, c, 1 + c % 2 AS rs, CASE WHEN regexp_extract(a, ' colspan="([0-9]+)"', 1) = '' THEN 1 WHEN CAST(regexp_extract(a, ' colspan="([0-9]+)"', 1) AS BIGINT) BETWEEN 1 AND 20 THEN CAST(regexp_extract(a, ' colspan="([0-9]+)"', 1) AS BIGINT) ELSE 1 END AS cs,
        row_number() OVER (PARTITION BY tbl ORDER BY r, c) AS k FROM g),
    f AS (SELECT tbl, k, r, CAST(0 AS BIGINT) AS col, rs, cs, flatten(list_transform(range(rs), lambda d: list_transform(range(cs), lambda q: (r + d) * 10000 + q))) AS taken FROM s WHERE k = 1 UNION ALL
      SELECT s.tbl, s.k, s.r, p.col, s.rs, s.cs, list_concat(taken, flatten(list_transform(range(s.rs), lambda d: list_transform(range(s.cs), lambda q: (s.r + d) * 10000 + p.col + q))))
      FROM f JOIN s ON s.tbl = f.tbl AND s.k = f.k + 1 CROSS JOIN LATERAL (SELECT CASE WHEN s.r = f.r THEN f.col + f.cs ELSE 0 END AS lo)
      CROSS JOIN LATERAL (SELECT list_min(list_filter(range(lo, lo + len(taken) + 1), lambda c: len(list_filter(range(c, c + s.cs), lambda q: list_contains(taken, s.r * 10000 + q))) = 0)) AS col) p),
    x AS (SELECT tbl, r + d AS r, col + q AS c, f.r AS own FROM f, range(2) u(d), range(20) v(q) WHERE d < rs AND q < cs)
    SELECT tbl, greatest(max(r) + 1, max(own) + 1) AS rows, max(c) + 1 AS columns, count(*) > count(DISTINCT (r, c)) AS overlap, count(DISTINCT (r, c)) AS slots FROM x GROUP BY tbl""",
)
def grid_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.stream_extent(structure_streams(spark, sf_dir), ["tbl"], "tokens", lambda cell, row_span, col_span: (1 + cell % 2, col_span or 1))


@REGISTRY.query(
    "grid_overlap",
    """WITH c AS (SELECT DISTINCT l_orderkey AS tbl, l_linenumber AS "row", l_partkey % 6 AS col, 1 + l_suppkey % 2 AS rs, 1 + CAST(l_quantity AS BIGINT) % 3 AS cs FROM lineitem),
    s AS (SELECT tbl, "row" + a AS r, col + b AS c FROM c, range(3) x(a), range(3) y(b) WHERE a < rs AND b < cs)
    SELECT tbl, greatest(max(r) + 1, (SELECT max("row") + 1 FROM c d WHERE d.tbl = s.tbl)) AS rows, max(c) + 1 AS columns, count(*) > count(DISTINCT (r, c)) AS overlap, count(DISTINCT (r, c)) AS slots FROM s GROUP BY tbl""",
)
def grid_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as tbl", "cast(l_linenumber as bigint) as row", "l_partkey % 6 as column", "1 + l_suppkey % 2 as row_span", "1 + cast(l_quantity as bigint) % 3 as col_span").distinct()
    return tables.grid_extent(c.withColumn("parsed", F.col("row") + 1), ["tbl"], "parsed")


@REGISTRY.query(
    "stop_rules",
    """WITH t AS (SELECT user_id % 6 AS stream, event_id, CASE WHEN user_id % 6 < 3 THEN CASE WHEN event_id % 4 = 0 AND user_id % 6 = 0 THEN 'sos' ELSE 'click' END WHEN event_type = 'signup' THEN 'sos' WHEN event_type = 'error' AND event_id > 300 THEN 'eos' ELSE event_type END AS token FROM events),
    n AS (SELECT *, CASE WHEN token IS DISTINCT FROM lag(token) OVER (PARTITION BY stream ORDER BY event_id) THEN 1 ELSE 0 END AS new FROM t), r AS (SELECT *, sum(new) OVER (PARTITION BY stream ORDER BY event_id) AS run FROM n),
    k AS (SELECT *, row_number() OVER (PARTITION BY stream, run ORDER BY event_id) AS nth FROM r), s AS (SELECT stream, min(event_id) AS stop FROM k WHERE token = 'eos' OR nth >= 96 GROUP BY stream)
    SELECT k.stream, count(*) AS n, max(event_id) AS last FROM k LEFT JOIN s USING (stream) WHERE (stop IS NULL OR event_id < stop) AND token <> 'sos' GROUP BY k.stream""",
)
def stop_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams that end at an end mark, and streams of one token that end with the 96th in a row, which is not kept; in one of them start marks break the run."""
    stream = F.col("user_id") % 6
    same = F.when((F.col("event_id") % 4 == 0) & (stream == 0), "sos").otherwise("click")
    token = F.when(stream < 3, same).when(F.col("event_type") == "signup", "sos").when((F.col("event_type") == "error") & (F.col("event_id") > 300), "eos").otherwise(F.col("event_type"))
    t = table(spark, sf_dir, "events").select(stream.alias("stream"), "event_id", token.alias("token"))
    return tables.stopped(t, ["stream"], "event_id", "token").groupBy("stream").agg(F.count("*").alias("n"), F.max("event_id").alias("last"))


@REGISTRY.query(
    "argmax_last",
    """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: round(CAST(x AS DOUBLE), 1)) AS a FROM embeddings) SELECT vec_id, CAST(64 - list_position(list_reverse(a), list_max(a)) AS BIGINT) AS idx, list_max(a) AS score FROM e""",
)
def argmax_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.transform("embedding", lambda x: F.round(x.cast("double"), 1))
    return table(spark, sf_dir, "embeddings").select("vec_id", a.alias("a")).select("vec_id", X.argmax_last(F.col("a")).alias("idx"), F.array_max("a").alias("score"))


@REGISTRY.query(
    "argmax_first",
    """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: round(CAST(x AS DOUBLE), 1)) AS a FROM embeddings) SELECT vec_id, CAST(list_position(a, list_max(a)) - 1 AS BIGINT) AS idx FROM e""",
)
def argmax_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.transform("embedding", lambda x: F.round(x.cast("double"), 1))
    return table(spark, sf_dir, "embeddings").select("vec_id", X.argmax_first(a).alias("idx"))


@REGISTRY.query(
    "topk_experts",
    """WITH e AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, i) AS k FROM e)
    SELECT vec_id, string_agg(CAST(i AS VARCHAR), ',' ORDER BY k) AS experts FROM r WHERE k <= 6 GROUP BY vec_id""",
)
def topk_experts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(X.top_k(F.col("embedding"), 6), ",").alias("experts"))


@REGISTRY.query(
    "nms",
    """WITH RECURSIVE b AS (SELECT l_orderkey AS page, l_partkey % 30 AS x, l_suppkey % 30 AS y, 10 + CAST(l_quantity AS BIGINT) AS w, 40 AS h, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount, l_partkey % 30, l_suppkey % 30, l_quantity) AS k FROM lineitem),
    f AS (SELECT page, k, [[x, y, w, h]] AS kept FROM b WHERE k = 1 UNION ALL
      SELECT b.page, b.k, CASE WHEN len(list_filter(kept, lambda o: (greatest(0, least(o[1] + o[3], x + w) - greatest(o[1], x)) * greatest(0, least(o[2] + o[4], y + h) - greatest(o[2], y))) / (o[3] * o[4] + w * h - greatest(0, least(o[1] + o[3], x + w) - greatest(o[1], x)) * greatest(0, least(o[2] + o[4], y + h) - greatest(o[2], y))) >= 0.5)) = 0 THEN list_append(kept, [x, y, w, h]) ELSE kept END
      FROM f JOIN b ON b.page = f.page AND b.k = f.k + 1),
    l AS (SELECT page, arg_max(kept, k) AS kept FROM f GROUP BY page)
    SELECT page, len(kept) AS n, CAST(list_sum(list_transform(kept, lambda o: o[1] * 7 + o[2] * 3 + o[3])) AS BIGINT) AS mark FROM l""",
)
def nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as page", "struct(l_discount as d, l_partkey % 30 as x, l_suppkey % 30 as y, 10 + cast(l_quantity as bigint) as width, 40L as height) as b")
    g = b.groupBy("page").agg(F.array_sort(F.collect_list("b")).alias("boxes")).select("page", planning.suppressed(F.col("boxes")).alias("kept"))
    mark = F.aggregate("kept", F.lit(0).cast("bigint"), lambda a, o: a + o["x"] * 7 + o["y"] * 3 + o["width"])
    return g.select("page", F.size("kept").cast("bigint").alias("n"), mark.alias("mark"))


@REGISTRY.query(
    "best_candidate",
    """SELECT page, edge, seq, confidence FROM (SELECT l_orderkey AS page, l_linestatus AS edge, l_partkey * 1000 + l_suppkey AS seq, l_discount AS confidence, row_number() OVER (PARTITION BY l_orderkey, l_linestatus ORDER BY l_discount DESC, l_partkey * 1000 + l_suppkey DESC) AS r FROM lineitem WHERE l_quantity BETWEEN 5 AND 45) WHERE r = 1""",
)
def best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most confident candidate of each page and edge within the size limits, the last of equals: an aggregate, so no sort per group."""
    c = table(spark, sf_dir, "lineitem").where("l_quantity between 5 and 45").selectExpr("l_orderkey as page", "l_linestatus as edge", "struct(l_discount as confidence, l_partkey * 1000 + l_suppkey as seq) as c")
    return c.groupBy("page", "edge").agg(F.max("c").alias("c")).select("page", "edge", "c.seq", "c.confidence")


@REGISTRY.query(
    "candidate_limits",
    """WITH c AS (SELECT l_orderkey AS page, count(*) AS n FROM lineitem GROUP BY l_orderkey), r AS (SELECT l_orderkey AS page, count(*) FILTER (k <= 3) AS kept FROM (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem) GROUP BY l_orderkey)
    SELECT page, n, kept, CASE WHEN n > 8 THEN 'table_candidate_invalid' END AS error FROM c JOIN r USING (page)""",
)
def candidate_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("page")).agg(F.count("*").alias("n"))
    return g.select("page", "n", F.least("n", F.lit(3)).cast("bigint").alias("kept"), F.when(F.col("n") > 8, "table_candidate_invalid").alias("error"))


@REGISTRY.query(
    "candidate_order",
    """SELECT l_orderkey AS page, string_agg(CAST(x AS VARCHAR) || ':' || CAST(y AS VARCHAR), ' ' ORDER BY y, x) AS ordered FROM (SELECT DISTINCT l_orderkey, l_partkey % 40 AS x, l_suppkey % 40 AS y FROM lineitem) GROUP BY l_orderkey""",
)
def candidate_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as page", "struct(l_suppkey % 40 as y, l_partkey % 40 as x) as p").groupBy("page").agg(F.array_sort(F.collect_set("p")).alias("p"))
    return g.select("page", F.array_join(F.transform("p", lambda q: F.concat_ws(":", q["x"], q["y"])), " ").alias("ordered"))


@REGISTRY.query(
    "distinct_models",
    """SELECT s_nationkey, string_agg(m, ',' ORDER BY m) AS models FROM (SELECT DISTINCT s_nationkey, 'f' || s_suppkey % 4 || ':r' || s_suppkey % 3 AS m FROM supplier) GROUP BY s_nationkey""",
)
def distinct_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    m = F.concat(F.lit("f"), (k % 4).cast("string"), F.lit(":r"), (k % 3).cast("string"))
    g = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.array_sort(F.collect_set(m)).alias("m"))
    return g.select("s_nationkey", F.array_join("m", ",").alias("models"))
