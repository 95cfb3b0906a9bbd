"""Shared recognition calls with their fall back as a query."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.operators import recognition as R
from docweave.registry import Registry, table

REGISTRY = Registry()


@dataclass(frozen=True)
class MarkedProvider:
    """Reports a content's digest. Its first byte says what goes wrong: ``S`` breaks a call that it shares, ``A`` every call, ``D`` only its own result."""

    def recognize_batch(self, contents: Sequence[bytes]) -> list[R.Blocks | R.ItemFailure]:
        marks = {c[:1] for c in contents}
        if b"A" in marks or (b"S" in marks and len(contents) > 1):
            raise ValueError("native_failed")
        return [R.ItemFailure("decode_failed") if c[:1] == b"D" else [(hashlib.sha256(c).hexdigest()[:16], 1.0)] for c in contents]


_WORK = """i AS (SELECT doc_id // 64 AS b, doc_id AS slot, o AS ord, 320 + (doc_id * 7 + o * 13) % 90 // 2 AS w, CASE WHEN (doc_id * 3 + o) % 23 = 5 THEN 'S' WHEN (doc_id + o * 5) % 61 = 9 THEN 'A' WHEN (doc_id * 5 + o) % 29 = 3 THEN 'D' ELSE 'F' END AS mark, text FROM documents, range(3) t(o) WHERE o <= doc_id % 3),
    r AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY w, slot, ord) AS k FROM i),
    g AS (SELECT b, k, w, 1 AS c, 1 AS n, w AS least FROM r WHERE k = 1 UNION ALL
      SELECT r.b, r.k, r.w, CASE WHEN j THEN c ELSE c + 1 END, CASE WHEN j THEN n + 1 ELSE 1 END, CASE WHEN j THEN least ELSE r.w END FROM g JOIN r ON r.b = g.b AND r.k = g.k + 1 CROSS JOIN LATERAL (SELECT n < 8 AND r.w <= least + 16 AS j)),
    h AS (SELECT b, c, count(*) AS n, max(w) AS most FROM g GROUP BY b, c),
    m AS (SELECT b, c, most, n, 1 AS call FROM h WHERE c = 1 UNION ALL
      SELECT h.b, h.c, h.most, CASE WHEN j THEN m.n + h.n ELSE h.n END, CASE WHEN j THEN call ELSE call + 1 END FROM m JOIN h ON h.b = m.b AND h.c = m.c + 1 CROSS JOIN LATERAL (SELECT m.most = h.most AND m.n + h.n <= 32 AS j)),
    q AS (SELECT g.b, call, list({'k': k, 'slot': r.slot, 'mark': r.mark} ORDER BY k) AS items FROM g JOIN m USING (b, c) JOIN r USING (b, k) GROUP BY g.b, call),
    p AS (SELECT b, 0 AS call, CAST([] AS BIGINT[]) AS before, CAST([] AS BIGINT[]) AS failed, CAST([] AS STRUCT(k BIGINT, slot BIGINT, mark VARCHAR)[]) AS active, false AS broken, items FROM (SELECT DISTINCT b, CAST([] AS STRUCT(k BIGINT, slot BIGINT, mark VARCHAR)[]) AS items FROM q) UNION ALL
      SELECT q.b, q.call, p.failed, p.failed || list_transform(list_filter(x.active, lambda i: i.mark IN ('A', 'D')), lambda i: i.slot), x.active, len(x.active) > 1 AND len(list_filter(x.active, lambda i: i.mark IN ('A', 'S'))) > 0, q.items
      FROM p JOIN q ON q.b = p.b AND q.call = p.call + 1 CROSS JOIN LATERAL (SELECT list_filter(q.items, lambda i: NOT list_contains(p.failed, i.slot)) AS active) x),
    e AS (SELECT b, call, before, active, broken, unnest(items) AS i FROM p),
    f AS (SELECT r.b, r.slot, r.ord, r.text, e.call, r.mark, r.k, CASE WHEN list_contains(before, r.slot) THEN 'skipped' WHEN NOT broken THEN 'call' WHEN len(list_filter(active, lambda a: a.slot = r.slot AND a.k < r.k AND a.mark IN ('A', 'D'))) > 0 THEN 'skipped' ELSE 'fallback' END AS mode FROM e JOIN r ON r.b = e.b AND r.k = e.i.k),
    z AS (SELECT *, CASE WHEN mode = 'skipped' THEN NULL WHEN mark = 'A' THEN 'native_failed' WHEN mark = 'D' THEN 'decode_failed' END AS error, CASE WHEN mode <> 'skipped' AND mark IN ('F', 'S') THEN left(sha256(mark || slot || '/' || ord || coalesce(text, '')), 16) END AS found FROM f)"""


def marked_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One to three regions of each document, some of them marked, in batches of 64 documents."""
    d = table(spark, sf_dir, "documents").withColumn("o", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("doc_id") % 3)))
    i, o = F.col("doc_id"), F.col("o")
    mark = F.when((i * 3 + o) % 23 == 5, "S").when((i + o * 5) % 61 == 9, "A").when((i * 5 + o) % 29 == 3, "D").otherwise("F")
    content = F.concat(mark, i.cast("string"), F.lit("/"), o.cast("string"), F.coalesce("text", F.lit(""))).cast("binary")
    return d.select(F.expr("doc_id div 64").alias("batch_id"), i.alias("slot_pos"), o.alias("ordinal"), (320 + F.floor((i * 7 + o * 13) % 90 / 2)).alias("width"), content.alias("content"))


@REGISTRY.query("recognition_calls", f"WITH RECURSIVE {_WORK} SELECT b AS batch_id, slot AS slot_pos, CAST(ord AS BIGINT) AS ordinal, CAST(call AS BIGINT) AS call, mode, found AS text, error FROM z")
def recognition_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every region's call, how it was made, and what came of it."""
    rows = R.recognized(marked_work(spark, sf_dir), MarkedProvider())
    return rows.select("batch_id", "slot_pos", "ordinal", "call", "mode", F.get("blocks", F.lit(0))["text"].alias("text"), "error")


@REGISTRY.query(
    "recognition_slots",
    f"""WITH RECURSIVE {_WORK}, s AS (SELECT b, slot, arg_min(error, (call, k)) FILTER (error IS NOT NULL) AS error, string_agg(found, ',' ORDER BY ord) AS texts, count(DISTINCT CASE WHEN mode = 'call' THEN (call, 0) WHEN mode = 'fallback' THEN (call, k) END) AS receipts FROM z GROUP BY b, slot)
    SELECT b AS batch_id, slot AS slot_pos, error, CASE WHEN error IS NULL THEN texts END AS texts, CASE WHEN error IS NULL THEN receipts END AS receipts FROM s""",
)
def recognition_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's regions in order, or the first failure that ended it."""
    slots = R.slot_results(R.recognized(marked_work(spark, sf_dir), MarkedProvider()))
    return slots.select("batch_id", "slot_pos", "error", F.array_join(F.transform("blocks", lambda b: b["text"]), ",").alias("texts"), "receipts")
