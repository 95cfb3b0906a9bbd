"""Joins and gates over evidence: cells with their geometry, work items with their images, seal scores, table grids, prefetch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.operators import validate as V

#: Score floors of the seal detector's views, and the share of its side within which a boundary view's hit must touch its edge.
FULL_PAGE_FLOOR, BOUNDARY_FLOOR, CONTACT, SIDE = 0.10, 0.025, 0.15, 640


def seal_gate(view: Column, score: Column, left: Column, right: Column, finite: Column) -> Column:
    """confirmed, boundary-candidate, ``provider_output_invalid`` (a score that counts beside a value that is not finite), or null for a row that goes.

    view is full, left or right. A row below its view's floor goes, whatever else it holds.
    """
    full = view == "full"
    counts = score >= F.when(full, FULL_PAGE_FLOOR).otherwise(BOUNDARY_FLOOR)
    touches = F.when(view == "left", left <= SIDE * CONTACT).when(view == "right", right >= SIDE - SIDE * CONTACT).otherwise(False)
    return F.when(~counts, None).when(~finite, F.lit("provider_output_invalid")).when(full, F.lit("confirmed")).when(touches, F.lit("boundary-candidate"))


def block_center(polygon: Column, box: Column) -> Column:
    """The mean of a polygon's four points, or else the middle of the box; null without both."""
    mean = lambda axis: F.aggregate(polygon, F.lit(0.0), lambda a, p: a + p[axis]) / 4
    middle = lambda at, size: box[at] + box[size] / F.lit(2.0)
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.when(polygon.isNotNull(), point(mean("x"), mean("y"))).when(box.isNotNull(), point(middle("x", "width"), middle("y", "height")))


def aligned_geometry(cells: DataFrame, geometry: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Cell tokens with the geometry at the same token position, and a verdict: ``unaligned`` for a token without geometry or geometry without a token."""
    a, b = cells.withColumn("__token", F.lit(True)), geometry.withColumn("__quad", F.lit(True))
    fine = F.col("__token").isNotNull() & F.col("__quad").isNotNull()
    return a.join(b, [*keys, position], "full").withColumn("verdict", F.when(~fine, F.lit("unaligned"))).drop("__token", "__quad")


def zipped(images: DataFrame, detections: DataFrame, receipts: DataFrame, key: str, place: str) -> DataFrame:
    """(key, images, detections, receipts, violation): the three lists of a batch must be equally long."""
    size = lambda df, name: df.groupBy(key).agg(F.count(place).alias(name))
    n = size(images, "images").join(size(detections, "detections"), key, "full").join(size(receipts, "receipts"), key, "full").na.fill(0)
    same = (F.col("images") == F.col("detections")) & (F.col("images") == F.col("receipts"))
    return n.withColumn("violation", V.first_violation(("provider_output_invalid", same)))


def scattered(work: DataFrame, results: DataFrame, item: str, image: str, detection: str) -> DataFrame:
    """Results of work items back at (image, detection): an image with a failed item has failed, with the error of its first, and no texts; others keep theirs and one receipt a batch.

    work: item, image, detection; results: item, batch, text, error. An item without a result counts as failed.
    """
    rows = work.join(results, item, "left").withColumn("error", F.when(F.col("batch").isNull(), F.lit("provider_output_invalid")).otherwise(F.col("error")))
    g = rows.groupBy(image).agg(
        F.min(F.when(F.col("error").isNotNull(), F.struct(F.col(item).alias("item"), F.col("error").alias("error"))))["error"].alias("error"),
        F.array_sort(F.collect_list(F.struct(F.col(detection).alias("detection"), F.col("text").alias("text")))).alias("texts"),
        F.countDistinct(F.when(F.col("error").isNull(), F.col("batch"))).alias("receipts"),
    )
    failed = F.col("error").isNotNull()
    return g.select(image, "error", F.when(~failed, F.array_join(F.transform("texts", lambda t: t["text"]), "|")).alias("texts"), F.when(failed, F.lit(0)).otherwise(F.col("receipts")).cast("bigint").alias("receipts"))


def prefetched(requests: DataFrame, key: str, size: str, cache_bytes: Column, max_items: int, max_bytes: int) -> DataFrame:
    """(key, items, bytes, prefetch): a layer's experts are fetched ahead only with a cache to keep them, and within the item and byte caps."""
    g = requests.groupBy(key).agg(F.count("*").alias("items"), F.sum(size).cast("bigint").alias("bytes"), F.max(cache_bytes).alias("cache"))
    return g.select(key, "items", "bytes", ((F.col("cache") > 0) & (F.col("items") <= max_items) & (F.col("bytes") <= max_bytes)).alias("prefetch"))


def grid_violations(tables: DataFrame, cells: DataFrame, slot: str) -> DataFrame:
    """(slot, violation): the first rule that a slot's tables and cells break, or null.

    tables: slot, id, rows, columns (both or neither), box; cells: slot, id,
    table (an id), row, column, row_span, col_span, box or null. Ids are unique over
    tables and cells; cells lie within their grid and their table's box, and do
    not overlap.
    """
    ids = tables.select(slot, "id").unionByName(cells.select(slot, "id")).groupBy(slot).agg(F.count("*").alias("n_ids"), F.countDistinct("id").alias("d_ids"))
    t = tables.select(slot, F.col("id").alias("table"), F.col("rows").alias("n_rows"), F.col("columns").alias("n_columns"), F.col("box").alias("table_box"))
    inside = lambda b, o: (b["x"] >= o["x"]) & (b["y"] >= o["y"]) & (b["x"] + b["width"] <= o["x"] + o["width"]) & (b["y"] + b["height"] <= o["y"] + o["height"])
    c = cells.join(t, [slot, "table"])
    spans = (F.col("row_span") > 0) & (F.col("col_span") > 0)
    within = (F.col("row") + F.col("row_span") <= F.coalesce("n_rows", F.lit(0))) & (F.col("column") + F.col("col_span") <= F.coalesce("n_columns", F.lit(0)))
    taken = c.where(spans & within).withColumn("r", F.explode(F.sequence("row", F.col("row") + F.col("row_span") - 1))).withColumn("c", F.explode(F.sequence("column", F.col("column") + F.col("col_span") - 1)))
    over = taken.groupBy(slot, "table").agg(F.count("*").alias("n"), F.countDistinct("r", "c").alias("d"))
    over = over.groupBy(slot).agg(F.bool_and(F.col("n") == F.col("d")).alias("apart"), F.max("n").alias("most"))
    by_cell = c.groupBy(slot).agg(F.count("*").alias("n_cells"), F.bool_and(spans).alias("spans"), F.bool_and(within).alias("within"), F.bool_and(F.col("box").isNull() | inside(F.col("box"), F.col("table_box"))).alias("boxes"))
    size = lambda n: F.col(n).between(1, V.MAX_AXIS)
    held = cells.groupBy(slot, "table").agg(F.count("*").alias("held"))
    dims = t.join(held, [slot, "table"], "left").withColumn("dims", (size("n_rows") & size("n_columns")) | (F.col("n_rows").isNull() & F.col("n_columns").isNull() & F.col("held").isNull()))
    by_table = dims.groupBy(slot).agg(F.count("*").alias("n_tables"), F.bool_and(F.coalesce("dims", F.lit(False))).alias("dims"))
    rows = by_table.join(ids, slot, "left").join(by_cell, slot, "left").join(over, slot, "left")
    true = lambda n: F.coalesce(F.col(n), F.lit(True))
    rules = (
        ("tables", F.col("n_tables") <= V.MAX_TABLES), ("ids", F.col("n_ids") == F.col("d_ids")), ("cells", F.coalesce("n_cells", F.lit(0)) <= V.MAX_CELLS), ("dimensions", F.col("dims")),
        ("spans", true("spans")), ("grid", true("within")), ("slots", F.coalesce("most", F.lit(0)) <= V.MAX_GRID_SLOTS), ("overlap", true("apart")), ("region", true("boxes")),
    )
    return rows.select(slot, V.first_violation(*rules).alias("violation"))
