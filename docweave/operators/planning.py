"""Batch planners and greedy admission: folds whose next decision depends on what was kept.

Each works on one batch, which the contract bounds at 256 slots, so a fold over
an array column is exact and bounded.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed limits.
BATCH_SLOTS = 256
WIDTH_STEP, GROUP_CAP, COALESCE_CAP = 16, 8, 32
COHORT_CAP, COHORT_FILL = 16, 0.9


def _replace_last(acc: Column, value: Column) -> Column:
    return F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(value))


def admitted(slots: Column, cap: int) -> Column:
    """Greedy admission in order: a slot that would exceed the cap is refused, later smaller ones may still come in.

    slots: array of (pos, size). Returns array of (pos, ok).
    """
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<struct<pos:bigint,ok:boolean>>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        ok = acc["used"] + s["size"] <= cap
        row = F.struct(s["pos"].cast("bigint").alias("pos"), ok.alias("ok"))
        return F.struct((acc["used"] + F.when(ok, s["size"]).otherwise(F.lit(0))).cast("bigint").alias("used"), F.concat(acc["out"], F.array(row)).alias("out"))

    return F.aggregate(slots, start, step)["out"]


def width_groups(items: Column, step_px: int = WIDTH_STEP, cap: int = GROUP_CAP, wide_cap: int = COALESCE_CAP) -> Column:
    """Items (width, idx) in width order, grouped within ``step_px`` of the group's least width, then neighbours of equal greatest width merged.

    Returns array of (least, most, members array of idx).
    """
    ordered = F.array_sort(F.transform(items, lambda i: F.struct(i["width"].cast("bigint").alias("width"), i["idx"].cast("bigint").alias("idx"))))
    kind = "array<struct<least:bigint,most:bigint,members:array<bigint>>>"
    none = F.array().cast(kind)

    def add(acc: Column, i: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        fits = F.coalesce((i["width"] <= last["least"] + step_px) & (F.size(last["members"]) < cap), F.lit(False))
        grown = F.struct(last["least"].alias("least"), i["width"].alias("most"), F.concat(last["members"], F.array(i["idx"])).alias("members"))
        fresh = F.struct(i["width"].alias("least"), i["width"].alias("most"), F.array(i["idx"]).alias("members"))
        return F.when(fits, _replace_last(acc, grown)).otherwise(F.concat(acc, F.array(fresh)))

    def merge(acc: Column, g: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        fits = F.coalesce((last["most"] == g["most"]) & (F.size(last["members"]) + F.size(g["members"]) <= wide_cap), F.lit(False))
        grown = F.struct(last["least"].alias("least"), g["most"].alias("most"), F.concat(last["members"], g["members"]).alias("members"))
        return F.when(fits, _replace_last(acc, grown)).otherwise(F.concat(acc, F.array(g)))

    return F.aggregate(F.aggregate(ordered, none, add), none, merge)


def cohorts(images: Column, peak: int, cap: int = COHORT_CAP, fill: float = COHORT_FILL) -> Column:
    """Contiguous cohorts of images (idx, w, h): on the shared canvas every member fills 90 %, and the tensor's peak stays within bounds.

    Returns array of (lo, n, w, h, least_area).
    """
    none = F.array().cast("array<struct<lo:bigint,n:bigint,w:bigint,h:bigint,least:bigint>>")

    def add(acc: Column, i: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        w, h, n = F.greatest(last["w"], i["w"]), F.greatest(last["h"], i["h"]), last["n"] + 1
        least = F.least(last["least"], i["w"] * i["h"])
        fits = F.coalesce((n <= cap) & (least >= fill * (w * h)) & (w * h * 12 * n <= peak), F.lit(False))
        grown = F.struct(last["lo"].alias("lo"), n.alias("n"), w.alias("w"), h.alias("h"), least.alias("least"))
        fresh = F.struct(i["idx"].alias("lo"), F.lit(1).cast("bigint").alias("n"), i["w"].alias("w"), i["h"].alias("h"), (i["w"] * i["h"]).alias("least"))
        return F.when(fits, _replace_last(acc, grown)).otherwise(F.concat(acc, F.array(fresh)))

    return F.aggregate(images, none, add)


def merged_passes(first: Column, second: Column) -> Column:
    """What stays of two passes' boxes: each suppressed by itself, then their union in order once more."""
    return suppressed(F.array_sort(F.concat(suppressed(first), suppressed(second))))


def suppressed(boxes: Column, threshold: float = 0.5, limit: int = 64) -> Column:
    """Greedy non-maximum suppression: array of boxes in order; one stays if it overlaps no kept box by the threshold, up to the limit."""
    from docweave.functions.geometry import iou

    def step(acc: Column, b: Column) -> Column:
        clear = (F.size(acc) < limit) & F.forall(acc, lambda k: iou(k, b) < threshold)
        return F.when(clear, F.concat(acc, F.array(b))).otherwise(acc)

    return F.aggregate(boxes, F.slice(boxes, 1, 0), step)
