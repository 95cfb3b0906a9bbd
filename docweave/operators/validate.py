"""Contract predicates. Each ``*_violation`` is a column: the first broken rule's code, or null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docweave.functions import geometry as G
from docweave.functions import text as T
from docweave.operators.stages import stage_tag

#: Fixed limits.
MAX_SLOTS = 256
MAX_ITEM_TEXT, MAX_STAGE_TEXT = 4096, 1_048_576
MAX_MODEL_NAME, MAX_LABEL = 256, 128
MAX_AXIS, MAX_GRID_SLOTS, MAX_TABLES, MAX_CELLS, MAX_SEALS = 4096, 16_384, 128, 4096, 256
POLYGON_MIN, POLYGON_MAX = 3, 64
REPRESENTATIONS = ("f32-tensor", "image-request", "token-ids", "utf8-text")
MICROBATCH_SCHEMA = 4


def first_violation(*rules: tuple[str, Column]) -> Column:
    """Code of the first rule that does not hold; a rule without a value counts as broken."""
    out = F.lit(None).cast("string")
    for code, ok in reversed(rules):
        out = F.when(~F.coalesce(ok, F.lit(False)), F.lit(code)).otherwise(out)
    return out


def asset_violation(inside: Column, size: Column, limit: int) -> Column:
    """A file lies under its root, isn't empty and keeps to its size cap."""
    return first_violation(("containment", inside), ("empty", size > 0), ("too_large", size <= limit))


def completed_violation(able: Column, stage: Column, output_bytes: Column) -> Column:
    """A completed stage is one that the provider has, and comes with output."""
    return first_violation(("stage_unsupported", F.array_contains(able, stage)), ("text_missing", output_bytes > 0))


def confidence_ok(c: Column) -> Column:
    return c.isNull() | (~F.isnan(c) & c.between(0, 1))


def provider_violation(provider_id: Column, engine: Column, stages: Column) -> Column:
    """Stages are known, distinct and in canonical order (that of their tags, not of their names)."""
    tags = F.transform(stages, stage_tag)
    return first_violation(
        ("provider_id", T.matches(provider_id, T.PROVIDER_ID)),
        ("engine", F.octet_length(engine).between(1, 128) & engine.rlike(r"\S")),
        ("stages", (F.size(stages) > 0) & F.forall(tags, lambda t: t.isNotNull()) & (F.array_sort(F.array_distinct(tags)) == tags)),
    )


def outcome_violation(stage: Column, status: Column, has_error: Column, evidence: Column) -> Column:
    """evidence is the type of the evidence present, null without any."""
    structured = stage.isin("table", "seal")
    return first_violation(
        ("error", status.isin("failed", "skipped") == has_error),
        ("evidence", ((status == "completed") & structured) == evidence.isNotNull()),
        ("evidence_type", F.coalesce(evidence == stage, F.lit(True))),
    )


def output_violation(model: Column, receipts: Column, page: Column, confidence: Column, label: Column, box: Column) -> Column:
    return first_violation(
        ("model", F.octet_length(model).between(1, MAX_MODEL_NAME) & T.bounded_text(model, MAX_MODEL_NAME)),
        ("receipts", receipts > 0),
        ("page", page >= 1),
        ("confidence", confidence_ok(confidence)),
        ("category", label.isNull() | T.matches(label, T.LABEL)),
        ("geometry", G.box_ok(box)),
    )


def receipt_violation(r: Column) -> Column:
    """r: schema, family, weights, input, output (digests), representation, micro_index, micro_count, micro_slots (null: no microbatch)."""
    micro = r["micro_index"].isNotNull()
    return first_violation(
        ("family", F.octet_length(r["family"]).between(1, MAX_MODEL_NAME)),
        ("weights_digest", T.matches(r["weights"], T.SHA256_ANY)),
        ("input_digest", T.matches(r["input"], T.SHA256_ANY)),
        ("output_digest", T.matches(r["output"], T.SHA256_ANY)),
        ("representation", r["representation"].isin(*REPRESENTATIONS)),
        ("microbatch", (r["schema"] == MICROBATCH_SCHEMA) == micro),
        ("microbatch_range", ~micro | ((r["micro_index"] < r["micro_count"]) & (r["micro_slots"] > 0))),
    )


def canvas_ok(width: Column, height: Column) -> Column:
    return width.between(1, G.MAX_CANVAS) & height.between(1, G.MAX_CANVAS)


def region_violation(width: Column, height: Column, box: Column, polygon: Column) -> Column:
    """The polygon has no points or 3 to 64, all on the canvas (edges included), and its envelope is the box."""
    n = F.size(polygon)
    return first_violation(
        ("area", (box["width"] > 0) & (box["height"] > 0)),
        ("canvas", (box["x"] >= 0) & (box["y"] >= 0) & (box["x"] + box["width"] <= width) & (box["y"] + box["height"] <= height)),
        ("polygon_size", (n == 0) | n.between(POLYGON_MIN, POLYGON_MAX)),
        ("polygon_canvas", F.forall(polygon, lambda p: p["x"].between(0, width) & p["y"].between(0, height))),
        ("envelope", (n == 0) | (G.envelope_of_points(polygon) == box)),
    )


def edge_rank(e: Column) -> Column:
    return F.when(e == "left", 0).when(e == "top", 1).when(e == "right", 2).when(e == "bottom", 3)


def seal_violation(status: Column, edges: Column, box: Column, width: Column, height: Column, text: Column, confidence: Column) -> Column:
    ranks = F.transform(edges, edge_rank)
    touches = lambda e: (
        F.when(e == "left", box["x"] == 0).when(e == "top", box["y"] == 0).when(e == "right", box["x"] + box["width"] == width).when(e == "bottom", box["y"] + box["height"] == height)
    )
    return first_violation(
        ("edge_order", (F.array_sort(F.array_distinct(ranks)) == ranks) & ~F.exists(ranks, lambda r: r.isNull())),
        ("edge_touch", F.forall(edges, touches)),
        ("boundary", (status != "boundary-candidate") | (F.size(edges) > 0)),
        ("confidence", confidence.isNull() | text.isNotNull()),
    )


def tensor_violation(shape: Column, values: Column) -> Column:
    product = F.aggregate(shape, F.lit(1).cast("bigint"), lambda a, n: a * n)
    return first_violation(
        ("shape", F.forall(shape, lambda n: n > 0)),
        ("length", F.size(values) == product),
        ("finite", F.forall(values, lambda v: ~F.isnan(v) & (F.abs(v) < float("inf")))),
    )


def ctc_violation(index: Column, score: Column, finite: Column, classes: Column) -> Column:
    return first_violation(
        ("finite", finite == 1),
        ("index", (index >= 0) & (index == F.floor(index)) & (index < classes)),
        ("score", ~F.isnan(score) & (F.abs(score) < float("inf"))),
    )


def budget_violation(prompt: Column, generated: Column, limit: Column, context: Column) -> Column:
    return first_violation(
        ("cap", generated.between(1, F.least(limit, context - 1))),
        ("context", prompt + generated <= context),
    )


def cache_violation(manual_bytes: Column, automatic: Column, limit: Column) -> Column:
    return first_violation(("exclusive", ~((manual_bytes > 0) & automatic)), ("budget", manual_bytes <= limit))


def quality_retry(detections: Column, ranges: Column, floor: int = 32) -> Column:
    """A successful pass that found nothing, on an image with some contrast in a channel."""
    return (detections == 0) & F.exists(ranges, lambda r: r >= floor)


def dark(r: Column, g: Column, b: Column) -> Column:
    return (77 * r + 150 * g + 29 * b) < 160 * 256


def mask(value: Column, threshold: float, x: Column, y: Column, width: Column, height: Column) -> Column:
    return (value > threshold) & (x < width) & (y < height)
