"""Outcome matrices: slots by requested stages against what a provider can do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stages in canonical order; a stage's tag is its place.
STAGES = ("orientation", "preprocessing", "layout", "text", "table", "formula", "seal")


def stage_tag(stage: Column) -> Column:
    tags = F.create_map(*[F.lit(x) for k, s in enumerate(STAGES) for x in (s, k)])
    return tags[stage]


def canonical(stages: Column) -> Column:
    """Distinct stages in canonical order."""
    return F.transform(F.array_sort(F.transform(F.array_distinct(stages), stage_tag)), lambda t: F.array(*map(F.lit, STAGES))[t])


def outcomes(slots: DataFrame, requested: Column, supported: Column, failed: Column, rollup: str | None = None) -> DataFrame:
    """One row for each slot and requested stage, with its status; the slot's own status too, under the name of ``rollup``.

    Where ``failed`` holds, the first supported stage is failed and the later ones
    are skipped; unsupported stages stay so. The stage list is bounded by the
    seven stages, so the matrix is an array per slot: no join, no shuffle.
    """
    able = F.filter(requested, lambda s: F.array_contains(supported, s))
    matrix = F.transform(
        requested,
        lambda s: F.struct(
            s.alias("stage"),
            F.when(~F.array_contains(supported, s), "unsupported").when(~failed, "completed").when(s == F.get(able, F.lit(0)), "failed").otherwise("skipped").alias("status"),
        ),
    )
    rows = slots.withColumn("outcome", matrix)
    if rollup:
        rows = rows.withColumn(rollup, slot_status(F.transform("outcome", lambda o: o["status"])))
    return rows.withColumn("outcome", F.explode("outcome")).select("*", "outcome.stage", "outcome.status").drop("outcome")


def slot_status(statuses: Column) -> Column:
    """completed if all are, failed if none is, else partial (unsupported stages are not completed)."""
    done = F.size(F.filter(statuses, lambda s: s == "completed"))
    return F.when(done == F.size(statuses), "completed").when(done == 0, "failed").otherwise("partial")


def positional(expected: DataFrame, given: DataFrame, keys: list[str], position: str, identity: str) -> DataFrame:
    """Full join by position with a verdict: missing, unexpected, mismatch or null (fine)."""
    a = expected.select(*keys, position, F.col(identity).alias("expected_id"))
    b = given.select(*keys, position, F.col(identity).alias("given_id"))
    verdict = F.when(F.col("given_id").isNull(), "missing").when(F.col("expected_id").isNull(), "unexpected").when(F.col("expected_id") != F.col("given_id"), "mismatch")
    return a.join(b, [*keys, position], "full").withColumn("verdict", verdict)


def isolated(bad_source: Column, bad_batch: Column, with_preprocessing: Column) -> Column:
    """(preprocessing, text): a bad source fails preprocessing and skips text, or fails text where preprocessing isn't asked for; a failed microbatch fails text alone."""
    before = F.when(with_preprocessing, F.when(bad_source, "failed").otherwise("completed"))
    text = F.when(bad_source & with_preprocessing, "skipped").when(bad_source | bad_batch, "failed").otherwise("completed")
    return F.struct(before.alias("preprocessing"), text.alias("text"))


def branch_results(slots: DataFrame, branches: dict[str, DataFrame], key: str, supported: Column | None = None) -> DataFrame:
    """Slots left-joined with each branch's (key, status). A branch without a row counts as failed, or as unsupported where the array ``supported`` lacks its stage."""
    out = slots
    for name, rows in branches.items():
        able = F.lit(True) if supported is None else F.array_contains(supported, F.lit(name))
        out = out.join(rows.select(key, F.col("status").alias(name)), key, "left").withColumn(name, F.coalesce(name, F.when(able, "failed").otherwise("unsupported")))
    return out
