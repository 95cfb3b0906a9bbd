"""Length-prefixed digests of providers, models and outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions.binary import byte, digest, fold, optional, prefixed, u64_le
from docweave.operators.stages import stage_tag

#: Domain tags of the digests.
PROVIDER_DOMAIN = "docweave.provider.v1"
MODEL_DOMAIN = "docweave.model.v1"
BATCH_DOMAIN = "docweave.batch.v1"


def provider(provider_id: Column, engine: Column, off_device: Column, stages: Column) -> Column:
    tags = fold(F.transform(stages, lambda s: byte(stage_tag(s))))
    return digest(prefixed(F.lit(PROVIDER_DOMAIN)), prefixed(provider_id), prefixed(engine), F.when(off_device, byte(F.lit(1))).otherwise(byte(F.lit(0))), u64_le(F.size(stages)), tags)


def model(models: Column) -> Column:
    """Of distinct (family, revision, weights) structs in sorted order; null without any."""
    known = F.array_sort(F.array_distinct(models))
    each = F.transform(known, lambda m: F.concat(optional(m["family"]), optional(m["revision"]), optional(m["weights"])))
    return F.when(F.size(models) > 0, digest(prefixed(F.lit(MODEL_DOMAIN)), u64_le(F.size(known)), fold(each)))


def ordered(domain: str, parts: Column) -> Column:
    """Of strings in the order given."""
    return digest(prefixed(F.lit(domain)), u64_le(F.size(parts)), fold(F.transform(parts, prefixed)))


def determinism(runs: DataFrame, keys: list[str], print_: Column, other: Column) -> DataFrame:
    """Runs, distinct prints and distinct values of ``other`` by key; stable where all runs of a key have one print."""
    g = runs.select(*keys, print_.alias("__print"), other.alias("__other")).groupBy(*keys).agg(F.count("*").alias("runs"), F.countDistinct("__print").alias("prints"), F.countDistinct("__other").alias("others"))
    return g.withColumn("stable", F.col("prints") == 1)
