"""Benchmark reports: derived fields recomputed from the samples and compared, and reports made of observed metrics.

A report is a struct, read from its JSON: schema, revision, fingerprints, samples
(the first cold, the others warm, in order), a summary of the warm ones by metric, and the
output that all must share. A report holds at most a hundred samples, so its rules are array
expressions: no report is exploded or joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from docweave.operators.validate import first_violation

#: The schema's name, most warm samples, and the percentiles of a summary.
SCHEMA, MOST_SAMPLES, PERCENTILES = "execution-baseline.v1", 100, (50, 95)
METRICS = ("elapsed_nanos", "images_per_second_milli", "peak_resident_bytes")
_SAMPLE = "phase:string,index:bigint,elapsed_nanos:bigint,first_result_nanos:bigint,images_per_second_milli:bigint,resident_before:bigint,peak_resident_bytes:bigint,resident_after:bigint,output_sha256:string,output_bytes:bigint"
_METRIC = "struct<minimum:bigint,p50:bigint,p95:bigint,maximum:bigint>"
REPORT = f"schema string, revision string, fingerprints array<string>, samples array<struct<{_SAMPLE}>>, summary struct<{','.join(f'{m}:{_METRIC}' for m in METRICS)}>, output_sha256 string, output_bytes bigint"


def is_digest(c: Column) -> Column:
    return c.rlike("^[0-9a-f]{64}$")


def throughput_milli(elapsed_nanos: Column) -> Column:
    """Images a second in thousandths, rounded down."""
    return F.floor(F.lit(10**12).cast("decimal(20,0)") / elapsed_nanos.cast("decimal(20,0)")).cast("bigint")


def summary(values: Column) -> Column:
    """Least, nearest-rank 50th and 95th percentile, and greatest of an array; null unless all are positive."""
    ordered = F.array_sort(values)
    at = lambda p: F.get(ordered, F.floor((F.size(ordered) * p + 99) / 100).cast("int") - 1)
    own = F.struct(F.get(ordered, 0).alias("minimum"), *(at(p).alias(f"p{p}") for p in PERCENTILES), F.try_element_at(ordered, F.lit(-1)).alias("maximum"))
    return F.when((F.size(values) > 0) & F.forall(values, lambda v: v > 0), own)


def summaries(warm: Column) -> Column:
    """The summary struct of an array of samples."""
    metric = lambda name: F.transform(warm, lambda s: s[name])
    return F.struct(*(summary(metric(m)).alias(m) for m in METRICS))


def warm_samples(r: Column) -> Column:
    return F.slice(r["samples"], 2, MOST_SAMPLES + 1)


def sample_ok(s: Column, place: Column) -> Column:
    phase = F.when(place == 0, "cold").otherwise("warm")
    return (
        (s["phase"] == phase) & (s["index"] == place) & (s["elapsed_nanos"] > 0) & (s["first_result_nanos"] == s["elapsed_nanos"]) & (s["images_per_second_milli"] == throughput_milli(F.nullif(s["elapsed_nanos"], F.lit(0).cast("bigint"))))
        & (s["resident_before"] > 0) & (s["peak_resident_bytes"] >= s["resident_before"]) & (s["peak_resident_bytes"] >= s["resident_after"]) & is_digest(s["output_sha256"]) & (s["output_bytes"] > 0)
    )


def report_violation(r: Column) -> Column:
    """The first rule that a report (a struct of REPORT) breaks: header, fingerprints, sample_count, sample, summary or determinism; null if none."""
    samples = r["samples"]
    prints = r["fingerprints"]
    checked = F.transform(samples, lambda s, i: F.coalesce(sample_ok(s, i), F.lit(False)))
    same = F.forall(samples, lambda s: (s["output_sha256"] == r["output_sha256"]) & (s["output_bytes"] == r["output_bytes"]))
    return first_violation(
        ("header", (r["schema"] == SCHEMA) & r["revision"].rlike("^([0-9a-f]{40}|[0-9a-f]{64})$")),
        ("fingerprints", (F.size(prints) > 0) & F.forall(prints, is_digest) & (F.array_sort(F.array_distinct(prints)) == prints)),
        ("sample_count", F.size(samples).between(2, MOST_SAMPLES + 1)),
        ("sample", F.forall(checked, lambda ok: ok)),
        ("summary", r["summary"] == summaries(warm_samples(r))),
        ("determinism", is_digest(r["output_sha256"]) & (r["output_bytes"] > 0) & same),
    )


def derived(r: Column) -> Column:
    """A report with throughput and summary computed from its samples."""
    samples = F.transform(r["samples"], lambda s: s.withField("images_per_second_milli", throughput_milli(F.nullif(s["elapsed_nanos"], F.lit(0).cast("bigint")))))
    return r.withField("samples", samples).withField("summary", summaries(F.slice(samples, 2, MOST_SAMPLES + 1)))


def observed(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, Observation]:
    """df, which measures itself as it runs: rows and the metrics given, read from the observation once an action has ended."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *(c.alias(n) for n, c in metrics.items())), seen


def report_row(df: DataFrame, seen: Observation) -> DataFrame:
    """One row of JSON: what an observation measured, by name, without paths or times of day."""
    values = seen.get
    spark = df.sparkSession
    return spark.range(1).select(F.to_json(F.struct(*(F.lit(values[k]).alias(k) for k in sorted(values)))).alias("report"))
