"""Reports, hosts, quads, branches and passes on literal cases."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from docweave.functions.text import approved_url
from docweave.functions.vectors import banned_tokens
from docweave.operators import planning, report, stages, structure

SHA = "a" * 64


def sound(n: int = 4) -> dict:
    times = [5000 + 100 * k for k in range(n)]
    samples = [
        {"phase": "warm" if k else "cold", "index": k, "elapsed_nanos": t, "first_result_nanos": t, "images_per_second_milli": 10**12 // t, "resident_before": 10, "peak_resident_bytes": 20 + k, "resident_after": 15, "output_sha256": SHA, "output_bytes": 9}
        for k, t in enumerate(times)
    ]

    def summed(name):
        v = sorted(s[name] for s in samples[1:])
        at = lambda p: v[(len(v) * p + 99) // 100 - 1]
        return {"minimum": v[0], "p50": at(50), "p95": at(95), "maximum": v[-1]}

    return {"schema": report.SCHEMA, "revision": "b" * 40, "fingerprints": ["c" * 64, "d" * 64], "samples": samples, "summary": {m: summed(m) for m in report.METRICS}, "output_sha256": SHA, "output_bytes": 9}


def changed(path: str, value, n: int = 4) -> dict:
    out = at = sound(n)
    *way, last = [int(k) if k.isdigit() else k for k in path.split(".")]
    for k in way:
        at = at[k]
    at[last] = value
    return out


CASES = [
    (sound(), None), (sound(2), None), (sound(101), None), (sound(102), "sample_count"), (sound() | {"samples": sound()["samples"][:1]}, "sample_count"), (changed("schema", "v0"), "header"), (changed("revision", "B" * 40), "header"), (changed("fingerprints", []), "fingerprints"),
    (changed("fingerprints", ["c" * 64] * 2), "fingerprints"), (changed("samples.0.elapsed_nanos", 0), "sample"), (changed("samples.2.images_per_second_milli", None), "sample"), (changed("samples.1.phase", "cold"), "sample"), (changed("samples.3.resident_after", 99), "sample"),
    (changed("summary.peak_resident_bytes.maximum", 99), "summary"), (changed("summary", None), "summary"), (changed("output_bytes", 8), "determinism"), (changed("output_sha256", "e" * 64), "determinism"),
]


def test_report_rules(spark):
    df = spark.createDataFrame([(k, json.dumps(r)) for k, (r, _) in enumerate(CASES)], "k int, d string").select("k", F.from_json("d", report.REPORT).alias("r"))
    got = {r.k: r.v for r in df.select("k", report.report_violation(F.col("r")).alias("v")).collect()}
    assert got == {k: want for k, (_, want) in enumerate(CASES)}
    kept = df.where("k <= 2").select("k", (report.derived(F.col("r")) == F.col("r")).alias("same")).collect()
    assert all(r.same for r in kept)


def test_observed_metrics_need_no_second_pass(spark, tmp_path):
    seen_rows = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen_rows.add(b.num_rows)
            yield b

    df, seen = report.observed(spark.range(100).mapInArrow(count, "id bigint"), "o", top=F.max("id"))
    df.write.parquet(str(tmp_path / "out"))
    assert json.loads(report.report_row(df, seen).first().report) == {"rows": 100, "top": 99} and seen_rows.value == 100


@pytest.mark.parametrize(
    "url, ok",
    [("https://a.org/x", True), ("https://a.org", True), ("https://A.org#x", True), ("http://a.org/", False), ("https://a.org@b.net/", False), ("https://a.org:443/", False), ("https://xa.org/", False), ("https:///a.org", False), ("ftp://a.org/ https://a.org/", False), (None, False)],
)
def test_approved_hosts(spark, url, ok):
    assert spark.createDataFrame([(url,)], "u string").select(approved_url(F.col("u"), ("a.org", "b.org"))).first()[0] is ok


def test_quads_keep_to_their_crop_or_are_null(spark):
    row = lambda *logits: spark.createDataFrame([([float(v) for v in logits],)], "v array<float>").select(structure.cell_quad(F.col("v"), F.lit(7), F.lit(9), F.lit(60), F.lit(30))).first()[0]
    assert row(99, 99, 99, -99, -99, -99, -99, 99) == [67, 39, 67, 9, 7, 9, 7, 39]
    assert row(0, 99, 0, -99, 0, -99, 0, 99) is None  # no width
    assert row(99, 99, -99, 99, -99, 0, 99, 99) is None  # half of 60 is the crop's height: no height


def test_missing_branches(spark):
    slots = spark.createDataFrame([(1, ["text"]), (2, ["text", "table"])], "k int, able array<string>")
    none = spark.createDataFrame([], "k int, status string")
    got = stages.branch_results(slots, {"text": spark.createDataFrame([(1, "completed")], "k int, status string"), "table": none}, "k", F.col("able"))
    assert sorted((r.k, r.text, r.table) for r in got.collect()) == [(1, "completed", "unsupported"), (2, "failed", "failed")]


def test_passes_and_whitelists(spark):
    box = lambda d, x: (d, x, 0, 10, 10)
    kind = "array<struct<d:bigint,x:bigint,y:bigint,width:bigint,height:bigint>>"
    df = spark.createDataFrame([([box(1, 0), box(3, 1), box(4, 50)], [box(2, 2), box(5, 100)])], f"a {kind}, b {kind}")
    assert [b.d for b in df.select(planning.merged_passes(F.col("a"), F.col("b"))).first()[0]] == [1, 4, 5]
    t = spark.createDataFrame([("a b a c a".split(),)], "t array<string>")
    assert t.select(banned_tokens(F.col("t"), 2, 40, F.array(F.lit("b")))).first()[0] == ["c"]
