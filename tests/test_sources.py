"""Structure streams, tensor containers, record blobs and resampling against plain Python."""

from __future__ import annotations

import hashlib
import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from docweave.operators import structure, tensors
from docweave.plans.structure import structure_states
from docweave.sources import records
from docweave.sources import tensors as containers

# Structure streams


def test_every_error_state_occurs(spark, sf):
    want = {e for row in structure.TRANSITIONS.values() for e in row if isinstance(e, str)} | {"geometry_repeated", "geometry_missing", "geometry_misaligned", "span_not_numeric", "span_out_of_range", "incomplete", None}
    assert {r.error for r in structure_states(spark, sf).select("error").distinct().collect()} == want


@pytest.mark.parametrize(
    "tokens, places, want",
    [
        (["<tbody>", "<tr>", "<td", ' rowspan="2"', ' colspan="3"', ">", "</td>", "<td></td>", "</tr>", "</tbody>"], [2, 7], [(0, 2, 3, 2), (0, 1, 1, 7)]),
        (["<tr>", "<td", "<td></td>", "</td>", "</tr>", "<tr>", "</tr>"], [1, 2], [(0, 1, 1, 2), (0, 1, 1, 1)]),  # a plain cell in an open one stands before it
        ([], [], []),
        (["<tr>", "<td", ' colspan="2"', ' colspan="+4"', "</td>", "</tr>"], [1], [(0, 1, 4, 1)]),
    ],
)
def test_sound_streams(tokens, places, want):
    cells, rows, error, at = structure.parsed(list(enumerate(tokens)), places)
    assert (error, at) == (None, None) and rows == tokens.count("</tr>")
    assert [(c["row"], c["row_span"], c["col_span"], c["place"]) for c in cells] == want


def test_faults_have_an_order():
    stream = lambda *t: list(enumerate(t))
    assert structure.parsed(stream(' colspan="x"'), [])[2:] == ("span_not_numeric", 0)  # before the missing cell
    assert structure.parsed(stream("<td></td>"), [])[2:] == ("cell_outside_row", 0)  # before the missing geometry
    assert structure.parsed(stream("<tr>", "<td></td>"), [1, 1])[2:] == ("geometry_repeated", None)
    assert structure.parsed(stream("<tr>", *["<td></td>"] * 4097, "</tr>"), list(range(1, 4098)))[2:] == ("too_many_cells", None)


def test_tables_without_geometry_or_tokens(spark):
    tokens = spark.createDataFrame([("a", 0, "<tr>"), ("a", 1, "</tr>"), ("b", 0, "<tr>"), ("b", 1, None), (None, 0, "</tr>")], "k string, pos int, token string")
    got = structure.structures(tokens, spark.createDataFrame([("b", 0, 4)], "k string, ordinal int, pos int"), ["k"]).collect()
    assert sorted((r.k or "", r.rows, r.error) for r in got) == [("", 0, "row_unopened"), ("a", 1, None), ("b", 0, "incomplete")]


# Tensor containers


def built(header, data: bytes) -> bytes:
    text = header if isinstance(header, bytes) else json.dumps(header).encode()
    return struct.pack("<Q", len(text)) + text + data


T = lambda dtype, shape, a, b: {"dtype": dtype, "shape": shape, "data_offsets": [a, b]}


@pytest.mark.parametrize(
    "content, fault",
    [
        (built({"__metadata__": {"format": "x"}, "b": T("BF16", [3, 1], 4, 10), "a": T("F32", [], 0, 4)}, b"0123456789"), None),
        (built({}, b""), None), (built({}, b"x"), "data_length"), (b"", "prefix_short"), (None, "prefix_short"), (struct.pack("<Q", (1 << 64) - 1) + b"{}", "header_too_long"), (struct.pack("<Q", 3) + b"{}", "header_short"),
        (built(b"[]", b""), "header_invalid"), (built(b"\xff{}", b""), "header_invalid"), (built({"a": T("U8", [2], 0, 2), "b": T("U8", [0], 2, 2)}, b"xy"), None), (built({"a": T("U8", [2], 0, 2), "b": T("U8", [2], 1, 3)}, b"xyz"), "range_overlap"),
        (built({"a": T("U8", [2], 1, 3)}, b"xyz"), "range_gap"), (built({"a": T("U8", [1 << 40, 1 << 40, 0], 0, 0)}, b""), None), (built({"a": T("U8", None, 0, 0)}, b""), "shape_invalid"), (built({"a\0": T("U8", [], 0, 1)}, b"x"), "name_invalid"),
        (built({"a": {"dtype": "U8", "shape": [1]}}, b"x"), "range_invalid"),
    ],
)
def test_container_faults(spark, content, fault):
    row = containers.inventory(spark.createDataFrame([(1, content)], "k int, c binary"), "c").first()
    assert row.fault == fault


def test_inventory_and_digest(spark):
    header = {"z": T("F32", [2, 2], 0, 16), "a": T("I64", [1], 16, 24)}
    df = containers.inventory(spark.createDataFrame([(built(header, bytes(24)),)], "c binary"), "c", F.lit(2))
    row = df.withColumn("digest", containers.inventory_digest(F.col("tensors"), b"d")).first()
    assert [(t.name, t.begin, t.end) for t in row.tensors] == [("z", 0, 16), ("a", 16, 24)] and row.fault is None
    q = lambda n: struct.pack("<Q", n)
    said = b"d" + q(2) + q(1) + b"a" + q(3) + b"I64" + q(1) + q(1) + q(8) + q(1) + b"z" + q(3) + b"F32" + q(2) + q(2) + q(2) + q(16)
    assert row.digest == hashlib.sha256(said).hexdigest()
    assert containers.inventory(spark.createDataFrame([(built(header, bytes(24)),)], "c binary"), "c", F.lit(3)).first().fault == "tensor_count"


# Record blobs

LAYOUT = "id:i8,s:i2,v:f4*3,w:f8"


def test_blobs_round_trip_in_ranges(spark, tmp_path):
    records.register(spark)
    path = str(tmp_path / "blobs")
    df = spark.range(1000).selectExpr("id", "CAST(id % 300 - 150 AS SMALLINT) AS s", "array(CAST(id AS FLOAT), CAST(-0.5 AS FLOAT), CAST('NaN' AS FLOAT)) AS v", "id / 7 AS w").repartition(3)
    df.write.format("records").option("layout", LAYOUT).mode("append").save(path)
    assert sum(p.stat().st_size for p in (tmp_path / "blobs").iterdir()) == 1000 * 30
    read = spark.read.format("records").option("layout", LAYOUT).option("partitionBytes", 3000)
    back = read.option("records", 1000).load(path)
    assert back.schema.simpleString() == df.schema.simpleString() and back.rdd.getNumPartitions() >= 10
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    df.limit(5).write.format("records").option("layout", LAYOUT).mode("overwrite").save(path)
    assert read.option("records", 5).load(path).count() == 5
    with pytest.raises(Exception, match="exactly 6 records"):
        read.option("records", 6).load(path).count()


def test_blob_lengths_and_layouts(spark, tmp_path):
    records.register(spark)
    (tmp_path / "odd.blob").write_bytes(struct.pack("<3f", 1, 2, 3) + b"\0")
    (tmp_path / "fine").write_bytes(struct.pack("<qf", 1, 0.5) + struct.pack("<qf", 2, 1.5))
    read = lambda layout, name: spark.read.format("records").option("layout", layout).load(str(tmp_path / name)).collect()
    assert [tuple(r) for r in read("a:i8,b:f4", "fine")] == [(1, 0.5), (2, 1.5)]
    for layout, name, said in (("a:f4", "odd.blob", "whole number"), ("a:f4", "none.blob", "none.blob"), ("a:f3", "fine", "layout"), ("a:f4,A:f4", "fine", "repeat")):
        with pytest.raises(Exception, match=said):
            read(layout, name)


def test_blobs_take_no_nulls_and_leave_nothing_behind(spark, tmp_path):
    records.register(spark)
    for rows in ("CAST(NULL AS BIGINT) AS id, array(1L, 2L) AS v", "1L AS id, array(1L) AS v", "1L AS id, array(1L, NULL) AS v"):
        with pytest.raises(Exception, match="no place"):
            spark.range(1).selectExpr(*[x.strip() for x in rows.split(", ", 1)]).write.format("records").option("layout", "id:i8,v:i8*2").mode("append").save(str(tmp_path / "b"))
    assert [p for p in (tmp_path / "b").rglob("*") if p.suffix == records.SUFFIX] == []


# Resampling


@pytest.mark.parametrize("side, target", [(8, 5), (8, 11), (3, 8), (8, 8), (7, 1), (1, 4)])
def test_cubic_against_matrices(spark, side, target):
    rng = np.random.default_rng(side * 31 + target)
    grid = rng.standard_normal((side, side))
    scale = side / target
    wide = max(scale, 1)

    def kernel(x):
        x = abs(x)
        return 1.5 * x**3 - 2.5 * x**2 + 1 if x < 1 else -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2 if x < 2 else 0

    m = np.zeros((target, side))
    for t in range(target):
        c = scale * (t + 0.5)
        for s in range(max(0, int(c - 2 * wide + 0.5)), min(side, int(c + 2 * wide + 0.5))):
            m[t, s] = kernel((s + 0.5 - c) / wide)
    m /= m.sum(axis=1, keepdims=True)
    want = grid if side == target else m @ grid @ m.T
    got = spark.createDataFrame([(grid.reshape(-1).tolist(),)], "v array<double>").select(tensors.resized(F.col("v"), side, target)).first()[0]
    assert np.allclose(np.array(got).reshape(target, target), want)
    assert np.allclose(m.sum(axis=1), 1)


# Image headers


def test_headers_cut_anywhere_never_raise():
    from docweave.plans.images import KINDS, made
    from docweave.sources import images

    for kind in KINDS:
        data = made(5, kind, 20, 9, 6)
        assert images.geometry(data) == (20, 9)
        for n in range(len(data)):
            assert images.geometry(data[:n]) in (None, (20, 9)) and images.orientation(data[:n]) in (1, 6)
            try:
                images.decode(data[:n])
            except ValueError:
                pass
    assert images.directory(b"II*\0" + struct.pack("<IH", 8, 500) + b"\x01") == {}
    assert images.exif_orientation(b"MM\0*" + struct.pack(">IH", 8, 1) + struct.pack(">HHII", 0x0112, 4, 1, 99)) == 1
