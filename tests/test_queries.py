"""Every catalogue query against its SQL in DuckDB: same columns, types and rows."""

from __future__ import annotations

import math
import os

import duckdb
import numpy as np
import pytest

from docweave.operators import detect, pixels
from docweave.plans.catalog import REGISTRY
from docweave.sources.config import Detection

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    return con


def value(v):
    return repr(round(v, 9) + 0.0) if isinstance(v, float) else repr(v)


def detection_maps(spark, sf, rows):
    """Maps built here, one embedding at a time; regions and boxes are tested in test_fixtures."""
    want = []
    for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect():
        values = np.kron(np.abs(np.array(r.embedding, np.float64)).reshape(8, 8) * 5, np.ones((8, 8)))
        found = detect.detect(values, (64, 56), (640, 560), Detection(threshold=0.5, box_threshold=0.5))
        want += [(r.vec_id, k, ",".join(f"{x},{y}" for x, y in quad), score) for k, (quad, score) in enumerate(found)]
    got = sorted((r.slot, r.ordinal, r.quad, r.score) for r in rows)
    assert [g[:3] for g in got] == [w[:3] for w in sorted(want)]
    assert all(abs(g[3] - w[3]) < 2e-6 for g, w in zip(got, sorted(want), strict=True))


def pixel_tensors(spark, sf, rows):
    """Images laid out here from each item's whole bytes; the tensors of known images are tested in test_fixtures."""
    got = {r.doc_id: r for r in rows}
    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    assert len(got) == len(items)
    for r in items:
        content = r.text.encode()
        side = max(16, 4 * math.ceil(math.sqrt(len(content) / 3) / 4))
        flat = np.resize(np.frombuffer(content, np.uint8), 3 * side * side)
        image = flat.reshape(side, side, 3)[::-1, :, ::-1]  # a bitmap's rows run upwards, its colours are blue, green, red
        assert abs(got[r.item_id].detector - round(float(pixels.detector_tensor(image, 32, 32, (64, 32)).mean()), 5)) < 2e-5
        assert abs(got[r.item_id].recognition - round(float(pixels.recognition_tensor(image, 64).mean()), 5)) < 2e-5
        assert abs(got[r.item_id].seal - round(float(pixels.seal_tensor(image, 24).mean()), 5)) < 2e-5


def mask_borders(spark, sf, rows):
    """Masks built here, their regions and holes by flooding; the borders themselves are tested in test_borders."""
    from test_borders import borders

    got: dict[int, list] = {}
    for r in rows:
        got.setdefault(r.slot, []).append(r.hole)
    y, x = np.mgrid[0:24, 0:24]
    ring = np.minimum(np.minimum(x, y), np.minimum(23 - x, 23 - y)) % 4
    for e in spark.read.parquet(f"{sf}/embeddings.parquet").collect():
        want = borders((ring == 0) | (np.kron(np.array(e.embedding).reshape(8, 8), np.ones((3, 3))) > 0.05))
        assert sorted(got[e.vec_id]) == sorted(h for h, _ in want)


#: What SQL can't say: each such query has its own check.
BY_HAND = {"detection_maps": detection_maps, "pixel_tensors": pixel_tensors, "mask_borders": mask_borders}


@pytest.mark.parametrize("name", list(REGISTRY))
def test_query(spark, sf, db, name):
    entry = REGISTRY[name]
    df = entry.run(spark, sf)
    rows = df.collect()
    if entry.oracle is None:
        BY_HAND[name](spark, sf, rows)
        return
    want = db.sql(entry.oracle)
    columns = sorted(want.columns)
    assert columns == sorted(df.columns)
    kinds = dict(zip(want.columns, map(str, want.types), strict=True))
    assert {c: TYPES[t] for c, t in df.dtypes} == kinds
    mine = sorted(tuple(value(r[c]) for c in columns) for r in rows)
    assert mine == sorted(tuple(value(r[want.columns.index(c)]) for c in columns) for r in want.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(REGISTRY) <= set(entry.queries())
