"""Vector codes against whole-number brute force in plain Python."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from docweave.llm import codes

VECTORS = "vec_id bigint, embedding array<float>, label int, v string, code string, part int"


def brute(rows: list[tuple[int, list[float], object]], rounds: int = 4, entries: int = 256) -> tuple[dict, list]:
    kept = sorted(((i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(kept[0][1]) // 4
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(4)]

    def best(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(4):
            groups: dict[int, list] = {}
            for _, v, _ in kept:
                groups.setdefault(best(cut(v, p), books[p])[1], []).append(cut(v, p))
            for k, parts in groups.items():
                books[p][k] = [sum(c) // len(parts) for c in zip(*parts, strict=True)]
    out = []
    for i, v, label in kept:
        found = [best(cut(v, p), books[p]) for p in range(4)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), label))
    return out, books


def test_report(spark):
    rng = random.Random(7)
    rows = [(k, [float(np.float32(rng.gauss(0, 0.3))) for _ in range(16)], rng.choice([None, 1, 2])) for k in range(-20, 330)]
    rows += [rows[5], (rows[9][0], rows[10][1], 2), (None, rows[3][1], 1)]  # repeated rows, a repeated id, a null id, equal vectors
    bad = [(900, None, 1), (901, [1.0, None] * 8, 1), (902, [float("nan")] * 16, None), (903, [float("inf")] + [0.0] * 15, 2), (904, [], 1), (905, [1.0] * 8, 1), (906, [1e9] * 16, 2)]
    df = spark.createDataFrame([(i, v, label, "x", "x", 1) for i, v, label in rows + bad], VECTORS)
    want, books = brute(rows)
    sums: dict = {}
    for _, _, error, label in want:
        sums[label] = sums.get(label, 0) + error
    text = ",".join(str(c) for book in books for entry in book for c in entry)
    got = sorted(map(tuple, codes.code_report(df).collect()), key=repr)
    assert got == sorted(((i, code, error, sums[label], hashlib.sha256(text.encode()).hexdigest()) for i, code, error, label in want), key=repr)


def test_few_and_none(spark):
    df = spark.createDataFrame([(4, [0.5, -0.5, 0.25, -0.001], 1, "", "", 0), (2, [0.5, -0.5, 0.25, -0.001], None, "", "", 0)], VECTORS)
    assert sorted((r.vec_id, r.code, r.error, r.label_error) for r in codes.code_report(df).collect()) == [(2, "00000000", 0, 0), (4, "00000000", 0, 0)]
    assert codes.code_report(df.where("vec_id > 9")).collect() == []
    odd = spark.createDataFrame([(1, [0.5] * 6, 1, "", "", 0)], VECTORS)
    assert codes.code_report(odd).collect() == []


@pytest.mark.parametrize("width,spread", [(1, 5), (3, 1000), (16, 60), (16, 1 << 26), (32, 2)])
def test_bounds_lose_nothing(width, spread):
    """Small spreads give ties, large ones show rounding."""
    rng = np.random.default_rng(width + spread)
    parts, book = rng.integers(-spread, spread + 1, (700, width)), rng.integers(-spread, spread + 1, (256, width))
    parts[::7] = book[rng.integers(0, 256, 100)]
    index, distance = codes.nearest(parts, book)
    whole = ((parts[:, None, :] - book[None]) ** 2).sum(axis=2)
    assert (distance == whole.min(axis=1)).all() and (index == whole.argmin(axis=1)).all()


def test_decode(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(k, [rng.gauss(0, 0.2) for _ in range(8)], 0, "", "", 0) for k in range(300)], VECTORS)
    vectors = codes.integers(df)
    books = codes.fit(vectors)
    for r in codes.decode(codes.encode(vectors, books), books).join(vectors.select("vec_id", "v"), "vec_id").collect():
        assert r.error == sum((a - round(b * 1024)) ** 2 for a, b in zip(r.v, r.vector, strict=True))
