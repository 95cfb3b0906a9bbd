"""Literal cases with known outcomes."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docweave.facade import Descriptor, EchoProvider, Engine
from docweave.functions import binary as B
from docweave.functions import geometry as G
from docweave.functions import text as T
from docweave.functions import vectors as X
from docweave.operators import ctc, detect, generation, grounding, pixels, planning, seals, tables, tensors
from docweave.operators import stages as S
from docweave.operators import validate as V
from docweave.sources import config, images


def one(spark, *columns):
    return tuple(spark.range(1).select(*(c.alias(f"c{k}") for k, c in enumerate(columns))).first())


def array(kind, *values):
    return F.expr(f"cast(array({', '.join(map(str, values))}) as array<{kind}>)")


def test_signatures(spark):
    of = lambda b: B.media_type(F.lit(b))
    assert one(spark, of(b"\x89PNG\r\n\x1a\nxx"), of(b"\xff\xd8\xff"), of(b"not an image"), of(b"RIFF1234WEBP"), of(b"")) == ("image/png", "image/jpeg", None, "image/webp", None)


def test_little_endian_with_high_bytes(spark):
    assert [bytes(x) for x in one(spark, B.u64_le(F.lit(200)), B.u64_le(F.lit(0x1234)))] == [struct.pack("<Q", 200), struct.pack("<Q", 0x1234)]


def test_identifiers(spark):
    ids = ["page.7:left_2", ".hidden", "z" * 128, "z" * 129, ""]
    assert one(spark, *(T.matches(F.lit(i), T.SLOT_ID) for i in ids)) == (True, False, True, False, False)
    assert one(spark, *(T.matches(F.lit(i), T.PROVIDER_ID) for i in ("_reader", "reader.v2", "reader v2", "Reader"))) == (False, True, False, False)


def test_ctc_collapse(spark):
    rows = spark.createDataFrame([(1, k, c, s) for k, (c, s) in enumerate(zip((0, 1, 0, 1, 2), (0.9, 0.8, 0.9, 0.8, 0.8)))], "item int, t int, class_index int, score double")
    r = ctc.collapse(rows, ["item"], "t", "AB").first()
    assert r.decoded == "AAB" and abs(r.confidence - 0.8) < 1e-12
    space = spark.createDataFrame([(1, 0, 3, 1.0), (1, 1, 3, 1.0)], "item int, t int, class_index int, score double")
    assert ctc.collapse(space, ["item"], "t", "AB").first().decoded == " "


def test_argmax_ties(spark):
    a = array("double", 0.1, 0.8, 0.8, 0.2)
    assert one(spark, X.argmax_last(a), X.argmax_first(a), X.argmax_first(array("double", 1, 2, 2))) == (2, 1, 1)
    nan = F.array(F.lit(0.9), F.lit(float("nan")), F.lit(0.1))
    assert one(spark, X.argmax_first(nan), X.finite(nan)) == (0, False)


def test_box_score_and_detection():
    grid = np.arange(9, dtype=np.float32).reshape(3, 3)
    assert detect.box_score(grid, [(1, 0), (2, 1), (1, 2), (0, 1)]) == 4.0
    values = np.zeros((64, 64), np.float32)
    values[8:24, 40:56] = 1
    assert detect.detect(values, (32, 32), (32, 32), config.Detection()) == []
    ((quad, score),) = detect.detect(values, (64, 64), (64, 64), config.Detection())
    assert score == 1.0 and min(x for x, _ in quad) < 40 and max(y for _, y in quad) > 23


def test_reading_order(spark):
    rows = spark.createDataFrame([(1, 0, 100, 0), (1, 1, 0, 10)], "page bigint, seq bigint, x bigint, y bigint")
    assert {r.seq: r["rank"] for r in tables.reading_order(rows, ["page"]).collect()} == {1: 0, 0: 1}


def test_quality_retry(spark):
    of = lambda found, *r: V.quality_retry(F.lit(found), array("int", *r))
    assert one(spark, of(0, 31, 31, 31), of(0, 32, 0, 7), of(0, 5, 9, 200), of(1, 90, 90, 90), of(0)) == (False, True, True, False, False)


@pytest.mark.parametrize("size", [(1, 1), (37, 911), (63, 64), (640, 480), (1301, 77), (5000, 3), (96, 2900)])
@pytest.mark.parametrize("cap", [320, 896, 1000])
def test_detector_dims(spark, size, cap):
    """The shorter side grows to 64, a longer side beyond the cap shrinks the whole to it; then both go to the nearest multiple of 32, at least 32."""
    grow = max(1.0, 64 / min(size))
    factor = cap / max(size) if max(size) * grow > cap else grow
    got = tuple(one(spark, G.detector_dims(F.lit(float(size[0])), F.lit(float(size[1])), cap))[0])
    for side, n in zip(size, got, strict=True):
        assert n % 32 == 0 and n >= 32 and (n == 32 or abs(n - side * factor) <= 16 + 1)


def test_recognition_width(spark):
    sizes = [(7, 9), (333, 48), (640, 31), (3000, 44), (90_000, 20), (5, 0), (-3, 4)]
    want = [None if w <= 0 or h <= 0 else max(320, min(3200, -(-48 * w // h))) for w, h in sizes]
    assert one(spark, *(G.recognition_width(F.lit(w), F.lit(h)) for w, h in sizes)) == tuple(want)


def groups(spark, widths):
    items = F.expr(f"array({', '.join(f'named_struct("width", {w}, "idx", {k})' for k, w in enumerate(widths))})")
    (out,) = one(spark, planning.width_groups(items))
    return [list(g.members) for g in out], [g.most for g in out]


@pytest.mark.parametrize("seed", range(6))
def test_width_groups(spark, seed):
    """Every item once, in order of width; no group is wider than its bound or larger than it may be, and none could have taken the next item."""
    rng = np.random.default_rng(seed)
    widths = (330 + rng.integers(0, [4, 30, 400][seed % 3], 50 + seed)).tolist()
    members, most = groups(spark, widths)
    order = sorted(range(len(widths)), key=lambda k: (widths[k], k))
    assert sum(members, []) == order and most == [max(widths[k] for k in g) for g in members]
    small, at = [], 0
    while at < len(order):  # groups of at most eight within 16 of their first, before neighbours of one greatest width are joined
        end = at + 1
        while end < len(order) and end - at < 8 and widths[order[end]] <= widths[order[at]] + 16:
            end += 1
        small.append(order[at:end])
        at = end
    joined: list[list[int]] = []
    for g in small:
        if joined and widths[joined[-1][-1]] == widths[g[-1]] and len(joined[-1]) + len(g) <= 32:
            joined[-1] = joined[-1] + g
        else:
            joined.append(g)
    assert members == joined


def test_cohorts(spark):
    of = lambda sizes, peak: [(c.lo, c.n) for c in one(spark, planning.cohorts(F.expr(f"array({', '.join(f'named_struct("idx", {k}L, "w", {w}L, "h", {h}L)' for k, (w, h) in enumerate(sizes))})"), peak))[0]]
    assert of([(100, 90), (100, 100), (89, 100)], 1 << 40) == [(0, 2), (2, 1)]  # 90 of 100 rows are enough, 89 are not
    assert of([(50, 70)] * 35, 1 << 40) == [(0, 16), (16, 16), (32, 3)]
    assert of([(200, 300)] * 9, 4 * 12 * 200 * 300 + 1) == [(0, 4), (4, 4), (8, 1)]


def test_greedy_admission(spark):
    slots = F.expr("array(" + ", ".join(f'named_struct("pos", {k}, "size", {n})' for k, n in enumerate((50, 60, 30, 20, 10))) + ")")
    assert [a.ok for a in one(spark, planning.admitted(slots, 100))[0]] == [True, False, True, True, False]


def test_nms_survivors_do_not_overlap(spark):
    rng = np.random.default_rng(1)
    boxes = F.expr("array(" + ", ".join(f'named_struct("x", {x}L, "y", {y}L, "width", 20L, "height", 20L)' for x, y in rng.integers(0, 40, (30, 2))) + ")")
    (kept,) = one(spark, planning.suppressed(boxes))

    def iou(a, b):
        side = lambda p, q: max(0, 20 - abs(p - q))
        both = side(a.x, b.x) * side(a.y, b.y)
        return both / (800 - both)

    assert kept and all(iou(a, b) < 0.5 for k, a in enumerate(kept) for b in kept[:k])


def test_grid(spark):
    tokens = ["<tr>", "<td", ' rowspan="2"', ">", "</td>", "<td></td>", "</tr>", "<tr>", "<td></td>", "</tr>"]
    rows = spark.createDataFrame([(1, k, t) for k, t in enumerate(tokens)], "tbl bigint, pos bigint, token string")
    cells = tables.cell_tokens(rows, ["tbl"], "pos", "token").select("tbl", "row", "cell", F.col("row_span").cast("bigint"), F.col("col_span").cast("bigint"))
    grid = tables.placed(cells, ["tbl"])
    assert sorted((r.row, r.column, r.row_span, r.col_span) for r in grid.collect()) == [(0, 0, 2, 1), (0, 1, 1, 1), (1, 1, 1, 1)]
    r = tables.grid_extent(grid.withColumn("parsed", F.lit(2)), ["tbl"], "parsed").first()
    assert (r.rows, r.columns, r.overlap) == (2, 2, False)


def test_outcomes(spark):
    slots = spark.createDataFrame([("a", False), ("c", True)], "slot string, bad boolean")
    wanted = S.canonical(F.array(F.lit("formula"), F.lit("text"), F.lit("preprocessing")))
    able = F.array(F.lit("preprocessing"), F.lit("text"))
    rows = [(r.slot, r.stage, r.status) for r in S.outcomes(slots, wanted, able, F.col("bad")).collect()]
    assert rows == [
        ("a", "preprocessing", "completed"), ("a", "text", "completed"), ("a", "formula", "unsupported"),
        ("c", "preprocessing", "failed"), ("c", "text", "skipped"), ("c", "formula", "unsupported"),
    ]


def test_structured_evidence(spark):
    box = lambda *v: G.box(*map(F.lit, v))
    points = lambda *p: F.array(*(F.struct(F.lit(x).cast("bigint").alias("x"), F.lit(y).cast("bigint").alias("y")) for x, y in p))
    region = lambda polygon: V.region_violation(F.lit(1000), F.lit(2000), box(100, 200, 800, 900), polygon)
    assert one(spark, region(points((100, 200), (900, 200), (900, 1100), (100, 1100))), region(points((100, 200), (901, 200), (900, 1100)))) == (None, "envelope")
    edges = lambda *e: F.expr(f"cast(array({', '.join(map(repr, e))}) as array<string>)")
    seal = lambda status, e, text, conf: V.seal_violation(F.lit(status), e, box(900, 300, 100, 120), F.lit(1000), F.lit(2000), text, conf)
    none = F.lit(None).cast("string")
    assert one(spark, seal("confirmed", edges("right"), F.lit("t"), F.lit(0.9)), seal("confirmed", edges("left"), none, none), seal("boundary-candidate", edges(), none, none), seal("confirmed", edges("right"), none, F.lit(0.9))) == (None, "edge_touch", "boundary", "confidence")


def test_seal_views(spark):
    (views,) = one(spark, seals.page_views(F.lit(1200), F.lit(1600)))
    assert [(v.kind, v.x, v.width) for v in views] == [("full", 0, 1200), ("left", 0, 100), ("right", 1100, 100)]
    (v,) = one(spark, seals.adjacent_view(F.lit(1190), F.lit(1684), F.lit("right"), G.box(*map(F.lit, (1130, 790, 60, 206)))))
    assert (v.x, v.width, v.height) == (1126, 64, 412)
    f = spark.createDataFrame([(1, 1130, 730, 60, 298), (1, 1182, 790, 8, 26), (1, 1183, 838, 7, 21)], "page bigint, x bigint, y bigint, width bigint, height bigint")
    assert [tuple(r) for r in seals.fused(f, ["page"]).collect()] == [(1, 1182, 730, 8, 298)]


def blocks(spark, markup):
    (out,) = one(spark, grounding.blocks(F.lit(markup), F.lit(1000), F.lit(500)))
    return out


def test_grounding(spark):
    text = "<|ref|>title<|/ref|><|det|>[[0,0,999,100]]<|/det|>Head\n<|det|>equation [[100, 200, 400, 300], [500,250,900,350]]<|/det|>x \\coloneqq y"
    a, b = blocks(spark, text)
    assert a.role == "title" and tuple(a.parts[0]) == (0, 0, 1000, 50) and b.role == "equation-block" and len(b.parts) == 2
    bad = "<|det|>image [1,2,3,4]<|/det|>x<|det|>text [0,0,1000,5]<|/det|>x<|det|>text [5,5,5,9]<|/det|>x"
    kept = grounding.blocks(F.lit(bad), F.lit(1000), F.lit(500))
    assert one(spark, F.size(kept), grounding.warned(F.lit(bad), kept)) == (0, True)
    assert blocks(spark, "before <|det|>text [1,2") == []
    many = ",".join(["[1,2,3,4]"] * 129)
    assert one(spark, grounding.boxes(F.lit(f"[{many}]")), grounding.boxes(F.lit("[[1,2,3,4],]")), grounding.boxes(F.lit("[007,2,30,4]")).isNotNull()) == (None, None, True)


def test_generation(spark):
    assert generation.banned([5, 6, 7, 6, 7], 3, 8) == {6}
    assert one(spark, X.banned_tokens(array("int", 5, 6, 7, 6, 7), 3, 8))[0] == [6]
    assert generation.greedy(np.array([1.0, 2.0, 2.0]), set()) == 1
    with pytest.raises(ValueError):
        generation.greedy(np.array([np.nan, np.inf]), set())
    x = np.random.default_rng(0).normal(size=(5, 8))
    turned = generation.rope(x, np.arange(5.0))
    assert np.allclose(np.linalg.norm(turned, axis=1), np.linalg.norm(x, axis=1)) and np.allclose(turned[0], x[0])
    assert np.allclose(generation.attend(x[:1], x[:1], x[:1]), x[:1])
    h = generation.gru(np.zeros(2), np.ones(3), np.zeros((9, 2)), np.zeros((9, 3)), np.zeros(9), np.zeros(9))
    assert np.allclose(h, 0.5)


def test_windows_round_trip(spark):
    w = tensors.window_of(F.col("id") % 40, F.floor(F.col("id") / 40), 40, 14)
    back = spark.range(1600).select("id", w.alias("w")).select("id", tensors.unwindow(F.col("w.win"), F.col("w.slot"), 40, 14).alias("p"))
    assert back.where("p.y <> id % 40 or p.x <> id div 40").count() == 0


def test_percentiles(spark):
    rows = spark.createDataFrame([(3_000_000_000,), (1_000_000_000,), (2_000_000_000,)], "ns bigint")
    r = rows.agg(*(F.expr(f"percentile_disc({p}) within group (order by ns)").cast("bigint") for p in (0.5, 0.95))).first()
    assert tuple(r) == (2_000_000_000, 3_000_000_000)


# Sources


def png(pixels, filters):
    h, w, c = pixels.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    lines = []
    flat = pixels.reshape(h, w * c).astype(int)
    for y, f in zip(range(h), filters):
        up = flat[y - 1] if y else np.zeros(w * c, int)
        left = np.concatenate([np.zeros(c, int), flat[y][:-c]])
        corner = np.concatenate([np.zeros(c, int), up[:-c]])
        paeth = [min(((abs(a + b - d - a), 0, a), (abs(a + b - d - b), 1, b), (abs(a + b - d - d), 2, d)))[2] for a, b, d in zip(left, up, corner)]
        base = {0: 0, 1: left, 2: up, 3: (left + up) // 2, 4: np.array(paeth)}[f]
        lines.append(bytes([f]) + ((flat[y] - base) % 256).astype(np.uint8).tobytes())
    head = struct.pack(">IIBBBBB", w, h, 8, {3: 2, 4: 6}[c], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")


@pytest.mark.parametrize("channels", [3, 4])
def test_png_filters(channels):
    pixels = np.random.default_rng(1).integers(0, 256, (5, 6, channels)).astype(np.uint8)
    assert np.array_equal(images.decode(png(pixels, (0, 1, 2, 3, 4))), pixels[:, :, :3])


def test_admission_of_files(spark, tmp_path):
    pixels = np.full((2, 3, 3), 7, np.uint8)
    (tmp_path / "a.png").write_bytes(png(pixels, (0, 0)))
    (tmp_path / "b.txt").write_bytes(b"not an image")
    rows = {r.path.rsplit("/", 1)[1]: r for r in images.read_sources(spark, str(tmp_path)).collect()}
    assert (rows["a.png"].media_type, rows["b.txt"].error_code) == ("image/png", "source_type_unsupported")
    found = {r.path.rsplit("/", 1)[1]: r for r in images.decoded(images.read_sources(spark, str(tmp_path))).collect()}
    assert (found["a.png"].width, found["a.png"].height) == (3, 2) and "image_invalid" in found["b.txt"].error


def test_exif_turn_hides_geometry():
    tiff = b"II*\0" + struct.pack("<IHHHIHH", 8, 1, 0x0112, 3, 1, 6, 0)
    app1 = b"Exif\0\0" + tiff
    sof = b"\xff\xc0" + struct.pack(">HBHHB", 11, 8, 20, 30, 1) + b"\1\1\0"
    jpeg = lambda extra: b"\xff\xd8" + extra + sof
    assert images.probe(jpeg(b"")) == (30, 20)
    assert images.probe(jpeg(b"\xff\xe1" + struct.pack(">H", len(app1) + 2) + app1)) is None


def test_resize_keeps_flat_images_and_crops_straighten():
    flat = np.full((5, 4, 3), 90, np.uint8)
    assert (pixels.resize(flat, 9, 3) == 90).all()
    image = np.random.default_rng(0).integers(0, 256, (12, 16, 3)).astype(np.uint8)
    assert np.array_equal(pixels.crop(image, [(2, 3), (10, 3), (10, 8), (2, 8)]), image[3:8, 2:10])
    assert pixels.recognition_tensor(image, 100)[:, :, 64:].max() == 0


def test_config():
    text = "Global:\n  model_name: det\nPostProcess:\n  name: DBPostProcess\n  thresh: 0.2 # low\n  max_candidates: 99999\n"
    d = config.detection(config.parse_yaml(text), "det")
    assert d == config.Detection(0.2, 0.6, 10_000, 1.5)
    with pytest.raises(ValueError):
        config.detection(config.parse_yaml(text), "rec")
    assert config.dictionary(["a", "", "<td>"], total=4) == ["sos", "a", "<td></td>", "eos"]


# Facade


def test_engine(spark):
    engine = Engine(spark, EchoProvider())
    assert engine.diagnostic().first().ready
    slots = [(1, 0, b"\x89PNG\r\n\x1a\nA"), (1, 1, b"text"), (1, 2, b"BM-broken"), (1, 3, None)]
    out = engine.extract_batch(spark.createDataFrame(slots, "batch_id bigint, slot_pos bigint, content binary"), ["formula", "text", "preprocessing"])
    got = {}
    for r in out.collect():
        got.setdefault(r.slot_pos, []).append((r.stage, r.status))
        assert r.slot_status == ("partial" if r.slot_pos == 0 else "failed")
    assert [s for s, _ in got[0]] == ["preprocessing", "text", "formula"]
    assert got[2] == [("preprocessing", "failed"), ("text", "skipped"), ("formula", "unsupported")]
    with pytest.raises(ValueError):
        engine.extract_batch(out, ["text", "text"])
    assert Descriptor("p", "e").with_stages(["seal", "text", "text"]).stages == ("text", "seal")


def test_components_need_four_crossings(spark):
    """A 2 x 2 grid is admitted with its extents; a chain of two lines each way with three crossings is not."""
    from docweave.operators import tables

    grid, chain = [(1, 1, 3, 10, 5), (1, 1, 4, 30, 5), (1, 2, 3, 10, 25), (1, 2, 4, 30, 25)], [(2, 1, 3, 10, 5), (2, 1, 4, 30, 5), (2, 2, 4, 30, 25)]
    x = spark.createDataFrame(grid + chain, "page bigint, h bigint, v bigint, x bigint, y bigint")
    assert [tuple(r) for r in tables.admitted_components(x).collect()] == [(1, 1, 2, 2, 4, 10, 5, 30, 25)]


def test_regions_by_flooding():
    """Runs give the regions that a flood from each pixel gives, in the same order."""
    rng = np.random.default_rng(4)
    for share in (0.1, 0.4, 0.6, 1.0):
        mask = rng.random((23, 31)) < share
        left = {(int(x), int(y)) for y, x in np.argwhere(mask)}
        want = []
        for y, x in np.argwhere(mask):
            if (int(x), int(y)) not in left:
                continue
            region, todo = set(), [(int(x), int(y))]
            while todo:
                p = todo.pop()
                if p in left:
                    left.remove(p)
                    region.add(p)
                    todo += [(p[0] + a, p[1] + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
            want.append(region)
        assert [set(map(tuple, r.tolist())) for r in detect.components(mask)] == want


def test_nearest_ranks(spark):
    from docweave.plans.aggregates import nearest_ranks

    rng = np.random.default_rng(6)
    rows = [(k, int(v)) for k in ("a", "b") for v in rng.integers(-500, 10**6, 501 if k == "a" else 7)] + [("c", 5)]
    got = {r.k: (r.p50, r.p95, r.n) for r in nearest_ranks(spark.createDataFrame(rows, "k string, v bigint"), "k", "v", {"p50": 0.5, "p95": 0.95}, bucket=1000).collect()}
    for k in "abc":
        v = sorted(x for n, x in rows if n == k)
        assert got[k] == (v[-(-len(v) // 2) - 1], v[-(-len(v) * 95 // 100) - 1], len(v))


def test_batches_that_break_a_rule(spark):
    engine = Engine(spark, EchoProvider())
    good = b"\xff\xd8\xff1"
    rows = [(1, k, f"s{k}", None, good) for k in range(257)] + [(2, 0, "a", None, good), (2, 1, "a", None, good)] + [(3, 0, "a", None, good), (3, 1, "b", "b", good)] + [(4, 0, "a", None, good), (4, 1, "b", "a", good)] + [(5, 0, "a", "z", good)]
    slots = spark.createDataFrame(rows, "batch_id bigint, slot_pos bigint, slot_id string, predecessor string, content binary")
    assert {r.batch_id: r.violation for r in engine.violations(slots).collect()} == {1: "slots", 2: "slot_ids", 3: "predecessor", 4: None, 5: "predecessor"}
    out = engine.extract_batch(slots, ["text"]).groupBy("batch_id", "error_code").count().collect()
    assert {(r.batch_id, r.error_code, r["count"]) for r in out} == {(1, "batch_invalid", 257), (2, "batch_invalid", 2), (3, "batch_invalid", 2), (4, None, 2), (5, "batch_invalid", 1)}


def test_slots_fail_alone_and_lines_keep_their_order(spark, tmp_path):
    class Faulty(EchoProvider):
        def recognize(self, content):
            if content.endswith(b"boom"):
                raise KeyError("no such weight")
            return [(f"line {k}", 1.0) for k in range(12)]

    engine = Engine(spark, Faulty())
    for k in range(300):
        (tmp_path / f"{k:03}.jpg").write_bytes(b"\xff\xd8\xff" + (b"boom" if k == 299 else b"%03d" % k))
    out = {(r.batch_id, r.slot_pos): (r.error_code, r.text) for r in engine.extract(str(tmp_path)).collect()}
    assert sorted(out) == [(k // 256, k % 256) for k in range(300)]
    assert out.pop((1, 43))[0] == "runtime_failed"
    assert set(out.values()) == {(None, "\n".join(f"line {k}" for k in range(12)))}


def test_the_96th_repeat_ends_a_stream(spark):
    rows = [(1, k, "a") for k in range(200)] + [(2, k, "a") for k in range(95)] + [(2, 95, "b"), (2, 96, "eos"), (2, 97, "a")] + [(3, 0, "sos"), (3, 1, "a")]
    out = tables.stopped(spark.createDataFrame(rows, "s int, at int, token string"), ["s"], "at", "token").groupBy("s").count().collect()
    assert {r.s: r["count"] for r in out} == {1: 95, 2: 96, 3: 1}
