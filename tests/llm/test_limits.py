"""Cases at the operators' limits: malformed files, long windows, large benchmarks, numerals, clashing names."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pytest

import corpus_pipeline
from docweave.llm import decontaminate, langid, matroska, pieces, simhash, toxicity
from docweave.llm import matroska as m
from docweave.llm.common import rows_out


def mka(*clusters: bytes, tracks: bytes = b"", info: bytes = b"") -> bytes:
    return m.element(m.EBML, b"") + m.element(m.SEGMENT, m.element(m.INFO, info) + m.element(m.TRACKS, tracks) + b"".join(m.element(m.CLUSTER, c) for c in clusters))


def bare(eid: int, at: int = 0, frames: tuple[bytes, ...] = (b"ab", b"cd")) -> bytes:
    return m.element(eid, m.vint(1) + struct.pack(">hB", at, m.FIXED) + bytes([len(frames) - 1]) + b"".join(frames))


def test_group_and_cluster_children_in_any_order():
    frames = lambda group: m.element(m.BLOCK_GROUP, group)
    lasting = m.uint(m.BLOCK_DURATION, 10)
    data = mka(frames(lasting + bare(m.BLOCK)) + frames(bare(m.BLOCK, 50) + m.element(m.REFERENCE_BLOCK, b"\x01")) + frames(m.element(m.REFERENCE_BLOCK, b"\x01") + lasting + bare(m.BLOCK, 90)) + m.uint(m.TIMESTAMP, 1000))
    got = [(p.timestamp_ns // 1_000_000, p.keyframe) for p in m.parse(data).packets]
    assert got == [(1000, True), (1005, True), (1050, False), (1050, False), (1090, False), (1095, False)]


MALFORMED = {
    "scale": mka(m.uint(m.TIMESTAMP, 5) + bare(m.SIMPLE_BLOCK), info=m.uint(m.TIMESTAMP_SCALE, (1 << 64) - 1)),
    "time": mka(m.uint(m.TIMESTAMP, (1 << 63) + 7) + bare(m.SIMPLE_BLOCK)),
    "long number": mka(m.element(m.TIMESTAMP, b"\x01" * 9) + bare(m.SIMPLE_BLOCK)),
    "rate": mka(bare(m.SIMPLE_BLOCK), tracks=m.element(m.TRACK_ENTRY, m.uint(m.TRACK_NUMBER, 1) + m.element(m.CODEC_ID, b"A_PCM/INT/LIT") + m.element(m.AUDIO, m.element(m.SAMPLING, struct.pack(">d", 5e-324)) + m.uint(m.BIT_DEPTH, 8)))),
    "cut": matroska.mux(matroska.padded(b"abc"))[:-3],
    "noise": bytes(range(256)),
}


@pytest.mark.parametrize("name", list(MALFORMED))
def test_malformed_files_are_one_error_row(spark, name):
    good = matroska.mux(matroska.padded(b"fine"))
    df = spark.createDataFrame([(1, good), (2, MALFORMED[name]), (3, None), (4, good)], "k bigint, f binary")
    rows = matroska.packet_table(df, "k", "f").collect()
    assert sorted((r.key, r.error is None) for r in rows) == [(1, True), (2, False), (4, True)]
    with pytest.raises(ValueError):
        matroska.parse(MALFORMED[name])


def test_flipped_bytes_never_stop_a_job():
    rng, good = np.random.default_rng(2), matroska.mux(matroska.padded(b"some text " * 300))
    for _ in range(400):
        data = bytearray(good)
        for at in rng.integers(0, 200 if rng.random() < 0.5 else len(data), 3):
            data[at] = rng.integers(256)
        try:
            packets = matroska.parse(bytes(data)).packets
        except ValueError:
            continue
        names = [f.name for f in matroska.PACKETS][1:-1]
        rows_out({"key": [1] * len(packets), "error": [None] * len(packets), **{n: [getattr(p, n) for p in packets] for n in names}}, matroska.PACKETS)


@pytest.mark.parametrize("window", [1, 2, 300, 1000])
def test_windows_of_any_length(spark, window):
    words = [f"w{k}" for k in range(1500)]
    docs = spark.createDataFrame([(1, " ".join(["x"] * 700 + words[100 : 100 + window] + ["y"] * 400)), (2, " ".join(words[100 : 99 + window]))], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, " ".join(words))], "item_id bigint, text string")
    got = {r.doc_id: [list(s) for s in r.spans] for r in decontaminate.find_contamination(docs, items, window).collect()}
    assert got == {1: [[700, 700 + window]], 2: []}


def test_a_million_windows_leave_few_candidates(spark):
    items = spark.range(500).selectExpr("id AS item_id", "array_join(transform(sequence(1, 2012), k -> concat('i', id, 'x', k)), ' ') AS text")
    patterns = decontaminate.pattern_rows(items).cache()
    assert patterns.count() == 1_000_000
    shifts, bitmap = decontaminate.searcher_tables(decontaminate.jump_rows(items), patterns)
    patterns.unpersist()
    searcher = decontaminate.Searcher(shifts, bitmap)
    assert len(list(searcher.candidates([b"d%d" % k for k in range(25_000)]))) < 500  # of 24,988 places
    own = [b"i77x%d" % k for k in range(100, 140)]
    assert [c[0] for c in searcher.candidates([b"a"] * 20 + own)] == list(range(20, 20 + 40 - 12))


def test_numerals_are_no_letters(spark):
    assert not any(map(langid.has_letter, ["\u00b2 \u00bd 3", "\u2167", "_ 1 .", ""]))
    assert all(map(langid.has_letter, ["\u00b2a", "1 \u00e9", "\u65e5", "\u00aa"]))


def test_last_at_most_is_exact():
    rng = np.random.default_rng(9)
    sizes = rng.integers(1, 70, 5000)
    share = np.concatenate([np.sort(np.concatenate(([0.0], rng.random(n - 1)))) for n in sizes])
    hi = np.cumsum(sizes)
    lo = hi - sizes
    u = np.where(rng.random(5000) < 0.3, np.nextafter(1, 0), rng.random(5000))
    u[::9] = share[hi[::9] - 1]
    want = [a + np.searchsorted(share[a:b], x, side="right") - 1 for a, b, x in zip(lo, hi, u, strict=True)]
    for near in (lo, hi - 1, rng.integers(-5, len(share) + 5, 5000)):
        assert (pieces.last_at_most(share, lo, hi, u, near) == want).all()


def test_last_at_most_needs_no_hint():
    rng = np.random.default_rng(4)
    sizes = rng.integers(1, 40, 300)
    hi = np.cumsum(sizes)
    lo = hi - sizes
    share = np.concatenate([np.concatenate([[0.0], np.sort(rng.integers(0, 9, n - 1) / 9)]) for n in sizes])
    u = rng.integers(0, 9, 300) / 9
    want = [b - 1 - int(np.argmax(share[a:b][::-1] <= x)) for a, b, x in zip(lo, hi, u)]
    assert pieces.last_at_most(share, lo, hi, u).tolist() == want


def test_positions_among_the_vocabulary_are_those_of_a_search():
    codec = pieces.Codec(pieces.vocabulary(pieces.DEFAULT_MODEL))
    h = np.concatenate([codec.hashes, codec.hashes + np.uint64(1), np.random.default_rng(5).integers(0, 1 << 64, 10_000, dtype=np.uint64), np.array([0, (1 << 64) - 1], np.uint64)])
    want = np.minimum(np.searchsorted(codec.hashes, h), len(codec.hashes) - 1)
    assert (codec.position(h) == want).all()


def test_columns_named_like_helpers(spark):
    text = "one two three four five six seven eight nine ten " * 8
    names = ["__text", "__TEXT_", "__kept", "__mark", "__id", "mark", "fp", "component_id", "own", "spans"]
    rows = [(k, text if k < 3 else f"{text} other {k} " + "abc " * k, *[f"{n}{k}" for n in names]) for k in (2, 1, 3, 4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, " + ", ".join(f"`{n}` string" for n in names))
    kept = simhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert {(r.doc_id, r["__text"], r["spans"]) for r in kept.collect()} >= {(1, "__text1", "spans1")}
    sf = "/root/testdata/sf0.001"
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and {r["__text"] for r in out.collect()} <= {f"__text{k}" for k in range(1, 5)}


def test_the_toxicity_sample_keeps_to_its_bounds(spark, monkeypatch):
    """Rows that repeat an id count, equal ones travel once; what is beyond the bytes stays where it is."""
    rows = [(k, f"text {k} é" * (1 + k % 5), "x") for k in range(200)] + [(7, "again", "x")] * 3 + [(8, None, "x"), (None, "lost", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, h string")
    labels = spark.createDataFrame([(k, int(k % 9 == 0)) for k in range(200)] + [(7, 1), (None, 1)], "doc_id bigint, toxic int")
    whole = toxicity.training_rows(docs, labels)
    held = {k for k in range(200) if zlib.crc32(str(k).encode()) % 4 == 2}
    label = {k: int(k % 9 == 0 or k == 7) for k in range(200)}
    assert sorted(whole) == sorted((t, label[k]) for k, t, _ in rows if k is not None and t is not None and k not in held)
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 500)
    some = toxicity.training_rows(docs, labels)
    assert some == whole[: len(some)]
    sizes = [len(t.encode()) for t, _ in some]
    assert sum(sizes) >= 500 > sum(sizes[:-1])
    monkeypatch.undo()
    assert len(toxicity.training_rows(docs, labels, per_class=5)) <= 10
    assert toxicity.training_rows(docs, labels.limit(0)) == []
