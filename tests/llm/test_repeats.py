"""Suffix and substring deduplication against brute force, with ordinary and forced-hot settings."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest

from docweave.llm import substrings, suffixes, windows
from docweave.llm.common import table


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def texts_of(df):
    return sorted((r.doc_id, (r.text or "").encode()) for r in df.select("doc_id", "text").collect() if r.doc_id is not None)


def brute_bytes(texts, size=100):
    first: dict[bytes, tuple[int, int]] = {}
    for i, t in texts:
        for p in range(len(t) - size + 1):
            first[t[p : p + size]] = min(first.get(t[p : p + size], (i, p)), (i, p))
    out = {}
    for i, t in texts:
        cut = np.zeros(len(t) + 1, bool)
        for p in range(len(t) - size + 1):
            if first[t[p : p + size]] < (i, p):
                cut[p : p + size] = True
        n_spans = int(np.count_nonzero(cut[:-1] & ~np.concatenate([[False], cut[:-2]]))) if len(t) else 0
        out[i] = (len(t), int(cut.sum()), n_spans, sha(bytes(c for c, x in zip(t, cut) if not x)))
    return out


def brute_words(texts, size=13):
    first: dict[tuple, int] = {}
    split = [(i, t.split()) for i, t in texts]
    for i, w in split:
        for p in range(len(w) - size + 1):
            key = tuple(w[p : p + size])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, w in split:
        cut = [False] * len(w)
        for p in range(len(w) - size + 1):
            if first[tuple(w[p : p + size])] < i:
                cut[p : p + size] = [True] * size
        out[i] = (len(w), sum(cut), sha(b" ".join(a for a, x in zip(w, cut) if not x)))
    return out


@pytest.mark.parametrize("hot", [False, True])
@pytest.mark.parametrize("operator, brute", [(suffixes.cut_report, brute_bytes), (substrings.cut_report, brute_words)])
def test_against_brute_force(spark, sf, monkeypatch, operator, brute, hot):
    if hot:
        monkeypatch.setattr(windows, "HOT_LOCAL", 1)
        monkeypatch.setattr(windows, "HOT", 2)
        monkeypatch.setattr(windows, "LOCAL_WINDOWS", 100)
    docs = table(spark, sf, "documents")
    got = {r.doc_id: tuple(r)[1:] for r in operator(docs).collect()}
    assert got == brute(texts_of(docs))


@pytest.mark.parametrize("operator, brute", [(suffixes.cut_report, brute_bytes), (substrings.cut_report, brute_words)])
def test_odd_rows(odd, operator, brute):
    rows = operator(odd).collect()
    assert len(rows) == odd.count()
    want = brute(texts_of(odd))
    for r in rows:
        if r.doc_id is not None:
            assert tuple(r)[1:] == want[r.doc_id]
        else:
            assert r.n_removed == 0


@pytest.mark.parametrize("operator", [suffixes.cut_report, substrings.cut_report])
def test_empty_table(empty, operator):
    assert operator(empty).collect() == []


def test_long_document_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(windows, "BLOCK_TOKENS", 256)
    rng = np.random.default_rng(3)
    base = rng.integers(97, 123, 3000).astype(np.uint8).tobytes().decode()
    docs = spark.createDataFrame([(1, base), (2, base[400:2100] + "#" + base[100:700])], "doc_id bigint, text string")
    got = {r.doc_id: tuple(r)[1:] for r in suffixes.cut_report(docs).collect()}
    assert got == brute_bytes(texts_of(docs))


def test_radix_groups_are_the_equal_windows():
    data = np.frombuffer(b"abcabcabd" + b"\0" * 8, np.uint8)
    place = np.arange(7)
    alive, group = windows.radix_groups(lambda p, k: data[p + k], place, np.zeros(7, np.int64), 3)
    groups = {}
    for p, g in zip(alive.tolist(), group.tolist()):
        groups.setdefault(g, set()).add(p)
    assert sorted(map(sorted, groups.values())) == [[0, 3], [1, 4], [2, 5]]


@pytest.mark.parametrize("fanout", [1, 2, 9])
def test_index_in_batches_equals_one_batch(spark, sf, fanout):
    docs = table(spark, sf, "documents")
    pick = lambda df: sorted((r.doc_id, r.n_removed) for r in df.collect())
    assert pick(substrings.cut_repeats(docs, batches=4, fanout=fanout)) == pick(substrings.cut_repeats(docs, batches=1))


def test_a_second_session_goes_on_with_the_index(spark, sf, tmp_path):
    """Batches by objects that only share the folder, across a compaction, equal one whole run; an interrupted batch leaves no trace."""
    docs = table(spark, sf, "documents").selectExpr("cast(doc_id as bigint) as doc_id", "cast(text as binary) as text")
    spec, folder = substrings.word_spec(), str(tmp_path / "index")
    edges = [-1, 60, 90, 130, 10**9]
    ranges = []
    for k, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
        index = substrings.FingerprintIndex.open(spark, spec, folder) if k else substrings.FingerprintIndex(spark, spec, folder)
        ranges += index.append(docs.where(f"doc_id > {lo} and doc_id <= {hi}"), docs).collect()
        if k == 1:  # a run that no manifest names
            index._run(index.runs[0][0])
    covered: dict[int, set[int]] = {}
    for r in ranges:
        covered.setdefault(r.doc, set()).update(range(r.lo, r.hi))
    want = brute_words(texts_of(table(spark, sf, "documents")))
    assert {i: len(covered.get(i, ())) for i in want} == {i: n for i, (_, n, _) in want.items()}
    with pytest.raises(ValueError):
        substrings.FingerprintIndex.open(spark, spec, folder).ingest(docs.where("doc_id = 5"))
    with pytest.raises(ValueError):
        substrings.FingerprintIndex(spark, spec, folder)


@pytest.mark.parametrize("window, gram", [(400, 32), (100, 8)])
def test_long_windows(spark, window, gram):
    """Runs of more than 255 windows."""
    base = "".join(chr(97 + (k * k * 7 + k) % 26) for k in range(1500))
    docs = spark.createDataFrame([(1, base), (2, "#" + base[100:1300] + "#")], "doc_id bigint, text string")
    got = {r.doc_id: r.n_removed for r in suffixes.cut_repeats(docs, window=window, gram=gram).collect()}
    assert got == {i: n for i, (_, n, _, _) in brute_bytes(texts_of(docs), window).items()}


def test_a_run_that_does_not_fit_is_refused():
    with pytest.raises(ValueError):
        suffixes.byte_spec(window=70_000, gram=32)
