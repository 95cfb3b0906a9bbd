"""Suffix-array deduplication: passages of ``WINDOW`` bytes or more that also stand earlier are cut.

The method's plain form orders all suffixes by their first ``WINDOW`` bytes, most
significant digit first. Dealing every suffix out by its leading bytes would
shuffle a row for each byte of the corpus, so here only suffixes that can still
be equal are sorted: those whose first ``WINDOW`` bytes have the same anchor
(windows.py). Where the runs around an anchor have one hash, that 64-bit hash
decides; all others go through the radix passes, 8 bytes a pass to the depth of
``WINDOW`` bytes, where a group of one is dropped and the groups left are exactly
the repeated windows.

Defined results: null text is empty; a text shorter than the window keeps all;
rows that share a doc_id are one document, whose marks apply to each of them;
rows with a null doc_id are compared with nothing and keep all; an empty table
gives no row; very long texts are read whole, in stretches that overlap by a
window less a byte; other columns, whatever their names, are ignored. Ids are
whole numbers; others raise Spark's cast error.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import documents, each_batch, rows_out
from docweave.llm.pieces import mix
from docweave.llm.windows import Spec, find_repeats, merged, with_ranges

WINDOW = 100
GRAM = 32
BYTE_VALUES = mix(np.arange(256, dtype=np.uint64))


def _tokens(text: bytes) -> np.ndarray:
    return BYTE_VALUES[np.frombuffer(text, np.uint8)]


def _cut(text: bytes):
    return lambda lo, hi: text[lo:hi] if hi <= len(text) else None


def _digits(window: int):
    def digits(contexts: list[bytes]):
        lens = np.array([len(c) for c in contexts], np.int64)
        data = b"".join(contexts) + b"\0" * 8
        words = np.ndarray(shape=(len(data) - 7,), dtype=">u8", buffer=data, strides=(1,))
        # The last digit may overlap the one before: equality is the same.
        step = [min(8 * k, max(0, window - 8)) for k in range(-(-window // 8))]
        mask = np.uint64(0xFFFFFFFFFFFFFFFF if window >= 8 else (0xFFFFFFFFFFFFFFFF << (64 - 8 * window)) & 0xFFFFFFFFFFFFFFFF)
        return (lambda place, k: words[place + step[k]].astype(np.uint64) & mask), np.cumsum(lens) - lens, len(step)

    return digits


def byte_spec(window: int = WINDOW, gram: int = GRAM) -> Spec:
    return Spec(window, gram, _tokens, _cut, within=True, digits=_digits(window))


KEPT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])


def cut_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the bytes left) for each row of docs."""
    rows = documents(docs)
    known = rows.where("doc_id is not null")
    found = with_ranges(known, find_repeats(known, byte_spec(window, gram)))
    alone = rows.where("doc_id is null").withColumn("spans", F.lit(None).cast("array<struct<lo:bigint,hi:bigint>>"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: dict[str, list] = {f.name: [] for f in KEPT}
        out["doc_id"] = batch.column("doc_id")
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            text = text or b""
            cut = merged(spans or [], len(text))
            ends = [0, *(b for _, b in cut)]
            out["kept"].append(b"".join(text[a:b] for a, b in zip(ends, [*(a for a, _ in cut), len(text)], strict=True)))
            out["n_bytes"].append(len(text))
            out["n_removed"].append(sum(b - a for a, b in cut))
            out["n_spans"].append(len(cut))
        return rows_out(out, KEPT)

    return found.unionByName(alone).mapInArrow(each_batch(run), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")


def cut_report(docs: DataFrame) -> DataFrame:
    """The contract's columns: doc_id, n_bytes, n_removed, n_spans and kept_sha256."""
    return cut_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
