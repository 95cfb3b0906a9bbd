"""Language identification by a byte convolutional network written in numpy.

A text's UTF-8 bytes are cut into windows of ``WINDOW`` bytes, the last one filled
up with zeros; nothing is left out. Each byte has an embedding; filters of
several widths slide over a window, each keeps its maximum, and a softmax layer
turns these into language probabilities. A text's probability is the mean over
its windows, weighted by the bytes they hold. Training (Adam on cross-entropy,
gradients by hand) runs on the driver over windows of a bounded, balanced sample
of labelled rows, drawn by a hash of the id over the whole table.

Defined results: a text that is null or has no letter is ``und`` with score 0;
an empty training set gives ``und`` for all; rows that repeat an id are judged
each; equal probabilities go to the language that sorts first; an empty table
gives no row; very long texts are read whole; other columns, whatever their
names, are ignored. Ids are whole numbers; others raise Spark's cast error.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docweave.llm.common import held_out, rows_out, slices

WINDOW = 192
EMBEDDING = 8
WIDTHS = (2, 3, 4)
FILTERS = 12
#: Bounds of the training sample: labelled documents a language, documents altogether (each language has its share, one at least), windows of a document.
DOCS_PER_LANG = 600
SAMPLE_DOCS = 60_000
WINDOWS_PER_DOC = 4
EPOCHS = 6
RATE = 0.004
BATCH = 64
#: Windows go through the network in batches of so many.
INFER_BATCH = 512
UNDETERMINED = "und"
#: Letters and numerals that aren't digits, such as fractions: what of it is a letter, str.isalpha says.
ALPHANUMERIC = re.compile(r"[^\W\d_]")
Params = dict[str, np.ndarray]


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in ALPHANUMERIC.finditer(text))


def windows_of(text: bytes) -> np.ndarray:
    count = -(-len(text) // WINDOW)
    return np.frombuffer(text.ljust(count * WINDOW, b"\0"), np.uint8).reshape(count, WINDOW)


def initial(n_langs: int, rng: np.random.Generator) -> Params:
    p = {"emb": rng.normal(0, 0.5, (256, EMBEDDING)), "out": rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, n_langs)), "bias": np.zeros(n_langs)}
    for w in WIDTHS:
        p[f"conv{w}"] = rng.normal(0, (w * EMBEDDING) ** -0.5, (w * EMBEDDING, FILTERS))
        p[f"shift{w}"] = np.zeros(FILTERS)
    return {k: v.astype(np.float32) for k, v in p.items()}


def unfolded(x: np.ndarray, width: int) -> np.ndarray:
    """(windows, places, width * embedding): the inputs of a filter at each place."""
    n, length, dim = x.shape
    flat = x.reshape(n, length * dim)
    return np.lib.stride_tricks.as_strided(flat, (n, length - width + 1, width * dim), (flat.strides[0], dim * flat.itemsize, flat.itemsize))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def gradients(p: Params, windows: np.ndarray, y: np.ndarray) -> Params:
    """Of the mean cross-entropy. Max pooling sends each filter's error to the place of its maximum alone."""
    x = p["emb"][windows]
    n = len(windows)
    best, pooled = {}, []
    for w in WIDTHS:
        response = unfolded(x, w) @ p[f"conv{w}"]
        best[w] = response.argmax(axis=1)
        pooled.append(np.take_along_axis(response, best[w][:, None, :], axis=1)[:, 0, :] + p[f"shift{w}"])
    z = np.concatenate(pooled, axis=1)
    h = np.maximum(z, 0)
    error = softmax(h @ p["out"] + p["bias"])
    error[np.arange(n), y] -= 1
    error /= n
    g = {"out": h.T @ error, "bias": error.sum(axis=0)}
    back = (error @ p["out"].T) * (z > 0)
    dx = np.zeros_like(x)
    rows = np.arange(n)[:, None]
    for k, w in enumerate(WIDTHS):
        own = back[:, k * FILTERS : (k + 1) * FILTERS]
        seen = unfolded(x, w)[rows, best[w]]  # windows, filters, width * embedding
        g[f"conv{w}"] = np.einsum("nf,nfd->df", own, seen)
        g[f"shift{w}"] = own.sum(axis=0)
        kernel = p[f"conv{w}"].reshape(w, EMBEDDING, FILTERS)
        for j in range(w):
            np.add.at(dx, (rows, best[w] + j), own[:, :, None] * kernel[j].T[None])
    g["emb"] = np.zeros_like(p["emb"])
    np.add.at(g["emb"], windows.ravel(), dx.reshape(-1, EMBEDDING))
    return g


def train(windows: np.ndarray, y: np.ndarray, n_langs: int, epochs: int = EPOCHS, seed: int = 1) -> Params:
    rng = np.random.default_rng(seed)
    p = initial(n_langs, rng)
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(windows))
        rate = RATE * (0.5 ** max(0, epoch - epochs // 2))
        for at in range(0, len(order), BATCH):
            own = order[at : at + BATCH]
            step += 1
            for k, g in gradients(p, windows[own], y[own]).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = (p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return p


class Network:
    """Inference. Filter responses are sums of looked-up rows: of byte pairs where the width allows, else of single bytes."""

    def __init__(self, p: Params) -> None:
        self.p = p
        self.plans = []
        for w in WIDTHS:
            kernel = p[f"conv{w}"].reshape(w, EMBEDDING, FILTERS)
            byte = [np.ascontiguousarray(p["emb"] @ kernel[j]) for j in range(w)]
            plan = []
            for j in range(0, w - 1, 2):  # first byte of the pair is the high half of its index
                plan.append((j, 2, np.ascontiguousarray((byte[j][:, None, :] + byte[j + 1][None, :, :]).reshape(65536, FILTERS))))
            if w % 2:
                plan.append((w - 1, 1, byte[w - 1]))
            self.plans.append((w, plan))

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        out = []
        for at in range(0, len(windows), INFER_BATCH):
            part = windows[at : at + INFER_BATCH].astype(np.intp)
            pairs = part[:, :-1] * 256 + part[:, 1:]
            pooled = []
            for w, plan in self.plans:
                places = WINDOW - w + 1
                response = None
                for j, size, rows in plan:
                    looked = rows[(pairs if size == 2 else part)[:, j : j + places]]
                    response = looked if response is None else np.add(response, looked, out=response)
                pooled.append(response.max(axis=1) + self.p[f"shift{w}"])
            h = np.maximum(np.concatenate(pooled, axis=1), 0)
            out.append(softmax(h @ self.p["out"] + self.p["bias"]))
        return np.concatenate(out) if out else np.zeros((0, len(self.p["bias"])), np.float32)


def training_rows(docs: DataFrame, per_lang: int = DOCS_PER_LANG, sample_docs: int = SAMPLE_DOCS) -> list[tuple[bytes, str]]:
    """(text, lang) of a bounded, balanced sample. Language counts cover the table; rows are drawn by a hash of the id."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where("lang is not null and text is not null and doc_id is not null").where(~held_out())
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    if not counts:
        return []
    per_lang = max(1, min(per_lang, sample_docs // len(counts)))
    # Twice the share, so that a language rarely falls short of its bound by chance; the bound itself is applied below.
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, 2 * per_lang / r["count"]))])
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit("language")), F.lit(1 << 30)) / float(1 << 30)
    few = rows.withColumn("draw", draw).where(F.col("draw") < F.coalesce(share[F.col("lang")], F.lit(0.0)))
    # Whole texts stay on the executors: a document sends windows that lie evenly over it.
    raw = F.col("text").cast("binary")
    n = F.greatest(F.octet_length("text") - WINDOW, F.lit(0))
    pieces = F.transform(F.sequence(F.lit(0), F.lit(WINDOWS_PER_DOC - 1)), lambda k: F.substring(raw, (F.floor(n * k / max(1, WINDOWS_PER_DOC - 1)) + 1).cast("int"), F.lit(WINDOW)))
    few = few.select("lang", "draw", "doc_id", F.array_distinct(pieces).alias("pieces"))
    few = few.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "doc_id"))).where(F.col("k") <= per_lang)
    chosen = sorted(few.collect(), key=lambda r: (r["draw"], r["lang"], r["k"]))
    return [(bytes(x), r["lang"]) for r in chosen for x in r["pieces"] if has_letter(bytes(x).decode(errors="ignore"))]


def fit(rows: list[tuple[bytes, str]]) -> tuple[list[str], Params] | None:
    langs = sorted({lang for _, lang in rows})
    if not langs:
        return None
    windows = np.concatenate([windows_of(t)[:1] for t, _ in rows])
    y = np.array([langs.index(lang) for _, lang in rows])
    return langs, train(windows, y, len(langs))


OUT = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("n_windows", pa.int64())])


def identify(docs: DataFrame, model: tuple[list[str], Params] | None) -> DataFrame:
    """doc_id, lang_pred, score (its probability) and n_windows for each row. One narrow pass over whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        network = Network(model[1]) if model else None
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            sure = [bool(t) and has_letter(t) and network is not None for t in texts]
            data = [t.encode() if ok else b"" for t, ok in zip(texts, sure, strict=True)]
            pred, score, count = [], [], []
            lo = 0
            while lo < len(data):  # texts go through the network in runs of about a megabyte
                hi, size = lo, 0
                while hi < len(data) and (hi == lo or size < 1 << 20):
                    size += len(data[hi])
                    hi += 1
                per = np.array([-(-len(t) // WINDOW) for t in data[lo:hi]])
                probs = network.probabilities(np.concatenate([windows_of(t) for t in data[lo:hi]])) if per.sum() else np.zeros((0, 1))
                filled = np.full(int(per.sum()), float(WINDOW))
                ends = np.cumsum(per)
                for k, t in enumerate(data[lo:hi]):
                    if per[k]:
                        filled[ends[k] - 1] = len(t) - WINDOW * (per[k] - 1)
                for k, n in enumerate(per):
                    if not n:
                        pred.append(UNDETERMINED)
                        score.append(0.0)
                    else:
                        own = slice(ends[k] - n, ends[k])
                        mean = filled[own] @ probs[own] / filled[own].sum()
                        best = int(mean.argmax())
                        pred.append(model[0][best])
                        score.append(round(float(min(1.0, mean[best])), 6))
                    count.append(int(n))
                lo = hi
            yield rows_out({"doc_id": batch.column("doc_id"), "lang_pred": pred, "score": score, "n_windows": count}, OUT)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, lang_pred string, score double, n_windows bigint")


def language_report(docs: DataFrame) -> DataFrame:
    """The contract's columns: doc_id, held_out, lang_pred and score; n_windows beside them."""
    return identify(docs, fit(training_rows(docs))).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "n_windows")
