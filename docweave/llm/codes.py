"""Vector code compression: product quantization in whole numbers, its nearest entries found behind segment-mean lower bounds.

Components become integers (floor of 1024 times the value) and vectors are cut
into ``PARTS`` equal parts, each with a codebook of its own. The nearest entry of
a part is found from coarse to fine: a block's squared sums and the norms of what
its mean leaves bound the distance from below (two vectors' block means differ by
at least as much as the vectors, and so do the lengths of their residuals). One
block spans the whole part first, then come blocks of four and of two components; entries whose
bound exceeds the distance of the best guess so far are dropped, and only survivors get exact integer
distances. Bounds are lowered by more than their rounding can reach, so no nearest entry is lost.

A codebook has at most ``ENTRIES`` entries and is all that leaves the tasks: a
round sends each entry's count and sums, added up by Spark.

Defined results: rows whose vector is null, empty or holds null or non-finite
components are dropped, as are those with an integer beyond plus or minus
``REACH`` (their squared distances exceed a long). Vectors whose length isn't that
of the kept row with the least id, or isn't a multiple of ``PARTS``, are dropped.
Ties go to the lower entry. Rows that repeat an id are each coded; the first
entries are ordered by id (null last) and then by vector. Fewer rows than entries make
shorter codebooks; an entry that no part chose stays. An empty table gives no
rows. Null labels share one sum. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm.common import each_batch, rows_out, written

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Largest integer component, so that a distance over 512 components fits a long.
REACH = 1 << 26
#: Parts that are compared with a codebook at once, and survivors whose components are fetched at once.
TILE, GATHER = 512, 1 << 14
#: How far float bounds are lowered, relative to the squared lengths that they are made of: far above their rounding.
SLACK = 1e-12


def usable(vector: Column) -> Column:
    """Whether a vector can be coded: all components there, finite and within reach."""
    fine = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float(REACH // SCALE)))  # NaN is greater than all
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(fine, F.lit(False))


def integers(embeddings: DataFrame) -> DataFrame:
    """vec_id, label and v, the vector's integers, of the rows that can be coded."""
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE))
    return embeddings.where(usable(F.col("embedding"))).select(F.col("vec_id").cast("bigint").alias("vec_id"), "label", v.cast("array<bigint>").alias("v"))


class Blocks:
    """Vectors cut into blocks: the blocks' means, each times the root of its width, beside the norm of what the means leave.

    Squared distances of these short vectors are the lower bounds; each is as long as the vector that it stands for.
    """

    def __init__(self, rows: np.ndarray, count: int) -> None:
        edges = np.linspace(0, rows.shape[1], count + 1).astype(int)[:-1]
        widths = np.diff(np.append(edges, rows.shape[1]))
        x = rows.astype(np.float64)
        sums = np.add.reduceat(x, edges, axis=1)
        left = x - np.repeat(sums / widths, widths, axis=1)
        self.short = np.column_stack((sums / np.sqrt(widths), np.sqrt(np.einsum("ij,ij->i", left, left))))
        self.square = np.einsum("ij,ij->i", self.short, self.short)


def bounds(parts: Blocks, entries: Blocks) -> np.ndarray:
    """Lower bounds of all squared distances, each lowered beyond its rounding."""
    out = parts.short @ (-2 * entries.short.T)
    out += ((1 - SLACK) * parts.square - 1)[:, None]
    out += ((1 - SLACK) * entries.square)[None, :]
    return out


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of parts the index of book's nearest row and the squared distance, exact; ties go to the lower index."""
    index, distance = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
    levels = sorted({1, -(-parts.shape[1] // 4), -(-parts.shape[1] // 2)})
    known = [Blocks(book, n) for n in levels]
    for at in range(0, len(parts), TILE):
        tile = parts[at : at + TILE]
        guess, alive = np.full(len(tile), np.iinfo(np.int64).max), np.ones((len(tile), len(book)), bool)
        for n, entries in zip(levels, known, strict=True):
            least = bounds(Blocks(tile, n), entries)
            guess = np.minimum(guess, ((tile - book[least.argmin(axis=1)]) ** 2).sum(axis=1))
            alive &= least <= guess[:, None]
        i, j = np.nonzero(alive)
        exact = np.empty(len(i), np.int64)
        for k in range(0, len(i), GATHER):
            gap = tile[i[k : k + GATHER]] - book[j[k : k + GATHER]]
            exact[k : k + GATHER] = np.einsum("ij,ij->i", gap, gap)
        starts = np.searchsorted(i, np.arange(len(tile)))  # the best guess survives its own bounds, so no row is without one
        best = np.minimum.reduceat(exact, starts)
        first = np.flatnonzero(exact == best[i])
        order = first[np.searchsorted(i[first], np.arange(len(tile)))]
        index[at : at + TILE], distance[at : at + TILE] = j[order], best
    return index, distance


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _round(vectors: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one more assignment: each entry the floored mean of its parts."""
    width = books.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
        for batch in batches:
            rows = _matrix(batch.column("v"))
            for p in range(PARTS):
                own = rows[:, p * width : (p + 1) * width]
                index, _ = nearest(own, books[p])
                counts[p] += np.bincount(index, minlength=books.shape[1])
                np.add.at(sums[p], index, own)
        p, e = np.nonzero(counts)
        schema = pa.schema([("part", pa.int64()), ("entry", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])
        yield rows_out({"part": p, "entry": e, "n": counts[p, e], "sums": sums[p, e].tolist()}, schema)

    each = vectors.select("v").mapInArrow(run, "part bigint, entry bigint, n bigint, sums array<bigint>")
    total = lambda i: F.sum(F.get("sums", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}")
    after = books.copy()
    for r in each.groupBy("part", "entry").agg(F.sum("n").alias("n"), *map(total, range(width))).collect():  # at most PARTS * ENTRIES rows
        after[r["part"], r["entry"]] = [int(r[f"s{i}"]) // r["n"] for i in range(width)]
    return after


def fit(vectors: DataFrame, rounds: int = ROUNDS) -> np.ndarray | None:
    """Codebooks (part, entry, component) of integers()' rows; None without rows. At most 256 entries a part come to the driver."""
    first = vectors.orderBy(F.asc_nulls_last("vec_id"), "v").limit(1).select(F.size("v").alias("n")).first()
    if first is None or first["n"] % PARTS:
        return None
    same = vectors.where(F.size("v") == first["n"])
    rows = same.orderBy(F.asc_nulls_last("vec_id"), "v").limit(ENTRIES).select("v").collect()
    books = np.array([r["v"] for r in rows], np.int64).reshape(len(rows), PARTS, -1).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        books = _round(same, books)
    return books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' integers by part, entry and place, comma-joined."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def encode(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code (two hex digits a part) and error (the squared distances' sum) of integers()' rows of the codebooks' length."""
    width = books.shape[2]
    schema = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("code", pa.string()), ("error", pa.int64())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = _matrix(batch.column("v"))
        found = [nearest(rows[:, p * width : (p + 1) * width], books[p]) for p in range(PARTS)]
        codes = np.stack([index for index, _ in found], axis=1).astype(np.uint8)
        text = codes.tobytes().hex()
        return rows_out({"vec_id": batch.column("vec_id"), "label": batch.column("label"), "code": [text[k : k + 2 * PARTS] for k in range(0, len(text), 2 * PARTS)], "error": sum(d for _, d in found)}, schema)

    same = vectors.where(F.size("v") == PARTS * width).select("vec_id", F.col("label").cast("string").alias("label"), "v")
    return same.mapInArrow(each_batch(run), "vec_id bigint, label string, code string, error bigint")


def decode(coded: DataFrame, books: np.ndarray) -> DataFrame:
    """coded with ``vector``, what its code stands for: the entries' integers over 1024."""
    schema = coded.select("code").schema
    flat = [[[float(x) / SCALE for x in entry] for entry in part] for part in books.tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [None if c is None else sum((flat[p][int(c[2 * p : 2 * p + 2], 16)] for p in range(PARTS)), []) for c in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vectors, pa.list_(pa.float64()))], names=[schema.names[0], "vector"])

    codes = coded.select("code").distinct().mapInArrow(run, "code string, vector array<double>")
    return coded.join(codes, "code", "left")


def code_report(embeddings: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error (error over the same label's rows) and codebooks_sha256 of each row that can be coded."""
    spark: SparkSession = embeddings.sparkSession
    vectors = integers(embeddings)
    books = fit(vectors)
    if books is None:
        return spark.createDataFrame([], "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string")
    coded, _ = written(encode(vectors, books), "codes")
    # Labels are few or many: Spark broadcasts their sums only once it has measured them.
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "same")
    joined = coded.join(sums, F.col("label").eqNullSafe(F.col("same")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
