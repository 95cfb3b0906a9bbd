"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A pattern is a window of ``WINDOW`` consecutive words of a benchmark item (the
whole item if it has fewer). Patterns of one length share a shift table: for the
hash of each block of two words, how far the search may jump when this block
ends at the current word. A document is read once from left to right; at a jump
of 0 the window there is a candidate unless a bitmap of the patterns' hashes
rules it out. Buckets of patterns by the hash of their last block (the suffix)
are rows of a table; candidates are joined with their bucket, where the window
and the test string are compared whole, byte by byte.

Only the shift tables and the bitmap travel to every worker. Their size follows
the number of windows, from ``SLOTS`` and ``BITS`` to ``GROWTH`` times as much: beyond that jumps
get shorter and candidates more, never other results. A jump is at most
``LONGEST``, so windows may be of any length. The items themselves are
joined, not broadcast or gathered, except where Spark measures them to be small.

Defined results: null or wordless text has no words and is clean; an item
without words has no window; windows of a null item_id hit but name no item;
rows that repeat an item_id act as one item; rows that repeat a document each
have its result; empty tables give no rows and no hits; very long texts are read
whole; other columns, whatever their names, are ignored, and
``drop_contaminated`` hands them on. Ids are whole numbers; others raise Spark's
cast error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import documents, mark, rows_out, slices, written

WINDOW = 13
BLOCK = 2
#: Least entries of a shift table, one table for each length of patterns, and least bits of the patterns' bitmap, and how often as large they get. Powers of 2.
SLOTS = 1 << 18
BITS = 1 << 24
GROWTH = 16
#: Entries and bits for each window, between those bounds.
SLOTS_EACH, BITS_EACH = 8, 32
#: The longest jump that a table's byte holds; a shorter one misses nothing.
LONGEST = 255
LOW32 = (1 << 32) - 1

#: A-Z are lowered, and the word class is [0-9a-z] after lowering plus everything beyond ASCII.
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Words of UTF-8 text: bytes beyond ASCII are word bytes, so the class needs no decoding."""
    return text.translate(NORMAL).split() if text else []


def block_hash(words: list[bytes], length: int) -> int:
    """Of the block that ends a sequence; its low bits are the place in a shift table."""
    return xxhash.xxh64_intdigest(b" ".join(words[-min(BLOCK, length) :]), length) & LOW32


def window_hash(window: bytes, length: int) -> int:
    return xxhash.xxh64_intdigest(window, 1000 + length) & LOW32


def sized(windows: int, each: int, least: int) -> int:
    """The power of 2 that gives each window its share, from least to GROWTH times least."""
    return min(max(least, 1 << max(0, windows * each - 1).bit_length()), least * GROWTH)


class Searcher:
    """The shift tables by pattern length and the bitmap, as bytes."""

    def __init__(self, shifts: dict[int, bytes], bitmap: bytes) -> None:
        self.shifts, self.bitmap, self.bits = sorted(shifts.items()), bitmap, len(bitmap) * 8 - 1

    def candidates(self, words: list[bytes]) -> Iterator[tuple[int, int, int, bytes]]:
        """(start, length, bucket, window) wherever a pattern may stand."""
        bitmap, bits, count, digest, space = self.bitmap, self.bits, len(words), xxhash.xxh64_intdigest, b" "
        for length, shift in self.shifts:
            block, end, slots = min(BLOCK, length), length, len(shift) - 1
            while end <= count:
                bucket = digest(space.join(words[end - block : end]), length) & LOW32
                if jump := shift[bucket & slots]:
                    end += jump
                    continue
                window = space.join(words[end - length : end])
                bit = window_hash(window, length) & bits
                if bitmap[bit >> 3] >> (bit & 7) & 1:
                    yield end - length, length, bucket, window
                end += 1


PATTERNS = pa.schema([("item_id", pa.int64()), ("length", pa.int32()), ("bucket", pa.int64()), ("window", pa.binary()), ("bit", pa.int64())])
JUMPS = pa.schema([("length", pa.int32()), ("bucket", pa.int64()), ("jump", pa.int32())])


def items_of(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").cast("binary").alias("text"))


def pattern_rows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """A row for each window of each item: item_id, length, bucket, window (its words, joined) and its hash, whose low bits are its bit of the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            out: dict[str, list] = {f.name: [] for f in PATTERNS}
            for item_id, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = words_of(text)
                size = min(window, len(words))
                for start in range(len(words) - size + 1 if size else 0):
                    own = words[start : start + size]
                    said = b" ".join(own)
                    for name, value in (("item_id", item_id), ("length", size), ("bucket", block_hash(own, size)), ("window", said), ("bit", window_hash(said, size))):
                        out[name].append(value)
            yield rows_out(out, PATTERNS)

    return items_of(benchmark).mapInArrow(run, "item_id bigint, length int, bucket bigint, window binary, bit bigint")


def jump_rows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """length, bucket and jump of each block of each item: in a run of windows, a block beyond the first window ends one of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            out: dict[str, list] = {f.name: [] for f in JUMPS}
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                size = min(window, len(words))
                for end in range(min(BLOCK, size), len(words) + 1) if size else ():
                    out["length"].append(size)
                    out["bucket"].append(block_hash(words[max(0, end - BLOCK) : end], size))
                    out["jump"].append(min(LONGEST, max(0, size - end)))
            yield rows_out(out, JUMPS)

    return items_of(benchmark).mapInArrow(run, "length int, bucket bigint, jump int")


def searcher_tables(jumps: DataFrame, patterns: DataFrame) -> tuple[dict[int, bytes], bytes]:
    """The shift tables and the bitmap. At most a table's entries a length and a row for 64 bits come to the driver."""
    windows = patterns.count()
    slots, n_bits = sized(windows, SLOTS_EACH, SLOTS), sized(windows, BITS_EACH, BITS)
    shifts: dict[int, np.ndarray] = {}
    found = jumps.groupBy("length", F.col("bucket").bitwiseAND(F.lit(slots - 1)).alias("slot")).agg(F.min("jump").alias("jump")).toArrow()
    length, slot, jump = (found.column(n).to_numpy() for n in ("length", "slot", "jump"))
    for size in np.unique(length).tolist():
        own = length == size
        table = np.full(slots, min(LONGEST, size - min(BLOCK, size) + 1), np.uint8)
        table[slot[own]] = jump[own]
        shifts[size] = table
    place = patterns.select(F.col("bit").bitwiseAND(F.lit(n_bits - 1)).cast("int").alias("bit"))
    bits = place.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, bit & 63)")).alias("mask")).toArrow()
    bitmap = np.zeros(n_bits // 64, "<u8")
    bitmap[bits.column("word").to_numpy()] = bits.column("mask").to_numpy().view(np.uint64)
    return {size: table.tobytes() for size, table in shifts.items()}, bitmap.tobytes()


def merged(spans: list[list[int]]) -> list[list[int]]:
    """Sorted ranges, joined where they overlap or touch."""
    out: list[list[int]] = []
    for lo, hi in spans:
        if out and lo <= out[-1][1]:
            out[-1][1] = max(hi, out[-1][1])
        else:
            out.append([lo, hi])
    return out


def _with_merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        at = batch.schema.get_field_index("spans")
        yield batch.set_column(at, batch.schema.field(at), pa.array([merged(s) for s in batch.column(at).to_pylist()], batch.schema.field(at).type))


SCANNED = pa.schema(
    [("doc_id", pa.int64()), ("mark", pa.binary()), ("n_words", pa.int64())]
    + [("found", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int32()), ("bucket", pa.int64()), ("window", pa.binary())])))]
)


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, mark (of the text), n_words, spans (merged word ranges) and items (sorted ids), a row for each document.

    One pass reads the texts; what it leaves, a count and the candidates of each
    row, is written, so that the joins read it without searching again.
    """
    spark = docs.sparkSession
    patterns, _ = written(pattern_rows(benchmark, window), "patterns")
    shared = spark.sparkContext.broadcast(searcher_tables(jump_rows(benchmark, window), patterns))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(*shared.value)
        for batch in slices(batches):
            n_words, found = [], []
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                n_words.append(len(words))
                found.append([{"start": s, "length": n, "bucket": b, "window": w} for s, n, b, w in searcher.candidates(words)])
            yield rows_out({"doc_id": batch.column("doc_id"), "mark": batch.column("mark"), "n_words": n_words, "found": found}, SCANNED)

    rows = documents(docs).withColumn("mark", mark()).mapInArrow(scan, "doc_id bigint, mark binary, n_words bigint, found array<struct<start:bigint,length:int,bucket:bigint,window:binary>>")
    scanned, _ = written(rows.withColumn("row", F.monotonically_increasing_id()), "scanned")
    tests = patterns.groupBy("length", "bucket", "window").agg(F.collect_set("item_id").alias("items"))
    hits = scanned.where(F.size("found") > 0).select("row", F.inline("found")).join(tests, ["length", "bucket", "window"])
    hits = hits.groupBy("row").agg(F.array_sort(F.collect_set(F.array("start", F.col("start") + F.col("length")))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    hits = hits.mapInArrow(_with_merged, hits.schema)
    return scanned.join(hits, "row", "left").select("doc_id", "mark", "n_words", none("spans", "array<array<bigint>>"), none("items", "array<bigint>"))


def _n_hit() -> F.Column:
    return F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s[1] - s[0])


def _contaminated() -> F.Column:
    return (_n_hit() > 0) & (_n_hit() * 20 >= F.col("n_words"))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's columns: n_words, n_hit, n_items, items_sha256 and contaminated by doc_id."""
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return find_contamination(docs, benchmark).select(
        "doc_id",
        "n_words",
        _n_hit().alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(names.cast("binary"), 256).alias("items_sha256"),
        _contaminated().alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents that aren't contaminated, with all their columns. Rows of one id and text share the verdict, so both name them."""
    bad = find_contamination(docs, benchmark, window).where(_contaminated()).select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark")).distinct()
    return docs.join(bad, docs["doc_id"].cast("bigint").eqNullSafe(bad["__id"]) & (mark(docs["text"]) == bad["__mark"]), "left_anti")
