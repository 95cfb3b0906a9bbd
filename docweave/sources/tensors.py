"""Tensor containers: a length-prefixed JSON header before the tensors' bytes, read to an inventory that is checked whole.

The first 8 bytes are the header's length, little-endian; the header names each
tensor's dtype, shape and byte range within what follows it. All of it is column
expressions: a header is decoded once a file, the tensors' bytes aren't touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions import binary as B

#: Bytes of a component, the header's key that is no tensor, the longest header, and what the digest starts with.
WIDTHS = {"BOOL": 1, "U8": 1, "I8": 1, "F8_E4M3": 1, "F8_E5M2": 1, "I16": 2, "U16": 2, "F16": 2, "BF16": 2, "I32": 4, "U32": 4, "F32": 4, "I64": 8, "U64": 8, "F64": 8}
METADATA = "__metadata__"
MAX_HEADER = 100_000_000
PREFIX = 8
HEADER = "map<string,struct<dtype:string,shape:array<bigint>,data_offsets:array<bigint>>>"


def le_number(c: Column) -> Column:
    """An unsigned little-endian number of at most 8 bytes; null beyond a long."""
    pairs = F.regexp_extract_all(F.hex(c), F.lit("(..)"), F.lit(1))
    text = F.conv(F.array_join(F.reverse(pairs), ""), 16, 10).cast("decimal(20,0)")
    return F.when(text <= (1 << 63) - 1, text.cast("bigint"))


def _entries(content: Column, length: Column) -> Column:
    """The header's tensors, ordered by byte range and name; null if it is no such object."""
    text = F.substring(content, PREFIX + 1, length.cast("int"))
    parsed = F.from_json(F.when(F.is_valid_utf8(text.cast("string")), text.cast("string")), HEADER)
    entries = F.filter(F.map_entries(parsed), lambda e: e["key"] != METADATA)
    return F.array_sort(
        F.transform(entries, lambda e: F.struct(F.get(e["value"]["data_offsets"], 0).alias("begin"), F.get(e["value"]["data_offsets"], 1).alias("end"), e["key"].alias("name"), e["value"]["dtype"].alias("dtype"), e["value"]["shape"].alias("shape")))
    )


def _fault(t: Column) -> Column:
    """What is wrong with one tensor by itself."""
    width = F.create_map(*(x for k, v in WIDTHS.items() for x in (F.lit(k), F.lit(v))))[t["dtype"]]
    elements = F.aggregate(t["shape"], F.lit(1).cast("decimal(38,0)"), lambda n, d: (n * d).cast("decimal(38,0)"))
    named = (F.length(t["name"]) > 0) & ~F.contains(t["name"], F.lit("\0"))
    return (
        F.when(~named, "name_invalid").when(width.isNull(), "dtype_unknown").when(t["shape"].isNull() | F.exists(t["shape"], lambda d: d.isNull() | (d < 0)), "shape_invalid")
        .when(t["begin"].isNull() | t["end"].isNull() | (t["begin"] < 0) | (t["end"] < t["begin"]), "range_invalid").when(elements * width != t["end"] - t["begin"], "size_mismatch")
    )


def inventory(files: DataFrame, content: str, expected: Column | None = None) -> DataFrame:
    """files with ``tensors`` (begin, end, name, dtype, shape by range, within the data), ``data_at``, and ``fault``: the first rule broken.

    The rules, in order: prefix_short, header_too_long, header_short, header_invalid, what is wrong with a tensor (in
    order of range), range_overlap, range_gap, data_length, and tensor_count where ``expected`` is given.
    """
    c, size = F.col(content), F.octet_length(content).cast("bigint")
    rows = files.withColumn("__length", F.when(size >= PREFIX, le_number(F.substring(c, 1, PREFIX))))
    length = F.col("__length")
    whole = (length <= MAX_HEADER) & (length + PREFIX <= size)
    rows = rows.withColumn("tensors", F.when(whole, _entries(c, length))).withColumn("data_at", F.when(whole, length + PREFIX))
    t = F.col("tensors")
    single = F.get(F.filter(F.transform(t, _fault), lambda f: f.isNotNull()), 0)
    before = F.transform(F.sequence(F.lit(1), F.size(t) - 1), lambda i: F.get(t, i)["begin"] - F.get(t, i - 1)["end"])
    steps = F.when(F.size(t) > 1, before).otherwise(F.array().cast("array<bigint>"))
    first, last = F.coalesce(F.get(t, 0)["begin"], F.lit(0)), F.coalesce(F.try_element_at(t, F.lit(-1))["end"], F.lit(0))
    fault = (
        F.when(c.isNull() | (size < PREFIX), "prefix_short").when(length.isNull() | (length > MAX_HEADER), "header_too_long").when(~whole, "header_short").when(t.isNull(), "header_invalid").when(single.isNotNull(), single)
        .when(F.exists(steps, lambda s: s < 0), "range_overlap").when((first != 0) | F.exists(steps, lambda s: s > 0), "range_gap").when(last != size - F.col("data_at"), "data_length")
    )
    if expected is not None:
        fault = fault.when(F.size(t) != expected, "tensor_count")
    return rows.withColumn("fault", fault).drop("__length")


def inventory_digest(tensors: Column, domain: bytes) -> Column:
    """SHA-256 over domain, count, and each tensor by name: name and dtype after their lengths, rank, dimensions, bytes; numbers are 64-bit little-endian."""
    by_name = F.array_sort(F.transform(tensors, lambda t: F.struct(t["name"].alias("name"), t["dtype"].alias("dtype"), t["shape"].alias("shape"), (t["end"] - t["begin"]).alias("bytes"))))
    said = F.transform(by_name, lambda t: F.concat(B.prefixed(t["name"]), B.prefixed(t["dtype"]), B.u64_le(F.size(t["shape"])), B.fold(F.transform(t["shape"], B.u64_le)), B.u64_le(t["bytes"])))
    return B.digest(F.lit(domain), B.u64_le(F.size(tensors)), B.fold(said))


def packed(tensors: Column) -> Column:
    """A container of an array of (name, dtype, shape, data), in that order."""
    sizes = F.transform(tensors, lambda t: F.octet_length(t["data"]).cast("bigint"))
    end = lambda k: F.aggregate(F.slice(sizes, F.lit(1), k), F.lit(0).cast("bigint"), lambda a, b: a + b)
    entry = F.transform(tensors, lambda t, i: F.struct(t["name"].alias("key"), F.struct(t["dtype"].alias("dtype"), t["shape"].alias("shape"), F.array(end(i), end(i + 1)).alias("data_offsets")).alias("value")))
    return container(F.to_json(F.map_from_entries(entry)), B.fold(F.transform(tensors, lambda t: t["data"])))


def container(header: Column, data: Column) -> Column:
    return F.concat(B.u64_le(F.octet_length(header)), header.cast("binary"), data)
