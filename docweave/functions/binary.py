"""Byte signatures, little-endian integers and length-prefixed digests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Leading bytes (hex) of each media type.
SIGNATURES = (
    ("image/png", "89504E470D0A1A0A"),
    ("image/jpeg", "FFD8FF"),
    ("image/gif", "474946383761"),
    ("image/gif", "474946383961"),
    ("image/bmp", "424D"),
    ("image/tiff", "49492A00"),
    ("image/tiff", "4D4D002A"),
)
RIFF, WEBP = "52494646", "57454250"


def media_type(content: Column) -> Column:
    """By leading bytes alone; null for anything else. Stays in generated code."""
    starts = lambda sig, at=1: F.hex(F.substring(content, at, len(sig) // 2)) == sig
    out = F.when(starts(RIFF) & starts(WEBP, 9), F.lit("image/webp"))
    for media, sig in SIGNATURES:
        out = out.when(starts(sig), F.lit(media))
    return out


def u64_le(n: Column) -> Column:
    pairs = F.regexp_extract_all(F.lpad(F.hex(n.cast("bigint")), 16, "0"), F.lit("(..)"), F.lit(1))
    return F.unhex(F.array_join(F.reverse(pairs), ""))


def byte(n: Column) -> Column:
    return F.unhex(F.lpad(F.hex(n.cast("bigint")), 2, "0"))


def prefixed(c: Column) -> Column:
    """UTF-8 bytes after their length as an unsigned 64-bit little-endian number."""
    return F.concat(u64_le(F.octet_length(c)), c.cast("binary"))


def optional(c: Column) -> Column:
    """A presence byte, then the prefixed value if there is one."""
    return F.when(c.isNull(), F.unhex(F.lit("00"))).otherwise(F.concat(F.unhex(F.lit("01")), prefixed(c)))


def fold(parts: Column) -> Column:
    """Binary concatenation of an array of binaries."""
    return F.aggregate(parts, F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, x))


def digest(*parts: Column) -> Column:
    return F.sha2(reduce(lambda a, b: F.concat(a, b), parts), 256)
