"""Image sources: bounded admission, header geometry and decoding without native libraries.

The container has no image library, so decoding covers what numpy and zlib can:
uncompressed BMP and non-interlaced 8-bit PNG, turned by their orientation. Other
types (JPEG, GIF, TIFF, WebP) are admitted by signature, measured and their
orientation read by header, and decode to an error row.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions.binary import media_type

#: Fixed limits.
MAX_SOURCE_BYTES = 32 * 1024 * 1024
MAX_SIDE = 16_384
MAX_DECODED_BYTES = 256 * 1024 * 1024
PNG = b"\x89PNG\r\n\x1a\n"
TIFF_ORDERS = {b"II*\0": "<", b"MM\0*": ">"}


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """path, size, sha256, media_type, content and error_code of each file. Files beyond the bound are listed and never read; Spark leaves empty files out of its listing."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*").load(path)
    small = files.where(F.col("length") <= MAX_SOURCE_BYTES)
    odd = files.where(F.col("length") > MAX_SOURCE_BYTES).select(
        "path", F.col("length").alias("size"), F.lit(None).cast("string").alias("sha256"), F.lit(None).cast("string").alias("media_type"), F.lit(None).cast("binary").alias("content"),
        F.lit("source_too_large").alias("error_code"),
    )
    kind = media_type(F.col("content"))
    read = small.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), kind.alias("media_type"), "content", F.when(kind.isNull(), "source_type_unsupported").alias("error_code"))
    return read.unionByName(odd)


def geometry(data: bytes) -> tuple[int, int] | None:
    """(width, height) as stored, from the header alone; None if it doesn't say."""
    try:
        if data[:8] == PNG and data[12:16] == b"IHDR":
            return struct.unpack(">II", data[16:24])
        if data[:2] == b"BM":
            w, h = struct.unpack("<ii", data[18:26])
            return w, abs(h)
        if data[:6] in (b"GIF87a", b"GIF89a"):
            return struct.unpack("<HH", data[6:10])
        if data[:3] == b"\xff\xd8\xff":
            frame = next((body for marker, body in _jpeg_segments(data) if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC)), b"")
            h, w = struct.unpack(">HH", frame[1:5])
            return w, h
        if data[:4] in TIFF_ORDERS:
            tags = directory(data)
            return (tags[0x0100], tags[0x0101]) if {0x0100, 0x0101} <= set(tags) else None
        if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
            return _webp_geometry(data)
    except struct.error:  # the header is cut short
        return None
    return None


def orientation(data: bytes) -> int:
    """The EXIF orientation, 1 to 8; 1 where the file says nothing or nothing valid. Later records don't count."""
    exif = b""
    try:
        if data[:8] == PNG:
            exif = next((body for kind, body in _png_chunks(data) if kind == b"eXIf"), b"")
        elif data[:3] == b"\xff\xd8\xff":
            exif = next((body for marker, body in _jpeg_segments(data) if marker == 0xE1 and body[:6] == b"Exif\0\0"), b"")
        elif data[:4] in TIFF_ORDERS:
            exif = data
        elif data[:4] == b"RIFF" and data[8:12] == b"WEBP":
            exif = next((body for kind, body in _webp_chunks(data) if kind == b"EXIF"), b"")
    except struct.error:
        return 1
    return exif_orientation(exif.removeprefix(b"Exif\0\0"))


def probe(data: bytes) -> tuple[int, int] | None:
    """(width, height) from the header alone; None if it is unknown or an EXIF orientation would turn the image."""
    return geometry(data) if orientation(data) == 1 else None


def _jpeg_segments(data: bytes) -> Iterator[tuple[int, bytes]]:
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        marker = data[at + 1]
        if marker == 0xFF:  # fill byte
            at += 1
            continue
        if marker == 0x01 or 0xD0 <= marker <= 0xD8:  # no length
            at += 2
            continue
        if marker in (0xD9, 0xDA):  # the image's data
            return
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        yield marker, data[at + 4 : at + 2 + size]
        at += 2 + max(2, size)


def _png_chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = 8
    while at + 12 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        yield kind, data[at + 8 : at + 8 + size]
        at += 12 + size


def _webp_chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = 12
    while at + 8 <= len(data):
        kind, size = struct.unpack("<4sI", data[at : at + 8])
        yield kind, data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2


def _webp_geometry(data: bytes) -> tuple[int, int] | None:
    kind, body = next(_webp_chunks(data), (b"", b""))
    if kind == b"VP8 " and body[3:6] == b"\x9d\x01\x2a":
        w, h = struct.unpack("<HH", body[6:10])
        return w & 0x3FFF, h & 0x3FFF
    if kind == b"VP8L" and body[:1] == b"\x2f":
        bits = struct.unpack("<I", body[1:5])[0]
        return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
    if kind == b"VP8X" and len(body) >= 10:
        return int.from_bytes(body[4:7], "little") + 1, int.from_bytes(body[7:10], "little") + 1
    return None


def directory(tiff: bytes) -> dict[int, int]:
    """Tag and value of a TIFF header's first directory: the entries that hold one short or long, the first of each tag."""
    order = TIFF_ORDERS.get(tiff[:4])
    if order is None or len(tiff) < 8:
        return {}
    at = struct.unpack(order + "I", tiff[4:8])[0]
    out: dict[int, int] = {}
    if at + 2 > len(tiff):
        return out
    for k in range(struct.unpack(order + "H", tiff[at : at + 2])[0]):
        entry = tiff[at + 2 + 12 * k : at + 14 + 12 * k]
        if len(entry) < 12:
            break
        tag, kind, count = struct.unpack(order + "HHI", entry[:8])
        if count == 1 and kind in (3, 4):
            out.setdefault(tag, struct.unpack(order + ("H" if kind == 3 else "I"), entry[8 : 10 if kind == 3 else 12])[0])
    return out


def exif_orientation(tiff: bytes) -> int:
    """Orientation of a TIFF header's first directory; 1 where it says nothing valid."""
    value = directory(tiff).get(0x0112, 1)
    return value if 1 <= value <= 8 else 1


def oriented(pixels: np.ndarray, turn: int) -> np.ndarray:
    """The pixels as they are meant to be seen: mirrored where the orientation says so, from 5 on with rows and columns swapped first."""
    if turn >= 5:
        pixels = pixels.swapaxes(0, 1)
    if turn in (2, 3, 6, 7):
        pixels = pixels[:, ::-1]
    if turn in (3, 4, 7, 8):
        pixels = pixels[::-1]
    return np.ascontiguousarray(pixels)


def decode(data: bytes) -> np.ndarray:
    """RGB pixels (height, width, 3), turned as the file's orientation says. ValueError with a code where the bounds or the format forbid it."""
    size = geometry(data)
    if size is None:
        raise ValueError("image_invalid: no header geometry")
    w, h = size
    if not (1 <= w <= MAX_SIDE and 1 <= h <= MAX_SIDE) or 4 * w * h > MAX_DECODED_BYTES:
        raise ValueError("image_invalid: too large")
    if data[:2] == b"BM":
        return _decode_bmp(data, w, h)
    if data[:4] == b"\x89PNG":
        return oriented(_decode_png(data, w, h), orientation(data))
    raise ValueError("image_invalid: no decoder")


def _decode_bmp(data: bytes, w: int, h: int) -> np.ndarray:
    if len(data) < 54:
        raise ValueError("image_invalid: short header")
    start, bits, packed = struct.unpack("<I", data[10:14])[0], struct.unpack("<H", data[28:30])[0], struct.unpack("<I", data[30:34])[0]
    if bits not in (24, 32) or packed:
        raise ValueError("image_invalid: BMP form")
    stride = (w * bits // 8 + 3) // 4 * 4
    if start + stride * h > len(data):
        raise ValueError("image_invalid: cut short")
    rows = np.frombuffer(data, np.uint8, stride * h, start).reshape(h, stride)[:, : w * bits // 8].reshape(h, w, bits // 8)
    top_down = struct.unpack("<i", data[22:26])[0] < 0
    return (rows if top_down else rows[::-1])[:, :, 2::-1].copy()


def _decode_png(data: bytes, w: int, h: int) -> np.ndarray:
    if len(data) < 29:
        raise ValueError("image_invalid: short header")
    depth, colour, interlace = data[24], data[25], data[28]
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
    if depth != 8 or channels is None or interlace:
        raise ValueError("image_invalid: PNG form")
    packed = [body for kind, body in _png_chunks(data) if kind == b"IDAT"]
    stride = w * channels
    try:
        raw = zlib.decompressobj().decompress(b"".join(packed), (stride + 1) * h)
    except zlib.error as e:
        raise ValueError("image_invalid: PNG data") from e
    if len(raw) < (stride + 1) * h:
        raise ValueError("image_invalid: cut short")
    lines = np.frombuffer(raw, np.uint8).reshape(h, stride + 1)
    out = np.zeros((h, stride), np.uint8)
    before = np.zeros(stride, np.int32)
    for y in range(h):
        before = _unfiltered(int(lines[y, 0]), lines[y, 1:].astype(np.int32), before, channels)
        out[y] = before
    pixels = out.reshape(h, w, channels)
    return np.repeat(pixels[:, :, :1], 3, axis=2) if channels < 3 else pixels[:, :, :3].copy()


def _unfiltered(kind: int, line: np.ndarray, up: np.ndarray, step: int) -> np.ndarray:
    if kind == 0:
        return line
    if kind == 2:
        return (line + up) & 255
    if kind == 1:  # running sums of each channel
        return (np.cumsum(line.reshape(-1, step), axis=0) & 255).reshape(-1)
    out = np.zeros_like(line)
    for x in range(len(line)):
        left = int(out[x - step]) if x >= step else 0
        if kind == 3:
            out[x] = (line[x] + (left + int(up[x])) // 2) & 255
        else:
            corner = int(up[x - step]) if x >= step else 0
            p = left + int(up[x]) - corner
            near = min((abs(p - left), 0, left), (abs(p - int(up[x])), 1, int(up[x])), (abs(p - corner), 2, corner))[2]
            out[x] = (line[x] + near) & 255
    return out


DECODED = pa.schema([("path", pa.string()), ("width", pa.int64()), ("height", pa.int64()), ("pixels", pa.binary()), ("error", pa.string())])


def decoded(sources: DataFrame) -> DataFrame:
    """path, width, height, pixels (RGB rows) and error of admitted sources (path, content); a bad image is an error row, not a failed task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    image = decode(content or b"")
                    row = (path, image.shape[1], image.shape[0], image.tobytes(), None)
                except (ValueError, struct.error) as e:
                    row = (path, None, None, None, str(e))
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, DECODED, strict=True)], schema=DECODED)

    return sources.select("path", "content").mapInArrow(run, "path string, width bigint, height bigint, pixels binary, error string")
