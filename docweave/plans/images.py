"""Header geometry, orientation and oriented decoding as queries."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.registry import Registry, table
from docweave.sources import images

REGISTRY = Registry()
KINDS = ("png", "bmp", "gif", "jpeg", "tiff_le", "tiff_be", "webp_vp8", "webp_vp8l", "webp_vp8x")


def exif(turn: int, order: str) -> bytes:
    """A TIFF header whose directory holds an unread entry and the orientation."""
    head = b"II*\0" if order == "<" else b"MM\0*"
    return head + struct.pack(order + "IHHHII", 8, 2, 0x010F, 2, 4, 0x41424300) + struct.pack(order + "HHIHHI", 0x0112, 3, 1, turn, 0, 0)


def shown(key: int, w: int, h: int) -> np.ndarray:
    """Pixels of image ``key``: each colour a line of its place."""
    y, x = np.mgrid[0:h, 0:w]
    return np.stack([(x * 7 + y * 13 + key) % 256, (x * 5 + y * 3) % 256, (x + y * 11 + key * 3) % 256], axis=2).astype(np.uint8)


def made(key: int, kind: str, w: int, h: int, turn: int) -> bytes:
    """An image file, or the header of one, that states its geometry and orientation (BMP, GIF, VP8 and VP8L can't state one)."""
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    riff = lambda *parts: b"RIFF" + struct.pack("<I", 4 + sum(8 + len(b) + len(b) % 2 for _, b in parts)) + b"WEBP" + b"".join(n + struct.pack("<I", len(b)) + b + b"\0" * (len(b) % 2) for n, b in parts)
    if kind == "png":
        lines = b"".join(b"\0" + line.tobytes() for line in shown(key, w, h))
        return images.PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"eXIf", exif(turn, ">")) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")
    if kind == "bmp":
        body = b"".join(line[:, ::-1].tobytes() + b"\0" * (-3 * w % 4) for line in shown(key, w, h)[::-1])
        return b"BM" + struct.pack("<IHHIIiiHHIIiiII", 54 + len(body), 0, 0, 54, 40, w, h, 1, 24, 0, len(body), 0, 0, 0, 0) + body
    if kind == "gif":
        return b"GIF89a" + struct.pack("<HHBBB", w, h, 0, 0, 0) + b";"
    if kind == "jpeg":
        part = lambda marker, body: struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body
        return b"\xff\xd8" + part(0xE0, b"JFIF\0") + part(0xE1, b"Exif\0\0" + exif(turn, "<")) + b"\xff" + part(0xC2, struct.pack(">BHHB", 8, h, w, 3)) + b"\xff\xd9"
    if kind.startswith("tiff"):
        order = "<" if kind.endswith("le") else ">"
        wide = struct.pack(order + "HHIHH", 0x0100, 3, 1, w, 0)
        return (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "IH", 8, 3) + wide + struct.pack(order + "HHII", 0x0101, 4, 1, h) + struct.pack(order + "HHIHHI", 0x0112, 3, 1, turn, 0, 0)
    if kind == "webp_vp8":
        return riff((b"VP8 ", b"\0\0\0\x9d\x01\x2a" + struct.pack("<HH", w | 0x4000, h)))
    if kind == "webp_vp8l":
        return riff((b"VP8L", b"\x2f" + struct.pack("<I", (w - 1) | (h - 1) << 14)))
    return riff((b"VP8X", b"\x08\0\0\0" + (w - 1).to_bytes(3, "little") + (h - 1).to_bytes(3, "little")), (b"EXIF", exif(turn, "<")))


SEEN = pa.schema([("doc_id", pa.int64()), ("kind", pa.string()), *((n, pa.int64()) for n in ("width", "height", "turn", "shown_width", "shown_height", "corner", "last")), ("grounded", pa.bool_()), ("error", pa.string())])


def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each file's stored geometry and orientation, whether boxes can be grounded in it, and its decoded first and last pixel."""
    for batch in batches:
        out: dict[str, list] = {f.name: [] for f in SEEN}
        for key, kind, data in zip(*(batch.column(n).to_pylist() for n in ("doc_id", "kind", "content")), strict=True):
            w, h = images.geometry(data) or (None, None)
            row = {"doc_id": key, "kind": kind, "width": w, "height": h, "turn": images.orientation(data), "grounded": images.probe(data) is not None}
            try:
                pixels = images.decode(data).astype(np.int64)
                colour = lambda p: int(p[0] << 16 | p[1] << 8 | p[2])
                row |= {"shown_height": pixels.shape[0], "shown_width": pixels.shape[1], "corner": colour(pixels[0, 0]), "last": colour(pixels[0, -1])}
            except ValueError as e:
                row["error"] = str(e)
            for name in out:
                out[name].append(row.get(name))
        yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in SEEN], schema=SEEN)


def image_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An image of a small size, a kind and an orientation for each document, by its id and length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, lengths = batch.column("doc_id").to_pylist(), batch.column("n").to_pylist()
            kinds = [KINDS[k % len(KINDS)] for k in keys]
            data = [made(k, kind, 1 + n % 23, 1 + n % 17 + k % 2, (k // 9) % 10) for k, kind, n in zip(keys, kinds, lengths, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(kinds), pa.array(data, pa.binary())], names=["doc_id", "kind", "content"])

    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n"))
    return docs.mapInArrow(run, "doc_id bigint, kind string, content binary")


@REGISTRY.query(
    "image_headers",
    """WITH d AS (SELECT doc_id, doc_id % 9 AS k, 1 + coalesce(strlen(text), 0) % 23 AS w, 1 + coalesce(strlen(text), 0) % 17 + doc_id % 2 AS h, doc_id // 9 % 10 AS t FROM documents),
    o AS (SELECT doc_id, w, h, k, CASE WHEN k IN (1, 2, 6, 7) OR t NOT BETWEEN 1 AND 8 THEN 1 ELSE t END AS turn FROM d),
    p AS (SELECT *, CASE WHEN turn IN (2, 3, 7, 8) THEN w - 1 ELSE 0 END AS x0, CASE WHEN turn IN (3, 4, 6, 7) THEN h - 1 ELSE 0 END AS y0 FROM o),
    q AS (SELECT *, CASE WHEN turn <= 4 THEN w - 1 - x0 ELSE x0 END AS x1, CASE WHEN turn <= 4 THEN y0 ELSE h - 1 - y0 END AS y1 FROM p)
    SELECT doc_id, ['png', 'bmp', 'gif', 'jpeg', 'tiff_le', 'tiff_be', 'webp_vp8', 'webp_vp8l', 'webp_vp8x'][k + 1] AS kind, w AS width, h AS height, turn, turn = 1 AS grounded,
    CASE WHEN k <= 1 THEN CASE WHEN turn <= 4 THEN w ELSE h END END AS shown_width, CASE WHEN k <= 1 THEN CASE WHEN turn <= 4 THEN h ELSE w END END AS shown_height,
    CASE WHEN k <= 1 THEN (x0 * 7 + y0 * 13 + doc_id) % 256 * 65536 + (x0 * 5 + y0 * 3) % 256 * 256 + (x0 + y0 * 11 + doc_id * 3) % 256 END AS corner,
    CASE WHEN k <= 1 THEN (x1 * 7 + y1 * 13 + doc_id) % 256 * 65536 + (x1 * 5 + y1 * 3) % 256 * 256 + (x1 + y1 * 11 + doc_id * 3) % 256 END AS last,
    CASE WHEN k > 1 THEN 'image_invalid: no decoder' END AS error FROM q""",
)
def image_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Geometry and orientation of nine kinds of files, and the upper corners of those that decode."""
    return image_files(spark, sf_dir).mapInArrow(seen, "doc_id bigint, kind string, width bigint, height bigint, turn bigint, shown_width bigint, shown_height bigint, corner bigint, last bigint, grounded boolean, error string")
