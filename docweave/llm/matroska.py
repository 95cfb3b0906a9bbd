"""Matroska columns: a small muxer and a parser that turns a file into a packet table.

The parser reads EBML elements with variable-length ids and sizes (unknown sizes
included), clusters with SimpleBlocks and BlockGroups, the three kinds of
lacing, and cues. A packet has its track, timestamp, key flag and the byte range
it holds in the file. A cluster's time, a block's duration and its references count
wherever they stand in their cluster or group. Frames of a lace follow each other by the duration that the
track gives them: its samples' for raw sound, else its default duration, else
the block's duration in equal parts, else none. A block of a group is a key frame
unless it refers to another block. Payload bytes are stored as unsigned 8-bit PCM
at 8 kHz: a frame of 192 samples lasts 24 ms, so every timestamp is exact.

Defined results: null text is empty, null media has no packets; a file that is
cut short, whose lace sizes don't fit, whose numbers or times exceed a long, or
that nests deeper than ``DEEPEST`` raises ``ValueError`` in ``parse`` and gives one row with its message in
``packet_table``; rows that repeat a document each have its result; an empty table
gives no row; very long texts are stored whole, a file at a time; other columns,
whatever their names, are ignored. Keys are whole numbers; others raise Spark's
cast error.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import documents, each_batch, rows_out

FRAME = 192
RATE = 8000
FRAME_MS = 1000 * FRAME // RATE
BLOCK_FRAMES = 8
CLUSTER_BLOCKS = 16

#: Element ids of the public Matroska specification.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
DOC_TYPE, TIMESTAMP_SCALE, TRACK_ENTRY, TRACK_NUMBER, CODEC_ID = 0x4282, 0x2AD7B1, 0xAE, 0xD7, 0x86
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
MASTERS = {EBML, SEGMENT, INFO, TRACKS, TRACK_ENTRY, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_POSITIONS, 0xE1}
TOP_LEVEL = {INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1254C367, 0x1043A770, 0x1941A469}
REFERENCE_BLOCK, DEFAULT_DURATION, AUDIO, SAMPLING, CHANNELS, BIT_DEPTH = 0xFB, 0x23E383, 0xE1, 0xB5, 0x9F, 0x6264
XIPH, FIXED, EBML_LACE = 0x02, 0x04, 0x06
#: Timestamps, numbers of tracks and cues are longs.
LONGEST_NS = (1 << 63) - 1
#: Levels of elements within each other; the specification's masters that are read here need six.
DEEPEST = 16


def vint(value: int, width: int = 0) -> bytes:
    """A size: the shortest width whose all-ones value, which means unknown, stays free."""
    width = width or next(w for w in range(1, 9) if value < (1 << 7 * w) - 1)
    return ((1 << 7 * width) | value).to_bytes(width, "big")


def element(eid: int, body: bytes) -> bytes:
    return eid.to_bytes((eid.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def uint(eid: int, value: int) -> bytes:
    return element(eid, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def lace_header(kind: int, sizes: list[int]) -> bytes:
    """Frame count and sizes as the lacing kind writes them; the last size is left to the block's."""
    head = bytes([len(sizes) - 1])
    if kind == XIPH:
        return head + b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    if kind == EBML_LACE:
        out = head + vint(sizes[0])
        for before, n in zip(sizes, sizes[1:-1]):
            width = next(w for w in range(1, 9) if abs(n - before) < 1 << (7 * w - 1))
            out += vint(n - before + (1 << (7 * width - 1)) - 1, width)
        return out
    return head


def block(track: int, at: int, frames: list[bytes], kind: int, simple: bool) -> bytes:
    lacing = kind if len(frames) > 1 else 0
    head = vint(track) + struct.pack(">hB", at, lacing | (0x80 if simple else 0))
    body = head + (lace_header(lacing, [len(f) for f in frames]) if lacing else b"") + b"".join(frames)
    if simple:
        return element(SIMPLE_BLOCK, body)
    return element(BLOCK_GROUP, element(BLOCK, body) + uint(BLOCK_DURATION, FRAME_MS * len(frames)))


def mux(payload: bytes) -> bytes:
    """One audio track of 8-bit samples: laced blocks of up to 8 frames, clusters of up to 16 blocks, a cue for each cluster."""
    head = element(EBML, uint(0x4286, 1) + uint(0x42F7, 1) + uint(0x42F2, 4) + uint(0x42F3, 8) + element(DOC_TYPE, b"matroska") + uint(0x4287, 4) + uint(0x4285, 2))
    n_frames = -(-len(payload) // FRAME)
    info = element(INFO, uint(TIMESTAMP_SCALE, 1_000_000) + element(0x4489, struct.pack(">d", float(FRAME_MS * n_frames))) + element(0x4D80, b"docweave") + element(0x5741, b"docweave"))
    audio = element(0xE1, element(0xB5, struct.pack(">d", float(RATE))) + uint(0x9F, 1) + uint(0x6264, 8))
    tracks = element(TRACKS, element(TRACK_ENTRY, uint(TRACK_NUMBER, 1) + uint(0x73C5, 1) + uint(0x83, 2) + element(CODEC_ID, b"A_PCM/INT/LIT") + audio))
    parts, cues, at = [info, tracks], [], len(info) + len(tracks)
    per_cluster = BLOCK_FRAMES * CLUSTER_BLOCKS
    for first in range(0, n_frames, per_cluster):
        blocks = []
        for n, k in enumerate(range(first, min(first + per_cluster, n_frames), BLOCK_FRAMES)):
            last = min(k + BLOCK_FRAMES, first + per_cluster, n_frames)
            frames = [payload[FRAME * i : FRAME * (i + 1)] for i in range(k, last)]
            blocks.append(block(1, FRAME_MS * (k - first), frames, (XIPH, FIXED, EBML_LACE)[n % 3], simple=n % 4 != 3))
        cluster = element(CLUSTER, uint(TIMESTAMP, FRAME_MS * first) + b"".join(blocks))
        cues.append(element(CUE_POINT, uint(CUE_TIME, FRAME_MS * first) + element(CUE_POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER, at))))
        parts.append(cluster)
        at += len(cluster)
    return head + element(SEGMENT, b"".join([*parts, element(CUES, b"".join(cues))]))


@dataclass
class Packet:
    track: int
    timestamp_ns: int
    cluster: int
    block: int
    lace: int
    keyframe: bool
    offset: int
    size: int


@dataclass
class Track:
    """What a track says of its frames' durations; defaults as the specification has them."""

    number: int = 0
    codec: str = ""
    frame_ns: int = 0
    rate: float = 8000.0
    channels: int = 1
    depth: int = 0

    def lasts(self, size: int, share_ns: int) -> int:
        if self.codec.startswith("A_PCM/") and self.depth and self.rate > 0:
            time = size * 8 * 1_000_000_000 / (self.rate * self.channels * self.depth)
            if not time <= LONGEST_NS:
                raise ValueError(f"a frame of {size} bytes lasts too long at a sampling rate of {self.rate}")
            return round(time)
        return self.frame_ns or share_ns


@dataclass
class Media:
    packets: list[Packet] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)  # time, track, file offset of the cluster
    clusters: list[int] = field(default_factory=list)  # file offsets
    codecs: dict[int, str] = field(default_factory=dict)
    durations: dict[int, int] = field(default_factory=dict)  # of blocks that state one, in ticks
    tracks: dict[int, Track] = field(default_factory=dict)
    scale: int = 1_000_000


def read_vint(data: bytes, at: int, limit: int, keep_marker: bool) -> tuple[int, int, bool]:
    """Value, next offset, and whether all value bits are set (an unknown size)."""
    if at >= limit or not data[at]:
        raise ValueError(f"no variable-length integer at byte {at}")
    width = 9 - data[at].bit_length()
    if at + width > limit:
        raise ValueError(f"integer at byte {at} is cut short")
    raw = int.from_bytes(data[at : at + width], "big")
    value = raw & ((1 << 7 * width) - 1)
    return (raw if keep_marker else value), at + width, value == (1 << 7 * width) - 1


def elements(data: bytes, at: int, end: int, parent: int) -> Iterator[tuple[int, int, int, int]]:
    """(id, start, body start, body end) of each child. An unknown size lasts to the next element of the parent's level."""
    while at < end:
        start = at
        eid, at, _ = read_vint(data, at, end, keep_marker=True)
        size, at, unknown = read_vint(data, at, end, keep_marker=False)
        if unknown:
            stop = end if eid != CLUSTER else next((s for i, s in _peek(data, at, end) if i in TOP_LEVEL), end)
        else:
            stop = at + size
            if stop > end:
                raise ValueError(f"element {eid:X} at byte {start} ends beyond its parent")
        yield eid, start, at, stop
        at = stop


def _peek(data: bytes, at: int, end: int) -> Iterator[tuple[int, int]]:
    while at < end:
        start = at
        eid, at, _ = read_vint(data, at, end, keep_marker=True)
        yield eid, start
        size, at, _ = read_vint(data, at, end, keep_marker=False)
        at += size


def lace_sizes(data: bytes, at: int, end: int, kind: int) -> tuple[list[int], int]:
    if at >= end:
        raise ValueError("a lace has no count")
    count, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if kind == XIPH:
        for _ in range(count - 1):
            n = 0
            while True:
                if at >= end:
                    raise ValueError("a Xiph lace is cut short")
                n, more, at = n + data[at], data[at] == 255, at + 1
                if not more:
                    break
            sizes.append(n)
    elif kind == EBML_LACE and count > 1:
        n, at, _ = read_vint(data, at, end, keep_marker=False)
        sizes.append(n)
        for _ in range(count - 2):
            width = 9 - data[at].bit_length() if at < end and data[at] else 1
            raw, at, _ = read_vint(data, at, end, keep_marker=False)
            sizes.append(sizes[-1] + raw - ((1 << (7 * width - 1)) - 1))
    elif kind == FIXED:
        if (end - at) % count:
            raise ValueError("a fixed lace does not divide its block")
        return [(end - at) // count] * count, at
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("lace sizes exceed their block")
    return sizes, at


def parse(data: bytes) -> Media:
    out, segment = Media(), 0
    ticks: list[int] = []  # each cluster's time, wherever it is stated
    entry, cue_time, positions, refers, lasts = Track(), 0, [], False, None
    block_sizes: list[list[Packet]] = []  # the packets of each block, whose times are spread when all is known

    def number(lo: int, hi: int) -> int:
        if hi - lo > 8:
            raise ValueError(f"a number of {hi - lo} bytes at byte {lo}")
        return int.from_bytes(data[lo:hi], "big")

    def real(lo: int, hi: int) -> float:
        if hi - lo not in (0, 4, 8):
            raise ValueError(f"a float of {hi - lo} bytes at byte {lo}")
        return struct.unpack(">d" if hi - lo == 8 else ">f", data[lo:hi])[0] if hi > lo else 0.0

    def add_block(lo: int, hi: int, simple: bool) -> None:
        track, at, _ = read_vint(data, lo, hi, keep_marker=False)
        if at + 3 > hi:
            raise ValueError(f"block at byte {lo} is cut short")
        relative, flags = struct.unpack_from(">hB", data, at)
        at += 3
        lacing = flags & 0x06
        sizes, at = lace_sizes(data, at, hi, lacing) if lacing else ([hi - at], at)
        own = []
        for k, size in enumerate(sizes):
            own.append(Packet(track, relative, len(out.clusters) - 1, len(block_sizes), k, bool(flags & 0x80) if simple else True, at, size))
            at += size
        block_sizes.append(own)
        out.packets += own

    def visit(lo: int, hi: int, parent: int, depth: int) -> None:
        nonlocal segment, entry, cue_time, positions, refers, lasts
        if depth > DEEPEST:
            raise ValueError(f"elements nest deeper than {DEEPEST} levels at byte {lo}")
        for eid, start, a, b in elements(data, lo, hi, parent):
            if eid == SEGMENT:
                segment = a
            elif eid == CLUSTER:
                out.clusters.append(start)
                ticks.append(0)
            elif eid == TRACK_ENTRY:
                entry = Track()
            elif eid == BLOCK_GROUP:
                refers, lasts = False, None
            elif eid == CUE_POINT:
                cue_time, positions = 0, []
            elif eid == CUE_POSITIONS:
                positions.append([0, segment])
            elif eid == TRACK_NUMBER and parent == TRACK_ENTRY:
                entry.number = number(a, b)
            elif eid == CODEC_ID and parent == TRACK_ENTRY:
                entry.codec = data[a:b].decode("ascii", "replace")
            elif eid == DEFAULT_DURATION and parent == TRACK_ENTRY:
                entry.frame_ns = number(a, b)
            elif parent == AUDIO and eid == SAMPLING:
                entry.rate = real(a, b)
            elif parent == AUDIO and eid == CHANNELS:
                entry.channels = max(1, number(a, b))
            elif parent == AUDIO and eid == BIT_DEPTH:
                entry.depth = number(a, b)
            elif eid == TIMESTAMP_SCALE:
                out.scale = number(a, b)
            elif eid == TIMESTAMP and parent == CLUSTER:
                ticks[-1] = number(a, b)
            elif eid == SIMPLE_BLOCK or eid == BLOCK:
                add_block(a, b, simple=eid == SIMPLE_BLOCK)
            elif eid == BLOCK_DURATION and parent == BLOCK_GROUP:
                lasts = number(a, b)
            elif eid == REFERENCE_BLOCK:
                refers = True
            elif eid == CUE_TIME:
                cue_time = number(a, b)
            elif eid == CUE_TRACK and positions:
                positions[-1][0] = number(a, b)
            elif eid == CUE_CLUSTER and positions:
                positions[-1][1] = segment + number(a, b)
            if eid in MASTERS:
                before = len(block_sizes)
                visit(a, b, eid, depth + 1)
                if eid == TRACK_ENTRY:
                    out.tracks[entry.number] = entry
                    out.codecs[entry.number] = entry.codec
                elif eid == CUE_POINT:
                    out.cues += [(cue_time, track, at) for track, at in positions]
                elif eid == BLOCK_GROUP:  # the group's other elements may stand before its block or after it
                    for n in range(before, len(block_sizes)):
                        if lasts is not None:
                            out.durations[n] = lasts
                        for p in block_sizes[n]:
                            p.keyframe = not refers

    visit(0, len(data), 0, 0)
    for n, own in enumerate(block_sizes):
        when = ((ticks[own[0].cluster] if own[0].cluster >= 0 else 0) + own[0].timestamp_ns) * out.scale
        share = out.durations.get(n, 0) * out.scale // max(1, len(own))
        for p in own:
            p.timestamp_ns = when
            if not -LONGEST_NS <= when <= LONGEST_NS:
                raise ValueError(f"the timestamp of the packet at byte {p.offset} exceeds a long")
            when += out.tracks.get(p.track, _UNKNOWN).lasts(p.size, share)
    return out


_UNKNOWN = Track()


def read_back(data: bytes, media: Media, track: int = 1) -> bytes:
    """The track's bytes in time order."""
    own = sorted((p for p in media.packets if p.track == track), key=lambda p: (p.timestamp_ns, p.offset))
    return b"".join([data[p.offset : p.offset + p.size] for p in own])


def padded(text: bytes) -> bytes:
    return text + b" " * (-len(text) % FRAME or (0 if text else FRAME))


def features(samples: bytes, media: Media) -> str:
    """Counts of the packet table and the waveform's mean, power and sign changes about the mid level."""
    wave = np.frombuffer(samples, np.uint8).astype(np.float64) - 128.0
    changes = int(np.count_nonzero(np.diff(np.signbit(wave))))
    clusters = set(media.clusters)
    cued = sum(at in clusters for _, _, at in media.cues)
    spans = [(p.timestamp_ns, p.size) for p in media.packets]
    end = max(t + n * 1_000_000_000 // RATE for t, n in spans) // 1_000_000
    return f"packets={len(spans)};clusters={len(media.clusters)};cued={cued};duration_ms={end};mean={wave.mean():.6f};rms={np.sqrt(np.mean(wave * wave)):.6f};changes={changes}"


STORED = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("n_packets", pa.int64())]
)


def store_texts(docs: DataFrame) -> DataFrame:
    """Each whole text muxed, parsed again and described: the contract's columns and n_packets. One narrow pass, a file at a time."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: dict[str, list] = {f.name: [] for f in STORED}
        out["doc_id"] = batch.column("doc_id")
        for text in batch.column("text").to_pylist():
            text = text or b""
            stored = mux(padded(text))
            media = parse(stored)
            samples = read_back(stored, media)
            for name, value in (
                ("n_bytes", len(text)), ("payload_bytes", len(samples)), ("payload_sha256", hashlib.sha256(samples).hexdigest()), ("tail_crc32", zlib.crc32(samples[-16:])),
                ("media_bytes", len(stored)), ("media_sha256", hashlib.sha256(stored).hexdigest()), ("feature", features(samples, media)), ("n_packets", len(media.packets)),
            ):
                out[name].append(value)
        return rows_out(out, STORED)

    return documents(docs).mapInArrow(
        each_batch(run),
        "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, n_packets bigint",
    )


def mux_column(df: DataFrame, key: str, text: str) -> DataFrame:
    """key and media (binary): the file that holds each text."""
    schema = pa.schema([("key", pa.int64()), ("media", pa.binary())])
    run = lambda b: rows_out({"key": b.column("key"), "media": [mux(padded(t or b"")) for t in b.column("text").to_pylist()]}, schema)
    return df.select(F.col(key).cast("bigint").alias("key"), F.col(text).cast("string").cast("binary").alias("text")).mapInArrow(each_batch(run), "key bigint, media binary")


PACKETS = pa.schema(
    [("key", pa.int64()), ("track", pa.int64()), ("timestamp_ns", pa.int64()), ("cluster", pa.int64()), ("block", pa.int64()), ("lace", pa.int64()), ("keyframe", pa.bool_()), ("offset", pa.int64()), ("size", pa.int64()), ("error", pa.string())]
)


def packet_table(df: DataFrame, key: str, media: str) -> DataFrame:
    """A row for each packet of each file (null media: none); a file that can't be parsed gives one row with its error."""
    names = [f.name for f in PACKETS][1:-1]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: dict[str, list] = {f.name: [] for f in PACKETS}
        for k, data in zip(batch.column("key").to_pylist(), batch.column("media").to_pylist(), strict=True):
            if data is None:
                continue
            try:
                packets, error = parse(data).packets, None
            except ValueError as e:
                packets, error = [None], str(e)
            for p in packets:
                out["key"].append(k)
                out["error"].append(error)
                for name in names:
                    out[name].append(None if p is None else getattr(p, name))
        return rows_out(out, PACKETS)

    return df.select(F.col(key).cast("bigint").alias("key"), F.col(media).cast("binary").alias("media")).mapInArrow(
        each_batch(run), "key bigint, track bigint, timestamp_ns bigint, cluster bigint, block bigint, lace bigint, keyframe boolean, offset bigint, size bigint, error string"
    )
