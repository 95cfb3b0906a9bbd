"""SentencePiece encoding by sampling from the piece lattice, and lossless decoding.

Text is cut into chunks that no piece of the vocabulary crosses: a run of
spaces with the run of other characters after it, or a line feed. Within a
chunk every piece that matches somewhere is an edge of a lattice; a character
without a piece of its own is an edge of byte pieces. Forward filtering sums the
weights of all paths to each position; backward sampling then draws a path from
the end, each edge with its share of that sum. Random numbers are a hash of the
row key, the chunk's place in the row and the step, so a row's pieces depend on
its key and text alone: not on batches, partitions or retries.

A piece's weight is (1 + rank)^-theta, the rank being the negated score that
the vocabulary file gives; theta is a parameter (larger: closer to the most
frequent pieces).

Defined results: null text has null pieces, empty text none; spaces, line feeds
and U+2581 come back as they were, also where the vocabulary lacks a piece for them;
a null key samples as key 0; rows that repeat a key and text repeat the pieces;
an empty table gives no row; very long texts are encoded whole, a block of
``BLOCK_CHARS`` or one text at a time; other columns, whatever their names, are
ignored. Keys are whole numbers; others raise Spark's cast error.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm.common import slices

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
THETA = 1.0
SEED = 7
#: Rows are encoded together until they have so many characters.
BLOCK_CHARS = 1 << 19
#: Log weight of a byte-piece edge: less likely than any piece.
FALLBACK = -16.0
SPACE_MARK = 0x2581
#: Stands for a U+2581 that the text itself has: beyond Unicode, so no piece matches it.
OWN_MARK = 0x110000
CHUNK = re.compile(r"\n| *[^ \n]+| +")
U64 = np.uint64
MASK = (1 << 64) - 1
BITMAP_BITS = 22
#: Leading bits of a hash that lead to its place among the vocabulary's.
FIRST_BITS = 18


def last_at_most(share: np.ndarray, lo: np.ndarray, hi: np.ndarray, u: np.ndarray, near: np.ndarray | None = None) -> np.ndarray:
    """For each draw u the last edge of lo .. hi - 1 whose share is at most u, by bisection, from ``near`` on where that isn't beyond it. Shares rise within a range; the first edge's is 0."""
    at = lo.copy()
    if near is not None:
        near = np.clip(near, lo, hi - 1)
        at = np.where(share[near] <= u, near, at)
    step = 1 << int((hi - at).max(initial=0)).bit_length() >> 1
    while step:
        probe = at + step
        inside = np.flatnonzero(probe < hi)
        on = inside[share[probe[inside]] <= u[inside]]
        at[on] += step
        step >>= 1
    return at


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64 (public domain)."""
    x = x + U64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def draws(stream: np.ndarray, step: int) -> np.ndarray:
    """Uniform numbers in [0, 1), one for each stream."""
    return (mix(stream + U64(step * 0xD1B54A32D192ED03 & MASK)) >> U64(11)).astype(np.float64) * 2.0**-53


class Ranges:
    """Hashes of any range of a sequence of 64-bit values in constant time: (S[b] - S[a]) times a power of an inverse."""

    MULTIPLIER = 0x9E3779B97F4A7C15 | 1
    INVERSE = pow(MULTIPLIER, -1, 1 << 64)

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U64)

    def grow(self, n: int) -> None:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            for name, base in (("up", self.MULTIPLIER), ("down", self.INVERSE)):
                steps = np.full(size, base, U64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def prefix(self, values: np.ndarray) -> np.ndarray:
        self.grow(len(values) + 1)
        out = np.zeros(len(values) + 1, U64)
        np.cumsum(values * self.up[: len(values)], out=out[1:])
        return out

    def of(self, prefix: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((prefix[b] - prefix[a]) * self.down[a])


def vocabulary(model_path: str) -> list[tuple[str, float, int]]:
    """(surface, score, byte or -1) of each piece by id; control pieces have an empty surface."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    out = []
    for i in range(sp.get_piece_size()):
        special = sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)
        byte = int(sp.id_to_piece(i)[3:5], 16) if sp.is_byte(i) else -1
        out.append(("" if special or byte >= 0 else sp.id_to_piece(i), sp.get_score(i), byte))
    if sorted(b for _, _, b in out if b >= 0) != list(range(256)):
        raise ValueError("the vocabulary has no full set of byte pieces, so decoding would not be lossless")
    return out


def code_points(text: str) -> np.ndarray:
    cps = np.frombuffer(text.encode("utf-32-le"), "<u4").copy()
    own, space = cps == SPACE_MARK, cps == 32
    cps[own], cps[space] = OWN_MARK, SPACE_MARK
    return cps


class Codec:
    """Encodes and decodes with one vocabulary."""

    def __init__(self, vocab: list[tuple[str, float, int]], theta: float = THETA, seed: int = SEED) -> None:
        self.seed = seed
        self.byte_id = np.zeros(256, np.int64)
        self.bytes_of = []
        self.ranges = Ranges()
        ids, surfaces = [], []
        for i, (surface, _, byte) in enumerate(vocab):
            self.bytes_of.append(bytes([byte]) if byte >= 0 else surface.replace("▁", " ").encode())
            if byte >= 0:
                self.byte_id[byte] = i
            elif surface:
                ids.append(i)
                surfaces.append(surface)
        lengths = np.array([len(s) for s in surfaces], np.int64)
        self.longest = int(lengths.max())
        cps = np.frombuffer("".join(surfaces).encode("utf-32-le"), "<u4")
        ends = np.cumsum(lengths)
        hashes = self.ranges.of(self.ranges.prefix(mix(cps.astype(U64))), ends - lengths, ends)
        order = np.argsort(hashes)
        self.hashes, self.ids, self.lengths = hashes[order], np.array(ids, np.int64)[order], lengths[order]
        rank = np.maximum(0.0, -np.array([vocab[i][1] for i in ids]))[order]
        self.weights = -theta * np.log1p(rank)
        self.first = np.searchsorted(self.hashes, np.arange(1 << FIRST_BITS, dtype=U64) << U64(64 - FIRST_BITS))
        self.bitmap = np.zeros(1 << BITMAP_BITS, bool)
        self.bitmap[(self.hashes >> U64(64 - BITMAP_BITS)).astype(np.int64)] = True

    def position(self, h: np.ndarray) -> np.ndarray:
        """Where each hash is among the sorted ones, if it is: looked for from the first that has its leading bits."""
        end = len(self.hashes) - 1
        k = np.minimum(self.first[(h >> U64(64 - FIRST_BITS)).astype(np.int64)], end)
        ahead = np.flatnonzero(self.hashes[k] < h)
        while len(ahead):
            k[ahead] += 1
            ahead = ahead[k[ahead] <= end]
            ahead = ahead[self.hashes[k[ahead]] < h[ahead]]
        return np.minimum(k, end)

    def lattice(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The lattices of chunks, which stand in order of falling length.

        Nodes are numbered by position and then by chunk. Returns each position's
        first node, for edges sorted by end node start, piece (or -1 - code point) and
        the share of the end's sum that earlier edges have, each node's first edge
        and the chunks' lengths.
        """
        lens = np.fromiter(map(len, chunks), np.int64, len(chunks))
        cps = code_points("".join(chunks))
        first = np.cumsum(lens) - lens
        deepest = int(lens[0])
        alive = len(lens) - np.searchsorted(lens[::-1], np.arange(deepest + 1), side="left")  # chunks that reach a position
        nodes = np.concatenate([[0], np.cumsum(alive)])
        chunk = np.repeat(np.arange(len(lens)), lens)
        place = np.arange(len(cps)) - first[chunk]
        room = lens[chunk] - place
        prefix = self.ranges.prefix(mix(cps.astype(U64)))
        at = np.arange(len(cps))
        starts, ends, pieces, weights = [], [], [], []
        for n in range(1, min(self.longest, deepest) + 1):
            if n > 1:
                at = at[room[at] >= n]
            h = self.ranges.of(prefix, at, at + n)
            maybe = np.flatnonzero(self.bitmap[(h >> U64(64 - BITMAP_BITS)).astype(np.int64)])
            own = h[maybe]
            k = self.position(own)
            hit = (self.hashes[k] == own) & (self.lengths[k] == n)
            found, k = at[maybe[hit]], k[hit]
            edges = [(found, self.ids[k], self.weights[k])]
            if n == 1:
                bare = np.ones(len(cps), bool)
                bare[found] = False
                bare = np.flatnonzero(bare)
                edges.append((bare, -1 - cps[bare].astype(np.int64), np.full(len(bare), FALLBACK)))
            for pos, piece, weight in edges:
                starts.append(nodes[place[pos]] + chunk[pos])
                ends.append(nodes[place[pos] + n] + chunk[pos])
                pieces.append(piece)
                weights.append(weight)
        start, end, piece, weight = map(np.concatenate, (starts, ends, pieces, weights))
        order = np.argsort(end, kind="stable")
        start, end, piece, weight = start[order], end[order], piece[order], weight[order]
        total = np.zeros(nodes[-1])
        share = np.empty(len(end))
        edge_of = np.concatenate([[0], np.cumsum(np.bincount(end, minlength=nodes[-1]))])  # each node's first edge
        for p in range(1, deepest + 1):
            lo, hi = nodes[p], nodes[p + 1]
            a, b = edge_of[lo], edge_of[hi]
            groups, count = edge_of[lo:hi] - a, np.diff(edge_of[lo : hi + 1])
            x = total[start[a:b]] + weight[a:b]
            top = np.maximum.reduceat(x, groups)
            e = np.exp(x - np.repeat(top, count))
            mass = np.add.reduceat(e, groups)
            total[lo:hi] = top + np.log(mass)
            running = np.cumsum(e) - e
            share[a:b] = (running - np.repeat(running[groups], count)) / np.repeat(mass, count)
        return nodes, start, piece, share, edge_of, lens

    def encode(self, texts: list[str], keys: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's ids end."""
        found = [CHUNK.findall(t) for t in texts]
        per_text = np.fromiter(map(len, found), np.int64, len(found))
        chunks = list(chain.from_iterable(found))
        if not chunks:
            return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        distinct = list(dict.fromkeys(chunks))
        slots = dict(zip(distinct, range(len(distinct))))
        slot = np.fromiter(map(slots.__getitem__, chunks), np.int64, len(chunks))
        by_length = np.argsort([-len(c) for c in distinct], kind="stable")
        nodes, start, piece, share, edge_of, lens = self.lattice([distinct[i] for i in by_length])
        rank = np.empty(len(distinct), np.int64)
        rank[by_length] = np.arange(len(distinct))
        chunk = rank[slot]
        ordinal = np.arange(len(slot)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
        row = mix(np.array([k & MASK for k in keys], U64) ^ U64(self.seed * 0x9E3779B97F4A7C15 & MASK))
        stream = mix(np.repeat(row, per_text) + ordinal.astype(U64))
        node, who = nodes[lens[chunk]] + chunk, np.arange(len(slot))
        n_pieces = np.zeros(len(slot), np.int64)
        drawn: list[tuple[np.ndarray, np.ndarray]] = []
        while len(who):
            u = draws(stream[who], len(drawn))
            edge = last_at_most(share, edge_of[node], edge_of[node + 1], u)
            drawn.append((who, piece[edge]))
            n_pieces[who] += 1
            node = start[edge]
            on = node >= nodes[1]  # nodes of position 0 come first
            node, who = node[on], who[on]
        last = np.cumsum(n_pieces)
        ids = np.empty(int(last[-1]), np.int64)
        for step, (who, p) in enumerate(drawn):  # drawn from the end
            ids[last[who] - 1 - step] = p
        ends = np.concatenate([[0], last])[np.cumsum(per_text)]
        return self._bytes_for_bare(ids, ends)

    def _bytes_for_bare(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bare = np.flatnonzero(ids < 0)
        if not len(bare):
            return ids, ends
        cps = -1 - ids[bare]
        small = cps < 128
        ids[bare[small]] = self.byte_id[cps[small]]
        wide = bare[~small]
        if not len(wide):
            return ids, ends
        spelled = [chr({OWN_MARK: SPACE_MARK, SPACE_MARK: 32}.get(c, c)).encode() for c in cps[~small].tolist()]
        width = np.ones(len(ids), np.int64)
        width[wide] = [len(s) for s in spelled]
        at = np.cumsum(width)
        out = np.repeat(ids, width)
        spots = np.repeat(at[wide] - width[wide], width[wide])
        spots += np.arange(len(spots)) - np.repeat(np.cumsum(width[wide]) - width[wide], width[wide])
        out[spots] = self.byte_id[np.frombuffer(b"".join(spelled), np.uint8)]
        return out, np.concatenate([[0], at])[ends]

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.bytes_of[i] for i in ids]).decode()


OUT = pa.schema([("doc_id", pa.int64()), ("pieces", pa.list_(pa.int32())), ("decoded", pa.string())])


def encode_rows(docs: DataFrame, model_path: str = DEFAULT_MODEL, theta: float = THETA, seed: int = SEED) -> DataFrame:
    """doc_id, pieces (array of ids) and decoded, the text that the pieces spell. One narrow pass over whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(model_path))  # bounded by the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value, theta, seed)
        for batch in slices(batches):
            keys, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            lo = 0
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size < BLOCK_CHARS):
                    size += len(texts[hi] or "")
                    hi += 1
                own = texts[lo:hi]
                ids, ends = codec.encode([t or "" for t in own], [k or 0 for k in keys[lo:hi]])
                offsets = np.concatenate([[0], ends])
                decoded = [None if t is None else codec.decode(ids[a:b].tolist()) for t, a, b in zip(own, offsets, offsets[1:])]
                pieces = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()), mask=pa.array([t is None for t in own]))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pieces, pa.array(decoded, pa.string())], schema=OUT)
                lo = hi

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, pieces array<int>, decoded string")


def decode_rows(encoded: DataFrame, model_path: str = DEFAULT_MODEL) -> DataFrame:
    """doc_id and text from doc_id and pieces."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary(model_path))
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value)
        for batch in slices(batches):
            texts = [None if p is None else codec.decode(p) for p in batch.column("pieces").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], schema=schema)

    return encoded.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("pieces").cast("array<int>").alias("pieces")).mapInArrow(run, "doc_id bigint, text string")


def encode_report(docs: DataFrame, model_path: str = DEFAULT_MODEL) -> DataFrame:
    """doc_id, n_pieces, pieces_sha256 (ids joined by commas) and text_sha256 (of the decoded text) for each row."""
    return encode_rows(docs, model_path).select(
        "doc_id",
        F.coalesce(F.size("pieces"), F.lit(0)).cast("bigint").alias("n_pieces"),
        F.sha2(F.array_join("pieces", ",").cast("binary"), 256).alias("pieces_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("text_sha256"),
    )


def encode_ids(docs: DataFrame, model_path: str = DEFAULT_MODEL) -> DataFrame:
    """What is trained on: doc_id, pieces (array of ids; null for a null text), their number, and text_sha256 of the text that they spell."""
    return encode_rows(docs, model_path).select("doc_id", "pieces", F.coalesce(F.size("pieces"), F.lit(0)).cast("bigint").alias("n_pieces"), F.sha2(F.col("decoded").cast("binary"), 256).alias("text_sha256"))


def load(spark: SparkSession, model_path: str = DEFAULT_MODEL) -> Codec:
    return Codec(vocabulary(model_path))
