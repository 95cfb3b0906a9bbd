"""Exact repeats of fixed-length windows of tokens, found without shuffling every window.

Every window of T tokens holds T - G + 1 grams of G tokens; the gram with the
least hash (the leftmost on ties) is its anchor. Equal windows have equal anchors
at equal offsets, and consecutive windows mostly share theirs, so a run of
windows travels as one row: the anchor's hash (``key``), a hash of all tokens
the run covers and of its shape (``ctx``), the document and the place.

Occurrences with the same key and ctx are equal windows throughout: all but the
earliest are repeats. If a key has several ctx (the ends of a repeated passage,
or versions of one), their windows are compared token by token: these few runs
are fetched from the documents and sorted by most-significant-digit radix
passes to depth T, where groups of equal windows remain.

Skew: a map task sends one row for each key and ctx that it has seen, however
often; a key with many ctx in one task is *hot*: its runs go to single windows,
which spread over all tasks by their own hash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import slices, written
from docweave.llm.pieces import Ranges, mix

U64, I64 = np.uint64, np.int64
PLACE_BITS = 20
PLACE_MASK = U64((1 << PLACE_BITS) - 1)
#: Tokens that are hashed together; places within them fit PLACE_BITS.
BLOCK_TOKENS = 1 << 18
#: Rows that a map task resolves together before it sends them.
LOCAL_ROWS = 1 << 20
#: Different runs of one key, in one map task or altogether, beyond which the key is hot.
HOT_LOCAL, HOT = 32, 64
#: Windows of hot keys that a task resolves among themselves before it sends them.
LOCAL_WINDOWS = 1 << 16
#: Runs whose windows are compared in one go.
VERIFY_ROWS = 20_000

ANCHOR, MARK, COVERED, REQUEST, HISTORY = range(5)
#: Bits of a sent row's meta: the run's length below, then its kind, then its place.
KIND_AT, PLACE_AT = 16, 20

Texts = list[tuple[int, bytes]]


@dataclass(frozen=True)
class Spec:
    """Tokens and windows: ``tokens`` gives a 64-bit value for each token of a text; ``cut`` the bytes of a token range, None beyond the text."""

    window: int
    gram: int
    tokens: Callable[[bytes], np.ndarray]
    cut: Callable[[bytes], Callable[[int, int], bytes | None]]
    #: Whether an earlier window of the same document counts.
    within: bool
    #: Digits of windows for the radix passes: from contexts, the digit reader and each context's first place.
    digits: Callable[[list[bytes]], tuple[Callable[[np.ndarray, int], np.ndarray], np.ndarray, int]]

    def __post_init__(self) -> None:
        if not 1 <= self.gram <= self.window or self.reach >= 1 << KIND_AT:
            raise ValueError(f"a window of {self.window} tokens with grams of {self.gram}: runs would be longer than {(1 << KIND_AT) - 1} windows, or none")

    @property
    def reach(self) -> int:
        return self.window - self.gram + 1


Rows = dict[str, np.ndarray]


def runs_of(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, spec: Spec, ranges: Ranges) -> Rows:
    """Runs of windows with one anchor: piece, place of the first window, run length, key and ctx."""
    n, t, g = len(values), spec.window, spec.gram
    count = n - t + 1
    if count <= 0:
        return {k: np.zeros(0, I64) for k in ("piece", "place", "run", "key", "ctx")}
    prefix = ranges.prefix(values)
    grams = mix((prefix[g:] - prefix[:-g]) * ranges.down[: n - g + 1])
    least, size = (grams & ~PLACE_MASK) | np.arange(len(grams), dtype=U64), 1
    while 2 * size <= spec.reach:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < spec.reach:
        least = np.minimum(least[: len(least) - (spec.reach - size)], least[spec.reach - size :])
    first = np.empty(count, bool)
    first[0] = True
    np.not_equal(least[1:], least[:-1], out=first[1:])
    for cut in (starts, ends - t + 1):  # runs end where a piece's windows do
        first[cut[(cut > 0) & (cut < count)]] = True
    place = np.flatnonzero(first)
    run = np.diff(np.append(place, count))
    piece = np.searchsorted(starts, place, side="right") - 1
    whole = place + t <= ends[piece]
    place, run, piece = place[whole], run[whole], piece[whole]
    at = (least[place] & PLACE_MASK).astype(I64)
    ctx = (prefix[place + run - 1 + t] - prefix[place]) * ranges.down[place]
    ctx = mix(ctx + (at - place).astype(U64) * U64(0xA24BAED4963EE407) + run.astype(U64) * U64(0x9FB21C651E98DF25))
    return {"piece": piece, "place": place, "run": run, "key": grams[at].view(I64), "ctx": ctx.view(I64)}


def pieces_of(texts: Texts, spec: Spec) -> Iterator[tuple[list[np.ndarray], list[tuple[int, int]]]]:
    """Token values in blocks: whole documents, or stretches of long ones that overlap by a window less one token."""
    values, origin, size = [], [], 0
    for doc, text in texts:
        tokens = spec.tokens(text)
        for base in range(0, max(1, len(tokens) - spec.window + 1), BLOCK_TOKENS):
            part = tokens[base : base + BLOCK_TOKENS + spec.window - 1]
            if size and size + len(part) > BLOCK_TOKENS:
                yield values, origin
                values, origin, size = [], [], 0
            if len(part) >= spec.window:
                values.append(part)
                origin.append((doc, base))
                size += len(part)
    if values:
        yield values, origin


def joined(parts: list[Rows]) -> Rows:
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}


def taken(rows: Rows, which: np.ndarray) -> Rows:
    return {k: v[which] for k, v in rows.items()}


def resolve(rows: Rows, within: bool) -> tuple[Rows, np.ndarray]:
    """Rows in order of key, ctx, document and place, and which of them repeat an earlier equal run."""
    order = np.lexsort((rows["place"], rows["doc"], rows["ctx"], rows["key"]))
    rows = taken(rows, order)
    n = len(order)
    head = np.ones(n, bool)
    head[1:] = (rows["key"][1:] != rows["key"][:-1]) | (rows["ctx"][1:] != rows["ctx"][:-1])
    lead = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    later = rows["doc"] > rows["doc"][lead]
    if within:
        later |= (rows["doc"] == rows["doc"][lead]) & (rows["place"] > rows["place"][lead])
    return rows, later


def group_counts(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted keys: each row's group and each group's first row (and the end)."""
    head = np.ones(len(key), bool)
    head[1:] = key[1:] != key[:-1]
    return np.cumsum(head) - 1, np.append(np.flatnonzero(head), len(key))


SENT = pa.schema([(n, pa.int64()) for n in ("key", "ctx", "doc", "meta")])
SENT_DDL = "key bigint, ctx bigint, doc bigint, meta bigint"


def spread(rows: Rows) -> Rows:
    """Rows that need no company, under a key of their document: a hot key's are not all dealt to one task."""
    return rows | {"key": mix(rows["doc"].view(U64)).view(I64)}


def packed(rows: Rows, kind: int) -> pa.RecordBatch:
    meta = (rows["place"] << PLACE_AT) | (kind << KIND_AT) | rows["run"]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (rows["key"], rows["ctx"], rows["doc"], meta)], schema=SENT)


def unpacked(batch: pa.RecordBatch) -> Rows:
    key, ctx, doc, meta = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
    return {"key": key, "ctx": ctx, "doc": doc, "place": meta >> PLACE_AT, "run": meta & ((1 << KIND_AT) - 1), "kind": (meta >> KIND_AT) & 15}


def sent_by_map(spec: Spec) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Map side: documents (doc_id, text) to rows, repeats within the task already resolved."""

    def flush(parts: list[Rows]) -> Iterator[pa.RecordBatch]:
        rows, later = resolve(joined(parts), spec.within)
        yield packed(spread(taken(rows, later)), COVERED)
        rest = taken(rows, ~later)
        group, bounds = group_counts(rest["key"])
        hot = np.diff(bounds) > HOT_LOCAL
        yield packed(taken(rest, ~hot[group]), ANCHOR)
        if hot.any():
            yield packed(spread(taken(rest, hot[group])), REQUEST)
            yield packed(taken(rest, bounds[:-1][hot]), MARK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = Ranges()
        parts, size = [], 0
        for batch in slices(batches):
            texts = [(d, t) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) if t and len(t) >= spec.window]
            for values, origin in pieces_of(texts, spec):
                lens = np.array([len(v) for v in values])
                ends = np.cumsum(lens)
                found = runs_of(np.concatenate(values), ends - lens, ends, spec, ranges)
                doc, base = (np.array(x, I64)[found["piece"]] for x in zip(*origin, strict=True))
                place = found["place"] - (ends - lens)[found["piece"]] + base
                parts.append({"key": found["key"], "ctx": found["ctx"], "doc": doc, "place": place, "run": found["run"]})
                size += len(doc)
                if size >= LOCAL_ROWS:
                    yield from flush(parts)
                    parts, size = [], 0
        if size:
            yield from flush(parts)

    return run


JUDGED = pa.schema([("kind", pa.int8()), ("key", pa.int64()), ("ctx", pa.int64()), ("doc", pa.int64()), ("place", pa.int64()), ("run", pa.int32()), ("hot", pa.bool_())])
JUDGED_DDL = "kind tinyint, key bigint, ctx bigint, doc bigint, place bigint, run int, hot boolean"


def judged(rows: Rows, kind: int, hot: np.ndarray | bool) -> pa.RecordBatch:
    n = len(rows["doc"])
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, kind, np.int8)), pa.array(rows["key"]), pa.array(rows["ctx"]), pa.array(rows["doc"]), pa.array(rows["place"]), pa.array(rows["run"].astype(np.int32)), pa.array(np.broadcast_to(hot, n).copy())],
        schema=JUDGED,
    )


def judge(rows: Rows, spec: Spec, keep_new: bool) -> Iterator[pa.RecordBatch]:
    """Whole key groups: repeats, runs to compare, and what an index adds. History rows are never reported themselves."""
    marked = np.unique(rows["key"][rows["kind"] == MARK])
    fresh = np.unique(rows["key"][(rows["kind"] == MARK) & (rows["run"] != 0)])  # an index keeps marks with a run of 0
    if keep_new and len(fresh):
        yield judged({k: (fresh if k == "key" else np.zeros(len(fresh), I64)) for k in ("key", "ctx", "doc", "place", "run")}, MARK, True)
    rows = taken(rows, rows["kind"] != MARK)
    if not len(rows["key"]):
        return
    rows, later = resolve(rows, spec.within)
    new = rows["kind"] == ANCHOR
    yield judged(taken(rows, later & new), COVERED, False)
    rest, new = taken(rows, ~later), new[~later]
    if keep_new:
        yield judged(taken(rest, new), ANCHOR, False)
    group, bounds = group_counts(rest["key"])
    n = np.diff(bounds)
    heads = rest["key"][bounds[:-1]]
    any_new = np.logical_or.reduceat(new, bounds[:-1])
    is_marked = np.isin(heads, marked)
    several = (n > 1) & any_new
    if not spec.within:
        several &= np.maximum.reduceat(rest["doc"], bounds[:-1]) > np.minimum.reduceat(rest["doc"], bounds[:-1])
    asked = several | (is_marked & (any_new | np.isin(heads, fresh)))
    hot = is_marked | (n > HOT)
    yield judged(taken(rest, asked[group]), REQUEST, hot[group][asked[group]])


def whole_groups(batches: Iterator[pa.RecordBatch], read: Callable[[pa.RecordBatch], Rows], limit: int) -> Iterator[Rows]:
    """Of batches sorted by key: rows in parts of about ``limit`` that never split a key."""
    parts, size = [], 0
    for batch in batches:
        rows = read(batch)
        if not len(rows["key"]):
            continue
        parts.append(rows)
        size += len(rows["key"])
        if size >= limit:
            rows = joined(parts)
            last = int(np.flatnonzero(rows["key"] != rows["key"][-1])[-1]) + 1 if rows["key"][0] != rows["key"][-1] else 0
            if last:
                yield {k: v[:last] for k, v in rows.items()}
            parts = [{k: v[last:] for k, v in rows.items()}]
            size = len(parts[0]["key"])
            limit = max(limit, 2 * size)
    if size:
        yield joined(parts)


def judged_by_key(spec: Spec, keep_new: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Reduce side: rows sorted by key to judged rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed: list[pa.RecordBatch] = []

        def read(batch: pa.RecordBatch) -> Rows:
            rows = unpacked(batch)
            ready = (rows["kind"] == COVERED) | (rows["kind"] == REQUEST)
            for kind, hot in ((COVERED, False), (REQUEST, True)):
                if (own := rows["kind"] == kind).any():
                    passed.append(judged(taken(rows, own), kind, hot))
            return taken(rows, ~ready)

        for rows in whole_groups(batches, read, LOCAL_ROWS // 4):
            yield from passed
            passed.clear()
            yield from judge(rows, spec, keep_new)
        yield from passed

    return run


def by_key(rows: DataFrame) -> DataFrame:
    """Dealt and sorted by key. The number of partitions is the session's, and AQE may merge small ones."""
    return rows.repartition("key").sortWithinPartitions("key")


def radix_groups(digit: Callable[[np.ndarray, int], np.ndarray], place: np.ndarray, group: np.ndarray, passes: int) -> tuple[np.ndarray, np.ndarray]:
    """Most-significant-digit radix sort, limited in depth: which windows are repeated, and their groups.

    Each pass orders the windows of each group by their next digit; a group that
    becomes a single window is dropped, as it can't repeat. After the last pass the
    groups are exactly the sets of equal windows.
    """
    alive = np.arange(len(place))
    for k in range(-1, passes):
        if not len(alive):
            break
        d = digit(place[alive], k) if k >= 0 else group[alive]
        order = np.lexsort((d, group[alive])) if k >= 0 else np.argsort(d, kind="stable")
        alive, d = alive[order], d[order]
        own = group[alive]
        head = np.ones(len(alive), bool)
        head[1:] = (own[1:] != own[:-1]) | (d[1:] != d[:-1])
        label = np.cumsum(head) - 1
        count = np.bincount(label)
        keep = count[label] > 1
        alive = alive[keep]
        group = group.copy() if k < 0 else group
        group[alive] = label[keep]
    return alive, group[alive]


FETCHED = pa.schema([("key", pa.int64()), ("doc", pa.int64()), ("place", pa.int64()), ("run", pa.int32()), ("bytes", pa.binary())])
FETCHED_DDL = "key bigint, doc bigint, place bigint, run int, bytes binary"


def fetched(spec: Spec) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Documents with their requests to the runs' bytes. Windows of hot keys are sent one by one, repeats in the batch resolved here."""

    def sent(out: list[tuple]) -> pa.RecordBatch:
        columns = zip(*out, strict=True) if out else ([] for _ in FETCHED)
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, FETCHED, strict=True)], schema=FETCHED)

    def settled(windows: dict[bytes, tuple[int, int]], covered: set[tuple[int, int]]) -> pa.RecordBatch:
        return sent([(_signed(piece), doc, at, 1, piece) for piece, (doc, at) in windows.items()] + [(doc, doc, at, 1, None) for doc, at in covered])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            windows: dict[bytes, tuple[int, int]] = {}
            covered: set[tuple[int, int]] = set()
            for part in slices(iter([batch]), 256):
                out = []
                for doc, text, requests in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), part.column("requests").to_pylist(), strict=True):
                    cut = spec.cut(text)
                    for r in requests:
                        lo, n = r["place"], r["run"]
                        whole = cut(lo, lo + n - 1 + spec.window)
                        if whole is None:  # another row's place, where rows share a doc_id
                            continue
                        if not r["hot"]:
                            out.append((r["key"], doc, lo, n, whole))
                            continue
                        for at in range(lo, lo + n):
                            piece, here = cut(at, at + spec.window), (doc, at)
                            best = windows.get(piece)
                            if best is None or here < best:
                                windows[piece], here = here, best
                            if here is not None and here != windows[piece]:
                                if spec.within or here[0] > windows[piece][0]:
                                    covered.add(here)
                                else:
                                    out.append((_signed(piece), *here, 1, piece))
                yield sent(out)
                if len(windows) + len(covered) >= LOCAL_WINDOWS:
                    yield settled(windows, covered)
                    windows.clear()
                    covered.clear()
            yield settled(windows, covered)

    return run


def _signed(piece: bytes) -> int:
    h = xxhash.xxh64_intdigest(piece)
    return h - (1 << 64) if h >> 63 else h


RANGES = pa.schema([("doc", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])
RANGES_DDL = "doc bigint, lo bigint, hi bigint"


def compared(spec: Spec) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Fetched runs sorted by key to the token ranges that repeat an earlier window."""

    def ranges(doc: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(place), pa.array(place + spec.window)], schema=RANGES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed: list[pa.RecordBatch] = []

        def read(batch: pa.RecordBatch) -> Rows:
            own = np.array(batch.column("bytes").to_pylist() + [None], object)[:-1]
            rows = {n: batch.column(n).to_numpy(zero_copy_only=False).astype(I64) for n in ("key", "doc", "place", "run")} | {"bytes": own}
            ready = np.array([b is None for b in own], bool)
            if ready.any():
                passed.append(ranges(rows["doc"][ready], rows["place"][ready]))
            return taken(rows, ~ready)

        for rows in whole_groups(batches, read, VERIFY_ROWS):
            yield from passed
            passed.clear()
            digit, base, passes = spec.digits(list(rows["bytes"]))
            n = rows["run"]
            which = np.repeat(np.arange(len(n)), n)
            step = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
            group, _ = group_counts(rows["key"])
            alive, equal = radix_groups(digit, base[which] + step, group[which], passes)
            if not len(alive):
                continue
            doc, place = rows["doc"][which[alive]], (rows["place"][which] + step)[alive]
            found, later = resolve({"key": equal, "ctx": np.zeros(len(equal), I64), "doc": doc, "place": place}, spec.within)
            yield ranges(found["doc"][later], found["place"][later])
        yield from passed

    return run


def compare(requests: DataFrame, docs: DataFrame, spec: Spec) -> DataFrame:
    """(doc, lo, hi) of windows that repeat, from requests (key, doc, place, run, hot) and docs (doc_id, text), ids not null.

    Written, so that the texts and runs that were shuffled for it are gone before the result is joined with the texts.
    """
    wanted = requests.groupBy("doc").agg(F.collect_set(F.struct("key", "place", "run", "hot")).alias("requests"))
    rows = docs.join(wanted, docs["doc_id"] == wanted["doc"]).select("doc_id", "text", "requests").mapInArrow(fetched(spec), FETCHED_DDL)
    return written(by_key(rows).mapInArrow(compared(spec), RANGES_DDL), "verified")[0]


def ranges_of(covered: DataFrame, window: int) -> DataFrame:
    return covered.select("doc", F.col("place").alias("lo"), (F.col("place") + F.col("run") - 1 + window).alias("hi"))


def merged(spans: list[dict], limit: int) -> list[tuple[int, int]]:
    """Sorted maximal ranges, within a text of ``limit`` tokens."""
    out: list[list[int]] = []
    for lo, hi in sorted((s["lo"], min(s["hi"], limit)) for s in spans):
        if lo >= hi:
            continue
        if out and lo <= out[-1][1]:
            out[-1][1] = max(hi, out[-1][1])
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def with_ranges(docs: DataFrame, ranges: DataFrame) -> DataFrame:
    """docs (doc_id, text, ids not null) with spans array<struct<lo, hi>>, null where there are none."""
    gathered = ranges.groupBy("doc").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    return docs.join(gathered, docs["doc_id"] == gathered["doc"], "left").select("doc_id", "text", "spans")


def find_repeats(docs: DataFrame, spec: Spec) -> DataFrame:
    """(doc, lo, hi): token ranges of all windows that also start earlier. docs: doc_id (not null), text (bytes)."""
    sent = docs.mapInArrow(sent_by_map(spec), SENT_DDL)
    table, _ = written(by_key(sent).mapInArrow(judged_by_key(spec), JUDGED_DDL).drop("ctx"), "repeats")
    covered = ranges_of(table.where(F.col("kind") == COVERED), spec.window)
    return covered.unionByName(compare(table.where(F.col("kind") == REQUEST), docs, spec))
