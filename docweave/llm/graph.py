"""Near-duplicate vectors over a flat graph: robust pruning on overlapping shards, united adjacency lists, range search from medoids.

1. Equal vectors become one point with a count.
2. Points are dealt to the shards of their ``OVERLAP`` nearest pivots. Pivots are drawn
   from the points themselves and thinned to one a ball, so a dense group isn't torn
   apart; shards beyond ``CAP`` are split again by pivots of their own. What no pivot can split (a ball of near
   copies) is cut into blocks, and every two blocks meet in a task of their own.
3. Each block's graph is built alone: a point's nearest and some random points are
   pruned so that no kept neighbour is nearer to a dropped one by the factor ``ALPHA``.
4. A point's adjacency list is the union of its lists of all shards.
5. In each task every point is searched from the blocks' medoids by a greedy beam; from
   what lies in range (itself among it) the search goes on over all neighbours in range until none is new.
   Every similarity is a double precision product, so found links are verified as they are found.
6. A pair that shares several shards belongs to the least of them, so it counts once. Tasks return a row for
   a point: its number of links there and a representative of what it hangs together with; pairs stay in the task.
7. A sample of ``AUDIT`` points is compared with all points by brute force. While fewer than
   ``RECALL`` of their links were found, all is done again with twice the overlap.

A task holds at most about two blocks (their rows are dealt by hash). Nothing is dropped: no partner, candidate
or bucket has a cap; only graph degrees are bounded, as pruning does.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components link with nothing, as do rows with a null id, whose component is null. Vectors of different
lengths aren't compared. Rows that repeat an id are vectors of their own. Equal vectors
are linked, whatever their rounding. An empty table gives no rows. Labels and other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from docweave.llm.common import drop_path, written
from docweave.llm.components import components

LIKE = 0.95
#: Points in a shard as aimed at, and at most in a block; pivots that one cell is split by; levels of splitting.
TARGET, CAP, PIVOTS, LEVELS = 500, 4096, 4096, 3
#: Shards that a point lies in, and how far alike two pivots may be.
OVERLAP, APART = 4, 0.8
#: Rows of a cell that one task compares with its pivots.
SALT_ROWS = 8192
#: Graph: neighbours kept, nearest and random candidates, pruning factor on squared distances; search: beam and queries at once.
DEGREE, NEAREST, RANDOM, ALPHA, BEAM, QUERIES = 16, 24, 8, 1.44, 8, 256
#: Points of the audit, the recall that it asks for, and the overlap beyond which it isn't repeated.
AUDIT, RECALL, MOST_OVERLAP = 512, 0.98, 16
#: Pairs whose components are fetched at once.
GATHER = 1 << 14


def units(column: pa.Array) -> np.ndarray:
    """A batch's vectors, all of one length, at length one."""
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _products(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty(len(a))
    for k in range(0, len(a), GATHER):
        out[k : k + GATHER] = np.einsum("ij,ij->i", x[a[k : k + GATHER]], x[b[k : k + GATHER]])
    return out


# The graph of a block.


def robust_prune(x: np.ndarray, candidates: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """For each row's candidates (-1: none; one candidate may repeat) those kept, nearest first, -1 behind: a kept one drops all that it is nearer to by alpha."""
    m, c = candidates.shape
    out = np.full((m, degree), -1, np.int64)
    for at in range(0, m, QUERIES):
        own = np.arange(at, min(at + QUERIES, m))
        cand = candidates[own]
        vectors = x[cand]
        far = 2 - 2 * np.einsum("qcd,qd->qc", vectors, x[own])
        far[(cand < 0) | (cand == own[:, None])] = np.inf
        order = np.argsort(far, axis=1, kind="stable")
        far, cand = np.take_along_axis(far, order, 1), np.take_along_axis(cand, order, 1)
        vectors = np.take_along_axis(vectors, order[:, :, None], 1)
        between = 2 - 2 * (vectors @ vectors.transpose(0, 2, 1))
        open_, kept = np.isfinite(far), np.zeros(len(own), np.int64)
        for k in range(c):
            take = open_[:, k] & (kept < degree)
            rows = np.flatnonzero(take)
            out[own[rows], kept[rows]] = cand[rows, k]
            kept[rows] += 1
            open_[rows] &= alpha * between[rows, k] > far[rows]
            open_[rows] &= cand[rows] != cand[rows, k, None]
    return out


def block_graph(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Adjacency (point, DEGREE) of a block: nearest and random points pruned, then once more together with those that point back."""
    m = len(x)
    near = min(NEAREST, m - 1)
    if near < 1:
        return np.full((m, DEGREE), -1, np.int64)
    best = np.empty((m, near), np.int64)
    for at in range(0, m, QUERIES):
        alike = x[at : at + QUERIES] @ x.T
        alike[np.arange(len(alike)), np.arange(at, at + len(alike))] = -np.inf
        best[at : at + QUERIES] = np.argpartition(-alike, near - 1, axis=1)[:, :near]
    some = np.random.default_rng(seed).integers(0, m, (m, RANDOM))
    first = robust_prune(x, np.concatenate((best, some), axis=1))
    source, slot = np.nonzero(first >= 0)
    target = first[source, slot]
    order = np.lexsort((slot, target))  # those that ranked the point highest come first
    source, target = source[order], target[order]
    rank = np.arange(len(target)) - np.searchsorted(target, target)
    back = np.full((m, DEGREE), -1, np.int64)
    few = rank < DEGREE
    back[target[few], rank[few]] = source[few]
    return robust_prune(x, np.concatenate((first, back), axis=1))


def medoid(x: np.ndarray) -> int:
    return int(np.argmax(x @ x.mean(axis=0)))


def range_search(x: np.ndarray, graph: np.ndarray, entries: np.ndarray, like: float = LIKE) -> np.ndarray:
    """Keys a * len(x) + b, a < b, of the pairs of alike points that a search of every point finds."""
    m, found = len(x), []
    for at in range(0, m, QUERIES):
        own = np.arange(at, min(at + QUERIES, m))
        q, rows = len(own), np.arange(len(own))
        seen = np.zeros((q, m), bool)
        seen[rows, own] = True
        nodes = np.tile(entries, (q, 1))
        seen[rows[:, None], nodes] = True
        alike = x[own] @ x[entries].T
        spent = np.zeros(nodes.shape, bool)
        hits = [(rows, own)]
        inside = alike >= like
        hits.append((np.nonzero(inside)[0], nodes[inside]))
        while True:  # greedy: the best node that isn't spent yet, of each query at once
            score = np.where(spent, -np.inf, alike)
            best = score.argmax(axis=1)
            live = np.flatnonzero(np.isfinite(score[rows, best]))
            if not len(live):
                break
            spent[live, best[live]] = True
            next_ = graph[nodes[live, best[live]]]
            fresh = (next_ >= 0) & ~seen[live[:, None], next_]
            a, k = np.nonzero(fresh)
            b = next_[a, k]
            seen[live[a], b] = True  # lists hold no node twice
            values = np.full((q, next_.shape[1]), -np.inf)
            values[live[a], k] = _products(x, own[live[a]], b)
            wide = np.full((q, next_.shape[1]), -1, np.int64)
            wide[live[a], k] = b
            inside = values >= like
            hits.append((np.nonzero(inside)[0], wide[inside]))
            nodes, alike = np.concatenate((nodes, wide), axis=1), np.concatenate((alike, values), axis=1)
            spent = np.concatenate((spent, values == -np.inf), axis=1)
            if nodes.shape[1] > BEAM:
                keep = np.argpartition(-alike, BEAM - 1, axis=1)[:, :BEAM]
                nodes, alike, spent = (np.take_along_axis(v, keep, 1) for v in (nodes, alike, spent))
        a, b = (np.concatenate(v) for v in zip(*hits, strict=True))
        while len(a):  # range: all neighbours of what is in range
            found.append(np.minimum(own[a], b) * m + np.maximum(own[a], b))
            next_ = graph[b]
            i, k = np.nonzero(next_ >= 0)
            key = np.unique(a[i] * m + next_[i, k])
            key = key[~seen[key // m, key % m]]
            a, b = key // m, key % m
            seen[a, b] = True
            near = _products(x, own[a], b) >= like
            a, b = a[near], b[near]
    keys = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return keys[keys // max(m, 1) != keys % max(m, 1)]


# Points, shards and blocks.


def comparable() -> Column:
    """Whether a row can link at all; never null."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))


def points(embeddings: DataFrame) -> tuple[DataFrame, DataFrame, str]:
    """(pid, rep, mult, v) of the different vectors that can link, as a written table; (vec_id, v) of all rows that can; the table's path."""
    single = isinstance(embeddings.schema["embedding"].dataType.elementType, FloatType)  # stored as it comes; sums and products are doubles
    v = F.transform("embedding", lambda x: x.cast("double") + 0.0).cast("array<float>" if single else "array<double>")
    rows = embeddings.where(comparable()).select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v"))
    each = rows.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("mult")).withColumn("pid", F.monotonically_increasing_id())
    out, path = written(each.select("pid", "rep", "mult", "v"), "points")
    return out, rows, path


def _thin(table: pa.Table) -> pa.Table:
    """A cell's pivots, less those that are too like an earlier one."""
    x = units(table.column("v").combine_chunks())
    keep: list[int] = []
    for k in np.argsort(table.column("pid").to_numpy(), kind="stable"):
        if not keep or (x[keep] @ x[k]).max() < APART:
            keep.append(int(k))
    return table.take(pa.array(keep)) if len(keep) > 1 else table.slice(0, 0)


def _nearest_pivots(overlap: int):
    """Batches of cells' pivots, each cell's before its points, to (cell, pid) of the points' new cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pivots, names = None, None, []
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "salt", "kind")], axis=1)
            starts = np.concatenate(([0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(keys)]))
            for lo, hi in zip(starts[:-1], starts[1:], strict=True) if len(keys) else ():
                part, (cell, salt, kind) = batch.slice(lo, hi - lo), keys[lo]
                x = units(part.column("v"))
                if (cell, salt) != now:
                    now, pivots, names = (cell, salt), np.zeros((0, x.shape[1])), []
                pid = part.column("pid").to_numpy()
                if kind == 0:
                    pivots, names = np.concatenate((pivots, x)), np.concatenate((names, pid)).astype(np.int64)
                    continue
                k = min(overlap, max(1, len(names) // 3))
                if len(names) < 2:  # nothing to split by: the cell stays as it is
                    out = np.full((len(x), 1), -1, np.int64)
                else:
                    out = names[np.argpartition(-(x @ pivots.T), k - 1, axis=1)[:, :k]]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(out.size, cell)), pa.array(np.repeat(pid, out.shape[1])), pa.array(out.reshape(-1))], names=["cell", "pid", "pivot"])

    return run


def seats(known: DataFrame, overlap: int = OVERLAP) -> tuple[DataFrame, list[str]]:
    """(cell, pid) of the shards that points lie in, and the tables that this reads."""
    at, paths, settled = known.select(F.size("v").cast("bigint").alias("cell"), "pid", "v"), [], []
    for level in range(LEVELS):
        sizes, path = written(at.groupBy("cell").agg(F.count("*").alias("n")), "sizes")
        paths.append(path)
        settled.append(at.join(sizes.where(F.col("n") <= CAP), "cell", "left_semi").select("cell", "pid"))
        large = sizes.where(F.col("n") > CAP)
        if large.isEmpty():
            break
        salts = F.ceil(F.col("n") / SALT_ROWS)
        rows = at.join(large, "cell").withColumn("salt", F.pmod(F.xxhash64(F.lit("salt"), "pid"), salts))
        want = F.least(F.lit(float(PIVOTS)), F.ceil(F.col("n") / TARGET).cast("double"))
        drawn = F.pmod(F.xxhash64(F.lit(level), "pid"), F.lit(1 << 40)) < want / F.col("n") * float(1 << 40)
        thin = rows.where(drawn).select("cell", "n", "pid", "v").groupBy("cell").applyInArrow(_thin, f"cell bigint, n bigint, pid bigint, v {known.schema['v'].dataType.simpleString()}")
        pivots = thin.select("cell", "pid", "v", F.explode(F.sequence(F.lit(0).cast("bigint"), salts - 1)).alias("salt"), F.lit(0).cast("bigint").alias("kind"))
        both = rows.select("cell", "salt", F.lit(1).cast("bigint").alias("kind"), "pid", "v").unionByName(pivots)
        dealt = both.repartition("cell", "salt").sortWithinPartitions("cell", "salt", "kind").mapInArrow(_nearest_pivots(overlap), "cell bigint, pid bigint, pivot bigint")
        child = F.when(F.col("pivot") < 0, F.col("cell")).otherwise(F.xxhash64("cell", "pivot")).alias("cell")
        after, path = written(dealt.select(child, "pid"), "seats")
        paths.append(path)
        if level + 1 == LEVELS:
            settled.append(after)
        at = after.join(known.select("pid", "v"), "pid").select("cell", "pid", "v")
    out = settled[0]
    for s in settled[1:]:
        out = out.unionByName(s)
    return out, paths


def _blocks(known: DataFrame, placed: DataFrame) -> tuple[DataFrame, str]:
    """(pid, mult, v, cells, cell, block, blocks) of each point in each of its shards, as a written table, and its path."""
    per_cell = placed.groupBy("cell").agg(F.ceil(F.count("*") / CAP).alias("blocks"))
    cells = placed.groupBy("pid").agg(F.array_sort(F.collect_set("cell")).alias("cells"))
    wide = known.select("pid", "mult", "v").join(cells, "pid").withColumn("cell", F.explode("cells"))
    rows = wide.join(per_cell, "cell").withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "pid"), F.col("blocks")))
    return written(rows.select("pid", "mult", "v", "cells", "cell", "block", "blocks"), "blocks")


GRAPH = "pid bigint, near array<bigint>, entry boolean, cell bigint"


def _build(table: pa.Table) -> pa.Table:
    pid = table.column("pid").to_numpy()
    order = np.argsort(pid, kind="stable")  # rows come in any order; the graph shouldn't depend on it
    pid, x = pid[order], units(table.column("v").combine_chunks().take(pa.array(order)))
    graph = block_graph(x, int(pid[0]) & 0xFFFF)
    entry = np.zeros(len(pid), bool)
    entry[medoid(x)] = True
    near = [pid[g[g >= 0]] for g in graph]
    return pa.table({"pid": pid, "near": pa.array(near, pa.list_(pa.int64())), "entry": entry, "cell": np.full(len(pid), table.column("cell")[0].as_py())})


def adjacency(blocks: DataFrame) -> tuple[DataFrame, str]:
    """(pid, near, entry_of): each point's neighbours in the graphs of all its shards, and the shards whose medoid it is."""
    each = blocks.select("cell", "block", "pid", "v").groupBy("cell", "block").applyInArrow(_build, GRAPH)
    united = each.groupBy("pid").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"), F.collect_set(F.when(F.col("entry"), F.col("cell"))).alias("entry_of"))
    return written(united, "adjacency")


def _padded(column: pa.Array, fill: int) -> np.ndarray:
    sizes = column.value_lengths().to_numpy()
    out = np.full((len(column), max(1, int(sizes.max()))), fill, np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = column.flatten().to_numpy()
    return out


def _local(ids: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Neighbours as places in the sorted ids, those elsewhere as -1, in front as far as they go."""
    place = np.minimum(np.searchsorted(ids, near), len(ids) - 1)
    place = np.where(ids[place] == near, place, -1)
    return -np.sort(-place, axis=1)[:, : max(1, int((place >= 0).sum(axis=1).max()))]


def roots(m: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node that each of m hangs together with by the pairs a, b."""
    root = np.arange(m)
    while True:
        least = np.minimum(root[a], root[b])
        after = root.copy()
        np.minimum.at(after, root[a], least)
        np.minimum.at(after, root[b], least)
        np.minimum.at(after, a, least)
        np.minimum.at(after, b, least)
        after = after[after]
        if (after == root).all():
            return root
        root = after


def _search(like: float):
    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("pid").to_numpy(), kind="stable")
        table = table.take(pa.array(order))
        column = lambda c: table.column(c).combine_chunks()
        pid, mult, block, cell = column("pid").to_numpy(), column("mult").to_numpy(), column("block").to_numpy(), table.column("cell")[0].as_py()
        x, m = units(column("v")), len(pid)
        graph = _local(pid, _padded(column("near"), -1))
        entries = np.flatnonzero((_padded(column("entry_of"), cell - 1) == cell).any(axis=1))
        pairs = range_search(x, graph, entries, like)
        a, b = pairs // m, pairs % m
        if table.column("i")[0].as_py() != table.column("j")[0].as_py():  # two blocks: each alone has a task of its own
            across = block[a] != block[b]
            a, b = a[across], b[across]
        cells, mine = _padded(column("cells"), np.iinfo(np.int64).max), np.zeros(len(a), bool)
        for k in range(0, len(a), GATHER):
            own, other = cells[a[k : k + GATHER]], cells[b[k : k + GATHER]]
            shared = (own[:, :, None] == other[:, None, :]).any(axis=2) & (own != np.iinfo(np.int64).max)
            mine[k : k + GATHER] = own[np.arange(len(own)), shared.argmax(axis=1)] == cell
        a, b = a[mine], b[mine]
        n = np.bincount(a, mult[b], m) + np.bincount(b, mult[a], m)
        hit = np.flatnonzero(n)
        root = roots(m, a, b)
        return pa.table({"pid": pid[hit], "n": n[hit].astype(np.int64), "root": pid[root[hit]]})

    return run


def links(known: DataFrame, overlap: int, like: float) -> tuple[DataFrame, str]:
    """(pid, n, root) a row for a point and a shard where it has links: how many, weighed by copies, and the least point that it hangs together with."""
    placed, paths = seats(known, overlap)
    blocks, blocks_path = _blocks(known, placed)
    near, near_path = adjacency(blocks)
    rows = blocks.join(near, "pid").withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    rows = rows.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    found, path = written(rows.select("cell", "i", "j", "block", "pid", "mult", "v", "cells", "near", "entry_of").groupBy("cell", "i", "j").applyInArrow(_search(like), "pid bigint, n bigint, root bigint"), "links")
    for p in (*paths, blocks_path, near_path):
        drop_path(known.sparkSession, p)
    return found, path


def audit(known: DataFrame, found: DataFrame, like: float = LIKE, sample: int = AUDIT) -> tuple[int, int]:
    """Links that a sample of about ``sample`` points has by brute force, and how many of them were found."""
    total = known.count()
    share = min(1.0, sample / max(1, total))
    asked = known.where(F.pmod(F.xxhash64(F.lit("audit"), "pid"), F.lit(1 << 30)) < int(share * (1 << 30))).select("pid", "v").collect()
    by_size: dict[int, tuple[list, list]] = {}
    for r in asked:
        ids, vectors = by_size.setdefault(len(r["v"]), ([], []))
        ids.append(r["pid"])
        vectors.append(r["v"])
    models = {n: (np.array(ids), units(pa.array(vectors, pa.list_(pa.float64())))) for n, (ids, vectors) in by_size.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {n: np.zeros(len(ids), np.int64) for n, (ids, _) in models.items()}
        for batch in batches:
            size, pid, mult = batch.column("v").value_lengths().to_numpy(), batch.column("pid").to_numpy(), batch.column("mult").to_numpy()
            for n in set(size.tolist()) & set(models):
                own = np.flatnonzero(size == n)
                for k in range(0, len(own), 2048):
                    part = own[k : k + 2048]
                    near = (units(batch.column("v").take(pa.array(part))) @ models[n][1].T >= like) & (pid[part][:, None] != models[n][0][None, :])
                    counts[n] += (near * mult[part][:, None]).sum(axis=0)
        out = [(int(i), int(c)) for n, (ids, _) in models.items() for i, c in zip(ids, counts[n], strict=True) if c]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*out, strict=True)], names=["pid", "n"])

    truth = known.select("pid", "mult", "v").mapInArrow(run, "pid bigint, n bigint").groupBy("pid").agg(F.sum("n").alias("n"))
    got = found.groupBy("pid").agg(F.sum("n").alias("got"))
    row = truth.join(got, "pid", "left").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("got"), F.lit(0))).first()
    return int(row[0]), int(row[1])


def near_duplicate_report(embeddings: DataFrame, like: float = LIKE, overlap: int = OVERLAP) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row; found and truth of the audit are the last columns."""
    known, rows, _ = points(embeddings)
    while True:
        found, path = links(known, overlap, like)
        truth, got = audit(known, found, like)
        if got >= RECALL * truth or overlap >= MOST_OVERLAP:
            break
        drop_path(embeddings.sparkSession, path)
        overlap *= 2
    tree, _ = components(found.select(F.col("pid").alias("u"), F.col("root").alias("v")))
    counts = found.groupBy("pid").agg(F.sum("n").alias("n"))
    # A component's root is a point; its id is the least id of any row of any of its points.
    grouped = known.join(tree, F.col("pid") == F.col("node"), "left").select("pid", "rep", "mult", F.coalesce("root", "pid").alias("root"), "v")
    least = grouped.groupBy("root").agg(F.min("rep").alias("component_id"))
    each = grouped.join(least, "root").join(counts, "pid", "left").select("v", "component_id", (F.col("mult") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    same = lambda df: df.withColumn("h", F.xxhash64("v"))  # noqa: E731  a sort by hashes seldom looks at a vector
    linked = same(rows).join(same(each), ["h", "v"]).select("vec_id", "n_links", "component_id")
    alone = embeddings.where(~comparable()).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").cast("bigint").alias("component_id"))
    whole = linked.unionByName(alone)
    return whole.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"), F.lit(truth).cast("bigint").alias("audit_links"), F.lit(got).cast("bigint").alias("audit_found"))
