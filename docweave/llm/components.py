"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import drop_path, written


def _oriented(edges: DataFrame) -> DataFrame:
    """Each edge once, from its larger end u to its smaller end v."""
    return edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang neighbours on the smallest node around: the larger ones (large star), or the smaller ones and the node itself."""
    arcs = edges.select(F.col("u").alias("n"), F.col("v").alias("w"))
    if large:
        arcs = arcs.unionByName(edges.select(F.col("v").alias("n"), F.col("u").alias("w")))
    least = arcs.groupBy("n").agg(F.least(F.min("w"), F.col("n")).alias("m"))
    moved = arcs.join(least, "n")
    out = moved.where("w > n" if large else "true").select(F.col("w").alias("u"), F.col("m").alias("v"))
    if not large:
        out = out.unionByName(least.select(F.col("n").alias("u"), F.col("m").alias("v")))
    return _oriented(out)


def components(edges: DataFrame, rounds: int = 60) -> tuple[DataFrame, str]:
    """(node, root) of every node that has an edge and isn't its root, and the path of this table; edges has long columns u and v.

    root is the component's smallest node. Every round is written to the shared
    folder, so a lost executor costs one round. Groups are only aggregated or
    joined, never gathered.
    """
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    now, path = written(_oriented(edges), "edges")
    seen = mark(now)
    for _ in range(rounds):
        after, new_path = written(_star(_star(now, large=True), large=False), "edges")
        drop_path(edges.sparkSession, path)
        now, path, before, seen = after, new_path, seen, mark(after)
        if seen == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")), path
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def ends_of(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """u, v, root_u and root_v: the edges with their ends' roots by a table (node, root); an end that it lacks is its own."""
    of = lambda end: roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))
    both = edges.join(of("u"), "u", "left").join(of("v"), "v", "left")
    return both.select("u", "v", F.coalesce("root_u", "u").alias("root_u"), F.coalesce("root_v", "v").alias("root_v"))


def widened(roots: DataFrame, path: str, edges: DataFrame) -> tuple[DataFrame, str]:
    """The components of a table (node, root), and its path, once further edges hold; the table at the path given is deleted.

    What is together already isn't contracted again: only the edges' roots are,
    each pair of them once, however many edges lie between two components.
    """
    moved, moved_path = components(ends_of(edges, roots).select(F.col("root_u").alias("u"), F.col("root_v").alias("v")))
    tops = moved.select(F.col("node").alias("root"), F.col("root").alias("top"))
    rest = roots.join(tops, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    # A node that moved was a root or in no component, so it has no row yet.
    out = written(rest.unionByName(moved), "roots")
    for old in (path, moved_path):
        drop_path(edges.sparkSession, old)
    return out
