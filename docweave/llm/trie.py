"""Conversation prefix trie, summed up by leaf-peeling message passing.

A node is a distinct sequence of first turns; its members are the conversations
that start with it. A turn counts by the SHA-256 of its role and text, a prefix by
two running sums, of 62 bits each, of its turns' hashes salted by place: so a
conversation of any length is scanned in pieces by many tasks (``running``). Two
different prefixes are taken for one only if both sums agree, for n nodes by chance about n^2 / 2^125.

Peeling works on chains. A node belongs to the chain of its member with the
least hash: a chain is a path that ends where that member does, so its top's
subtree total is the sum over its nodes and over the chains that hang on them.
Each chain holds a counter of the chains that hang on it and aren't finished; in a
round those whose counter is zero send their totals, added up by receiver, and the
others take them in and count down, until only the root's chain is left and
finishes. Which members lead is as good as random, so along a path the chain
changes about ln(members) times at most, however deep the trie is. At last each node's
own total is the running sum of its chain from below.

A node's member list may hold most conversations: its ids are joined in blocks of
1,024 neighbouring ids, and the digest streams over a node's blocks in order.

Defined results: turns are ordered by turn (null first), role and the digest; null
role or text is empty; rows that repeat a turn are each a turn; rows with a null
conv_id belong to no conversation and are left out; empty and very long texts count
like any other; an empty table has no node, not even a root. Other columns, whatever
their names, are ignored. Ids and turns are whole numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import written
from docweave.llm.running import forget, running

WORD = r"[^ \x09-\x0D]+"
BITS = 62
MASK = (1 << BITS) - 1
#: Neighbouring ids in a block are this power of two; it changes no result.
BLOCK_BITS = 10
NODE = ("depth", "h1", "h2")


def ranked(conversations: DataFrame) -> tuple[DataFrame, str]:
    """(conv_id, place, digest, words) of every turn, as a written table, and its path. Texts don't travel, only their digests."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    words = F.regexp_count(text, F.lit(WORD)).cast("bigint")
    slim = conversations.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), role.alias("role"), digest.alias("digest"), words.alias("words"))
    # The row's number parts equal rows, so that even a turn that is most of the table can be cut into ranges.
    rows, path = written(slim.withColumn("row", F.monotonically_increasing_id()), "turns")
    out, ranked_path = running(rows, "conv_id", ["turn", "role", "digest", "row"], label="ranked")
    forget(conversations, path)
    return out.select("conv_id", "place", "digest", "words"), ranked_path


def as_given(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, pos, digest, words, last) and conversations (conv_id, length) as they are."""
    lengths = turns.groupBy("conv_id").agg(F.max("place").alias("length"))
    rows = turns.join(lengths, "conv_id").select("conv_id", F.col("place").alias("pos"), "digest", "words", (F.col("place") == F.col("length")).alias("last"))
    return rows, lengths


def shared_heads(turns: DataFrame, group: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt on their group's head: c takes the first crc32(c) % most turns of c - c % group, then its own after as many."""
    lengths = turns.groupBy("conv_id").agg(F.max("place").alias("n"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("bigint")
    convs = lengths.select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("base"))
    bases = lengths.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    took = F.least("h", F.coalesce("base_n", F.lit(0))).cast("bigint")
    convs = convs.join(bases, "base", "left").select("conv_id", "base", "h", took.alias("took"), (took + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))
    heads = turns.where((F.col("conv_id") % group == 0) & (F.col("place") < most)).select(F.col("conv_id").alias("base"), F.col("place").alias("pos"), "digest", "words")
    taken = convs.join(heads, "base").where("pos <= took").select("conv_id", "pos", "digest", "words", (F.col("pos") == F.col("length")).alias("last"))
    pos = F.col("place") - F.col("h") + F.col("took")
    own = turns.join(convs, "conv_id").where("place > h").select("conv_id", pos.alias("pos"), "digest", "words", (pos == F.col("length")).alias("last"))
    return taken.unionByName(own), convs.select("conv_id", "length")


def _ends(ends: DataFrame) -> DataFrame:
    """(depth, h1, h2, ends_sha256) of ends (depth, h1, h2, conv_id): the digest streams over blocks of ids in ascending order."""
    each = ends.groupBy(*NODE, F.shiftright("conv_id", BLOCK_BITS).alias("block")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, names = None, hashlib.sha256(), [*NODE, "ends_sha256"]
        out: list[tuple] = []
        for batch in batches:
            for *node, ids in zip(*(batch.column(c).to_pylist() for c in (*NODE, "ids")), strict=True):
                if node == key:
                    digest.update(b",")
                else:
                    if key is not None:
                        out.append((*key, digest.hexdigest()))
                    key, digest = node, hashlib.sha256()
                digest.update(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=names)
                out = []
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, digest.hexdigest())], names=names)

    return each.repartition(*NODE).sortWithinPartitions(*NODE, "block").mapInArrow(run, "depth bigint, h1 bigint, h2 bigint, ends_sha256 string")


def _chain_first(chain: Column) -> Column:
    return F.col("parent_chain").isNull() | (F.col("parent_chain") != chain)


def peel(tree: DataFrame) -> tuple[DataFrame, list[str]]:
    """(chain, depth, leaves, saved): what chains that hang on a node bring to it, added up; and the tables that this reads.

    tree has depth, chain, parent_chain, leaves and saved of each node by itself. A
    round reads and writes the chains that aren't finished, a row each; finished ones stay where they are.
    """
    first = _chain_first(F.col("chain"))
    total = [F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")]
    each = tree.groupBy("chain").agg(*total, F.max(F.when(first, F.col("parent_chain"))).alias("up"), F.max(F.when(first, F.col("depth") - 1)).alias("at"))
    hanging = tree.where(first & F.col("parent_chain").isNotNull()).groupBy("parent_chain").agg(F.count("*").alias("open"))
    state, path = written(each.join(hanging, F.col("chain") == F.col("parent_chain"), "left").select("chain", "up", "at", "leaves", "saved", F.coalesce("open", F.lit(0)).cast("bigint").alias("open")), "chains")
    finished, paths = [], [path]
    while not state.isEmpty():
        done = state.where("open = 0")
        finished.append(done.where("up is not null").select(F.col("up").alias("chain"), F.col("at").alias("depth"), "leaves", "saved"))
        news = done.groupBy("up").agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"), F.count("*").alias("closed")).withColumnRenamed("up", "to")
        more = lambda c, m: (F.col(c) + F.coalesce(m, F.lit(0))).alias(c)
        rest = state.where("open > 0").join(news, F.col("chain") == F.col("to"), "left")
        state, path = written(rest.select("chain", "up", "at", more("leaves", "more_leaves"), more("saved", "more_saved"), (F.col("open") - F.coalesce("closed", F.lit(0))).alias("open")), "chains")
        paths.append(path)
    if not finished:
        return tree.limit(0).select("chain", "depth", "leaves", "saved"), paths
    return reduce(DataFrame.unionByName, finished).groupBy("chain", "depth").agg(*total), paths


def build(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row for each node of the trie of turns (conv_id, pos, digest, words, last) and convs (conv_id, length), with trie_report's columns."""
    salted = lambda n: F.xxhash64(F.lit(n), F.col("pos"), F.col("digest")).bitwiseAND(F.lit(MASK)).alias(f"t{n}")
    rows, rows_path = written(turns.select("conv_id", "pos", "words", "last", salted(1), salted(2)), "salted")
    paths, paths_path = running(rows, "conv_id", ["pos"], ["t1", "t2"], bits=BITS, label="prefixes")
    forget(turns, rows_path)
    back = lambda n: (F.col(f"sum_t{n}") - F.col(f"t{n}")).bitwiseAND(F.lit(MASK)).alias(f"p{n}")
    nothing = F.lit(0).cast("bigint")
    at = paths.select(F.col("pos").alias("depth"), F.col("sum_t1").alias("h1"), F.col("sum_t2").alias("h2"), back(1), back(2), "conv_id", "words", "last")
    root = convs.select(nothing.alias("depth"), nothing.alias("h1"), nothing.alias("h2"), nothing.alias("p1"), nothing.alias("p2"), "conv_id", nothing.alias("words"), (F.col("length") == 0).alias("last"))
    members = at.unionByName(root)
    grouped = members.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min(F.xxhash64("conv_id")).alias("chain"), F.min("words").alias("words"), F.min("p1").alias("p1"), F.min("p2").alias("p2"))
    nodes, nodes_path = written(grouped, "nodes")
    ends, ends_path = written(_ends(members.where("last").select(*NODE, "conv_id")), "ends")
    forget(turns, paths_path)

    under = nodes.where("depth > 0")
    kids = under.groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("h1"), F.col("p2").alias("h2")).agg(F.count("*").alias("n_children"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("h1").alias("p1"), F.col("h2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), F.col("chain").alias("parent_chain"))
    linked = nodes.join(kids, list(NODE), "left").join(parents, ["depth", "p1", "p2"], "left")
    tree = linked.select(
        *NODE, "conv_id", "chain", "parent_conv_id", "parent_chain", "n_convs", F.coalesce("n_children", nothing).alias("n_children"),
        F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("bigint").alias("leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"),
    )
    tree, tree_path = written(tree, "tree")
    forget(turns, nodes_path)

    brought, chain_paths = peel(tree)
    more = lambda c: (F.col(c) + F.coalesce(F.col(f"more_{c}"), nothing)).alias(c)
    brought = brought.select("chain", "depth", F.col("leaves").alias("more_leaves"), F.col("saved").alias("more_saved"))
    kept = [c for c in tree.columns if c not in ("leaves", "saved")]
    summed, summed_path = written(tree.join(brought, ["chain", "depth"], "left").select(*kept, more("leaves"), more("saved")), "summed")
    forget(turns, tree_path, *chain_paths)
    totals, _ = running(summed, "chain", [F.desc("depth")], ["leaves", "saved"], label="totals")
    forget(turns, summed_path)
    none = hashlib.sha256(b"").hexdigest()
    return totals.join(ends, list(NODE), "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("sum_leaves").alias("n_leaves"), F.col("sum_saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256")
    )


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations as they are: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns, path = ranked(conversations)
    trie = build(*as_given(turns))
    forget(conversations, path)
    return trie


def trie_report(conversations: DataFrame) -> DataFrame:
    """The trie of conversations rebuilt on shared heads."""
    turns, path = ranked(conversations)
    trie = build(*shared_heads(turns))
    forget(conversations, path)
    return trie


def with_turns(trie: DataFrame, conversations: DataFrame) -> DataFrame:
    """A trie of conversations as they are with role, text and words of each node's last turn; null at the root."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    turns, _ = ranked(conversations)
    last = trie.select("conv_id", "depth").join(turns, (F.col("place") == F.col("depth")) & (trie["conv_id"] == turns["conv_id"])).select(trie["conv_id"], "depth", "digest", "words")
    texts = conversations.select(role.alias("role"), text.alias("text"), digest.alias("digest")).dropDuplicates(["digest"])
    return trie.join(last.join(texts, "digest").drop("digest"), ["conv_id", "depth"], "left")
