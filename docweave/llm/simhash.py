"""SimHash near-duplicates by multi-index hashing.

Fingerprints are 64 bits wide and link at ``RADIUS`` (2) or fewer differing
bits. A fingerprint is cut into two segments of 32 bits, each with a table keyed
by its value. Two fingerprints within distance 2 have high segments within
distance 1, or else equal low ones: so a fingerprint looks up the ball of radius
1 around its high segment and the ball of radius 0, the value itself, around its
low one. Of a ball only the values with one more bit set are enumerated, as the
other fingerprint of such a pair finds this one's value in its own. What the
tables hold there are candidates; the complete distance of each is verified
within the join, so only links become rows. Copies share one fingerprint, hence
one entry, and a segment's bucket holds distinct fingerprints alone.

Defined results: null or wordless text has fingerprint zero, linked like any
other; rows that repeat a doc_id each keep their own fingerprint; a null doc_id
has the component of its fingerprint's other rows (null if all their ids are
null); an empty table gives no row; very long texts are read whole, their hashes
counted in blocks; other columns, whatever their names, are ignored, and
``keep_one_of_each`` hands them on. Ids are whole numbers; others raise Spark's
cast error.

Fingerprints of 3 words and 2 bits are op9's contract. The pipeline's stage asks for
more (``near_duplicates``): documents whose sets of 5-word shingles have a
Jaccard similarity of ``SIMILARITY`` or more. At the threshold one bit in 6.6 differs,
so the stage's fingerprints are wider: ``STAGE_SEGMENTS`` segments of
``STAGE_BITS`` bits, each with a table, looked up by the ball of radius 1. What
they lead to is confirmed on the whole sets. Segments that all differ in two bits
or more hide a pair, so what the tables leave in several components is met again
by MinHash bands (a pair at the threshold shares none with a chance of 5e-9, a
closer pair with less) and then by an exact join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import documents, drop_path, each_batch, free_name, mark, rows_out, slices, written
from docweave.llm.components import components, ends_of, widened

SHINGLE = 3
SEED = 42
RADIUS = 2
SEGMENT_BITS = 32
#: Shingle hashes are counted in blocks of so many.
COUNT_BLOCK = 1 << 14
#: The stage's shingles, and its least similarity as a fraction.
STAGE_SHINGLE = 5
SIMILARITY = (4, 5)
#: Of each set so many keys, each of so many least values: (1 - 0.8 ** 5) ** 48 is the chance that a pair at 0.8 shares none.
BANDS, BAND_ROWS = 48, 5
_DRAW = np.random.default_rng(SEED)
#: Odd factors permute the 64-bit hashes; a band's key is a sum of products with its own factors.
PERMUTE = _DRAW.integers(0, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BAND_KEY = _DRAW.integers(0, 1 << 63, (BANDS, BAND_ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Words of 64 bits of a set's parities, by which the exact join bounds how much two sets can have in common.
PARITY_WORDS = 16
#: Hashes are permuted in blocks of so many, texts taken so many at a time.
PERMUTE_BLOCK, STAGE_ROWS = 256, 128
#: The stage's fingerprint: segments, bits of each, and the words of 64 bits that hold them and one further word.
STAGE_SEGMENTS, STAGE_BITS, STAGE_WORDS = 8, 24, 4
#: Odd factors give the words their own hashes; byte lanes count so many bits without a carry.
WORD_HASH = _DRAW.integers(0, 1 << 63, STAGE_WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LANE_BLOCK = 255
#: Last words, of which no segment is cut, that differ in more bits of 64 are no candidates: a pair at the threshold differs in 10, in more than 20 with a chance of 4e-4.
WORD_RADIUS = 20
#: Nor are whole fingerprints that differ in more bits of 256: a pair at the threshold differs in 39, in more than 64 with a chance of 1e-5.
STAGE_RADIUS = 64
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_hashes(text: bytes | None, shingle: int = SHINGLE) -> list[int]:
    words = text.translate(LOWER).split() if text else []
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) < shingle:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a : b - 1], SEED) for a, b in zip(starts, starts[shingle:])]


def fingerprint(text: bytes | None) -> int:
    """Bit j is 1 if it is set in more than half of the shingles' hashes."""
    hashes = np.array(shingle_hashes(text), dtype="<u8")
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), COUNT_BLOCK):
        part = hashes[k : k + COUNT_BLOCK].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


PRINTS = pa.schema([("doc_id", pa.int64()), ("mark", pa.binary()), ("fp", pa.int64())])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, mark and fp, the fingerprint's bits as a signed long."""
    run = lambda b: rows_out({"doc_id": b.column("doc_id"), "mark": b.column("mark"), "fp": np.array([fingerprint(t) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)}, PRINTS)
    return documents(docs).withColumn("mark", mark()).mapInArrow(each_batch(run), "doc_id bigint, mark binary, fp bigint")


def segment_tables(distinct: DataFrame) -> DataFrame:
    """The entries of both tables: segment (0 high, 1 low), value, fp and node."""
    high, low = F.shiftrightunsigned("fp", SEGMENT_BITS), F.col("fp").bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1))
    return distinct.select("fp", "node", F.posexplode(F.array(high, low)).alias("segment", "value"))


def balls(distinct: DataFrame) -> DataFrame:
    """What each fingerprint looks up, in the same columns and ``near``: whether the value is one bit away."""
    entries = segment_tables(distinct)
    bit = F.explode(F.sequence(F.lit(0), F.lit(SEGMENT_BITS - 1)))
    flipped = F.col("value").bitwiseOR(F.expr("shiftleft(1L, bit)"))
    around = entries.where("segment = 0").select("*", bit.alias("bit")).select("fp", "node", "segment", F.col("value").alias("own"), flipped.alias("value")).where("own <> value")
    return entries.select("fp", "node", "segment", "value", F.lit(False).alias("near")).unionByName(around.select("fp", "node", "segment", "value", F.lit(True).alias("near")))


def links(distinct: DataFrame) -> DataFrame:
    """Links (u, v) between the nodes of a table (fp, node) with distinct fp: all pairs within RADIUS."""
    ask, held = balls(distinct).alias("a"), segment_tables(distinct).alias("b")
    once = F.col("a.near") | (F.col("a.fp") < F.col("b.fp"))
    close = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= RADIUS
    met = ask.join(held, (F.col("a.segment") == F.col("b.segment")) & (F.col("a.value") == F.col("b.value")) & once & close)
    return met.select(F.col("a.node").alias("u"), F.col("b.node").alias("v"))


def fingerprint_groups(docs: DataFrame) -> DataFrame:
    """doc_id, mark, fp, group and component_id by op9's contract, a row for each row of docs; rows of one fingerprint are a group."""
    prints, _ = written(fingerprints(docs), "fingerprints")
    # A class whose ids are all null has no id to be known by: it links to nothing.
    nodes, _ = written(prints.groupBy("fp").agg(F.min("doc_id").alias("node")), "classes")
    known = nodes.where(F.col("node").isNotNull())
    roots, _ = components(links(known))
    labels = known.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    return prints.join(labels, "fp", "left").select("doc_id", "mark", "fp", F.col("fp").alias("group"), "component_id")


def near_duplicate_report(docs: DataFrame) -> DataFrame:
    """The contract's columns: doc_id, fingerprint in hex and component_id."""
    return fingerprint_groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_set(text: bytes | None) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, STAGE_SHINGLE), dtype="<u8"))


def set_print(shingles: np.ndarray) -> int:
    """The set's own name, by which equal sets are one entry."""
    return xxhash.xxh64_intdigest(shingles.tobytes(), SEED)


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """The set's keys, none for the empty set. Sets that share a key are candidates."""
    if not len(shingles):
        return np.zeros(0, np.uint64)
    least = np.full(len(PERMUTE), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingles), PERMUTE_BLOCK):
        np.minimum(least, np.multiply.outer(shingles[k : k + PERMUTE_BLOCK], PERMUTE).min(axis=0), out=least)
    return (least.reshape(BANDS, BAND_ROWS) * BAND_KEY).sum(axis=1, dtype=np.uint64)


def parities(shingles: np.ndarray) -> np.ndarray:
    """Bit k is 1 if an odd number of shingles falls to k. Two sets' bits differ in no more places than the sets have shingles apart."""
    odd = np.bincount((shingles % np.uint64(64 * PARITY_WORDS)).astype(np.int64), minlength=64 * PARITY_WORDS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def stage_fingerprint(shingles: np.ndarray) -> np.ndarray:
    """The stage's bits (0 or 1): bit j of a word is 1 if it is set in more than half of the shingles' hashes for that word."""
    hashes = np.multiply.outer(shingles, WORD_HASH)
    hashes ^= hashes >> np.uint64(32)
    hashes *= WORD_HASH
    counts = np.zeros(64 * STAGE_WORDS, np.int64)
    for k in range(0, len(hashes), LANE_BLOCK):
        bits = np.unpackbits(hashes[k : k + LANE_BLOCK].view(np.uint8), axis=1, bitorder="little")
        counts += bits.view(np.uint64).sum(axis=0, dtype=np.uint64).view(np.uint8)
    return (2 * counts > len(shingles)).astype(np.uint8)


def segment_values(bits: np.ndarray) -> np.ndarray:
    """Each segment's value, with the segment's number above it."""
    values = bits[: STAGE_SEGMENTS * STAGE_BITS].reshape(STAGE_SEGMENTS, STAGE_BITS).astype(np.int64) @ (1 << np.arange(STAGE_BITS, dtype=np.int64))
    return values + (np.arange(STAGE_SEGMENTS) << STAGE_BITS)


BANDED = pa.schema([("doc_id", pa.int64()), ("mark", pa.binary()), ("fp", pa.int64()), ("print", pa.list_(pa.int64())), ("segments", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64()))])
BANDED_SQL = "doc_id bigint, mark binary, fp bigint, print array<bigint>, segments array<bigint>, keys array<bigint>"
SETS = pa.schema([("fp", pa.int64()), ("shingles", pa.list_(pa.int64())), ("parity", pa.list_(pa.int64()))])
signed = lambda values: np.array(values, np.uint64).view(np.int64)


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, STAGE_ROWS):
        sets = [shingle_set(t) for t in b.column("text").to_pylist()]
        bits = [stage_fingerprint(s) for s in sets]
        prints = np.packbits(np.array(bits), axis=1, bitorder="little").view(np.int64)
        # The empty set is one entry and similar to no other.
        segments = [segment_values(f) if len(s) else [] for f, s in zip(bits, sets)]
        yield rows_out({"doc_id": b.column("doc_id"), "mark": b.column("mark"), "fp": signed([set_print(s) for s in sets]), "print": list(prints), "segments": segments, "keys": [signed(band_keys(s)) for s in sets]}, BANDED)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, STAGE_ROWS):
        sets = [shingle_set(t) for t in b.column("text").to_pylist()]
        yield rows_out({"fp": signed([set_print(s) for s in sets]), "shingles": [signed(s) for s in sets], "parity": [parities(s) for s in sets]}, SETS)


def segment_pairs(nodes: DataFrame) -> DataFrame:
    """Candidates (u, v) by multi-index hashing of a table (fp, print, segments).

    As in ``links``, but a value's entry in the table is the least set that has it,
    so that a large group meets one set and not each other. The last word's distance
    is verified in the join, the complete one after it.
    """
    entries = nodes.select("fp", F.col("print")[STAGE_WORDS - 1].alias("word"), F.explode("segments").alias("value"))
    held = entries.groupBy("value").agg(F.min("fp").alias("least"), F.min_by("word", "fp").alias("least_word"))
    bits = F.sequence(F.lit(0), F.lit(STAGE_BITS - 1))
    ball = F.transform(bits, lambda k: F.col("value").bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), k)))
    ask = entries.select("fp", "word", F.explode(F.array_distinct(F.concat(F.array("value"), ball))).alias("value"))
    close = F.bit_count(F.col("word").bitwiseXOR(F.col("least_word"))) <= WORD_RADIUS
    met = ask.alias("a").join(held.hint("shuffle_hash").alias("b"), (F.col("a.value") == F.col("b.value")) & (F.col("fp") != F.col("least")) & close)
    pairs = met.select(F.greatest("fp", "least").alias("u"), F.least("fp", "least").alias("v")).distinct()
    side = lambda end: nodes.select(F.col("fp").alias(end), F.col("print").alias(f"of_{end}"))
    differ = sum((F.bit_count(F.col("of_u")[k].bitwiseXOR(F.col("of_v")[k])) for k in range(STAGE_WORDS)), F.lit(0))
    return pairs.join(side("u"), "u").join(side("v"), "v").where(differ <= STAGE_RADIUS).select("u", "v")


def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (u, v) whose ends lie in different components, by a table (node, root)."""
    return ends_of(pairs.distinct(), roots).where("root_u <> root_v").select("u", "v")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) of sets (fp, shingles) that are similar enough, counted on the whole sets."""
    part, whole = SIMILARITY
    side = lambda end: sets.select(F.col("fp").alias(end), F.col("shingles").alias(f"of_{end}"))
    both = pairs.distinct().join(side("u"), "u").join(side("v"), "v")
    common = F.size(F.array_intersect("of_u", "of_v"))
    return both.where((part + whole) * common >= part * (F.size("of_u") + F.size("of_v"))).select("u", "v")


def met_least(rows: DataFrame, by: str) -> DataFrame:
    """The rows whose value of ``by`` others share, with their number (size) and the least fp of them (least).

    Values are counted where they are and then joined: a hot value's rows are
    never gathered, and Spark can split the join. Its smaller side is hashed, so
    the rows aren't sorted.
    """
    least = rows.groupBy(by).agg(F.count("*").alias("size"), F.min("fp").alias("least")).where("size > 1")
    return rows.join(least.hint("shuffle_hash"), by)


def rare_shingles(sets: DataFrame, wanted: DataFrame) -> DataFrame:
    """fp, n, shingle and at: of each wanted set's n shingles, from the rarest on, those in its prefix that other wanted sets have too.

    Two sets that are similar enough share a shingle of their prefixes, whose
    length is n - ceil(SIMILARITY n) + 1 (prefix filtering). Passages that many
    documents have are not rare, so they lead nobody together, and a set with
    more shingles of its own than its prefix is long meets no other set.
    """
    part, whole = SIMILARITY
    rows = sets.join(wanted, "fp", "left_semi").select("fp", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    shared = rows.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1")
    own = rows.join(shared, "shingle").groupBy("fp", "n").agg(F.array_sort(F.collect_list(F.struct("df", "shingle"))).alias("s"))
    alone = F.col("n") - F.size("s")
    length = (F.col("n") - F.ceil(F.col("n") * part / whole) + 1 - alone).cast("int")
    prefix = own.where(length > 0).select("fp", "n", alone.alias("alone"), F.posexplode(F.slice("s", 1, length)).alias("k", "s"))
    return prefix.select("fp", "n", F.col("s.shingle").alias("shingle"), (F.col("alone") + F.col("k")).alias("at"))


def sides(rare: DataFrame, roots: DataFrame, sets: DataFrame) -> DataFrame:
    """The rows of ``rare_shingles`` whose shingle lies in several components, with root and parity, and main: whether the shingle's largest component holds the set."""
    rows = rare.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    each = rows.groupBy("shingle", "root").agg(F.count("*").alias("of_root"))
    several = each.groupBy("shingle").agg(F.max_by("root", "of_root").alias("largest"), F.count("*").alias("n_roots")).where("n_roots > 1")
    rows = rows.join(several, "shingle").join(sets.select("fp", "parity"), "fp")
    return rows.select("fp", "n", "shingle", "at", "root", "parity", (F.col("root") == F.col("largest")).alias("main"))


def still_apart(rows: DataFrame) -> DataFrame:
    """Candidates (u, v): sets of different components that share a shingle of the prefix and can be similar enough.

    A shingle's largest component isn't joined with itself, only the other sets with
    it and with each other. Two bounds, neither of which leaves out a pair, are part
    of the join: the shingles from here on, if this is the first in common, and the
    parities, which tell how many the sets have apart at least.
    """
    part, whole = SIMILARITY
    a, b = rows.where("not main").alias("a"), rows.alias("b")
    both = F.col("a.n") + F.col("b.n")
    reach = F.least(F.col("a.n") - F.col("a.at"), F.col("b.n") - F.col("b.at"))
    differ = sum((F.bit_count(F.col("a.parity")[k].bitwiseXOR(F.col("b.parity")[k])) for k in range(PARITY_WORDS)), F.lit(0))
    once = F.col("b.main") | (F.col("a.fp") > F.col("b.fp"))
    meet = (F.col("a.shingle") == F.col("b.shingle")) & (F.col("a.root") != F.col("b.root")) & once & ((part + whole) * reach >= part * both) & ((part + whole) * differ <= (whole - part) * both)
    return a.join(b, meet).select(F.greatest("a.fp", "b.fp").alias("u"), F.least("a.fp", "b.fp").alias("v"))


def set_components(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, root) of the sets of a table (fp, print, segments, keys, node) that are linked to a smaller one.

    First each set meets the least of what its fingerprint's segments lead to,
    then the others that this leaves in different components: a large group's sets
    lead to many of each other, but seldom need more than one. Where segments
    leave the sets of a MinHash bucket in several components, each meets the
    bucket's least one. Sets of a bucket that are still in several go on to an
    exact join by rare shingles: there again each set meets the least set of each
    of its shingles, and then those of other components that share a shingle of
    the prefix and can still reach the similarity from its place. So a large group
    of copies is never listed pair by pair and no pair is left out. Each step's
    links widen the components of the steps before.
    """
    met, met_path = written(segment_pairs(nodes), "met")
    keyed = nodes.select("fp", F.explode("keys").alias("key"))
    shared, shared_path = written(met_least(keyed, "key"), "buckets")
    wanted = shared.select("fp").union(met.select("u")).union(met.select("v")).distinct().join(nodes, "fp").select(F.col("node").alias("doc_id")).distinct()
    sets, sets_path = written(documents(docs).join(wanted, "doc_id", "left_semi").mapInArrow(_sets, "fp bigint, shingles array<bigint>, parity array<bigint>").dropDuplicates(["fp"]), "sets")
    roots, roots_path = components(confirmed(met.groupBy("u").agg(F.min("v").alias("v")), sets))
    roots, roots_path = widened(roots, roots_path, confirmed(apart(met, roots), sets))
    buckets = shared.where("fp <> least").select(F.col("fp").alias("u"), F.col("least").alias("v"))
    roots, roots_path = widened(roots, roots_path, confirmed(apart(buckets, roots), sets))
    left = shared.where("size > 2").join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("key", "fp", F.coalesce("root", "fp").alias("root"))
    mixed = left.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
    left = left.join(mixed, "key", "left_semi").select("fp").distinct()
    rare, rare_path = written(rare_shingles(sets, left), "rare")
    star = met_least(rare, "shingle").where("fp <> least").select(F.col("fp").alias("u"), F.col("least").alias("v"))
    roots, roots_path = widened(roots, roots_path, confirmed(apart(star, roots), sets))
    open_, open_path = written(sides(rare, roots, sets), "open")
    roots, _ = widened(roots, roots_path, confirmed(still_apart(open_), sets))
    for path in (met_path, shared_path, sets_path, rare_path, open_path):
        drop_path(docs.sparkSession, path)
    return roots


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, mark, fp (of the shingle set), group and component_id by the stage's similarity, a row for each row of docs; components that share an id are several groups."""
    prints, _ = written(documents(docs).withColumn("mark", mark()).mapInArrow(_banded, BANDED_SQL), "bands")
    nodes, nodes_path = written(prints.groupBy("fp").agg(F.min("doc_id").alias("node"), *(F.first(c).alias(c) for c in ("print", "segments", "keys"))), "nodes")
    # Sets are linked under their own names, as ids may repeat; the component's id is its least document's.
    roots = set_components(docs, nodes.where(F.col("node").isNotNull()))
    labels = nodes.select("fp", "node").join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "node", F.coalesce("root", "fp").alias("root"))
    least = labels.groupBy("root").agg(F.min("node").alias("component_id"))
    labels = labels.join(least, "root").select("fp", F.col("root").alias("group"), "component_id")
    return prints.select("doc_id", "mark", "fp").join(labels, "fp", "left").select("doc_id", "mark", "fp", "group", "component_id")


def keep_one_of_each(docs: DataFrame, groups: Callable[[DataFrame], DataFrame] = fingerprint_groups) -> DataFrame:
    """The documents with one row of each group of near-duplicates, that of the smallest id.

    Of a group's rows that repeat this id one stays, that of the smallest mark: an
    id that several groups know keeps a row for each. Rows with a null id belong to
    no group and stay. The join's partitioning also serves the last step.
    """
    known = docs.where("doc_id is not null")
    own = groups(known).where("doc_id = component_id").groupBy("group").agg(F.min(F.struct("doc_id", "mark")).alias("own"))
    kept = own.select(F.col("own.doc_id").alias("__kept"), F.col("own.mark").alias("__mark")).distinct()
    said = free_name(docs, "__text")
    rows = known.withColumn(said, mark())
    rows = rows.join(kept, (rows["doc_id"] == kept["__kept"]) & (rows[said] == kept["__mark"]), "left_semi").dropDuplicates(["doc_id", said]).drop(said)
    return rows.unionByName(docs.where("doc_id is null"))
