"""Substring deduplication by a log-structured index of window fingerprints.

Documents arrive in batches, in order of doc_id. The index is a folder of sorted
immutable runs: tables of the fingerprints (anchor key and run hash, see
windows.py) that no earlier document had, dealt by key to a fixed number of
buckets. A batch is fingerprinted and its keys are dealt to the same buckets, so
each run is merge-joined with them where it lies: no run is shuffled. Entries of keys that
the batch has too go on with it and are judged: what an earlier document has is a repeat,
what several versions have is verified word by word, and what is new becomes
the next run. When the runs reach ``FANOUT`` they are merged into one that holds
each fingerprint once, by its smallest doc_id. A manifest names the runs that
count; it is replaced last, so a job that dies leaves the index as it was, and
any later session opens it and goes on.

What the hashes decide: rows of one key are one group, and in it runs with the
same 64-bit run hash count as equal without a look at their words. Groups with
several run hashes are verified word by word.

Defined results: null text has no words; fewer words than a window keep all;
rows that share a doc_id are one document, whose marks apply to each of them;
rows with a null doc_id are compared with nothing and keep all; an empty table
gives no row; very long texts are read whole, in stretches that overlap by a
window less a word; other columns, whatever their names, are ignored. Ids are
whole numbers; others raise Spark's cast error.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm.common import documents, drop_path, each_batch, rows_out, shared_dir, shuffles_freed, written
from docweave.llm.windows import (
    ANCHOR,
    COVERED,
    HISTORY,
    JUDGED,
    JUDGED_DDL,
    KIND_AT,
    MARK,
    PLACE_AT,
    REQUEST,
    SENT_DDL,
    Spec,
    compare,
    judged_by_key,
    merged,
    ranges_of,
    sent_by_map,
    whole_groups,
    with_ranges,
)

WINDOW = 13
GRAM = 4
#: Batches of the whole-table query, and the runs at which the index is compacted.
BATCHES = 3
FANOUT = 2


def _tokens(text: bytes) -> np.ndarray:
    words = text.split()  # the word class is everything but ASCII white space
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _cut(text: bytes):
    words = text.split()
    return lambda lo, hi: b" ".join(words[lo:hi]) if hi <= len(words) else None


def _digits(window: int):
    def digits(contexts: list[bytes]):
        numbers: dict[bytes, int] = {}
        words = [[numbers.setdefault(w, len(numbers)) for w in c.split(b" ")] for c in contexts]
        lens = np.array([len(w) for w in words], np.int64)
        flat = np.array([n for w in words for n in w], np.int64)
        return (lambda place, k: flat[place + k]), np.cumsum(lens) - lens, window

    return digits


def word_spec(window: int = WINDOW, gram: int = GRAM) -> Spec:
    return Spec(window, gram, _tokens, _cut, within=False, digits=_digits(window))


class FingerprintIndex:
    """Sorted immutable runs of fingerprints in a folder that the driver and all executors see."""

    def __init__(self, spark: SparkSession, spec: Spec, folder: str, fanout: int = FANOUT, buckets: int | None = None) -> None:
        """A new index, which must not exist yet; see ``open`` for one that does. buckets: the session's shuffle partitions unless given."""
        self.spark, self.spec, self.folder, self.fanout = spark, spec, folder.rstrip("/"), fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[tuple[DataFrame, str]] = []
        self.asked: list[str] = []
        self.highest: int | None = None
        self.version = 0
        if self._versions():
            raise ValueError(f"{folder} holds an index already")

    @classmethod
    def open(cls, spark: SparkSession, spec: Spec, folder: str, fanout: int = FANOUT) -> FingerprintIndex:
        """The index as its last complete manifest has it."""
        index = cls.__new__(cls)
        index.spark, index.spec, index.folder, index.fanout = spark, spec, folder.rstrip("/"), fanout
        versions = index._versions()
        if not versions:
            raise ValueError(f"{folder} holds no index")
        index.version = versions[-1]
        said = json.loads(spark.read.text(f"{index.folder}/manifest-{index.version}").first()[0])
        if said["window"] != spec.window or said["gram"] != spec.gram:
            raise ValueError(f"the index was made with windows of {said['window']} and grams of {said['gram']}")
        index.highest, index.asked, index.buckets = said["highest"], said["asked"], said["buckets"]
        index.runs = [(spark.read.schema(JUDGED_DDL).parquet(f"{index.folder}/{name}"), f"{index.folder}/{name}") for name in said["runs"]]
        return index

    def _versions(self) -> list[int]:
        """Numbers of the complete manifests, in order."""
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/manifest-*/_SUCCESS")
        found = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at) or []
        return sorted(int(f.getPath().getParent().getName().split("-")[1]) for f in found)

    def _commit(self, runs: list[tuple[DataFrame, str]], highest: int | None) -> None:
        said = json.dumps({"buckets": self.buckets, "runs": [path.rsplit("/", 1)[1] for _, path in runs], "asked": self.asked, "highest": highest, "window": self.spec.window, "gram": self.spec.gram})
        self.spark.createDataFrame([(said,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/manifest-{self.version + 1}")
        before, self.version = self.version, self.version + 1
        self.runs, self.highest = runs, highest
        drop_path(self.spark, f"{self.folder}/manifest-{before}")

    def history(self) -> list[DataFrame]:
        """The runs' entries in the form that map tasks send: fingerprints, and marks of hot keys. Spark knows each as a table in buckets of sorted keys."""
        kind = F.when(F.col("kind") == MARK, MARK).otherwise(HISTORY)
        meta = F.shiftleft(F.col("place"), PLACE_AT).bitwiseOR(F.shiftleft(kind.cast("bigint"), KIND_AT)).bitwiseOR(F.col("run").cast("bigint"))
        return [self._bucketed(path).where(F.col("kind").isin(ANCHOR, MARK)).select("key", "ctx", "doc", meta.alias("meta")) for _, path in self.runs]

    def _bucketed(self, path: str) -> DataFrame:
        """A run as a bucketed table; a session that hasn't written it makes it known first."""
        name = path.rsplit("/", 1)[1]
        if not self.spark.catalog.tableExists(name):
            columns = ", ".join(c.strip() for c in JUDGED_DDL.split(",") if not c.strip().startswith("kind "))
            self.spark.sql(f"CREATE TABLE {name} ({columns}, kind TINYINT) USING parquet PARTITIONED BY (kind) CLUSTERED BY (key) SORTED BY (key) INTO {self.buckets} BUCKETS LOCATION '{path}'")
            self.spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
        return self.spark.table(name)

    def ingest(self, docs: DataFrame) -> DataFrame:
        """Judge a batch (doc_id, text; ids not null), all of whose ids are beyond those ingested; returns repeats and verification requests."""
        ids = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
        if ids[0] is not None and self.highest is not None and ids[0] <= self.highest:
            raise ValueError(f"the batch starts at {ids[0]}, but ids up to {self.highest} are in the index")
        if len(self.runs) >= self.fanout:
            self.compact()
        rows, sent = docs.mapInArrow(sent_by_map(self.spec), SENT_DDL), None
        if self.runs:
            rows, sent = written(rows, "sent")  # read twice: for its keys, and whole
            keys = rows.select("key").distinct()
            rows = reduce(DataFrame.unionByName, (known.join(keys, "key", "left_semi") for known in self.history()), rows)
        run = self._run(self._dealt(rows).mapInArrow(judged_by_key(self.spec, keep_new=True), JUDGED_DDL))
        if sent:
            drop_path(self.spark, sent)
        self.asked = [*self.asked, run[1].rsplit("/", 1)[1]]
        self._commit([*self.runs, run], self.highest if ids[1] is None else ids[1])
        return run[0].where(F.col("kind").isin(COVERED, REQUEST)).drop("ctx")

    def append(self, docs: DataFrame, corpus: DataFrame) -> DataFrame:
        """Ingest a batch and resolve its requests: (doc, lo, hi), the word ranges that repeat an earlier document. corpus: the texts of all ingested documents and these.

        Windows of hot keys are in no run, as they were dealt one by one: earlier
        batches' requests for them stay in the index and are compared again.
        """
        before, asked = self.highest, self.asked
        verdict = self.ingest(docs)
        requests = verdict.where(F.col("kind") == REQUEST)
        for name in asked:
            earlier = self.spark.read.schema(JUDGED_DDL).parquet(f"{self.folder}/{name}").where((F.col("kind") == REQUEST) & F.col("hot"))
            requests = requests.unionByName(earlier.drop("ctx"))
        covered = ranges_of(verdict.where(F.col("kind") == COVERED), self.spec.window)
        verified = compare(requests, corpus, self.spec)
        return covered.unionByName(verified if before is None else verified.where(F.col("doc") > before))

    def compact(self) -> None:
        """Merge all runs into one: each fingerprint once, by its smallest document."""
        rows = self._dealt(reduce(DataFrame.unionByName, (run.where(F.col("kind").isin(ANCHOR, MARK)) for run, _ in self.runs)))

        def once(batches):
            names = [f.name for f in JUDGED]
            read = lambda b: {n: b.column(n).to_numpy(zero_copy_only=False) for n in names}
            for rows in whole_groups(batches, read, 1 << 18):
                order = np.lexsort((rows["place"], rows["doc"], rows["ctx"], rows["kind"], rows["key"]))
                rows = {n: v[order] for n, v in rows.items()}
                same = np.logical_and.reduce([rows[n][1:] == rows[n][:-1] for n in ("key", "kind", "ctx")])
                head = np.append(True, ~same)
                lead = np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))
                # A document's own repeats of a fingerprint share its fate, so all of the smallest document's stay.
                keep = head | (rows["doc"] == rows["doc"][lead]) & (rows["kind"] != MARK)
                yield pa.RecordBatch.from_arrays([pa.array(rows[n][keep], JUDGED.field(n).type) for n in names], schema=JUDGED)

        old = self.runs
        self._commit([self._run(rows.mapInArrow(once, JUDGED_DDL))], self.highest)
        self._forget(old)

    def drop(self) -> None:
        """Delete the index; the verdicts on past batches stay."""
        self._forget(self.runs)
        self.runs, self.asked = [], []
        drop_path(self.spark, f"{self.folder}/manifest-{self.version}")

    def _forget(self, runs: list[tuple[DataFrame, str]]) -> None:
        for _, path in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {path.rsplit('/', 1)[1]}")  # Spark's knowledge of it alone: its verdicts stay
            for kind in (ANCHOR, MARK):
                drop_path(self.spark, f"{path}/kind={kind}")

    def _run(self, rows: DataFrame) -> tuple[DataFrame, str]:
        name = f"run_{uuid.uuid4().hex}"
        path = f"{self.folder}/{name}"
        with shuffles_freed(self.spark):
            rows.write.format("parquet").partitionBy("kind").bucketBy(self.buckets, "key").sortBy("key").option("path", path).saveAsTable(name)
        return self.spark.read.schema(JUDGED_DDL).parquet(path), path

    def _dealt(self, rows: DataFrame) -> DataFrame:
        """Dealt by key as the buckets are, and sorted."""
        return rows.repartition(self.buckets, "key").sortWithinPartitions("key")


KEPT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary())])


def cut_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """doc_id, n_words, n_removed and kept (UTF-8) for each row of docs, ingested in ``batches`` ranges of doc_id."""
    rows = documents(docs)
    known = rows.where("doc_id is not null")
    spec = word_spec(window, gram)
    index = FingerprintIndex(docs.sparkSession, spec, f"{shared_dir(docs.sparkSession)}/index-{uuid.uuid4().hex}", fanout)
    cuts = known.approxQuantile("doc_id", [k / batches for k in range(1, batches)], 0.01) if batches > 1 else []
    edges = sorted({int(c) for c in cuts})
    verdicts = []
    for lo, hi in zip([None, *edges], [*edges, None], strict=True):
        part = known
        if lo is not None:
            part = part.where(F.col("doc_id") > lo)
        if hi is not None:
            part = part.where(F.col("doc_id") <= hi)
        verdicts.append(index.ingest(part))
    index.drop()  # a whole-table call keeps none
    verdict = reduce(DataFrame.unionByName, verdicts)
    requests = verdict.where(F.col("kind") == REQUEST)
    ranges = ranges_of(verdict.where(F.col("kind") == COVERED), window).unionByName(compare(requests, known, spec))
    found = with_ranges(known, ranges)
    alone = rows.where("doc_id is null").withColumn("spans", F.lit(None).cast("array<struct<lo:bigint,hi:bigint>>"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: dict[str, list] = {f.name: [] for f in KEPT}
        out["doc_id"] = batch.column("doc_id")
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            words = (text or b"").split()
            cut = merged(spans or [], len(words))
            ends = [0, *(b for _, b in cut)]
            out["kept"].append(b" ".join(w for a, b in zip(ends, [*(a for a, _ in cut), len(words)], strict=True) for w in words[a:b]))
            out["n_words"].append(len(words))
            out["n_removed"].append(sum(b - a for a, b in cut))
        return rows_out(out, KEPT)

    return found.unionByName(alone).mapInArrow(each_batch(run), "doc_id bigint, n_words bigint, n_removed bigint, kept binary")


def cut_report(docs: DataFrame) -> DataFrame:
    """The contract's columns: doc_id, n_words, n_removed and kept_sha256."""
    return cut_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
