"""Streams of slots: microbatch admission, predecessor checks with state across microbatches, and a sink that a replay doesn't change."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Turns whose sizes are summed as recent; what a key's state holds of turns that wait for an earlier one, before the first is let go.
RECENT, WAITING = 4, 128
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting that holds while a stream starts: it takes its own copy then."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def files(spark: SparkSession, path: str, schema, per_trigger: int = 8) -> DataFrame:
    """A stream of the Parquet files at a path, a few at a time. A glob may also name one file."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def run_to_end(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", partitions: int | None = None) -> DataFrame:
    """Process what is there now into Parquet under ``path`` and read it back. Exactly once, by the checkpoint.

    partitions: of the state, fixed by the first run on a checkpoint; the session's shuffle partitions unless given.
    """
    spark = stream.sparkSession
    with setting(spark, STATE_STORE, ROCKS), setting(spark, "spark.sql.shuffle.partitions", str(partitions or spark.conf.get("spark.sql.shuffle.partitions"))):
        query = stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def admitted(slots: DataFrame, limit: int = 32 * 1024 * 1024) -> DataFrame:
    """Each slot's size and error code: stateless, so it streams in append mode."""
    n = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")
    return slots.select("doc_id", n.alias("size_bytes"), F.when(n == 0, "source_invalid").when(n > limit, "source_too_large").alias("error_code"))


class Predecessors(StatefulProcessor):
    """Turns of one conversation, released in order.

    A turn whose predecessor is out (or turn 0) is ``followed``. One that comes too
    early waits in a list state, in whatever microbatch its predecessor comes. When
    the watermark is ``wait_ms`` past it, a timer lets all that wait go: the first is an ``orphan``, those right after it
    follow. At most ``waiting`` turns wait; beyond that the first is let go at once. A turn that
    is out or waits already is ``repeated``. ``recent`` sums the sizes of the last ``recent`` turns let out, a bounded list state.
    """

    def __init__(self, wait_ms: int, recent: int = RECENT, waiting: int = WAITING) -> None:
        self.wait_ms, self.n_recent, self.n_waiting = wait_ms, recent, waiting

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "last bigint, held bigint, recent array<bigint>")
        self.waiting = handle.getListState("waiting", "turn bigint, size bigint, at_ms bigint")

    def _known(self) -> tuple[int | None, dict[int, tuple[int, int]], list[int]]:
        """The last turn that is out, the turns that wait, and the sizes of the last turns. Each call to the state store costs a round trip, so the list is read only if it holds something."""
        last, held, recent = self.at.get() or (None, 0, [])
        return last, {t: (size, at) for t, size, at in self.waiting.get()} if held else {}, list(recent)

    def _keep(self, before: dict[int, tuple[int, int]], last: int | None, held: dict[int, tuple[int, int]], recent: list[int]) -> None:
        self.at.update((last, len(held), recent))
        if held and held != before:
            self.waiting.put([(t, size, at) for t, (size, at) in sorted(held.items())])
        elif before and not held:
            self.waiting.clear()

    def _let_out(self, key: tuple, turns: list[tuple[int, int, str]], sizes: list[int]) -> tuple[pd.DataFrame, list[int]]:
        """Rows of turns (turn, size, status) in order, and the sizes of the last ones; only those that are out count as recent."""
        recent: list[int | None] = []
        for _, size, status in turns:
            if status == "repeated":
                recent.append(None)
                continue
            sizes = (sizes + [size])[-self.n_recent :]
            recent.append(sum(sizes))
        return pd.DataFrame({"conv_id": key[0], "turn": [t for t, _, _ in turns], "status": [s for _, _, s in turns], "recent": pd.array(recent, dtype="Int64")}), sizes

    def _drain(self, last: int | None, held: dict[int, tuple[int, int]], out: list, force: bool) -> int | None:
        """Let go what follows, and with force whatever waits."""
        for turn in sorted(held):
            follows = turn == 0 or (last is not None and turn == last + 1)
            if not follows and not force:
                break
            out.append((turn, held.pop(turn)[0], "followed" if follows else "orphan"))
            last = turn
        return last

    def handleInputRows(self, key, rows, timerValues):
        last, held, sizes = self._known()
        before, out = dict(held), []
        frame = pd.concat(list(rows)).sort_values("turn", kind="stable")
        for turn, size, at in zip(frame["turn"], frame["size"], frame["at_ms"], strict=True):
            turn, size, at = int(turn), int(size), int(at)
            if turn in held or (last is not None and turn <= last):
                out.append((turn, size, "repeated"))
                continue
            held[turn] = (size, at)
            last = self._drain(last, held, out, force=False)
            if len(held) > self.n_waiting:
                first = min(held)
                out.append((first, held.pop(first)[0], "orphan"))
                last = self._drain(first, held, out, force=False)
        for turn in held.keys() - before.keys():
            self.handle.registerTimer(held[turn][1] + self.wait_ms)
        found, sizes = self._let_out(key, out, sizes)
        self._keep(before, last, held, sizes)
        if out:
            yield found

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        last, held, sizes = self._known()
        if not any(at + self.wait_ms <= expiredTimerInfo.getExpiryTimeInMs() for _, at in held.values()):
            return
        before, out = dict(held), []
        last = self._drain(last, held, out, force=True)
        found, sizes = self._let_out(key, out, sizes)
        self._keep(before, last, held, sizes)
        yield found


def followed(turns: DataFrame, wait_ms: int, late: str, recent: int = RECENT) -> DataFrame:
    """(conv_id, turn, status, recent) of a stream of turns (conv_id, turn, size, at: their time): see Predecessors. Turns later than ``late`` behind the newest are dropped, as Spark's watermark does."""
    rows = turns.withWatermark("at", late).select("conv_id", "turn", "size", "at", F.unix_millis("at").alias("at_ms"))
    out = "conv_id bigint, turn bigint, status string, recent bigint"
    return rows.groupBy("conv_id").transformWithStateInPandas(Predecessors(wait_ms, recent), out, "append", "eventTime")


def microbatches(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Run ``handle(frame, batch_id)`` for each microbatch until the input ends; handle must be idempotent by batch_id."""
    with setting(stream.sparkSession, STATE_STORE, ROCKS):
        query = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


class BatchSink:
    """Each microbatch in a folder of its own under ``path``, named by its id: a handle for microbatches().

    A batch counts once Spark's marker of a finished write is there. A replay of a
    batch that counts changes nothing, and one that broke off is written anew from the start.
    """

    def __init__(self, path: str) -> None:
        self.path = path.rstrip("/")

    def _file(self, spark: SparkSession, name: str):
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p

    def committed(self, spark: SparkSession) -> list[int]:
        """Ids of the batches that count."""
        fs, marks = self._file(spark, "batch=*/_SUCCESS")
        return sorted(int(s.getPath().getParent().getName().split("=")[1]) for s in fs.globStatus(marks))

    def __call__(self, frame: DataFrame, batch_id: int) -> None:
        fs, mark = self._file(frame.sparkSession, f"batch={batch_id}/_SUCCESS")
        if not fs.exists(mark):
            frame.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def read(self, spark: SparkSession, schema) -> DataFrame:
        """All rows of the batches that count, with ``batch``, their id."""
        done = [f"{self.path}/batch={b}" for b in self.committed(spark)]
        rows = spark.read.schema(schema).option("basePath", self.path).parquet(*done) if done else spark.createDataFrame([], schema)
        return rows.withColumn("batch", F.col("batch").cast("bigint") if done else F.lit(None).cast("bigint"))
