"""Streams that are started anew: state across microbatches, timers, replays; and runs that are cancelled."""

from __future__ import annotations

import threading
import time

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from docweave.streaming import cancel, slots

TURNS = "conv_id bigint, turn bigint, size bigint, minute bigint"


@pytest.fixture
def fed(spark, tmp_path):
    """Feeds one arrival after the other to a stream of its own each, on one state."""

    def feed(*arrivals, wait_minutes=60, late="600 minutes"):
        for rows in arrivals:
            df = spark.createDataFrame(rows, TURNS).select("conv_id", "turn", "size", F.timestamp_seconds(F.col("minute") * 60 + 1_000_000_000).alias("at"))
            df.write.mode("append").parquet(str(tmp_path / "in"))
            stream = slots.followed(slots.files(spark, str(tmp_path / "in"), df.schema, 1000), wait_minutes * 60_000, late)
            out = slots.run_to_end(stream, str(tmp_path / "out"), str(tmp_path / "state"))
        return sorted(((r.conv_id, r.turn, r.status, r.recent) for r in out.collect() if r.conv_id >= 0), key=repr)

    return feed


def test_turns_wait_for_their_predecessor_across_restarts(fed):
    got = fed([(1, 2, 30, 2), (1, 0, 10, 0), (2, 1, 5, 1)], [(1, 4, 50, 4)], [(1, 1, 20, 1), (1, 3, 40, 3), (2, 0, 4, 0)])
    assert got == [(1, 0, "followed", 10), (1, 1, "followed", 30), (1, 2, "followed", 60), (1, 3, "followed", 100), (1, 4, "followed", 140), (2, 0, "followed", 4), (2, 1, "followed", 9)]


def test_a_timer_ends_the_wait(fed):
    clock = [(-1, 0, 0, 1_000_000)]
    got = fed([(1, 0, 10, 0), (1, 2, 30, 2), (1, 3, 40, 3), (3, 5, 7, 5)], [(1, 2, 30, 2), (1, 0, 10, 0)], clock, [(1, 1, 20, 1)])
    assert got == [(1, 0, "followed", 10), (1, 0, "repeated", None), (1, 2, "orphan", 40), (1, 2, "repeated", None), (1, 3, "followed", 80), (3, 5, "orphan", 7)]


def test_no_more_than_a_bounded_number_waits(spark, fed, monkeypatch):
    monkeypatch.setattr(slots.Predecessors.__init__, "__defaults__", (slots.RECENT, 2))
    assert fed([(1, t, 1, t) for t in (2, 4, 6)]) == [(1, 2, "orphan", 1)]


def test_batches_are_committed_once(spark, tmp_path):
    path = str(tmp_path / "in")
    sink, calls = slots.BatchSink(str(tmp_path / "out")), []

    def run(handle):
        slots.microbatches(slots.files(spark, path, "id bigint", 1000), handle, str(tmp_path / "state"))

    def counted(frame, batch_id):
        calls.append(batch_id)
        sink(frame, batch_id)

    def half(frame, batch_id):
        frame.limit(1).write.parquet(f"{tmp_path}/out/batch={batch_id}")
        (tmp_path / "out" / f"batch={batch_id}" / "_SUCCESS").unlink()
        raise RuntimeError

    def whole(frame, batch_id):
        counted(frame, batch_id)
        raise RuntimeError

    read = lambda: sorted((r.batch, r.id) for r in sink.read(spark, "id bigint").collect())
    assert read() == []
    spark.range(3).coalesce(1).write.mode("append").parquet(path)
    run(counted)
    first = read()
    spark.range(3, 5).coalesce(1).write.mode("append").parquet(path)
    with pytest.raises(StreamingQueryException):
        run(half)
    assert read() == first  # what broke off in the write doesn't count
    with pytest.raises(StreamingQueryException):
        run(whole)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "out").rglob("*.parquet")}
    run(counted)  # lost after the write: played again, and nothing changes
    assert {p: p.stat().st_mtime_ns for p in (tmp_path / "out").rglob("*.parquet")} == before
    assert calls == [0, 1, 1] and read() == [(0, 0), (0, 1), (0, 2), (1, 3), (1, 4)]
    assert sink.committed(spark) == [0, 1]


def slow(spark):
    def run(batches):
        for b in batches:
            time.sleep(0.2)
            yield b

    return spark.range(0, 4000, 1, 8).mapInArrow(run, "id bigint").withColumn("id", F.col("id") + 1)


def test_a_cancelled_run_leaves_nothing(spark, tmp_path):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        run = cancel.Run(spark)
        df, failed = slow(spark), []

        def work():
            try:
                run.write(df, str(tmp_path / "out"))
            except cancel.Cancelled as e:
                failed.append(e)

        thread = threading.Thread(target=work)
        thread.start()
        for _ in range(100):
            if run.active():
                break
            time.sleep(0.1)
        assert run.active()
        run.cancel()
        thread.join(60)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(failed) == 1 and not run.active()
    assert list(tmp_path.iterdir()) == []
    with pytest.raises(cancel.Cancelled):
        run.write(spark.range(3), str(tmp_path / "out"))  # a cancelled run starts nothing more
    again = cancel.Run(spark)
    again.write(spark.range(3), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    assert [p.name for p in tmp_path.iterdir()] == ["out"]


def test_other_errors_are_not_cancellation(spark, tmp_path):
    with pytest.raises(Exception) as e:
        cancel.Run(spark).write(spark.range(3).selectExpr("raise_error('no') AS x"), str(tmp_path / "out"))
    assert not isinstance(e.value, cancel.Cancelled) and list(tmp_path.iterdir()) == []


def test_streams_stop_with_their_run(spark, tmp_path):
    run = cancel.Run(spark)
    query = run.start(spark.readStream.format("rate").load().writeStream.format("noop").option("checkpointLocation", str(tmp_path / "state")))
    assert query.isActive
    run.cancel()
    assert not query.isActive
    with pytest.raises(cancel.Cancelled):
        run.start(spark.readStream.format("rate").load().writeStream.format("noop"))
