"""Places and running sums within a key's rows, in order, for keys of any size."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from docweave.llm.common import drop_path, written


def _counted(keys: np.ndarray, values: list[np.ndarray], before: tuple | None) -> tuple[np.ndarray, list[np.ndarray], tuple]:
    """Each row's place and running sums within its run of equal keys; before: the last row's key, place and sums."""
    starts = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1))
    lengths = np.diff(np.append(starts, len(keys)))
    goes_on = before is not None and before[0] == keys[0]
    place = np.arange(1, len(keys) + 1) - np.repeat(starts, lengths)
    place[: lengths[0]] += before[1] if goes_on else 0
    sums = []
    for k, v in enumerate(values):
        with np.errstate(over="ignore"):
            total = np.cumsum(v)
            total -= np.repeat(total[starts] - v[starts], lengths)
            total[: lengths[0]] += v.dtype.type(before[2][k] if goes_on else 0)
        sums.append(total)
    return place, sums, (keys[-1], int(place[-1]), [int(s[-1]) for s in sums])


def running(df: DataFrame, key: str, order: Sequence[str | Column], sums: Sequence[str] = (), bits: int | None = None, label: str = "running") -> tuple[DataFrame, str]:
    """df with ``place`` (1, 2, ... within the key) and ``sum_x`` for each x of sums, as a written table, and its path.

    Rows are dealt by ranges of key and order, so that a key with most of the rows
    spreads over as many tasks as it needs; each task scans its range in order and
    keeps three numbers. What a key had in earlier ranges comes from the last row
    of each task, one row a task, and is added where the key goes on. key is a
    long that is never null; with bits, sums are taken modulo that power of two.
    df should be a written table: Spark reads it twice, for the ranges' edges.
    """
    spark = df.sparkSession
    names, kind = list(sums), np.uint64 if bits else np.int64
    mask = (1 << bits) - 1 if bits else None
    added = [StructField("place", LongType()), *(StructField(f"sum_{s}", LongType()) for s in names), StructField("range_no", LongType()), StructField("edge", BooleanType())]
    schema = StructType([*df.schema.fields, *added])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, before, held = TaskContext.get().partitionId(), None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                yield held
            values = [batch.column(s).to_numpy(zero_copy_only=False).astype(kind) for s in names]
            place, totals, before = _counted(batch.column(key).to_numpy(zero_copy_only=False), values, before)
            out = [(t & kind(mask)).astype(np.int64) if bits else t for t in totals]
            n = batch.num_rows
            columns = [*batch.columns, pa.array(place), *map(pa.array, out), pa.array(np.full(n, at)), pa.array(np.zeros(n, bool))]
            held = pa.RecordBatch.from_arrays(columns, names=schema.names)
        if held is not None:  # only now is it known which row is the last
            last = np.arange(held.num_rows) == held.num_rows - 1
            yield pa.RecordBatch.from_arrays([*held.columns[:-1], pa.array(last)], names=schema.names)

    scanned, path = written(df.repartitionByRange(F.col(key), *order).sortWithinPartitions(F.col(key), *order).mapInArrow(scan, schema), label)
    ends = sorted(tuple(r) for r in scanned.where("edge").select("range_no", key, "place", *(f"sum_{s}" for s in names)).collect())  # a row a task
    offsets, so_far = [], [0] * (1 + len(names))
    for k, (_, own, *totals) in enumerate(ends[:-1]):
        so_far = [a + b for a, b in zip(so_far, totals, strict=True)] if k and ends[k - 1][1] == own else list(totals)
        so_far = [so_far[0], *(x & mask if mask else x for x in so_far[1:])]
        offsets.append((ends[k + 1][0], own, *so_far))  # the next range with rows is the only other place where the key can go on
    columns = ["place", *(f"sum_{s}" for s in names)]
    if offsets:
        known = spark.createDataFrame(offsets, StructType([StructField("o_range", LongType()), StructField("o_key", LongType()), *(StructField(f"o_{c}", LongType()) for c in columns)]))
        scanned = scanned.join(F.broadcast(known), (F.col("range_no") == F.col("o_range")) & (F.col(key) == F.col("o_key")), "left")  # a row a task at most
        for c in columns:
            total = F.col(c) + F.coalesce(F.col(f"o_{c}"), F.lit(0))
            scanned = scanned.withColumn(c, total.bitwiseAND(F.lit(mask)) if mask and c != "place" else total)
    return scanned.select(*df.columns, *columns), path


def forget(df: DataFrame, *paths: str) -> None:
    """Delete tables that nothing reads any more."""
    for path in paths:
        drop_path(df.sparkSession, path)
