"""Shared recognition calls over planned groups of work items, with a fall back to one item a call.

A batch's items are taken in order of canvas width (then slot and place) and cut
into groups of nearly equal width; each group is one call of the provider. A
shared call that fails is repeated an item at a time, in order, so a bad item
costs its own slot and not its neighbours. A slot whose item failed is finished:
its later items are skipped. Rows of a batch stream through one task in plan order,
so a task holds one group of contents, whatever the batch's size.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.operators.planning import COALESCE_CAP, GROUP_CAP, WIDTH_STEP

Blocks = list[tuple[str, float]]


@dataclass(frozen=True)
class ItemFailure:
    """One item's result that is none; code is the provider's own."""

    code: str


class BatchProvider(Protocol):
    """A result, or an ItemFailure, for each content of a call, in order. What it raises fails the call; it must pickle."""

    def recognize_batch(self, contents: Sequence[bytes]) -> Sequence[Blocks | ItemFailure]: ...


@dataclass(frozen=True)
class Item:
    batch_id: int
    slot_pos: int
    ordinal: int
    width: int
    content: bytes


def planned(items: Iterator[Item], step: int = WIDTH_STEP, cap: int = GROUP_CAP, wide_cap: int = COALESCE_CAP) -> Iterator[list[Item]]:
    """Groups of items that come in order of batch and width: none spans batches or more than ``step`` of width; neighbours of one greatest width are merged."""
    ready: list[Item] = []
    group: list[Item] = []

    def close() -> Iterator[list[Item]]:
        """The open group joins the one before it, or lets it go."""
        nonlocal ready, group
        if ready and group and ready[0].batch_id == group[0].batch_id and ready[-1].width == group[-1].width and len(ready) + len(group) <= wide_cap:
            ready = ready + group
        else:
            if ready:
                yield ready
            ready = group
        group = []

    for item in items:
        if group and (item.batch_id != group[0].batch_id or len(group) == cap or item.width > group[0].width + step):
            yield from close()
        group.append(item)
    yield from close()
    if ready:
        yield ready


RESULT = "batch_id bigint, slot_pos bigint, ordinal bigint, call bigint, step bigint, mode string, blocks array<struct<text:string,confidence:double>>, error string"
ROWS = pa.schema(
    [("batch_id", pa.int64()), ("slot_pos", pa.int64()), ("ordinal", pa.int64()), ("call", pa.int64()), ("step", pa.int64()), ("mode", pa.string())]
    + [("blocks", pa.list_(pa.struct([("text", pa.string()), ("confidence", pa.float64())]))), ("error", pa.string())]
)


def attempt(provider: BatchProvider, items: list[Item]) -> tuple[Sequence[Blocks | ItemFailure] | None, str | None]:
    """The results of one call, or the code that it failed with. A ValueError's message is the provider's code; whatever else it raises costs the call, not the task."""
    try:
        results = provider.recognize_batch([i.content for i in items])
    except ValueError as e:
        return None, str(e)
    except Exception:
        return None, "runtime_failed"
    return (results, None) if len(results) == len(items) else (None, "provider_output_invalid")


def called(provider: BatchProvider, groups: Iterator[list[Item]]) -> Iterator[tuple]:
    """Rows of RESULT: mode is call (a planned group's), fallback (one item's after its group failed) or skipped (its slot has failed before)."""
    batch, failed, call, step = None, set(), 0, 0

    def row(item: Item, mode: str, result: Blocks | ItemFailure | None) -> tuple:
        nonlocal step
        step += 1
        bad = result.code if isinstance(result, ItemFailure) else None
        if bad is not None:
            failed.add(item.slot_pos)
        blocks = None if bad is not None or result is None else [{"text": t, "confidence": c} for t, c in result]
        return (item.batch_id, item.slot_pos, item.ordinal, call, step, mode, blocks, bad)

    for group in groups:
        if group[0].batch_id != batch:
            batch, failed, call, step = group[0].batch_id, set(), 0, 0
        call += 1
        active = [i for i in group if i.slot_pos not in failed]
        yield from (row(i, "skipped", None) for i in group if i.slot_pos in failed)
        if not active:
            continue
        results, code = attempt(provider, active)
        if results is not None:
            yield from (row(i, "call", r) for i, r in zip(active, results, strict=True))
        elif len(active) == 1:
            yield row(active[0], "call", ItemFailure(code))
        else:
            for item in active:
                if item.slot_pos in failed:
                    yield row(item, "skipped", None)
                    continue
                results, code = attempt(provider, [item])
                yield row(item, "fallback", ItemFailure(code) if results is None else results[0])


def recognized(work: DataFrame, provider: BatchProvider) -> DataFrame:
    """RESULT for each row of work (batch_id, slot_pos, ordinal, width, content); call counts a batch's groups, step its rows in the order of their calls."""
    columns = ["batch_id", "slot_pos", "ordinal", "width", "content"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = (Item(*r) for b in batches for r in zip(*(b.column(c).to_pylist() for c in columns), strict=True))
        rows: list[tuple] = []
        for row in called(provider, planned(items)):
            rows.append(row)
            if len(rows) == 1024:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ROWS, strict=True)], schema=ROWS)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ROWS, strict=True)], schema=ROWS)

    slim = work.select(*(F.col(c).cast("bigint").alias(c) for c in columns[:4]), "content")
    return slim.repartition("batch_id").sortWithinPartitions("batch_id", "width", "slot_pos", "ordinal").mapInArrow(run, RESULT)


def slot_results(rows: DataFrame) -> DataFrame:
    """(batch_id, slot_pos, error, blocks, receipts): the slot's first failure, or else its items' blocks in order; receipts counts the calls that served it."""
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", "blocks")))
    served = F.countDistinct(F.when(F.col("mode") == "call", F.struct("call", F.lit(0).cast("bigint").alias("step"))).when(F.col("mode") == "fallback", F.struct("call", "step")))
    g = rows.groupBy("batch_id", "slot_pos").agg(F.min_by("error", F.when(F.col("error").isNotNull(), F.col("step"))).alias("error"), ordered.alias("items"), served.alias("receipts"))
    blocks = F.when(F.col("error").isNull(), F.flatten(F.transform("items", lambda i: i["blocks"])))
    return g.select("batch_id", "slot_pos", "error", blocks.alias("blocks"), F.when(F.col("error").isNull(), F.col("receipts")).alias("receipts"))
