"""The engine's front door: a provider protocol and extraction over batches of slots."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docweave.functions.binary import media_type
from docweave.operators import planning, recognition
from docweave.operators import stages as S
from docweave.operators import validate as V
from docweave.sources.images import MAX_SOURCE_BYTES

#: Fixed limit: bytes that one batch may admit.
MAX_BATCH_BYTES = 256 * 1024 * 1024


@dataclass(frozen=True)
class Descriptor:
    """What a provider is and can do; stages are kept distinct and in canonical order."""

    provider_id: str
    engine: str
    off_device: bool = False
    stages: tuple[str, ...] = ("text",)

    def with_stages(self, stages: Sequence[str]) -> Descriptor:
        return Descriptor(self.provider_id, self.engine, self.off_device, tuple(s for s in S.STAGES if s in set(stages)))


class Provider(Protocol):
    """Recognition of one source's bytes: (text, confidence) pairs. It runs on executors, so it must pickle.

    A provider that also has ``recognize_batch`` (recognition.BatchProvider) is called for whole groups.
    """

    def descriptor(self) -> Descriptor: ...

    def recognize(self, content: bytes) -> list[tuple[str, float]]: ...


@dataclass(frozen=True)
class EchoProvider:
    """A deterministic stand-in: reports the content's digest. Content that starts with ``BM-`` can't be decoded."""

    stages: tuple[str, ...] = ("preprocessing", "text")

    def descriptor(self) -> Descriptor:
        return Descriptor("echo", "echo engine").with_stages(self.stages)

    def recognize(self, content: bytes) -> list[tuple[str, float]]:
        if content.startswith(b"BM-"):
            raise ValueError("image_invalid")
        return [(hashlib.sha256(content).hexdigest()[:16], 1.0)]

    def recognize_batch(self, contents: Sequence[bytes]) -> list[recognition.Blocks | recognition.ItemFailure]:
        return Scalar(self).recognize_batch(contents)


@dataclass(frozen=True)
class Scalar:
    """Shared calls for a provider that has none: an item after the other, each failing alone."""

    provider: Provider

    def recognize_batch(self, contents: Sequence[bytes]) -> list[recognition.Blocks | recognition.ItemFailure]:
        out: list[recognition.Blocks | recognition.ItemFailure] = []
        for content in contents:
            try:
                out.append(list(self.provider.recognize(content)))
            except ValueError as e:  # the provider's own code
                out.append(recognition.ItemFailure(str(e)))
            except Exception:
                out.append(recognition.ItemFailure("runtime_failed"))
        return out


def batched(provider: Provider) -> recognition.BatchProvider:
    """The provider itself if it takes shared calls."""
    return provider if hasattr(provider, "recognize_batch") else Scalar(provider)


class Engine:
    """Extraction with one provider. Nothing is collected: requests and results are DataFrames."""

    def __init__(self, spark: SparkSession, provider: Provider) -> None:
        self.spark, self.provider = spark, provider

    def diagnostic(self) -> DataFrame:
        """One row: whether the descriptor is valid, and the first rule it breaks."""
        d = self.provider.descriptor()
        row = self.spark.createDataFrame([(d.provider_id, d.engine, list(d.stages))], "provider_id string, engine string, stages array<string>")
        violation = V.provider_violation(F.col("provider_id"), F.col("engine"), F.col("stages"))
        return row.withColumn("violation", violation).withColumn("ready", F.col("violation").isNull())

    def violations(self, slots: DataFrame) -> DataFrame:
        """(batch_id, slots, violation): the first rule that a batch breaks, or null.

        A batch has 1 to 256 slots, each with an id of its own (slot_id, or else its
        place); a slot that names a predecessor names the slot just before it.
        """
        own = F.col("slot_id" if "slot_id" in slots.columns else "slot_pos").cast("string").alias("slot_id")
        named = (F.col("predecessor") if "predecessor" in slots.columns else F.lit(None)).cast("string").alias("predecessor")
        before = F.lag("slot_id").over(Window.partitionBy("batch_id").orderBy("slot_pos"))
        rows = slots.select("batch_id", "slot_pos", own, named).withColumn("adjacent", F.col("predecessor").isNull() | F.col("predecessor").eqNullSafe(before))
        g = rows.groupBy("batch_id").agg(F.count("*").alias("slots"), F.countDistinct("slot_id").alias("ids"), F.bool_and("adjacent").alias("adjacent"))
        broken = V.first_violation(("slots", F.col("slots").between(1, V.MAX_SLOTS)), ("slot_ids", F.col("ids") == F.col("slots")), ("predecessor", F.col("adjacent")))
        return g.select("batch_id", "slots", broken.alias("violation"))

    def admit(self, slots: DataFrame) -> DataFrame:
        """slots (batch_id, slot_pos, content) with size, media_type, sha256 and error_code: the batch's rules, each slot by itself, then the batch's byte budget in order."""
        broken = self.violations(slots).where("violation is not null").select("batch_id", F.lit("batch_invalid").alias("broken"))
        slots = slots.select("batch_id", "slot_pos", "content").join(broken, "batch_id", "left")
        size, kind = F.coalesce(F.octet_length("content"), F.lit(0)).cast("bigint"), media_type(F.col("content"))
        code = F.when(F.col("broken").isNotNull(), F.col("broken")).when(F.col("content").isNull(), "source_unreadable").when(size == 0, "source_invalid").when(size > MAX_SOURCE_BYTES, "source_too_large").when(kind.isNull(), "source_type_unsupported")
        s = slots.select("batch_id", "slot_pos", "content", size.alias("size"), kind.alias("media_type"), F.sha2("content", 256).alias("sha256"), code.alias("error_code"))
        # The budget needs sizes only: contents don't travel with it.
        fine = s.where("error_code is null").groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct(F.col("slot_pos").alias("pos"), "size"))).alias("slots"))
        within = fine.select("batch_id", F.explode(planning.admitted(F.col("slots"), MAX_BATCH_BYTES)).alias("a")).select("batch_id", F.col("a.pos").alias("slot_pos"), "a.ok")
        return s.join(within, ["batch_id", "slot_pos"], "left").withColumn("error_code", F.coalesce("error_code", F.when(~F.col("ok"), "batch_too_large"))).drop("ok")

    def recognized(self, admitted: DataFrame) -> DataFrame:
        """(batch_id, slot_pos, error, text) of admitted slots, by shared calls; a slot that fails is an error row, its neighbours go on."""
        work = admitted.where("error_code is null").select("batch_id", "slot_pos", F.lit(0).alias("ordinal"), F.lit(0).alias("width"), "content")
        slots = recognition.slot_results(recognition.recognized(work, batched(self.provider)))
        return slots.select("batch_id", "slot_pos", "error", F.array_join(F.transform("blocks", lambda b: b["text"]), "\n").alias("text"))

    def extract_batch(self, slots: DataFrame, stages: Sequence[str]) -> DataFrame:
        """A row for each slot and requested stage: status, error_code, the slot's text and roll-up, and stage_tag, which orders the stages. In no order: the caller sorts."""
        wanted = [s for s in S.STAGES if s in set(stages)]
        if not wanted or len(wanted) != len(list(stages)):
            raise ValueError("batch_invalid: stages must be known, distinct and not empty")
        admitted = self.admit(slots)
        rows = admitted.drop("content").join(self.recognized(admitted), ["batch_id", "slot_pos"], "left").withColumn("error_code", F.coalesce("error_code", "error")).drop("error")
        able = F.array(*map(F.lit, self.provider.descriptor().stages)).cast("array<string>")
        matrix = S.outcomes(rows, F.array(*map(F.lit, wanted)), able, F.col("error_code").isNotNull(), rollup="slot_status")
        return matrix.withColumn("stage_tag", S.stage_tag(F.col("stage")))

    def extract(self, path: str, stages: Sequence[str] = ("text",)) -> DataFrame:
        """The files under a path in order of path, in batches of as many as one may hold."""
        from docweave.sources.images import read_sources

        files = read_sources(self.spark, path)
        # Only the names pass through one task, and Spark has listed them on the driver already.
        place = F.row_number().over(Window.orderBy("path")).cast("bigint") - 1
        ranked = files.select("path").withColumn("place", place).select("path", F.expr(f"place div {V.MAX_SLOTS}").alias("batch_id"), (F.col("place") % V.MAX_SLOTS).alias("slot_pos"))
        return self.extract_batch(files.join(ranked, "path").select("batch_id", "slot_pos", "content"), stages)
