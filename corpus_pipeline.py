"""The corpus pipeline: five stages of docweave.llm over documents, each written as Parquet and read again as the next one's input.

Defined results: a document's null text is clean, has no near-duplicate but other
empty ones, and null pieces; rows that repeat an id and text count as one
document, and rows that share an id alone are each judged by their own text;
rows with a null id belong to no group of near-duplicates and stay; empty tables
give no rows, and without labels of both classes nothing is toxic; very long
texts are taken whole; further columns of documents, whatever their names, are
handed on by all stages but the last, which has its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docweave.llm import decontaminate, pieces, pii, simhash, toxicity
from docweave.llm.common import drop_path, table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go. What is learnt comes from the labels and the documents given."""
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id stays of each group that a similarity of 0.8 or more of 5-word shingles links."""
    return simhash.keep_one_of_each(docs, simhash.near_duplicates)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose words lie in benchmark windows for a twentieth or more go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every confirmed span of personal data becomes the name of its kind."""
    return pii.redact_documents(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each document: its sampled pieces' ids and count, and the digest of the text that they spell."""
    return pieces.encode_ids(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", redact_personal_data),
    ("pieces", encode_pieces),
]

#: SQL can express neither the fitted model nor XXH64 fingerprints; tests/llm holds a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and read back."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, path = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            drop_path(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
