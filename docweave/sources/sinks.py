"""JSON envelopes and canonical digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def envelope(version: str, data: Column, error: Column) -> Column:
    """{schemaVersion, ok, data or error}; nulls are left out, so exactly one of the two appears."""
    return F.to_json(F.struct(F.lit(version).alias("schemaVersion"), error.isNull().alias("ok"), data.alias("data"), error.alias("error")))


def canonical_digest(value: Column) -> Column:
    """Of the JSON of a struct that holds no paths."""
    return F.sha2(F.to_json(value).cast("binary"), 256)


def write_envelopes(df: DataFrame, path: str, column: str = "envelope") -> None:
    """One JSON document a line."""
    df.select(F.col(column).alias("value")).write.mode("error").text(path)
