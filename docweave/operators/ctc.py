"""Greedy CTC decoding: raw class rows to text and confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def collapse(rows: DataFrame, keys: list[str], position: str, characters: str) -> DataFrame:
    """keys, decoded text and confidence; rows have class_index and score.

    Blanks (class 0) and repeats of the previous raw class are dropped. Class i
    is the i-th character and the class after the last one a space. The
    confidence is the mean score of what stays, 0 without any, within 0 and 1.
    The dictionary is a literal, so decoding needs no join.
    """
    before = F.lag("class_index").over(Window.partitionBy(*keys).orderBy(position))
    kept = (F.col("class_index") != 0) & ~F.col("class_index").eqNullSafe(before)
    char = F.get(F.array(*map(F.lit, (*characters, " "))), F.col("class_index") - 1)
    marked = rows.withColumn("char", F.when(kept, char)).withColumn("kept_score", F.when(kept, F.col("score")))
    ordered = F.array_sort(F.collect_list(F.when(kept_column(), F.struct(F.col(position), F.col("char")))))
    mean = F.coalesce(F.avg("kept_score"), F.lit(0.0))
    out = marked.groupBy(*keys).agg(ordered.alias("chars"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), mean)).alias("confidence"))
    return out.select(*keys, F.array_join(F.transform("chars", lambda c: c["char"]), "").alias("decoded"), "confidence")


def kept_column():
    return F.col("kept_score").isNotNull()
