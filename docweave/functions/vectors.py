"""Array reductions with explicit tie rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLT_MAX = 3.4028234663852886e38


def finite(a: Column) -> Column:
    return F.forall(a, lambda x: ~F.isnan(x) & (F.abs(x) <= FLT_MAX))


def argmax_last(a: Column) -> Column:
    """0-based index of the maximum, the last of equals."""
    return (F.size(a) - F.array_position(F.reverse(a), F.array_max(a))).cast("bigint")


def argmax_first(a: Column) -> Column:
    """0-based index of the maximum among finite values, the first of equals; null without any."""
    usable = F.transform(a, lambda x: F.when(~F.isnan(x) & (F.abs(x) <= FLT_MAX), x))
    return (F.nullif(F.array_position(usable, F.array_max(usable)), F.lit(0)) - 1).cast("bigint")


def top_k(a: Column, k: int) -> Column:
    """Indices of the k largest, larger first, smaller index first on ties."""
    pairs = F.transform(a, lambda x, i: F.struct((-x).alias("v"), i.alias("i")))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda p: p["i"].cast("bigint"))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once a row: an expression named in a lambda would be computed for each element."""
    return F.transform(F.array(value), use)[0]


def softmax(a: Column) -> Column:
    exps = once(F.array_max(a), lambda top: F.transform(a, lambda x: F.exp(x.cast("double") - top)))
    shares = lambda e: once(F.aggregate(e, F.lit(0.0), lambda s, x: s + x), lambda total: F.transform(e, lambda x: x / total))
    return once(exps, shares)


def with_softmax(df: DataFrame, name: str, out: str) -> DataFrame:
    """df with the softmax of an array column beside it. As one element of an explode it is computed once, however often it is used."""
    return df.withColumn(out, F.explode(F.array(softmax(F.col(name)))))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def rank_of(a: Column, index: Column) -> Column:
    """1-based rank of an element: larger values come before it, and equal ones at smaller indices."""
    before = lambda e: once(F.get(e, index), lambda own: F.size(F.filter(e, lambda x, i: (x > own) | ((x == own) & (i < index)))))
    return (once(a, before) + 1).cast("bigint")


def banned_tokens(tokens: Column, n: int, window: int, allowed: Column | None = None) -> Column:
    """Tokens that would complete an n-gram already in the trailing window, once each, in order of first occurrence; those of the array ``allowed`` never."""
    recent = F.when(F.size(tokens) > window, F.slice(tokens, -window, window)).otherwise(tokens)
    size = F.size(recent)
    tail = F.slice(recent, size - (n - 2), n - 1)
    starts = F.sequence(F.lit(1), size - n + 1)
    hits = F.filter(starts, lambda i: F.slice(recent, i, n - 1) == tail)
    found = F.transform(hits, lambda i: F.element_at(recent, i + n - 1))
    found = F.array_distinct(found) if allowed is None else F.array_except(found, allowed)
    return F.when(size >= n, found).otherwise(F.slice(tokens, 1, 0))
