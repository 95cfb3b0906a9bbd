"""Query registry: each entry pairs a Spark query with its DuckDB oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    """A registered query; ``oracle`` is None where SQL cannot express it."""

    run: Query
    oracle: str | None = None


class Registry(dict[str, Entry]):
    """Queries by name; modules fill one each and ``merge`` combines them."""

    def query(self, name: str, oracle: str | None = None) -> Callable[[Query], Query]:
        def add(fn: Query) -> Query:
            if name in self:
                raise ValueError(f"query {name} is registered twice")
            self[name] = Entry(fn, oracle)
            return fn

        return add

    def merge(self, *others: Registry) -> Registry:
        for other in others:
            for name, entry in other.items():
                if name in self:
                    raise ValueError(f"query {name} is registered twice")
                self[name] = entry
        return self


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, read through Spark so any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
