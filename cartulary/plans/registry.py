"""Named queries and their oracle SQL."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def add(run: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(run, sql)
        return run

    return add


ROWS_A_TASK = 100_000  # of a table that is dealt out, at most


def table(spark: SparkSession, sf_dir: str, name: str, dealt: bool = False) -> DataFrame:
    """A test table. ``dealt`` is for jobs that spend much time on each row: a table of a single file, which one task
    would read, is dealt out to all cores first, and one of many rows to more tasks, so that a task stays as long as it is."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if dealt:
        files = len(df.inputFiles())
        least = spark.sparkContext.defaultParallelism if files == 1 else files
        tasks = max(least, math.ceil(df.count() / ROWS_A_TASK))
        if tasks > files:
            return df.repartition(tasks)
    return df
