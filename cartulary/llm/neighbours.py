"""Rows in the order of their ids, each with the row that follows, without one sort over all rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS_PER_RUN = 2_000
MAX_RUNS = 20_000


def runs_with_next(docs: DataFrame, key: str, ties: str) -> DataFrame:
    """``docs`` cut into runs by ranges of ``key``, each run followed by the head of the next one.

    Returns the columns of ``docs`` with ``_run`` and ``_ahead``: rows with ``_ahead`` 1 are copies of the row
    that opens the next run (the first run follows the last). All rows of a run lie in one partition, sorted by
    (_run, _ahead, key with nulls first, ties), so a reader that goes through a partition meets each row's
    follower next. Run borders come from quantiles of the key and change nothing but the size of the runs.
    """
    ids = docs.select(key)
    total = ids.count()
    runs = max(1, min(MAX_RUNS, -(-total // ROWS_PER_RUN)))
    marks = ids.approxQuantile(key, [i / runs for i in range(1, runs)], 0.2 / runs) if runs > 1 else []
    borders = sorted({int(m) for m in marks})
    run = F.lit(0)
    if borders:
        run = _behind(F.col(key), borders)
    headed = ids.withColumn("_run", F.coalesce(run, F.lit(0))).groupBy("_run")
    opens = sorted(headed.agg(F.min(F.struct(F.col(key).isNotNull().alias("known"), key)).alias("h")).collect())
    heads: list[int | None] = [None] * (len(borders) + 1)
    before = [0] * (len(borders) + 1)
    for i, row in enumerate(opens):
        heads[row["_run"]] = row["h"][key]
        before[row["_run"]] = opens[i - 1]["_run"]
    here = docs.withColumn("_run", F.coalesce(run, F.lit(0)))
    opening = F.get(F.array(*[F.lit(h).cast("long") for h in heads]), F.col("_run"))
    earlier = F.get(F.array(*[F.lit(b) for b in before]), F.col("_run"))
    copy = F.when(F.col(key).eqNullSafe(opening), F.struct(earlier.alias("run"), F.lit(1).alias("ahead")))
    places = F.array_compact(F.array(F.struct(F.col("_run").alias("run"), F.lit(0).alias("ahead")), copy))
    dealt = here.withColumn("_place", F.explode(places)).select(
        *docs.columns, F.col("_place.run").alias("_run"), F.col("_place.ahead").alias("_ahead")
    )
    return dealt.repartition("_run").sortWithinPartitions("_run", "_ahead", F.col(key).asc_nulls_first(), ties)


def _behind(value, borders: list[int]):
    """How many of the sorted borders are not above ``value``, by halving steps."""
    steps = [1 << i for i in range(len(borders).bit_length() - 1, -1, -1)]
    marks = F.array(*[F.lit(b) for b in [-(1 << 63), *borders]])

    def halve(low, step):
        return F.when(F.get(marks, low + step) <= value, low + step).otherwise(low)

    return F.when(value.isNotNull(), F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), halve))
