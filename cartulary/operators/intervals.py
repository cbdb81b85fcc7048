"""Sets of weekly intervals as tables: ``key, weekday (1 = Sunday), start_min, end_min``.

Intervals are half-open minutes 0..1440 of one weekday. Set operations sweep over minutes: the
starts and ends of each minute are summed before the shuffle, which leaves at most 1441 rows per
(key, weekday) whatever the number of intervals, and one pass over those rows gives the result.
No interval is ever paired with another one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["key", "weekday"]
DAY_MINUTES = 1440


def _steps(intervals: DataFrame, side: str) -> DataFrame:
    """+1 at each start and -1 at each end, summed per minute."""
    other = "b" if side == "a" else "a"
    ends = F.array(
        F.struct(F.col("start_min").alias("minute"), F.lit(1).alias("step")),
        F.struct(F.col("end_min").alias("minute"), F.lit(-1).alias("step")),
    )
    return intervals.filter(F.col("end_min") > F.col("start_min")).select(
        *KEYS, F.inline(ends)
    ).select(*KEYS, "minute", F.col("step").alias(side), F.lit(0).alias(other))


def _sweep(steps: DataFrame, inside: Column) -> DataFrame:
    """Maximal runs of minutes for which ``inside`` holds, from the summed steps."""
    per_minute = steps.groupBy(*KEYS, "minute").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    in_order = Window.partitionBy(*KEYS).orderBy("minute")
    by_minute = in_order.rowsBetween(Window.unboundedPreceding, 0)
    runs = (
        per_minute.withColumn("a", F.sum("a").over(by_minute))
        .withColumn("b", F.sum("b").over(by_minute))
        .withColumn("next_minute", F.lead("minute").over(in_order))
        .withColumn("inside", inside)
        .withColumn("was_inside", F.coalesce(F.lag("inside").over(in_order), F.lit(False)))
        .withColumn(
            "run", F.sum((F.col("inside") & ~F.col("was_inside")).cast("int")).over(by_minute)
        )
        .filter("inside")
    )
    return runs.groupBy(*KEYS, "run").agg(
        F.min("minute").alias("start_min"), F.max("next_minute").alias("end_min")
    ).drop("run")


def union(intervals: DataFrame) -> DataFrame:
    """Overlapping and touching intervals merged."""
    return _sweep(_steps(intervals, "a"), F.col("a") > 0)


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """Minutes that lie in both sets."""
    steps = _steps(a, "a").unionByName(_steps(b, "b"))
    return _sweep(steps, (F.col("a") > 0) & (F.col("b") > 0))


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    """Minutes of ``a`` that do not lie in ``b``."""
    steps = _steps(a, "a").unionByName(_steps(b, "b"))
    return _sweep(steps, (F.col("a") > 0) & (F.col("b") <= 0))


def join_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Overlaps of two merged sets, each with the two intervals it comes from.

    Merged intervals of one side are disjoint, so an overlap starts where one of its two intervals
    starts while the other is open: each start looks up the latest start of either side.
    """
    starts = _starts(union(a), "a").unionByName(_starts(union(b), "b"), allowMissingColumns=True)
    at = starts.groupBy(*KEYS, "minute").agg(F.max("a_end").alias("a_end"), F.max("b_end").alias("b_end"))
    by_minute = (
        Window.partitionBy(*KEYS).orderBy("minute").rowsBetween(Window.unboundedPreceding, 0)
    )

    def latest(end: str) -> Column:
        seen = F.when(F.col(end).isNotNull(), F.struct("minute", end))
        return F.last(seen, ignorenulls=True).over(by_minute)

    open_at = at.select(*KEYS, "minute", latest("a_end").alias("a"), latest("b_end").alias("b"))
    return open_at.filter(
        (F.col("a.a_end") > F.col("minute")) & (F.col("b.b_end") > F.col("minute"))
    ).select(
        *KEYS,
        F.col("minute").alias("start_min"),
        F.least("a.a_end", "b.b_end").alias("end_min"),
        F.col("a.minute").alias("a_start"),
        F.col("a.a_end").alias("a_end"),
        F.col("b.minute").alias("b_start"),
        F.col("b.b_end").alias("b_end"),
    )


def _starts(intervals: DataFrame, side: str) -> DataFrame:
    return intervals.select(
        *KEYS, F.col("start_min").alias("minute"), F.col("end_min").alias(f"{side}_end")
    )
