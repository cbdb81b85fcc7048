"""The edit that explains a date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PLACE = "place_id"


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def nearest_edit(
    targets: DataFrame, edits: DataFrame, target_ts: str = "target_ts", payload: str = "description"
) -> DataFrame:
    """Per target the newest edit of its calendar day, else the edit nearest in time.

    Equal distances go to the newer edit, equal times to the larger ``edit_id``. A target without
    a date gets the newest edit, a place without edits gets nulls.

    Edits are first reduced to the first and last of each (place, day). Whatever day has no edit
    takes its nearest from the last edit of the day before it or the first of the day after, so
    the ordered windows hold at most one row per calendar day and place, and no target ever meets
    more than three edits.
    """
    edit = F.struct("edit_ts", "edit_id", payload)
    daily = (
        edits.filter(F.col("edit_ts").isNotNull())
        .groupBy(PLACE, F.to_date("edit_ts").alias("_day"))
        .agg(
            F.max_by(edit, F.struct("edit_ts", "edit_id")).alias("_last"),
            F.max_by(edit, F.struct(-_micros(F.col("edit_ts")), F.col("edit_id"))).alias("_first"),
        )
    )
    # A target without a date asks for the newest edit of its place, under a day of its own.
    dated = F.col(target_ts).isNotNull()
    day = F.coalesce(F.to_date(target_ts), F.lit("1970-01-01").cast("date"))
    asked = targets.filter(dated).select(PLACE, F.to_date(target_ts).alias("_day"))
    days = daily.select(PLACE, "_day", "_first", "_last").unionByName(
        asked.distinct(), allowMissingColumns=True
    )
    # A day asked for may also have edits: one row per (place, day) again.
    days = days.groupBy(PLACE, "_day").agg(
        F.first("_first", ignorenulls=True).alias("_first"),
        F.first("_last", ignorenulls=True).alias("_last"),
    )
    up = Window.partitionBy(PLACE).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    down = (
        Window.partitionBy(PLACE)
        .orderBy(F.desc("_day"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    around = days.select(
        PLACE,
        F.lit(True).alias("_dated"),
        "_day",
        F.col("_last").alias("_same"),
        F.last("_last", ignorenulls=True).over(up).alias("_before"),
        F.last("_first", ignorenulls=True).over(down).alias("_after"),
    )
    newest = daily.groupBy(PLACE).agg(F.max_by("_last", "_day").alias("_same"))
    newest = newest.select(PLACE, F.lit(False).alias("_dated"), F.lit("1970-01-01").cast("date").alias("_day"), "_same")
    facts = around.unionByName(newest, allowMissingColumns=True)

    # As many facts as days asked for; adaptive execution cuts a place or day with a large share of the targets.
    t = targets.withColumns({"_dated": dated, "_day": day}).join(facts, [PLACE, "_dated", "_day"], "left")
    goal = _micros(F.col(target_ts))
    to_before = goal - _micros(F.col("_before.edit_ts"))
    to_after = _micros(F.col("_after.edit_ts")) - goal
    nearer = F.when(
        F.col("_after").isNull() | (to_before < to_after), F.col("_before")
    ).otherwise(F.col("_after"))
    pick = F.coalesce(F.col("_same"), nearer)
    return t.withColumn("_pick", pick).select(*targets.columns, "_pick.*")
