"""Joins against facts must hold, and be spread, when one key has most of the rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from cartulary.operators import versions
from cartulary.operators.hotkeys import HOT_SHARE, hot_keys, lookup, one_each
from cartulary.operators.recipes import fixed_output, running_mean


def skewed(spark, n=6000):
    key = F.when(F.col("id") < n * 0.6, "hot").when(F.col("id") < n * 0.7, None).otherwise(
        F.concat(F.lit("k"), (F.col("id") % 500).cast("string"))
    )
    return spark.range(n).select("id", key.alias("key"))


def test_hot_keys_are_few(spark):
    hot = hot_keys(skewed(spark), ["key"])
    assert 0 < len(hot) <= 2 * HOT_SHARE
    assert max(hot.values()) >= 0.5 * HOT_SHARE


def test_lookup_equals_a_plain_join(spark):
    rows = skewed(spark)
    facts = rows.filter("key is not null").groupBy("key").agg(F.count("id").alias("n"))
    for how in ("left", "inner"):
        got = lookup(rows, facts, ["key"], how)
        want = rows.join(facts, "key", how)
        assert got.columns == want.columns
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_hot_rows_reach_many_tasks(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = skewed(spark)
        facts = rows.filter("key is not null").groupBy("key").agg(F.count("id").alias("n"))
        joined = lookup(rows, facts, ["key"]).filter("key = 'hot'")
        sizes = [r["n"] for r in joined.groupBy(F.spark_partition_id()).agg(F.count("id").alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(sizes) == 8 and max(sizes) < 0.3 * sum(sizes)


def _sizes(spark, joined):
    """Rows of the largest and of all tasks, without help by adaptive execution."""
    sizes = [r["n"] for r in joined.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    return max(sizes), sum(sizes)


def test_equal_hot_rows_reach_many_tasks(spark):
    ids = spark.range(0, 20_000, 1, 4).select(F.when(F.col("id") < 12_000, 0).otherwise(F.col("id")).alias("place_id"))
    found = spark.range(50).select(F.col("id").alias("place_id"), F.lit("x").alias("status"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = fixed_output(ids, found, "place_id", ["status"])
        assert got.filter("place_id = 0 and status = 'x'").count() == 12_000 and got.count() == 20_000
        most, all_ = _sizes(spark, got)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert most < 0.3 * all_


def test_one_fact_a_key(spark):
    ids = spark.createDataFrame([(1,), (2,), (1,)], "place_id int")
    found = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, None)], "place_id int, status string")
    got = [fixed_output(ids, f, "place_id", ["status"]).orderBy("place_id").collect() for f in (found, found.repartition(3))]
    assert got[0] == got[1] and len(got[0]) == 3 and got[0][0]["status"] in ("a", "b") and got[0][2]["status"] == ""


def test_rows_of_any_type_are_salted(spark):
    odd = ["map('a', 1) AS m", "named_struct('b', array(map('c', 2))) AS s", "parse_json('{\"x\": 1}') AS v"]
    rows = spark.range(9_000).selectExpr("if(id < 6000, 0, id) AS key", *odd)
    facts = spark.range(10).select(F.col("id").alias("key"), F.lit("f").alias("fact"))
    got = lookup(rows, facts, ["key"])
    assert (got.count(), got.filter("fact = 'f'").count()) == (9_000, 6_000)
    several = facts.selectExpr("key % 3 AS key", *odd)
    assert one_each(several, ["key"]).count() == 3


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("batch", ["1", "7", "10000"])
def test_sorted_scan_settles_what_batches_and_ranges_part(spark, seed, batch):
    """A place with most of the rows, cut anywhere, answers as a plain loop does."""
    draw = random.Random(seed)
    rows = []
    for i in range(400):
        place = draw.choice(["hot"] * 6 + ["a", "b", "c", "d"])
        rows.append((place, dt.datetime(2025, 1, 1) + dt.timedelta(hours=i // 2), f"e{i:03}", draw.choice("x" * 30 + "yz"), draw.choice(["None"] * 40 + ["B"]), f"n{i}"))
    df = spark.createDataFrame(draw.sample(rows, len(rows)), "place_id string, version_ts timestamp_ntz, entry_id string, badge string, brand string, name string")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        changes = {r["place_id"]: (r["entry_id"], r["changed"], r["badge"]) for r in versions.first_change(df, F.lit("2025-01-02").cast("timestamp_ntz"), ["badge"]).collect()}
        brands = {r["place_id"]: (r["found"], r["entry_id"], r["prior_name"]) for r in versions.first_brand(df).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    for place in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == place]
        late = [r for r in mine if r[1] >= dt.datetime(2025, 1, 2)]
        other = next((i for i, r in enumerate(late) if r[3] != late[0][3]), None)
        assert changes[place] == (late[-1 if other is None else other - 1][2], other is not None, late[0][3])
        hit = next((i for i, r in enumerate(mine) if r[4] != "None"), None)
        want = (False, None, mine[-1][5]) if hit is None else (True, mine[hit][2], mine[hit - 1][5] if hit else None)
        assert brands[place] == want


def test_running_mean_shares_a_day(spark):
    rows = [("2025-01-01", 10.0), ("2025-01-02", 20.0), ("2025-01-03", 60.0), ("2025-01-03", None)]
    df = spark.createDataFrame(rows, "date string, value double").withColumn("date", F.to_date("date"))
    got = sorted((str(r["date"]), r["moving_avg"]) for r in running_mean(df, "date", "value").collect())
    assert [m for _, m in got] == [10.0, 15.0, 30.0, 30.0]
