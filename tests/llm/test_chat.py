"""The role machine, repeated turns, and conversations of many turns."""

import time

import pytest
from pyspark.sql import functions as F

from cartulary.llm.chat import Template, format_chats, read_loss, read_turns

SCHEMA = "conv_id long, turn int, role string, text string"


def chats(spark, listed):
    rows = [(c, i, role, f"{role} {i}") for c, roles in enumerate(listed) for i, role in enumerate(roles)]
    return {r["conv_id"]: r for r in format_chats(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}


ORDERS = [
    (["user", "assistant"], True, 2),
    (["system", "user", "assistant", "user", "assistant"], True, 5),
    (["user"], False, 1),
    (["system"], False, 1),
    (["assistant", "user"], False, 0),
    (["user", "user", "assistant"], False, 1),
    (["user", "assistant", "assistant"], False, 2),
    (["user", "system", "assistant"], False, 1),
    (["system", "system"], False, 1),
    (["user", "assistant", "tool"], False, 2),
    (["user", "assistant", "user"], False, 3),
]


def test_machine(spark):
    got = chats(spark, [roles for roles, *_ in ORDERS])
    assert [(got[i]["valid"], got[i]["legal_turns"]) for i in range(len(ORDERS))] == [(v, n) for _, v, n in ORDERS]


def test_repeated_and_untold_turns_have_one_order(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "system", None), (1, 1, "assistant", "[</s>")]
    got = [format_chats(spark.createDataFrame(r, SCHEMA).repartition(n)).first() for r, n in ((rows, 1), (rows[::-1], 4))]
    assert got[0] == got[1] and got[0]["n_turns"] == 5
    one = spark.createDataFrame([got[0]]).select(read_turns(F.col("formatted")).alias("t"), read_loss(F.col("formatted"), F.col("segments")).alias("l")).first()
    assert [(t["role"], t["text"]) for t in one["t"]] == [("system", ""), ("user", "a"), ("user", "a"), ("user", "b"), ("assistant", "[</s>")]
    assert one["l"] == ["[</s>"]


def test_own_template(spark):
    mine = Template(opening="<<", closing=">>"[:0] + "</o>", head="<r>{role}<t>", tail="<e>", loss_roles=("user", "tool"))
    rows = [(1, 0, "user", "x<"), (1, 1, "tool", "é😀"), (1, 2, "assistant", "no")]
    df = format_chats(spark.createDataFrame(rows, SCHEMA), mine)
    one = df.select("segments", read_loss(F.col("formatted"), F.col("segments"), mine).alias("l"), "formatted").first()
    assert one["l"] == ["x<", "é😀"]
    for s, text in zip(one["segments"], ["x\\l", "é😀", "no"], strict=True):
        assert one["formatted"][s["start"] - 1 : s["start"] - 1 + s["length"]] == text


@pytest.mark.parametrize("n", [20_000])
def test_time_grows_with_the_turns(spark, n):
    turns = spark.range(n).select(
        F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
        F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"),
    )
    start = time.perf_counter()
    chat = format_chats(turns)
    one = chat.select("valid", F.size(read_turns(F.col("formatted"))).alias("n"), F.size(read_loss(F.col("formatted"), F.col("segments"))).alias("l")).first()
    assert (one["valid"], one["n"], one["l"]) == (True, n, n // 2)
    assert time.perf_counter() - start < 30
