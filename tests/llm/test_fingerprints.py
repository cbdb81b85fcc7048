"""Sketches: merged parts, containment, number of shingles and resemblance against whole sets."""

import random

import pytest
from pyspark.sql import functions as F

from cartulary.llm.fingerprints import K, containment, distinct_count, merged, resemblance, sketch
from cartulary.llm.neighbours import runs_with_next
from cartulary.llm.q_fingerprints import likeness, share_in, shingles_of, sketches_of
from cartulary.llm.shingles import shingle_hashes


def text(draw, n, words=5_000):
    return " ".join(f"w{draw.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="module")
def pairs():
    draw = random.Random(2)
    out = [("", ""), ("", "a"), ("one two", "one two"), (text(draw, 40), text(draw, 60))]
    for n, extra in [(50, 10), (300, 20), (900, 900), (2_000, 100), (1_500, 6_000)]:
        base = text(draw, n)
        out += [(base, base + " " + text(draw, extra)), (base, text(draw, extra) + " " + base), (base, text(draw, n))]
    return out


def test_estimates_against_whole_sets(spark, pairs):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    both = sketch(sketch(df, "a", "sa"), "b", "sb")
    sa, sb = F.col("sa"), F.col("sb")
    got = both.select("i", "sa", "sb", resemblance(sa, sb).alias("r"), containment(sa, sb).alias("c"), distinct_count(sa).alias("n")).collect()
    for row in got:
        x, y = (set(h.tolist()) for h in shingle_hashes([t.encode() for t in pairs[row["i"]]], 5))
        exact = len(x) < K and len(y) < K
        like = len(x & y) / len(x | y) if x or y else 1.0
        held = len(x & y) / len(x) if x else 1.0
        assert abs(row["r"] - like) <= (1e-9 if exact else 0.15)
        assert abs(row["c"] - held) <= (1e-9 if exact else 0.3 if len(y) > 3 * len(x) else 0.2)
        assert abs(row["n"] - len(x)) <= (1e-9 if len(x) < K else 0.3 * len(x))
        a, b = sketches_of(list(pairs[row["i"]]))
        assert (row["sa"], row["sb"]) == (a.tolist(), b.tolist())
        assert (row["r"], row["c"], row["n"]) == pytest.approx((likeness(a, b), share_in(a, b), shingles_of(a)))


def test_merged_parts_are_the_whole(spark):
    draw = random.Random(9)
    rows, whole = [], {}
    for key, parts in [("hot", 400), ("a", 3), ("b", 1), (None, 2)]:
        for _ in range(parts):
            t = text(draw, draw.randint(0, 60))
            rows.append((key, t))
            whole.setdefault(key, set()).update(shingle_hashes([t.encode()], 5)[0].tolist())
    df = sketch(spark.createDataFrame(rows, "key string, text string").repartition(7)).select("key", "sketch")
    df = df.unionByName(spark.createDataFrame([("b", None), ("none", None)], "key string, sketch array<long>"))
    got = {r["key"]: r["sketch"] for r in merged(df, "key").collect()}
    assert got == {k: sorted(v)[:K] for k, v in whole.items()} | {"none": []}
    again = merged(merged(df, "key"), "key")  # merging merged sketches changes nothing
    assert {r["key"]: r["sketch"] for r in again.collect()} == got
    assert merged(df.limit(0), "key").count() == 0


def test_runs_handle_repeated_and_null_ids_and_clashing_names(spark):
    rows = [(i // 3 if i % 5 else None, f"t{i}", i, i, i) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int, _x int, run int")
    out = runs_with_next(df, "doc_id", "text")
    assert out.filter("_ahead = 0").count() == 300
    assert out.columns == [*df.columns, "_run", "_ahead"]
    assert runs_with_next(df.limit(0), "doc_id", "text").count() == 0
