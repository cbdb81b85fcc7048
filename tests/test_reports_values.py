"""Value lists of every length give the same counts, those of the pattern test."""

import pytest
from pyspark.sql import functions as F

from cartulary.operators import reports as rp

ROWS = [("\tred | b",), ("RED",), ("redXb",), ("red\x85",), ("b|red\n",), ("a | red | c",), (None,), ("redder",), ("RedX d",)]


@pytest.mark.parametrize("delimiter,want,both", [("|", 5, 1), ("X", 2, 0)])
@pytest.mark.parametrize("n", [1, 18, 19, 6_000])
def test_counts_do_not_depend_on_the_length_of_the_list(spark, n, delimiter, want, both):
    sheet = spark.createDataFrame(ROWS, "tags string")
    values = ["red"] + [f"v{i}" for i in range(n - 1)] + (["a | red"] if n == 18 else [])
    config = spark.createDataFrame([("tags", v, delimiter) for v in values], "column string, value string, delimiter string")
    got = rp.build_report(sheet, config).filter("section_no > 0").collect()
    found = {r["label"]: (r["entry_no"], r["n"]) for r in got}
    assert len(got) == len(found) == len(values)
    assert found["red"] == (1, want)
    assert all(found[v] == (i + 1, 0) for i, v in enumerate(values) if v.startswith("v"))
    if n == 18:
        assert found["a | red"] == (19, both)


@pytest.mark.parametrize("delimiter,want", [("|", 5), ("X", 2)])
def test_the_pattern_test_agrees(spark, delimiter, want):
    sheet = spark.createDataFrame(ROWS, "tags string")
    assert sheet.filter(rp.has_node(rp.fill_blank(sheet["tags"]), "red", delimiter)).count() == want


SEARCHED = [
    ("a, b, c",), ("a ,b",), ("A,  b ,  c",), (" red | b | c",), ("x--y---z",), ("a  b   c",), ("one two  three",), (None,), ("",), (", ",),
    ("b, c",), ("a | red|c",), ("a|red | c\n",), ("q\u2028",), ("a, b",), ("--",), ("a,b, c,",), ("c, d | e, f",),
]


@pytest.mark.parametrize("delimiter", [", ", "|", " ", "  ", "--", " | ", "abab", ","])
@pytest.mark.parametrize("root_only", ["", "yes"])
def test_values_of_every_kind_count_as_the_pattern_does(spark, delimiter, root_only):
    """Delimiters of any length, values that hold them, blank ends: all as ``has_node`` says."""
    sheet = spark.createDataFrame(SEARCHED, "tags string")
    values = ["a", "b", "c", "a, b", "b, c", "a, b, c", "a  b", "red | c", "a | red", "red|c", "y", "z", "-z", "x--y", "one two", "two  three", ",", "--", "q", "a,b", " b", "c,", "e, f"]
    config = spark.createDataFrame([("tags", v, delimiter, root_only) for v in values], "column string, value string, delimiter string, root_only string")
    got = {r["label"]: r["n"] for r in rp.build_report(sheet, config).filter("section_no > 0").collect()}
    cell = rp.fill_blank(sheet["tags"])
    looked = rp.root_of(cell, delimiter) if root_only else cell
    want = sheet.agg(*[F.count_if(rp.has_node(looked, v, delimiter)).alias(f"v{i}") for i, v in enumerate(values)]).first()
    assert got == {v: want[f"v{i}"] for i, v in enumerate(values)}


def test_long_lists_under_a_long_delimiter_are_looked_up(spark):
    asks = [rp.Ask("tags", f"v{i}, w", ", ", *[False] * 6) for i in range(3_000)]
    plan = rp._plan(asks, {"tags": F.col("tags")})
    assert not plan.known and len(plan.nodes) == 1
    sheet = spark.range(2_000).select(F.concat(F.lit("x, v"), (F.col("id") % 40).cast("string"), F.lit(", w")).alias("tags"))
    got = rp.build_report(sheet, asks).filter("section_no > 0 and n > 0").collect()
    assert len(got) == 40 and {r["n"] for r in got} == {50}
