"""Hand-worked answers for the column expressions."""

import pytest
from pyspark.sql import functions as F

from cartulary.functions import headers, ids, notes, text, times, urls


def value(spark, make, *cells, schema=None):
    names = [f"c{i}" for i in range(len(cells))]
    schema = schema or ", ".join(f"{n} string" for n in names)
    df = spark.createDataFrame([cells], schema)
    return df.select(make(*(F.col(n) for n in names)).alias("x")).first()["x"]


CASES = [
    (ids.place_id, "&lt;br&gt;123 456", "123"),
    (ids.place_id, "n/a", ""),
    (ids.place_id, None, ""),
    (ids.place_id, "<a href='7'>x</a> 89", "89"),
    (ids.place_id_or_raw, "n/a", "n/a"),
    (ids.place_id_or_raw, "<b>12</b>", "12"),
    (ids.ticket_id, "<BR/>12 x 4567", "4567"),
    (ids.ticket_id, "﻿\"12 34\"", "12"),
    (ids.ticket_id, "none", ""),
    (ids.ticket_id_alnum, "# 12-34", "1234"),
    (ids.ticket_id_alnum, "--AB 12", "AB12"),
    (text.clean_markings, "['a', \"b-c\"]", "a, b-c"),
    (text.clean_list, "['a ', '', 'b']", "a, b"),
    (text.clean_list, "[1, 2,]", "1, 2"),
    (text.clean_list, "('a', 'b')", "a, b"),
    (text.clean_list, "[a, b]", "a, b"),
    (text.clean_list, "plain \"x\"", "plain x"),
    (text.title_level2, "POI Change (Unspec) – foo - bar", "POI Change (Unspec)"),
    (text.title_level2, "Remove - x", "Remove"),
    (text.brand_strip_paren, "Bata (79)", "Bata"),
    (text.to_number, "12.5", 12.5),
    (text.to_number, "x", None),
    (text.squeeze, " a  \n b ", "a b"),
    (urls.normalize_url, "https://www.a.com/x?q=1#f", "a.com/x?q=1#f"),
    (urls.normalize_url, "a.com/x", "a.com/x"),
    (urls.normalize_url, "", None),
    (urls.hyperlink_cell, '=HYPERLINK("http://x.y","t")', "http://x.y"),
    (urls.hyperlink_cell, "x.y/z", "https://x.y/z"),
    (urls.hyperlink_cell, "http://a b", "http://a b"),
    (urls.hyperlink_cell, "Oren Salon", ""),
]


def test_cells(spark):
    """All cases in one job."""
    df = spark.createDataFrame(
        [[cell for _, cell, _ in CASES]], ", ".join(f"c{i} string" for i in range(len(CASES)))
    )
    row = df.select(*(make(F.col(f"c{i}")).alias(f"x{i}") for i, (make, _, _) in enumerate(CASES))).first()
    wrong = [(make.__name__, cell, got, want) for (make, cell, want), got in zip(CASES, row) if got != want]
    assert not wrong


def test_header_tokens(spark):
    tokens = ["System Revert", "12-3 (4)", "2025-06-01 01:00 PM", "AMENITY", "---"]
    got = value(spark, text.header_tokens, tokens, schema="c0 array<string>")
    assert got == ["System Revert", "---"]


@pytest.mark.parametrize(
    "marker,shown,link,want",
    [
        (None, '"Bata" (79)', True, "Bata"),
        (None, "(79)", True, "not visible"),
        (None, "(79)", False, "None"),
        ("none", "Bata", True, "None"),
        (None, "Big  Shoe (12)", True, "Big Shoe"),
    ],
)
def test_brand_text(spark, marker, shown, link, want):
    got = value(
        spark, text.brand_text, marker, shown, link, schema="c0 string, c1 string, c2 boolean"
    )
    assert got == want


def test_lists(spark):
    arr = "c0 array<string>"
    assert value(spark, text.distinct_in_order, ["b", "a", "b"], schema=arr) == "b, a"
    assert value(spark, text.longest_string, ["ab", "xyz", "abc"], schema=arr) == "xyz"
    links = ["https://a.com", "http://in.corp.test/x", "ftp://z", "https://a.com", "https://corp.test"]
    got = value(spark, lambda c: urls.external_urls(c, "corp.test"), links, schema=arr)
    assert got == ["https://a.com"]


def test_url_prefer(spark):
    assert value(spark, urls.url_prefer, None, "b") == "b"
    assert value(spark, urls.url_prefer, "None", "b") == "None"


DATES = [
    (times.parse_version_ts, "2025-06-01 01:23 PM CDT", "2025-06-01 13:23:00"),
    (times.parse_version_ts, "nonsense here", None),
    (times.parse_edit_ts, "Jun 3, 2025 01:05 PM UTC", "2025-06-03 13:05:00"),
    (times.parse_edit_ts, "2025-06-03  07:05", "2025-06-03 07:05:00"),
    (times.parse_edit_ts, "2025-06-03 01:05 PM", "2025-06-03 01:05:00"),
    (times.parse_edit_ts, "2025-06-03", "2025-06-03 00:00:00"),
    (times.parse_edit_ts, "", None),
    (times.parse_closure_date, "7/4/2025", "2025-07-04 00:00:00"),
    (times.parse_closure_date, "7/4/2025 03:10 PM", "2025-07-04 15:10:00"),
    (times.parse_closure_date, "Jul 4, 2025", "2025-07-04 00:00:00"),
    (times.parse_closure_date, "soon", None),
]


def test_dates(spark):
    df = spark.createDataFrame(
        [[cell for _, cell, _ in DATES]], ", ".join(f"c{i} string" for i in range(len(DATES)))
    )
    row = df.select(*(make(F.col(f"c{i}")).alias(f"x{i}") for i, (make, _, _) in enumerate(DATES))).first()
    got = [str(x) if x else None for x in row]
    assert got == [want for _, _, want in DATES]


def test_date_texts(spark):
    at = lambda make: lambda c: make(c.cast("timestamp_ntz"))
    assert value(spark, at(times.fmt_mdy), "2025-07-04 10:00:00") == "7/4/2025"
    assert value(spark, at(times.fmt_iso), "2025-07-04 10:00:00") == "2025-07-04T10:00:00"
    assert value(spark, at(times.fmt_iso), None) == ""


@pytest.mark.parametrize(
    "cell,shown,strings,want",
    [
        ('x {"notes":"a  b","z":[1,],} y', None, [], "a b"),
        ('{"notes": 5}', '"seen"', [], "seen"),
        ('{"notes": " "}', None, ['"ab"', '"abc d"', "x"], "abc d"),
        ("no json", None, [], ""),
    ],
)
def test_json_notes(spark, cell, shown, strings, want):
    got = value(
        spark, notes.json_notes, cell, shown, strings,
        schema="c0 string, c1 string, c2 array<string>",
    )
    assert got == want


def test_headers(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], ["﻿Place ID ", "Edit  Closure", 'x"y"', "d"])
    assert headers.normalize_headers(df, "trim").columns[0] == "Place ID"
    assert headers.normalize_headers(df, "snake").columns[0] == "place_id"
    assert headers.normalize_headers(df, "unquote").columns[2] == "xy"
    assert headers.resolve_column(df, "edit closure") == "Edit  Closure"
    assert headers.resolve_column(df, "4") == "d"
    with pytest.raises(ValueError, match="the table has"):
        headers.resolve_column(df, "zz")
    assert headers.expand_letters(["ab-ad, C"]) == ["AB", "AC", "AD", "C"]
    assert headers.expand_letters(["Z-AB", "ZZ"]) == ["Z", "AA", "AB", "ZZ"]
    assert headers.select_letters(df, ["D,B-C"]).columns == ["d", "Edit  Closure", 'x"y"']


def test_no_try_is_left_out(spark):
    texts = ["2025-6-1 1:23 PM", "2025-06-01 13:23", "Jun 1, 2025 1:23 am", "Jun 1, 2025 13:23", "2025-06-01", "+2025-6-1", "6/1/2025", "6/1/2025 1:23 aM",
             "", "yesterday", "2025-6-1  1:23 PM", "JUN 1, 2025 1:23 p.m.", "2025-13-1", "20256-1", "-2025-6-1", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for formats in (times.VERSION_FORMATS, times.EDIT_FORMATS, times.CLOSURE_FORMATS):
        plain = F.coalesce(*(F.try_to_timestamp("t", F.lit(f)).cast("timestamp_ntz") for f in formats))
        found = rows.select(plain.cast("string").alias("want"), times.parse_any(F.col("t"), formats).cast("string").alias("got")).collect()
        assert [r["got"] for r in found] == [r["want"] for r in found]
        assert any(r["want"] for r in found)
