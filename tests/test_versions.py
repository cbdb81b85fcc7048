"""Version and edit histories: worked answers, edge rows, and a random check against plain Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from cartulary.operators import edits
from cartulary.operators import versions as v

BADGES = ["hours_badge", "hours_badge_hover", "modern_cat_badge", "modern_cat_badge_hover"]
SCHEMA = (
    "place_id string, version_ts timestamp_ntz, entry_id string, changed_fields array<string>, "
    "name string, url string, brand string, header array<string>, "
    + ", ".join(f"{b} string" for b in BADGES)
)


def ts(text):
    return dt.datetime.fromisoformat(text)


def at(text):
    return F.lit(text).cast("timestamp_ntz")


def version(place, day, entry, name="N", brand="None", fields=("brand",), badges="abcd", url=None):
    return (place, ts(day), entry, list(fields), name, url, brand, ["H", entry], *badges)


ROWS = [
    version("P", "2025-06-01", "v1", "N1"),
    version("P", "2025-06-21", "v2", "N2"),
    version("P", "2025-07-01", "v3", "N3", "Bata"),
    version("P", "2025-08-01", "v4", "N4", "Bata", badges="abcX"),
    version("Q", "2025-06-05", "w1", "M1", "Nike"),
    version("R", "2025-06-05", "x1", "O1", ""),
    version("R", "2025-06-05", "x2", "O2", "None", fields=("hours_period",)),
]


@pytest.fixture(scope="module")
def history(spark):
    shuffled = random.Random(1).sample(ROWS, len(ROWS))
    return spark.createDataFrame(shuffled, SCHEMA)


@pytest.mark.parametrize(
    "day,want", [("2025-07-25", "v3"), ("2025-07-01", "v2"), ("2025-01-01", "v1")]
)
def test_asof(history, day, want):
    got = {r["place_id"]: r["entry_id"] for r in v.asof_before(history, at(day)).collect()}
    assert got["P"] == want


def test_ties_go_by_entry(history):
    got = {r["place_id"]: r["entry_id"] for r in v.asof_before(history, at("2025-07-01")).collect()}
    assert got["R"] == "x2"
    got = {r["place_id"]: r["entry_id"] for r in v.asof_before(history, at("2025-01-01")).collect()}
    assert got["R"] == "x1"


def test_first_brand(history):
    got = {r["place_id"]: r for r in v.first_brand(history).collect()}
    assert (got["P"]["brand"], got["P"]["entry_id"], got["P"]["prior_name"]) == ("Bata", "v3", "N2")
    assert (got["Q"]["brand"], got["Q"]["prior_name"]) == ("Nike", None)
    # An empty brand is a brand for the newer rule.
    assert (got["R"]["entry_id"], got["R"]["brand"]) == ("x1", "")


def test_first_brand_self(history):
    got = {r["place_id"]: r for r in v.first_brand(history, self_prior=True).collect()}
    assert got["Q"]["prior_name"] == "M1"
    assert (got["R"]["brand"], got["R"]["prior_name"]) == ("None", "O2")


def test_first_change(history):
    got = {r["place_id"]: r for r in v.first_change(history, at("2025-06-20"), BADGES).collect()}
    assert set(got) == {"P"}
    assert (got["P"]["entry_id"], got["P"]["changed_at"]) == ("v3", "2025-07-01T00:00:00")
    got = v.first_change(history, at("2025-07-15"), BADGES).first()
    assert got["changed_at"] == v.NO_CHANGE and got["modern_cat_badge_hover"] == "X"


def test_field_filter(history):
    kept = v.filter_by_field(history, "hours_period").collect()
    assert sorted(r["entry_id"] for r in kept if r["place_id"] == "R") == ["x2"]
    assert len([r for r in kept if r["place_id"] == "P"]) == 4
    skipped = v.filter_by_field(history, "hours_period", keep_unfiltered=False).collect()
    assert [r["entry_id"] for r in skipped] == ["x2"]


def test_undated_versions(spark, history):
    undated = history.union(spark.createDataFrame([("P", None, "u", [], "N", None, "B", [], *"abcd")], SCHEMA))
    assert v.ordered_versions(undated).count() == len(ROWS)
    with pytest.raises(Exception, match="without a date"):
        v.dated_versions(undated, strict=True).collect()


def test_no_versions_give_blanks(spark, history):
    places = spark.createDataFrame([("P", "now", "T (x) - y"), ("Z", None, None)],
                                   "place_id string, present_badge string, title string")
    got = {
        r["place_id"]: tuple(r)[1:]
        for r in v.present_vs_edited(
            places, history, at("2025-07-25"), "hours_badge", "header", "title"
        ).collect()
    }
    assert got["P"] == ("7/1/2025", "H | v3", "now", "a", "T (x)")
    assert got["Z"] == ("", "", "", "", "")


EDITS = [
    ("P", ts("2025-07-02 09:00"), 1, "A"),
    ("P", ts("2025-07-02 18:00"), 2, "B"),
    ("P", ts("2025-07-10 00:00"), 3, "C"),
]
EDIT_SCHEMA = "place_id string, edit_ts timestamp_ntz, edit_id int, description string"


def test_nearest_edit(spark):
    targets = spark.createDataFrame(
        [(1, "P", ts("2025-07-02")), (2, "P", ts("2025-07-07")), (3, "P", None), (4, "Z", ts("2025-07-02"))],
        "id int, place_id string, target_ts timestamp_ntz",
    )
    found = edits.nearest_edit(targets, spark.createDataFrame(EDITS, EDIT_SCHEMA))
    assert {r["id"]: r["description"] for r in found.collect()} == {1: "B", 2: "C", 3: "C", 4: None}


def slow_nearest(target, known):
    """Newest first, then the first one of the same day, else the first of least distance."""
    known = sorted(known, key=lambda e: (e[1], e[2]), reverse=True)
    if not known:
        return None
    if target is None:
        return known[0][2]
    same = [e for e in known if e[1].date() == target.date()]
    return (same or [min(known, key=lambda e: abs(e[1] - target))])[0][2]


def slow_change(rows, start):
    rows = sorted((r for r in rows if r[1] >= start), key=lambda r: (r[1], r[2]))
    if not rows:
        return None
    for before, here in zip(rows, rows[1:]):
        if before[3:] != here[3:]:
            return before[2], True
    return rows[-1][2], False


def test_against_plain_python(spark):
    """Few distinct times, so that ties and equal distances do come up; one place holds most rows."""
    rng = random.Random(5)
    place = lambda: "hot" if rng.random() < 0.6 else f"p{rng.randint(1, 12)}"
    when = lambda: ts("2025-01-01") + dt.timedelta(hours=12 * rng.randint(0, 60))
    known = [(place(), when(), i, f"d{i}") for i in range(300)]
    asked = [(i, place() if i % 9 else "none", when() if i % 7 else None) for i in range(300)]
    targets = spark.createDataFrame(asked, "id int, place_id string, target_ts timestamp_ntz")
    found = edits.nearest_edit(targets, spark.createDataFrame(known, EDIT_SCHEMA)).collect()
    got = {r["id"]: r["edit_id"] for r in found}
    want = {i: slow_nearest(t, [e for e in known if e[0] == p]) for i, p, t in asked}
    assert got == want

    states = [(place(), when(), i, rng.choice("ab"), rng.choice(["x", None])) for i in range(300)]
    start = ts("2025-01-08")
    df = spark.createDataFrame(states, "place_id string, version_ts timestamp_ntz, entry_id int, f string, g string")
    changed = v.first_change(df, at("2025-01-08"), ["f", "g"]).collect()
    got = {r["place_id"]: (r["entry_id"], r["changed"]) for r in changed}
    want = {p: slow_change([s for s in states if s[0] == p], start) for p in {s[0] for s in states}}
    assert got == {p: w for p, w in want.items() if w}
