"""Weekly time expressions: worked examples and a minute-by-minute brute force."""

import random

import pytest
from pyspark.sql import functions as F

from cartulary.operators import intervals
from cartulary.operators import timetext as tx

WORKDAYS = [(d, 540, 1020) for d in range(2, 7)]
EXAMPLES = [
    ("[(t2h9){d5h8}]", WORKDAYS),
    ("[(t6h9){d3h1}]", [(1, 540, 600), (6, 540, 600), (7, 540, 600)]),
    ("[(h22){h4}]", [(d, 1320, 1440) for d in range(1, 8)]),
    ("[(t2){h4}]", []),
    ("[(t2h0){h1}]", [(2, 0, 60)]),
    ("[[(t2h9){h3}]+[(t2h12){h2}]]", [(2, 540, 840)]),
    ("[[(t2h9){h8}]-[(t2h12){h1}]]", [(2, 540, 720), (2, 780, 1020)]),
    ("[[(t2h9){h8}]*[(t2h12){h8}]]", [(2, 720, 1020)]),
    ("[(t2h9){h1}]+[(t3h9){h1}]", [(2, 540, 600), (3, 540, 600)]),
    ("[(y2025M1d1h9){h1}]", [(d, 540, 600) for d in range(1, 8)]),
]


def evaluate(spark, texts, whole=True):
    df = spark.createDataFrame(list(enumerate(texts)), "key int, cell string")
    out = {i: [] for i in range(len(texts))}
    for r in tx.weekly(df, whole=whole).collect():
        out[r["key"]].append((r["weekday"], r["start_min"], r["end_min"]))
    return [sorted(out[i]) for i in range(len(texts))]


def test_examples(spark):
    assert evaluate(spark, [e for e, _ in EXAMPLES]) == [want for _, want in EXAMPLES]


def test_cell_takes_first_piece_only(spark):
    cells = ["[(t2h9){h1}]+[(t3h9){h1}]", "open [(t2h9){h1}", "x [ [(t2h9){h1}] [(t3h9){h1}]"]
    assert evaluate(spark, cells, whole=False) == [
        [(2, 540, 600)],
        [],
        [(2, 540, 600)],
    ]


def test_snippets_stand_in_for_a_broken_expression(spark):
    cell = "[[(t2h9){h1}]+] then [(t3h9){h1}]"
    assert evaluate(spark, [cell], whole=False) == [[(2, 540, 600), (3, 540, 600)]]


def test_postfix():
    a = "[(t2h9){h1}]"
    assert tx.to_postfix(f"{a}+{a}*{a}")[1] == ["0", "1", "2", "*", "+"]
    assert tx.to_postfix(f"{a}-{a}*{a}")[1] == ["0", "1", "-", "2", "*"]
    assert tx.to_postfix(f"{a}-[{a}+{a}]")[1] == ["0", "1", "2", "+", "-"]
    assert tx.to_postfix(f"{a} junk {a}")[1] == ["0"]
    assert tx.to_postfix(f"[{a} junk]+{a}")[1] == ["0", "1", "+"]
    assert tx.to_postfix(f"[{a}+{a}")[1] == ["0", "1", "+"]
    for bad in ("", "[]", f"{a}+", "[(t2h9){h1}", "x"):
        with pytest.raises(ValueError):
            tx.to_postfix(bad)


def minutes_of(tree):
    """Set of (weekday, minute) of a random expression tree, the slow way."""
    op, *args = tree
    if op == "atom":
        day, start, length = args
        return {(day, m) for m in range(start, min(start + length, 1440))}
    left, right = minutes_of(args[0]), minutes_of(args[1])
    return {"+": left | right, "*": left & right, "-": left - right}[op]


def spell(tree):
    op, *args = tree
    if op == "atom":
        day, start, length = args
        return f"[(t{day}h{start // 60}m{start % 60}){{h{length // 60}m{length % 60}}}]"
    return f"[{spell(args[0])}{op}{spell(args[1])}]"


def random_tree(rng, depth):
    if depth == 0 or rng.random() < 0.25:
        return ("atom", rng.randint(2, 3), rng.randint(0, 1439), rng.randint(1, 700))
    return (rng.choice("+*-"), random_tree(rng, depth - 1), random_tree(rng, depth - 1))


def as_ranges(minutes):
    runs = []
    for day, minute in sorted(minutes):
        if runs and runs[-1][0] == day and runs[-1][2] == minute:
            runs[-1][2] = minute + 1
        else:
            runs.append([day, minute, minute + 1])
    return [tuple(r) for r in runs]


def test_random_expressions(spark):
    rng = random.Random(7)
    trees = [random_tree(rng, 3) for _ in range(150)]
    got = evaluate(spark, [spell(t) for t in trees])
    assert got == [as_ranges(minutes_of(t)) for t in trees]


def test_week_text(spark):
    df = spark.createDataFrame(
        [
            (1, "[[(t1h9){h8m30}]+[(t2h0){h24}]]"),
            (2, "PERM_CLOSED:[(y2025M1d1)]"),
            (3, "PERM_CLOSED:[(x)]"),
            (4, "TEMP_CLOSED:[(y2025M1d1)(y2025M3d28)]"),
            (5, " "),
        ],
        "key int, cell string",
    )
    out = {r["key"]: r for r in tx.translate_column(df, "cell").withColumn(
        "special", tx.specials_text(F.col("cell"))).collect()}
    lines = out[1]["translated"].split("\n")
    assert lines[:4] == ["Sunday", "9:00 am–5:30 pm", "Monday", "12:00 am–12:00 pm"]
    assert lines[4:6] == ["Tuesday", "Closed"] and len(lines) == 14
    assert out[2]["translated"] == "No (Closed permanently on 2025-01-01)"
    assert out[2]["special"] == "Permanently closed on January 1, 2025"
    assert out[3]["translated"] == "No (Closed permanently)"
    assert out[4]["translated"].count("Closed") == 7
    assert out[4]["special"] == "Temporarily closed from January 1, 2025 to March 28, 2025"
    assert out[5]["translated"] == "" and out[1]["special"] is None


WORDS = [
        ("[(t2h9){d5h8}]", "9:00 AM for 5 days and 8 hours on Monday through Friday"),
        ("[(t2t4t6h0){h1}]", "midnight for 1 hour on Monday, Wednesday and Friday"),
        ("[(M7d4y2025){d1}]", "1 day on July 4, in 2025"),
        ("[(M7y2025h9m5){m30}]", "9:05 AM for 30 minutes in July 2025"),
        ("[(h9)]", "9:00 AM for 0 minutes"),
        (
            "[[(t2h9){h8}]-[(t2h12){h1}]]+[(t3h9){h1}]",
            "9:00 AM for 8 hours on Monday except 12:00 PM for 1 hour on Monday"
            " and 9:00 AM for 1 hour on Tuesday",
        ),
        ("[[(h9){h8}]*[(d5){d1}]]", "9:00 AM for 8 hours limited to 1 day on day 5"),
    ]


def test_describe(spark):
    cells = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(WORDS)], "key int, cell string")
    df = tx.with_parsed(cells, whole=True).select("key", tx.describe(F.col("parsed")).alias("x"))
    got = {r["key"]: r["x"] for r in df.collect()}
    assert [got[i] for i in range(len(WORDS))] == [want for _, want in WORDS]


def random_set(rng, key):
    rows = []
    for _ in range(rng.randint(0, 6)):
        start = rng.randint(0, 1400)
        rows.append((key, rng.randint(1, 2), start, min(1440, start + rng.randint(0, 300))))
    return rows


def test_interval_sets(spark):
    rng = random.Random(3)
    schema = "key int, weekday int, start_min int, end_min int"
    a = [r for k in range(40) for r in random_set(rng, k)]
    b = [r for k in range(40) for r in random_set(rng, k)]
    da, db = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
    laid = lambda rows: {(k, d, m) for k, d, s, e in rows for m in range(s, e)}
    sa, sb = laid(a), laid(b)
    for got, want in [
        (intervals.union(da), sa),
        (intervals.intersect(da, db), sa & sb),
        (intervals.subtract(da, db), sa - sb),
    ]:
        rows = [(r["key"], r["weekday"], r["start_min"], r["end_min"]) for r in got.collect()]
        assert laid(rows) == want
        # Merged: no two runs of one day touch.
        ends = {(k, d, e) for k, d, _, e in rows}
        assert not [r for r in rows if (r[0], r[1], r[2]) in ends]
    overlaps = intervals.join_overlap(da, db).collect()
    assert laid([(r["key"], r["weekday"], r["start_min"], r["end_min"]) for r in overlaps]) == sa & sb


def test_large_amounts_neither_stop_the_job_nor_lose_digits(spark):
    cells = ["[(t2h9){h99999999}]", "[(h9){d2147483647h1}]", "[(t1h8){m" + "9" * 60 + "}]", "[(t2h9){d2147483648h1}]"]
    df = spark.createDataFrame(list(enumerate(cells)), "i int, cell string")
    parsed = df.withColumn("p", tx.parse_expression("cell"))
    rows = parsed.orderBy("i").select(tx.weekly_intervals(F.col("p")).alias("w"), tx.describe(F.col("p")).alias("d")).collect()
    assert [tuple(x) for x in rows[0]["w"]] == [(2, 540, 1440)]
    assert [tuple(x) for x in rows[1]["w"]] == [(d, 540, 600) for d in range(1, 8)]
    assert [tuple(x) for x in rows[2]["w"]] == [(1, 480, 1440)]
    assert "99999999 hours" in rows[0]["d"] and "2147483647 days and 1 hour" in rows[1]["d"]
    assert "2147483648 days" in rows[3]["d"] and "Monday through Tuesday" in rows[3]["d"]
    assert tx.translate_column(df, "cell").filter("translated is null").count() == 0


def test_amounts_keep_all_their_digits(spark):
    nines, long = "9" * 32, "7" * 90
    cells = {
        "[(h9){h" + nines + "}]": f"9:00 AM for {nines} hours",
        "[(h9){h" + nines + "h1}]": f"9:00 AM for 1{'0' * 32} hours",
        "[(h9){m" + long + "m" + long + "y007}]": f"9:00 AM for 7 years and {int(long) * 2} minutes",
        "[(h9){d0}]": "9:00 AM for 0 minutes",
        "[(t2h9){d" + long + "}]": f"9:00 AM for {long} days on Monday through {tx.WEEKDAYS[(2 + int(long) - 1 - 1) % 7]}",
    }
    df = spark.createDataFrame([(c,) for c in cells], "cell string")
    got = tx.with_parsed(df, whole=True).select("cell", tx.describe(F.col("parsed")).alias("d")).collect()
    assert {r["cell"]: r["d"] for r in got} == cells


def test_week_runs_are_bit_operations():
    mask = lambda day, start, end: ((1 << end - start) - 1) << (day - 1) * 1440 + start
    atoms = [mask(2, 0, 60) | mask(7, 1380, 1440), mask(2, 30, 90), mask(2, 60, 61)]
    assert tx.week_runs(["0", "1", "+"], atoms) == [(2, 0, 90), (7, 1380, 1440)]
    assert tx.week_runs(["0", "1", "*"], atoms) == [(2, 30, 60)]
    assert tx.week_runs(["0", "1", "2", "+", "-"], atoms) == [(2, 0, 30), (7, 1380, 1440)]
    assert tx.week_runs([], []) == [] and tx.week_runs(["0", "*"], atoms) == []


def test_atom_bits_say_what_atom_intervals_say(spark):
    rng = random.Random(4)
    part = lambda kinds, top: "".join(rng.choice(kinds) + str(rng.randint(0, top)) for _ in range(rng.randint(0, 4)))
    atoms = [f"({part('yMdthm', 31)})" + rng.choice(["", f"{{{part('yMdhm', rng.choice([3, 9, 99, 10**25]))}}}"]) for _ in range(600)]
    df = spark.createDataFrame([(a,) for a in atoms], "a string")
    for r in df.select("a", tx.atom_intervals(F.col("a")).alias("i")).collect():
        want = sorted((x["weekday"], x["start_min"], x["end_min"]) for x in r["i"])
        assert tx.week_runs(["0"], [tx.atom_bits(r["a"])]) == want, r["a"]
