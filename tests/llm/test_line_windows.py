"""Longer lines meet by windows: no near pair is left out, and lines that merely share common pieces do not meet."""

import math
import random

from pyspark.sql import functions as F

from cartulary.llm import lines, windows
from tests.llm.test_whole import WORDS, _edited, _within

LEAST = lines.SIMILAR


def _spread(line, sign, dice):
    """``line`` with as many edits as a pair may have, evenly spread and all of one kind."""
    out, n = list(line), int(len(line) * (0.1 if sign < 0 else 0.11))
    for i in sorted((len(out) * (2 * i + 1) // (2 * n) for i in range(n)), reverse=True):
        out[i : i + 1] = [] if sign < 0 else [dice.choice("qé𝒳"), out[i]]
    return "".join(out)


def _texts():
    dice = random.Random(5)
    out = []
    for size in (11, 14, 20, 33, 60, 100):
        for _ in range(3):
            line = " ".join(dice.choice(WORDS) for _ in range(size))
            out += [line, _spread(line, -1, dice), _spread(line, 1, dice)]
            out += [_edited(line, max(1, len(line) * n // 100), dice) for n in (3, 8, 10, 10)]
    return sorted(set(out))


def _found(spark, texts):
    table = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "id long, norm string, class long")
    return [(r["a"], r["b"]) for r in windows.window_pairs(table, LEAST).collect()]


def test_op4_every_long_line_has_a_window_with_one_edit_at_most():
    for begin, width in windows.widths(LEAST):
        assert all(2 * (n // width) > math.floor(n * (1 - LEAST) + 1e-9) for n in range(begin, 5_000))
    start = windows.first_range(LEAST)
    assert windows.lengths(start, LEAST) >= windows.widths(LEAST)[-1][0]
    assert windows.widths(0.8) == [] and windows.first_range(0.8) is None


def test_op4_windows_in_cells_and_rounds_leave_no_near_pair_out(spark, monkeypatch):
    monkeypatch.setattr(windows, "CELL_KEYS", 1_500)
    monkeypatch.setattr(windows, "ROUND_CHARS", 60_000)
    monkeypatch.setattr(windows, "READ", 100)
    monkeypatch.setattr(windows, "CHUNK", 64)
    texts = _texts()
    low = windows.first_range(LEAST)
    near = {
        frozenset((i, j))
        for j, b in enumerate(texts)
        for i, a in enumerate(texts[:j])
        if math.floor(math.log(min(len(a), len(b))) / -math.log(LEAST)) >= low
        and _within(a, b, int(max(len(a), len(b)) * (1 - LEAST) + 1e-9))
    }
    found = _found(spark, texts)
    assert len(near) > 100 and near <= {frozenset(p) for p in found}
    assert len(set(found)) == len(found)


def test_op4_lines_of_the_same_words_do_not_meet(spark):
    dice = random.Random(9)
    texts = sorted({" ".join(dice.choice(WORDS) for _ in range(20)) for _ in range(300)})
    by_pieces = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "id long, norm string, class long")
    with lines._held(spark, *lines.IN_CELLS):
        pieces = lines.piece_pairs(by_pieces).count()
    assert pieces > 500 and len(_found(spark, texts)) * 10 < pieces


def test_op4_a_line_is_shipped_in_stretches(spark, monkeypatch):
    dice = random.Random(3)
    texts = [" ".join(dice.choice(WORDS) for _ in range(500)) for _ in range(40)]
    monkeypatch.setattr(windows, "CELL_KEYS", 2_500)
    table = spark.createDataFrame([(t,) for t in texts], "norm string").withColumn("size", F.length("norm"))
    ranges = windows._ranges(table, LEAST)
    most = max(ranges.values(), key=lambda r: r.cells)
    shipped = []
    monkeypatch.setattr(windows, "_beside", lambda met, short, long: shipped.append((short, long)) or met.withColumn("width", F.lit(1)))
    _found(spark, texts)
    short, long = (sum(s[i].agg(F.sum(F.length("text"))).first()[0] for s in shipped) for i in (0, 1))
    assert most.groups == 1 and most.stretches > 5
    assert short * 2 < most.stretches * sum(map(len, texts)) and long <= 2 * sum(map(len, texts))


def test_op4_no_cell_has_more_keys_than_a_task_holds(spark, monkeypatch):
    monkeypatch.setattr(windows, "CELL_KEYS", 500)
    dice = random.Random(4)
    texts = [" ".join(dice.choice(WORDS) for _ in range(size)) for size in (14, 25, 60) for _ in range(200)]
    shipped = []
    monkeypatch.setattr(windows, "_beside", lambda met, short, long: shipped.append(long) or met.withColumn("width", F.lit(1)))
    _found(spark, texts)
    most = max(windows._keys_of_windows(long).groupBy("cell").count().agg(F.max("count")).first()[0] or 0 for long in shipped)
    assert most <= 800  # lines are dealt to groups by a hash, so not quite evenly
