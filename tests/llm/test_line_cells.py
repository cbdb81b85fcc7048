"""Pieces of lines stay inside their cell, and lines that are dealt to several groups still meet."""

import random
import re

from pyspark.sql import functions as F

from cartulary.llm import lines
from tests.llm.test_whole import WORDS, _edited, _within


def _texts():
    dice = random.Random(11)
    out = []
    for size in (2, 4, 9, 15, 30):
        for _ in range(6):
            line = " ".join(dice.choice(WORDS) for _ in range(size))
            out += [line] + [_edited(line, max(1, len(line) * n // 100), dice) for n in (5, 10)]
    return sorted(set(out))


def _table(spark, texts):
    return spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "id long, norm string, class long")


def test_op4_lines_of_several_groups_meet(spark, monkeypatch):
    monkeypatch.setattr(lines, "CELL_PIECES", 20)
    monkeypatch.setattr(lines, "CELL_CHARS", 200)
    texts = _texts()
    near = {
        frozenset((i, j))
        for j, b in enumerate(texts)
        for i, a in enumerate(texts[:j])
        if _within(a, b, int(max(len(a), len(b)) * (1 - lines.SIMILAR) + 1e-9))
    }
    with lines._held(spark, *lines.IN_CELLS):
        found = [(r["a"], r["b"]) for r in lines.piece_pairs(_table(spark, texts)).collect()]
    assert len(near) > 25 and near <= {frozenset(p) for p in found}
    assert len(set(found)) == len(found)


def test_op4_shuffles_lines_not_pieces(spark):
    before = spark.conf.get(lines.IN_CELLS[0], None)
    with lines._held(spark, *lines.IN_CELLS):
        pairs = lines.piece_pairs(_table(spark, _texts()))
        pairs.collect()
        plan = pairs._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert spark.conf.get(lines.IN_CELLS[0], None) == before
    exchanges = re.findall(r"Exchange (.*)", plan)
    assert len(exchanges) == 2 and all("cell" in e and "REPARTITION_BY_NUM" in e for e in exchanges)


def test_op4_long_line_is_cut_at_every_place(spark):
    text = "".join(random.Random(3).choice("abcé𝒳 ") for _ in range(9_000))
    row = spark.createDataFrame([(0, 1, 1, text, len(text))], "cell long, id long, class long, norm string, size int")
    for q in (3, 16):
        cut = row.withColumn("q", F.lit(q))
        every = {r["at"]: r["gram"] for r in lines._cut_up(cut, F.lit(1)).collect()}
        tiles = {r["at"]: r["gram"] for r in lines._cut_up(cut, F.col("q")).collect()}
        assert every == {i: text[i : i + q] for i in range(len(text) - q + 1)}
        assert tiles == {i: text[i : i + q] for i in range(0, len(text) - q + 1, q)}
