"""Whitening against plain numpy and plain integers."""

import math
from fractions import Fraction

import numpy as np
import pytest

from cartulary.llm import whitening
from cartulary.llm.q_whitening import op11
from cartulary.llm.whitening import cross_products, fitted, integer_vectors, spread, scatter, whitened

SCHEMA = "vec_id long, embedding array<float>, label int"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema).repartition(3)


def check(rows, vectors):
    """``rows`` of whitened(), held against ``vectors``: id to list of entries."""
    xs = {i: tuple(math.floor(256 * c) for c in v) for i, v in vectors.items()}
    fit = np.array(sorted(set(xs.values())), dtype=np.float64)
    n, s = len(fit), fit.sum(axis=0)
    v = (fit - s / n).T @ (fit - s / n) / n
    values, sides = np.linalg.eigh(v)
    k = min(4, fit.shape[1])
    assert len(rows) == k * len(xs)
    signs = {}
    for r in rows:
        x = xs[r["vec_id"]]
        c = r["component"] - 1
        assert r["n"] == n
        assert r["deviation"] == sum((n * a - int(b)) ** 2 for a, b in zip(x, s, strict=True))
        e = values[-1 - c]
        want = (np.array(x) - s / n) @ sides[:, -1 - c] / math.sqrt(e)
        assert abs(r["explained"] - e / values.sum()) < 1e-9
        assert 0 <= r["identity_error"] < 1e-9
        if abs(want) > 1e-6:
            sign = signs.setdefault(c, math.copysign(1, want * r["whitened"]))
            assert abs(r["whitened"] * sign - want) < 1e-6


def test_query_against_numpy(spark):
    rows = op11(spark, "/root/testdata/sf0.001").collect()
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    check(rows, {r["vec_id"]: r["embedding"] for r in table})


def test_equal_vectors_count_once_and_odd_ones_go(spark):
    draw = np.random.default_rng(3)
    some = {i: [float(np.float32(c)) for c in draw.normal(size=6)] for i in range(300)}
    copies = {1000 + i: some[0] for i in range(200)}
    odd = [(2000, None, 1), (2001, [], 1), (2002, [None] * 6, 1), (2003, [math.nan] * 6, 1), (2004, [1.0] * 5, 1), (2005, [math.inf] + [0.0] * 5, 1)]
    rows = [(i, v, 0) for i, v in (some | copies).items()] + odd
    check(whitened(frame(spark, rows)).collect(), some | copies)


@pytest.mark.parametrize("block", [1, 63, 64, 65, 1000])
def test_scatter_is_exact_in_any_blocks(spark, block, monkeypatch):
    draw = np.random.default_rng(block)
    u = draw.integers(0, [1, 2, 3, 1000, 1 << 40, 7], size=(min(block, 300), 6)).astype(np.uint64)
    bits = np.array([int(m).bit_length() for m in u.max(axis=0)])
    monkeypatch.setattr(whitening, "TILE", 4)
    want = [[sum(int(a) * int(b) for a, b in zip(u[:, i], u[:, j], strict=True)) for j in range(6)] for i in range(6)]
    assert cross_products(u, bits).tolist() == want


def test_covariance_by_integers(spark):
    rows = [(i, [i / 7, -i * i / 3, 1e6 * (i % 5), 2.0], 0) for i in range(500)]
    fit = integer_vectors(frame(spark, rows)).select("x").distinct()
    known = spread(fit)
    xs = [[math.floor(256 * float(np.float32(c))) for c in v] for _, v, _ in rows]
    xs = [list(t) for t in {tuple(x) for x in xs}]
    n = len(xs)
    exact = scatter(fit, known)
    mean = [Fraction(sum(x[i] for x in xs), n) for i in range(4)]
    for i in range(4):
        for j in range(4):
            assert Fraction(exact[i, j], n * n) == sum((x[i] - mean[i]) * (x[j] - mean[j]) for x in xs) / n


def test_degenerate_tables(spark):
    same = frame(spark, [(1, [0.5, 0.5], 0), (1, [0.5, 0.5], 0), (None, [0.5, 0.5], 1)])
    rows = whitened(same).collect()
    assert len(rows) == 6
    assert {(r["n"], r["deviation"], r["whitened"], r["explained"]) for r in rows} == {(1, 0, None, None)}
    line = frame(spark, [(i, [float(i), 2.0 * i], 0) for i in range(9)])
    got = whitened(line).collect()
    assert {r["component"] for r in got if r["whitened"] is not None} == {1}
    assert all(r["identity_error"] < 1e-9 for r in got)
    assert whitened(frame(spark, [], SCHEMA)).count() == 0
    assert fitted(integer_vectors(frame(spark, [(1, None, 0)])).select("x"), 4) is None


def test_clashing_columns_and_wide_entries(spark):
    rows = [(i, [float(c) for c in (i, 3e15 * (i % 2), -i)], 1, 2, 3) for i in range(64)]
    df = frame(spark, rows, "vec_id long, embedding array<double>, x int, n int, component int")
    got = whitened(df).collect()
    assert len(got) == 64 * 3
    assert {r["deviation"] for r in got} == {None}  # more than a long holds
    assert all(r["identity_error"] < 1e-4 for r in got)
