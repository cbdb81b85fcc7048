"""Whitening of embeddings by a bit-sliced scatter matrix.

1. Entries become integers, 256 to a unit; equal integer vectors count once in the fit.
2. Each dimension is shifted to start at 0 and cut into its bits. A bit plane packs one bit of one dimension across the
   rows, 64 to a word. The product sum of two dimensions is the number of common ones of each two of their planes (AND,
   then popcount), times the powers of two they stand for. Tasks add up such sums for their rows, Spark adds the tasks.
3. Sums are exact. They are centred as integers (n times a product sum, less the product of the sums) and divided once,
   so the covariance is right to the last bit before its eigenvectors are taken, on the driver, from a matrix whose size
   is that of a vector squared.
4. Rows are projected where they lie; the covariance of what comes out is measured over the fit list as well.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.llm.common import written

SCALE = 256
BLOCK_ROWS = 8_192  # rows sliced at once
TILE = 64  # dimensions whose planes meet at once
LONG = 1 << 63
LIMB, LIMBS = 50, 4  # a product sum is handed on as so many longs of so many bits


def integer_vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, x) of ``rows(vec_id, embedding)``: floor(256 c) of every entry c, as longs.

    Rows whose vector is null, empty, holds null, NaN or infinite entries or such as no long can hold are left out. So are
    vectors of another length than most have (of equally many, the longer): they lack entries, or have some too many.
    """
    scaled = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("c"))
    bad = F.exists("c", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= float(LONG // SCALE)))
    kept = scaled.where(F.col("c").isNotNull() & (F.size("c") > 0) & ~F.coalesce(bad, F.lit(True)))
    vectors = kept.select("vec_id", F.transform("c", lambda c: F.floor(c * SCALE).cast("long")).alias("x"))
    lengths = vectors.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    most = lengths.agg(F.max(F.struct("n", "d")).alias("m")).first()["m"]
    return vectors.where(F.size("x") == (most["d"] if most else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of equal length as rows of int64."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), dtype=np.int64)


def _blocks(batches: Iterator[pa.RecordBatch], name: str, rows: int) -> Iterator[np.ndarray]:
    """The vectors of a partition in blocks of about ``rows``."""
    waiting: list[np.ndarray] = []
    for batch in batches:
        found = _matrix(batch.column(batch.schema.get_field_index(name)))
        for at in range(0, len(found), rows):
            waiting.append(found[at : at + rows])
            if sum(map(len, waiting)) >= rows:
                yield np.concatenate(waiting)
                waiting = []
    if waiting:
        yield np.concatenate(waiting)


@dataclass(frozen=True)
class Spread:
    """Number of vectors, and lowest, highest and sum of each dimension."""

    n: int
    low: list[int]
    high: list[int]
    total: list[int]


def spread(fit: DataFrame) -> Spread:
    """What ``fit(x)`` spans; one row for each dimension reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, low, high, total = 0, None, None, None
        for x in _blocks(batches, "x", BLOCK_ROWS):
            # Sums of halves of the bits fit into longs, sums of the whole may not.
            added = [int(a) + (int(b) << 32) for a, b in zip((x & 0xFFFFFFFF).sum(axis=0), (x >> 32).sum(axis=0), strict=True)]
            least, most = x.min(axis=0), x.max(axis=0)
            n += len(x)
            low = least if low is None else np.minimum(low, least)
            high = most if high is None else np.maximum(high, most)
            total = added if total is None else [a + b for a, b in zip(total, added, strict=True)]
        if n:
            d = len(low)
            columns = [pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array(low), pa.array(high), pa.array([str(t) for t in total])]
            yield pa.RecordBatch.from_arrays(columns, names=["at", "n", "low", "high", "total"])

    parts = fit.select("x").mapInArrow(run, "at int, n long, low long, high long, total string")
    added = parts.groupBy("at").agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")
    )
    rows = sorted(added.collect(), key=lambda r: r["at"])
    return Spread(rows[0]["n"] if rows else 0, [r["low"] for r in rows], [r["high"] for r in rows], [int(r["total"]) for r in rows])


def bit_planes(u: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The planes of rows of ``u`` (uint64, from 0), as words of 64 rows; with the dimension and the bit of each plane."""
    dims = np.repeat(np.arange(u.shape[1]), bits)
    which = np.concatenate([np.arange(b) for b in bits]).astype(np.uint64) if len(bits) else np.zeros(0, np.uint64)
    padded = -(-len(u) // 64) * 64
    planes = np.zeros((len(dims), padded), dtype=bool)
    for p, (d, b) in enumerate(zip(dims, which, strict=True)):
        planes[p, : len(u)] = (u[:, d] >> b) & np.uint64(1)
    return np.packbits(planes, axis=1).view(np.uint64), dims, which


def common_ones(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many ones each plane of ``a`` has in common with each plane of ``b``."""
    out = np.empty((len(a), len(b)), dtype=np.int64)
    for i, plane in enumerate(a):
        out[i] = np.bitwise_count(plane & b).sum(axis=1, dtype=np.int64)
    return out


def cross_products(u: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The exact sums of u_i u_j over the rows of ``u``, as an object array of Python integers."""
    d = u.shape[1]
    out = np.zeros((d, d), dtype=object)
    tiles = [slice(at, min(d, at + TILE)) for at in range(0, d, TILE)]
    cut = [bit_planes(u[:, t], bits[t]) for t in tiles]
    # Weighted counts stay below 2^63 if two entries and the number of rows do.
    small = 2 * int(bits.max(initial=0)) + len(u).bit_length() < 63
    kind = np.int64 if small else object
    weights = []
    for t, (_, dims, which) in zip(tiles, cut, strict=True):
        w = np.zeros((t.stop - t.start, len(dims)), dtype=kind)
        w[dims, np.arange(len(dims))] = [1 << int(b) for b in which]
        weights.append(w)
    for i, a in enumerate(tiles):
        for j, b in enumerate(tiles[: i + 1]):
            ones = common_ones(cut[i][0], cut[j][0]).astype(kind)
            part = (weights[i] @ ones @ weights[j].T).astype(object)
            out[a, b] = part
            out[b, a] = part.T
    return out


def scatter(fit: DataFrame, known: Spread) -> np.ndarray:
    """n^2 times the covariance of ``fit(x)``, divisor n, as exact Python integers."""
    d = len(known.low)
    low = np.array(known.low, dtype=np.int64)
    bits = np.array([int(h - l).bit_length() for h, l in zip(known.high, known.low, strict=True)], dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for x in _blocks(batches, "x", BLOCK_ROWS):
            part = cross_products((x - low).view(np.uint64), bits)  # wraps round as it should where a range needs 64 bits
            total = part if total is None else total + part
        if total is not None:
            for i in range(d):  # a row of the matrix at a time, its lower half
                found = total[i, : i + 1]
                limbs = [pa.array([int(v) >> LIMB * n & (1 << LIMB) - 1 for v in found], pa.int64()) for n in range(LIMBS)]
                columns = [pa.array([i] * len(found), pa.int32()), pa.array(range(len(found)), pa.int32()), *limbs]
                yield pa.RecordBatch.from_arrays(columns, names=["i", "j", *limb_names])

    limb_names = [f"v{n}" for n in range(LIMBS)]
    parts = fit.select("x").mapInArrow(run, ", ".join(["i int", "j int", *[f"{v} long" for v in limb_names]]))
    added = parts.groupBy("i", "j").agg(*[F.sum(F.col(v).cast("decimal(20,0)")).alias(v) for v in limb_names])
    shifted = [t - known.n * l for t, l in zip(known.total, known.low, strict=True)]
    out = np.zeros((d, d), dtype=object)
    for row in added.collect():
        i, j = row["i"], row["j"]
        product = sum(int(row[v]) << LIMB * at for at, v in enumerate(limb_names))
        out[i, j] = out[j, i] = known.n * product - shifted[i] * shifted[j]
    return out


@dataclass(frozen=True)
class Whitening:
    """A fitted whitening: ``vectors`` has a unit eigenvector in each row, ``values`` falling eigenvalues, of which those
    that rounding alone could have made are null."""

    known: Spread
    vectors: np.ndarray
    values: list[float | None]
    explained: list[float | None]

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact: longs where they are sure to fit, Python integers elsewhere."""
        k = self.known
        if max(k.n * max(abs(l), abs(h)) + abs(t) for l, h, t in zip(k.low, k.high, k.total, strict=True)) < LONG:
            return x * k.n - np.array(k.total, dtype=np.int64)
        return x.astype(object) * k.n - np.array(k.total, dtype=object)

    def deviations(self, centred: np.ndarray) -> list[int | None]:
        """The sum of squares of each row; null where a long cannot hold it."""
        k = self.known
        if centred.dtype != object and sum((k.n * (h - l)) ** 2 for l, h in zip(k.low, k.high, strict=True)) < LONG:
            return (centred * centred).sum(axis=1).tolist()
        sums = (centred.astype(object) ** 2).sum(axis=1)
        return [int(s) if s < LONG else None for s in sums]

    def project(self, centred: np.ndarray) -> np.ndarray:
        """Whitened components of centred rows; NaN for components without an eigenvalue."""
        scale = np.array([1 / math.sqrt(v) if v else np.nan for v in self.values])
        return (centred / self.known.n).astype(np.float64) @ self.vectors.T * scale

    def identity_error(self, fit: DataFrame) -> float:
        """The largest entry of the covariance of whitened ``fit(x)`` less the identity, over components with a value.

        One row a task reaches the driver, of the size of the components squared.
        """
        real = [i for i, v in enumerate(self.values) if v]
        d = len(real)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x in _blocks(batches, "x", BLOCK_ROWS):
                y = self.project(self.centred(x))[:, real]
                mean = y.mean(axis=0)
                apart = (y - mean).T @ (y - mean)
                columns = [pa.array([len(y)], pa.int64()), pa.array([mean.tolist()]), pa.array([apart.ravel().tolist()])]
                yield pa.RecordBatch.from_arrays(columns, names=["n", "mean", "apart"])

        if not real:
            return 0.0
        kind = "n long, mean array<double>, apart array<double>"
        n, mean, apart = 0, np.zeros(d), np.zeros((d, d))
        for row in fit.select("x").mapInArrow(run, kind).toLocalIterator():
            m, theirs = row["n"], np.array(row["mean"])
            step = theirs - mean
            apart = apart + np.array(row["apart"]).reshape(d, d) + np.outer(step, step) * (n * m / (n + m))
            mean = mean + step * (m / (n + m))
            n += m
        return float(np.abs(apart / n - np.eye(d)).max())


def fitted(fit: DataFrame, components: int) -> Whitening | None:
    """The whitening to up to ``components`` components of ``fit(x)``, distinct vectors; None without vectors."""
    known = spread(fit)
    if not known.n:
        return None
    exact = scatter(fit, known)
    square = known.n * known.n
    covariance = np.array([[v / square for v in row] for row in exact], dtype=np.float64)
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:components]
    trace = sum(exact[i, i] for i in range(len(exact))) / square
    least = len(values) * np.finfo(float).eps * max(float(values.max()), 0.0)
    rows = vectors[:, order].T
    rows = rows * np.where(rows[np.arange(len(rows)), np.abs(rows).argmax(axis=1)] < 0, -1.0, 1.0)[:, None]  # reruns agree
    real = [float(values[i]) if values[i] > least else None for i in order]
    return Whitening(known, rows, real, [max(float(values[i]), 0.0) / trace if trace else None for i in order])


def whitened(rows: DataFrame, components: int = 4) -> DataFrame:
    """Whitened components of ``rows(vec_id, embedding)``, one row for each vector and component; others are ignored.

    Columns: vec_id, component (from 1, by falling eigenvalue), n (vectors of the fit list), deviation, whitened, explained,
    identity_error. Which rows are left out says ``integer_vectors``. Null ids and repeated rows stay. There are as many
    components as entries if those are fewer. A component whose eigenvalue is 0 has whitened null, and explained is null
    where nothing varies; a deviation that no long can hold is null. An empty table gives no rows.
    """
    vectors = written(integer_vectors(rows), "integer-vectors")
    fit = written(vectors.select("x").distinct(), "fit-list")
    model = fitted(fit, components)
    schema = (
        f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, "
        "explained double, identity_error double"
    )
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)
    error = model.identity_error(fit)
    k = len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                centred = model.centred(_matrix(part.column(1)))
                m = part.num_rows
                values = model.project(centred).ravel()
                columns = [
                    part.column(0).take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array([model.known.n] * (m * k), pa.int64()),
                    pa.array([v for v in model.deviations(centred) for _ in range(k)], pa.int64()),
                    pa.array(values, mask=np.isnan(values)),
                    pa.array(model.explained * m, pa.float64()),
                    pa.array([error] * (m * k), pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.mapInArrow(run, schema)
