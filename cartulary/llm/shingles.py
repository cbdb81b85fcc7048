"""Hashes of word shingles, for many texts at once.

A word is a run of bytes other than ASCII white space, with A to Z lower-cased. A shingle is ``width`` words in
a row; a text of fewer words is one shingle, a text without words has none. Hashes are 63-bit, so Spark's signed
longs keep their order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WIDTH = 5
SLICE_BYTES = 4 << 20  # text hashed at once; working memory is about 40 times as much

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_VALUE = np.arange(1, 257, dtype=np.uint64)
_VALUE[65:91] = _VALUE[97:123]
_VALUE[_SPACE] = 0
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.ones(1, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        grown = np.full(max(n, 2 * len(_POWERS)), _BASE, dtype=np.uint64)
        grown[0] = 1
        _POWERS = np.multiply.accumulate(grown)
    return _POWERS


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in parts whose text in ``column`` has about ``most`` bytes, at least a row each."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(sizes, dtype=np.int64), 0
    while at < batch.num_rows:
        start = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, start + most, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and for each text where its words end."""
    data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    ends = np.cumsum(lengths + 1)
    space = _SPACE[data]
    starts = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(texts), dtype=np.int64)
    spans = np.diff(np.append(starts, len(data)))
    place = np.arange(starts[0], len(data), dtype=np.int64) - np.repeat(starts, spans)
    terms = _VALUE[data[starts[0] :]] * _powers(int(spans.max()))[place]
    return mix(np.add.reduceat(terms, starts - starts[0])), np.searchsorted(starts, ends)


def shingle_hashes(texts: list[bytes], width: int = WIDTH) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, sorted, as int64."""
    words, ends = word_hashes(texts)
    n = len(words)
    rolled = np.zeros(max(0, n - width + 1), dtype=np.uint64)
    for i in range(width):
        rolled = rolled * _BASE + words[i : i + len(rolled)]
    rolled = (mix(rolled) >> np.uint64(1)).astype(np.int64)
    out, start = [], 0
    for end in ends.tolist():
        if end - start >= width:
            out.append(np.unique(rolled[start : end - width + 1]))
        elif end > start:
            short = np.uint64(end - start)
            for word in words[start:end]:
                short = np.uint64((int(short) * int(_BASE) + int(word)) & 0xFFFFFFFFFFFFFFFF)
            out.append((mix(np.array([short])) >> np.uint64(1)).astype(np.int64))
        else:
            out.append(np.zeros(0, dtype=np.int64))
        start = end
    return out


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets; two empty sets are alike."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)
