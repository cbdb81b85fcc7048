"""The fingerprint query: each document against an edited copy of itself and against the next document."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from cartulary.llm.fingerprints import K, sketches_of
from cartulary.llm.neighbours import runs_with_next
from cartulary.llm.registry import query, table
from cartulary.llm.shingles import slices

SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, n_shingles double, in_next double"
)


def likeness(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """What ``fingerprints.resemblance`` says, for two sketches in hand."""
    union = np.union1d(a, b)
    if not len(union):
        return 1.0
    seen = union if len(a) < k and len(b) < k else union[:k]
    both = np.intersect1d(a, b, assume_unique=True)
    return int(np.searchsorted(both, seen[-1], side="right")) / len(seen)


def shingles_of(a: np.ndarray, k: int = K) -> float:
    """What ``fingerprints.distinct_count`` says."""
    return float(len(a)) if len(a) < k else (k - 1) / (float(a[-1]) / float(1 << 63))


def share_in(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """What ``fingerprints.containment`` says."""
    if not len(a):
        return 1.0
    j, n, m = likeness(a, b, k), shingles_of(a, k), shingles_of(b, k)
    return min(1.0, j * (n + m) / ((1 + j) * n))


def written(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype("<i8").tobytes()).decode("ascii")


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Goes through sorted runs; each row waits for the row that follows it."""
    waiting = None
    for batch in batches:
        for part in slices(batch, 1):
            ids, texts, runs, ahead = (part.column(i).to_pylist() for i in range(4))
            texts = [t or "" for t in texts]
            rows = list(zip(ids, texts, runs, ahead, sketches_of(texts), strict=True))
            if waiting is not None:
                rows.insert(0, waiting)
            pairs = [(a, b) for a, b in zip(rows, rows[1:], strict=False) if not a[3]]
            waiting = rows[-1]
            halves = [len(a[1]) // 2 for a, _ in pairs]
            edited = [a[1][: len(a[1]) - h] + b[1][:h] for (a, b), h in zip(pairs, halves, strict=True)]
            found = sketches_of(edited)
            columns = [
                [a[0] for a, _ in pairs],
                [len(a[1]) for a, _ in pairs],
                [hashlib.sha256(e.encode("utf-8")).hexdigest() for e in edited],
                [written(a[4]) for a, _ in pairs],
                [written(f) for f in found],
                [likeness(a[4], f) for (a, _), f in zip(pairs, found, strict=True)],
                [likeness(a[4], b[4]) for a, b in pairs],
                [shingles_of(a[4]) for a, _ in pairs],
                [share_in(a[4], b[4]) for a, b in pairs],
            ]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.float64()] * 4]
            arrays = [pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True)]
            names = [field.split()[0] for field in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays(arrays, names=names)


@query("op3_fingerprints")
def op3(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return runs_with_next(docs, "doc_id", "text").mapInArrow(_compare, SCHEMA)
