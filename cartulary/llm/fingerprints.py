"""Document fingerprints: the k smallest shingle hashes of a text, as a sorted array of longs.

Such a bottom-k sketch says how alike two texts are, how far one holds the other and how many different
shingles there are. Sketches of parts merge into the sketch of the whole. A sketch of fewer than k hashes is
the whole set, and what it says is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartulary.llm.shingles import WIDTH, shingle_hashes, slices

K = 128
SALTS = 256
KEYS_HELD = 20_000  # keys a task merges at once


def sketches_of(texts: list[str | None], k: int = K, width: int = WIDTH) -> list[np.ndarray]:
    return [hashes[:k] for hashes in shingle_hashes([(t or "").encode("utf-8") for t in texts], width)]


def sketch(docs: DataFrame, text: str = "text", out: str = "sketch", k: int = K, width: int = WIDTH) -> DataFrame:
    """Adds ``out``, the sketch of ``text``, to each row; other columns stay, one of that name is replaced.

    A null text counts as empty; an empty text has an empty sketch; equal texts have equal sketches.
    """
    kept = docs.drop(out)
    place = kept.columns.index(text)
    schema = T.StructType([*kept.schema.fields, T.StructField(out, T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, place):
                found = sketches_of(part.column(place).to_pylist(), k, width)
                column = pa.array(found, type=pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*part.columns, column], names=[*part.schema.names, out])

    return kept.mapInArrow(run, schema)


def merged(sketches: DataFrame, key: str, sketch: str = "sketch", k: int = K) -> DataFrame:
    """(key, sketch): one sketch per key for the union of its parts.

    Each task first merges what it reads, so a key with a third of all rows sends one sketch a task, and those
    meet in two steps. Null sketches add nothing; a null key is a key; no rows give no rows.
    """
    rows = sketches.select(key, F.coalesce(sketch, F.array().cast("array<bigint>")).alias(sketch))

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[object, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            keys = pa.array(list(held), type=kinds.field(0).type)
            return pa.RecordBatch.from_arrays([keys, pa.array(list(held.values()), type=pa.list_(pa.int64()))], schema=kinds)

        kinds = None
        for batch in batches:
            kinds = pa.schema([(key, batch.schema.field(0).type), (sketch, pa.list_(pa.int64()))])
            for name, hashes in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = hashes.values.to_numpy()
                held[name] = np.union1d(held[name], found)[:k] if name in held else found[:k]
            if len(held) >= KEYS_HELD:
                yield out()
                held.clear()
        if held:
            yield out()

    parts = rows.mapInArrow(combine, rows.schema).withColumn("_salt", F.pmod(F.xxhash64(sketch), F.lit(SALTS)))
    least = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(sketch)))), 1, k)
    return parts.groupBy(key, "_salt").agg(least.alias(sketch)).groupBy(key).agg(least.alias(sketch))


def distinct_count(sketch: Column, k: int = K) -> Column:
    """How many different shingles: exact below k, else (k - 1) over the k-th hash's share of the range."""
    share = F.element_at(sketch, -1).cast("double") / float(1 << 63)
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise((k - 1) / share)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """The share of common shingles among all shingles of two texts, 0 to 1; 1 for two texts without any."""
    union = F.array_sort(F.array_union(a, b))
    whole = (F.size(a) < k) & (F.size(b) < k)
    seen = F.when(whole, union).otherwise(F.slice(union, 1, k))
    both = F.array_intersect(F.array_intersect(a, b), seen)
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(F.size(both) / F.size(seen))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """The share of a's shingles that b has, 0 to 1; 1 for a text without any."""
    j, n, m = resemblance(a, b, k), distinct_count(a, k), distinct_count(b, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), j * (n + m) / ((1 + j) * n)))
