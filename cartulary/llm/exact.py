"""Exact dedup of a new batch against immutable snapshots.

A snapshot keeps its digests in buckets, and for each bucket a static binary-fuse filter: three bytes-wide probes
per digest, about 1.13 bytes a key, no false negatives, one false positive in 256. New digests meet the filter
of their bucket; only those that pass join the snapshot's exact buckets. Copies inside the new batch are grouped
on their own. Rows that share a digest are then compared byte by byte, as the keys of a group-by over their texts,
so two different texts under one digest stay apart.

What moves between machines is digests, filters and the texts of rows that have a partner; a hot text is
combined before the shuffle, so a third of all rows being one text costs one row a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartulary.llm.common import sieved, written
from cartulary.llm.shingles import mix

BUCKET_KEYS = 100_000  # digests in a bucket, on average: what one task holds
_FINGER = np.uint64(0x9FB21C651E98DF25)


# -- the filter ---------------------------------------------------------------------------------------------


def _geometry(n: int) -> tuple[int, int]:
    """Slots of a segment (a power of two) and number of segments that keys can start in."""
    if n < 2:
        return 4, 1
    segment = 1 << min(18, max(2, int(np.floor(np.log(n) / np.log(3.33) + 2.25))))
    factor = max(1.125, 0.875 + 0.25 * np.log(1_000_000) / np.log(n))
    return segment, max(1, -(-int(np.ceil(n * factor)) // segment) - 2)


def _probes(keys: np.ndarray, seed: int, segment: int, starts: int) -> tuple[np.ndarray, np.ndarray]:
    """The three slots of each key, one in each of three neighbouring segments, and its one-byte fingerprint."""
    h = mix(keys + mix(np.array([seed + 1], dtype=np.uint64)))
    first = ((h >> np.uint64(32)) * np.uint64(starts)) >> np.uint64(32)
    inside = np.uint64(segment - 1)
    slots = np.empty((3, len(keys)), dtype=np.int64)
    for i, shift in enumerate((0, 18, 36)):
        slots[i] = ((first + np.uint64(i)) * np.uint64(segment) + ((mix(h + _FINGER) >> np.uint64(shift)) & inside)).astype(np.int64)
    return slots, (h & np.uint64(0xFF)).astype(np.uint8)


def build_filter(keys: np.ndarray) -> bytes:
    """A binary-fuse filter of distinct uint64 keys. Its header holds the seed and the geometry."""
    n = len(keys)
    segment, starts = _geometry(n)
    size = segment * (starts + 2)
    for seed in range(1000):
        slots, finger = _probes(keys, seed, segment, starts)
        count = np.bincount(slots.ravel(), minlength=size)
        owner = np.zeros(size, dtype=np.int64)  # xor of the keys at a slot: the one key, where it is one
        for row in slots:
            np.bitwise_xor.at(owner, row, np.arange(n, dtype=np.int64))
        waves, left = [], n
        single = np.flatnonzero(count == 1)
        while len(single):  # peel all slots that hold one key, wave by wave
            peeled, at = np.unique(owner[single], return_index=True)
            own = single[at]
            waves.append((peeled, own))
            left -= len(peeled)
            for row in slots:
                np.subtract.at(count, row[peeled], 1)
                np.bitwise_xor.at(owner, row[peeled], peeled)
            touched = np.unique(slots[:, peeled])
            single = touched[count[touched] == 1]
        if left == 0:
            break
    else:
        raise ValueError("no seed gives a filter; are the keys distinct?")
    table = np.zeros(size, dtype=np.uint8)
    for peeled, own in reversed(waves):
        others = np.bitwise_xor.reduce(table[slots[:, peeled]], axis=0)
        table[own] = finger[peeled] ^ others ^ table[own]
    return np.array([seed, segment, starts], dtype="<i8").tobytes() + table.tobytes()


def may_hold(filter_: bytes, keys: np.ndarray) -> np.ndarray:
    """False only for keys that are not in the filter."""
    seed, segment, starts = (int(x) for x in np.frombuffer(filter_[:24], dtype="<i8"))
    table = np.frombuffer(filter_[24:], dtype=np.uint8)
    slots, finger = _probes(keys, seed, segment, starts)
    return np.bitwise_xor.reduce(table[slots], axis=0) == finger


# -- digests ------------------------------------------------------------------------------------------------


def with_digest(docs: DataFrame, text: str = "text", digest: str = "digest", normal: str | None = None) -> DataFrame:
    """Adds the SHA-256 of the text with A to Z lower-cased, as binary; null counts as empty.

    With ``normal``, the normalised text is added as binary under that name, in place of the text.
    """
    kept = docs.drop(digest)
    place = kept.columns.index(text)
    names = [c for c in kept.columns if c != text]
    fields = [kept.schema[c] for c in names] + [T.StructField(digest, T.BinaryType())]
    if normal:
        fields.append(T.StructField(normal, T.BinaryType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode("utf-8").lower() for t in batch.column(place).to_pylist()]
            columns = [c for i, c in enumerate(batch.columns) if i != place]
            columns.append(pa.array([hashlib.sha256(t).digest() for t in texts], type=pa.binary()))
            if normal:
                columns.append(pa.array(texts, type=pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return kept.mapInArrow(run, T.StructType(fields))


def _keys(digests: pd.Series) -> np.ndarray:
    """The first eight bytes of each digest, what the filters hold."""
    return np.frombuffer(b"".join(d[:8] for d in digests), dtype="<u8")


def _bucket(digest: str, buckets: int):
    return F.pmod(F.xxhash64(digest), F.lit(buckets)).cast("int")


# -- snapshots ----------------------------------------------------------------------------------------------


def snapshot_filters(snapshot: DataFrame, buckets: int) -> DataFrame:
    """(bucket, filter) for the distinct digests of an immutable snapshot."""
    distinct = snapshot.select("digest").distinct().withColumn("bucket", _bucket("digest", buckets))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        keys = np.unique(_keys(group["digest"]))
        return pd.DataFrame({"bucket": [group["bucket"].iloc[0]], "filter": [build_filter(keys)]})

    return distinct.groupBy("bucket").applyInPandas(build, "bucket int, filter binary")


def screened(incoming: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """The distinct digests of ``incoming`` that a snapshot may hold."""
    distinct = incoming.select("digest").distinct().withColumn("bucket", _bucket("digest", buckets))

    def probe(group: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(group) or not len(held):
            return pd.DataFrame({"digest": []})
        passes = may_hold(bytes(held["filter"].iloc[0]), _keys(group["digest"]))
        return group.loc[passes, ["digest"]]

    both = distinct.groupBy("bucket").cogroup(filters.groupBy("bucket"))
    return both.applyInPandas(probe, "digest binary")


def dedup(snapshots: list[DataFrame], incoming: DataFrame) -> DataFrame:
    """Groups of equal texts over snapshots and a new batch, each ``(doc_id, text)``; other columns are ignored.

    Returns doc_id, digest, keep_id (the largest doc_id of the group), group_size, kept: a row for each row that
    comes in. Rows that repeat a doc_id are each rows of their own; of those that carry the largest id of a group
    all are kept, since the id names the row. A null doc_id is smaller than any other; a group of nothing but nulls
    keeps them all. Null texts count as empty. Empty inputs are fine.
    """
    parts = [written(with_digest(p.select("doc_id", "text")), "digests") for p in [*snapshots, incoming]]
    *old, new = parts
    pairs = None  # digests with a partner: in another part, or in their own
    for i, part in enumerate(parts):
        inside = part.groupBy("digest").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("digest")
        pairs = inside if pairs is None else pairs.unionByName(inside)
        for later in parts[i + 1 :]:  # a filter is made once for a snapshot and meets all that came after it
            buckets = max(1, -(-part.count() // BUCKET_KEYS))
            passed = screened(later, snapshot_filters(part, buckets), buckets)
            pairs = pairs.unionByName(passed.join(part.select("digest"), "digest", "left_semi"))
    shared = written(pairs.distinct().withColumn("_shared", F.lit(True)), "shared-digests")
    rows = old[0] if old else new
    for part in parts[1:]:
        rows = rows.unionByName(part)
    texts = snapshots[0].select("doc_id", "text") if snapshots else incoming.select("doc_id", "text")
    for part in [*snapshots, incoming][1:]:
        texts = texts.unionByName(part.select("doc_id", "text"))
    groups = written(_compared(texts, shared), "groups")
    apart = groups.groupBy("digest").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("digest")
    if apart.isEmpty():  # as good as always: one text for each digest
        labels = groups.select("digest", "keep_id", "group_size")
        found = rows.join(labels, "digest", "left")
    else:  # different texts under one digest: the rows say which text is theirs
        named = with_digest(texts, normal="normal").withColumn("_text", F.col("normal")).drop("normal")
        labels = groups.select(F.col("digest").alias("_d"), "normal", "keep_id", "group_size")
        found = named.join(labels, (named["digest"] == F.col("_d")) & (named["_text"] == F.col("normal")), "left")
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select(
        "doc_id",
        "digest",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
    )


def _compared(texts: DataFrame, shared: DataFrame) -> DataFrame:
    """(digest, normal, keep_id, group_size) of rows with a partner, grouped by their very bytes."""
    hashed = with_digest(texts, normal="normal")
    candidates = sieved(hashed, F.col("digest"), shared, F.col("digest"))
    grouped = candidates.groupBy("digest", "normal").agg(
        F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )
    return grouped.join(shared.select("digest"), "digest", "left_semi")
