"""Binary-fuse filters miss no key; the rendezvous draw recomputed; unequal weights, repeated and null ids."""

import math
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cartulary.llm.exact import build_filter, dedup, may_hold
from cartulary.llm.shards import rendezvous, shard_documents


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 1_000, 50_000])
def test_filters_hold_all_their_keys(n):
    draw = np.random.default_rng(n)
    keys = np.unique(draw.integers(0, 1 << 63, 2 * n).astype(np.uint64))[:n]
    built = build_filter(keys)
    assert may_hold(built, keys).all()
    others = draw.integers(1 << 63, 1 << 64, 20_000, dtype=np.uint64)
    assert may_hold(built, others).mean() < 0.02 or n < 10
    assert len(built) < 24 + max(64, 1.5 * n)


def test_repeated_and_null_ids_in_exact_dedup(spark):
    schema = "doc_id long, text string, digest int, keep_id int"
    old = spark.createDataFrame([(1, "A", 0, 0), (1, "A", 0, 0), (None, "b", 0, 0), (7, None, 0, 0)], schema)
    new = spark.createDataFrame([(2, "a", 0, 0), (None, "B", 0, 0), (2, "c", 0, 0), (9, "", 0, 0), (2, "a", 0, 0)], schema)
    got = Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in dedup([old], new).collect())
    want = Counter({(1, 2, 4, False): 2, (2, 2, 4, True): 2, (None, None, 2, True): 2, (2, 2, 1, True): 1, (7, 9, 2, False): 1, (9, 9, 2, True): 1})
    assert got == want
    assert dedup([old.limit(0)], new.limit(0)).count() == 0


def drawn(key, weights, seed=0):
    """The shard by the law, with hashes of another library."""
    draws = []
    for shard, weight in enumerate(weights):
        h = 42
        for form, value in (("<q", key), ("<i", shard), ("<i", seed)):
            h = xxhash.xxh64_intdigest(struct.pack(form, value), seed=h)
        if weight:
            draws.append((-math.log(((h >> 11) + 0.5) / (1 << 53)) / weight, shard))
    return min(draws)[1]


@pytest.mark.parametrize("weights", [[1.0] * 8, [1.0, 2.0, 0.0, 5.0], [3.0]])
def test_the_draw(spark, weights):
    rows = spark.range(-500, 1_500).select("id", rendezvous(F.col("id"), weights).alias("s")).collect()
    assert all(r["s"] == drawn(r["id"], weights) for r in rows)


def test_weights_share_and_growth_moves_keys_into_the_new_shard_alone(spark):
    weights = [1.0, 2.0, 5.0, 0.0]
    ids = spark.range(40_000)
    rows = ids.select(rendezvous(F.col("id"), weights).alias("a"), rendezvous(F.col("id"), [*weights, 2.0]).alias("b")).collect()
    shares = Counter(r["a"] for r in rows)
    assert shares[3] == 0 and all(abs(shares[i] / 40_000 - weights[i] / 8) < 0.02 for i in range(3))
    assert {r["b"] for r in rows if r["a"] != r["b"]} == {4}
    with pytest.raises(ValueError):
        rendezvous(F.col("id"), [0.0])


def test_repeated_ids_clashing_names_and_checksums(spark):
    rows = [(i % 40, f"é{i}" if i % 7 else None, 1, 2, 3, 4) for i in range(200)] + [(None, "x", 1, 2, 3, 4)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, _run int, _n int, _offset int, slot int")
    got = shard_documents(df, [1.0, 1.0, 3.0]).collect()
    assert Counter((r["doc_id"], r["text_crc32"], r["size"]) for r in got) == Counter(
        (d, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for d, t, *_ in rows
    )
    for shard in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in got)))
    assert len({r["shard"] for r in got if r["doc_id"] is None}) == 1
