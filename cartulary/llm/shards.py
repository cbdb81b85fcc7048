"""Sharding by weighted rendezvous hashing, and gapless slots inside a shard. Column work only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_RUN = 50_000  # rows that are numbered in one window; sets how far a shard is split, not the result's shape


def rendezvous(key: Column, weights: Sequence[float], seed: int = 0) -> Column:
    """The shard, 0-based, that draws ``key``: the smallest -ln(u) / weight over all shards.

    u comes from a hash of key and shard alone, so adding a shard moves only keys that the new shard draws,
    and a larger weight only draws keys in. Shards of weight 0 get nothing. A null key is a key like any other.
    """
    if not weights or min(weights) < 0 or max(weights) == 0:
        raise ValueError("weights are not negative, and one is above 0")
    draws = []
    for shard, weight in enumerate(weights):
        if weight > 0:
            hashed = F.shiftrightunsigned(F.xxhash64(key, F.lit(shard), F.lit(seed)), 11)
            u = (hashed.cast("double") + 0.5) / float(1 << 53)
            draws.append(F.struct((-F.log(u) / F.lit(float(weight))).alias("draw"), F.lit(shard).alias("shard")))
    return (F.least(*draws) if len(draws) > 1 else draws[0]).getField("shard")


def with_slots(rows: DataFrame, shard: str, key: str, ties: Sequence[str], total: int | None = None) -> DataFrame:
    """Adds ``slot``: a gapless number from 0 within each shard, without a window over a whole shard.

    A shard is cut into runs by a hash of ``key``; a window numbers the rows of a run by key and ``ties``, and
    runs get their offset from the counts of the runs before them. Those counts read no column but the key and
    what the shard follows from. Rows of one key share a run; equal rows take neighbouring slots.
    """
    total = rows.count() if total is None else total
    runs = max(1, -(-total // ROWS_PER_RUN))
    cut = rows.withColumn("_run", F.pmod(F.xxhash64(key, F.lit("run")), F.lit(runs)))
    counts = cut.groupBy(shard, "_run").agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.partitionBy(shard).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(shard, "_run", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(shard, "_run").orderBy(key, *ties)
    numbered = cut.withColumn("_at", F.row_number().over(inside) - 1)
    placed = numbered.join(offsets, [shard, "_run"])
    return placed.select(*rows.columns, (F.col("_offset") + F.col("_at")).cast("long").alias("slot"))


def shard_documents(docs: DataFrame, weights: Sequence[float], grown: Sequence[float] | None = None, seed: int = 0) -> DataFrame:
    """Places each row of ``docs(doc_id, text)``; other columns are ignored.

    Returns doc_id, size (UTF-8 bytes of the text plus 1, a null text counts none), text_crc32 (null: 0), shard,
    slot, grown_shard (the shard under the weights ``grown``, null without them). Only doc_id and the weights
    decide, so equal texts under different ids may part and rows that repeat an id stay together; null ids share
    a shard. The shuffle moves ids, sizes and checksums, never texts.
    """
    facts = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        rendezvous(F.col("doc_id"), weights, seed).alias("shard"),
        (rendezvous(F.col("doc_id"), grown, seed) if grown else F.lit(None).cast("int")).alias("grown_shard"),
    )
    return with_slots(facts, "shard", "doc_id", ["text_crc32", "size"], total=docs.count())
