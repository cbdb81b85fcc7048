"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartulary.session import scratch_path


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """``df`` as a table in the shared scratch folder, read back: lineage ends here and survives lost executors."""
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex[:8]}")
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def beside(docs: DataFrame, used: Sequence[str], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work`` on the columns ``used``, the others carried as one struct, so that no name of theirs can clash."""
    others = [c for c in docs.columns if c not in used]
    carried = docs.select(*used, F.struct(*[F.col(f"`{c}`") for c in others]).alias("_others")) if others else docs.select(*used)
    done = work(carried)
    added = [c for c in done.columns if c not in (*used, "_others")]
    return done.select(*[F.col(c) if c in used else F.col("_others").getField(c).alias(c) for c in docs.columns], *added)


SIEVE_BITS = 1 << 24  # of a sieve: at most 262,144 rows of 16 bytes, whatever the data


def sieved(rows: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column, inside: bool = True) -> DataFrame:
    """``rows`` without most of those whose key is not among the wanted; never drops one that is.

    With ``inside`` false, the other rows: those the sieve knows not to be wanted.

    A bitmap of fixed size is broadcast, so rows with large texts need not be shuffled to find out that nobody
    asks for them. An exact join has to follow. With far more than ten million wanted keys it lets most through.
    """

    def place(hashed: Column) -> Column:
        return F.pmod(F.xxhash64(hashed), F.lit(SIEVE_BITS))

    def bit(at: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)).cast("int"))

    words = (
        wanted.select(place(wanted_key).alias("_spot"))
        .groupBy(F.shiftright("_spot", 6).alias("_word"))
        .agg(F.bit_or(bit(F.col("_spot"))).alias("_bits"))
    )
    marked = rows.withColumn("_spot", place(key))
    met = marked.join(F.broadcast(words), F.shiftright("_spot", 6) == F.col("_word"), "inner" if inside else "left")
    hit = F.coalesce(F.col("_bits").bitwiseAND(bit(F.col("_spot"))) != 0, F.lit(False))
    return met.where(hit if inside else ~hit).select(*rows.columns)


def connected(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges(a, b)``: the smallest node it is connected with.

    Large-star and small-star rounds: each ties a node's neighbours to the smallest of them, until nothing changes.
    Every round is written to the shared folder. Nodes are longs; loops and repeated edges are harmless.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = written(pairs, "edges")
    before = None
    while True:
        facts = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if before == facts:
            break
        before = facts
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = moved.unionByName(least.select("a", F.col("m").alias("b")))
        now = written(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("label"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots).distinct()
