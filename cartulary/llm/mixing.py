"""Mixing sources to target weights.

Every source is cut into blocks by a hash of its rows. A source's target becomes a quota of blocks: whole
epochs, then a prefix of a permuted epoch, whose last block is taken in part so that the words come near the
target. A splitting tree hands the quotas to the output shards: each node draws its left child's blocks from a
multivariate hypergeometric distribution, so all shards hold the mixture and the quotas are met exactly. The
blocks of a shard are the next ones of each source's permuted order, hence disjoint, and rows are shuffled
within their shard.

The driver sees one row per source and per block (bounded by MAX_BLOCKS), never rows of documents; what it
sends back is one row per source.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartulary.llm.common import beside, written

WORD = r"[^\x20\x09-\x0D]+"
MAX_BLOCKS = 200_000  # blocks of all sources together, besides one for each source
BLOCK_WORDS = 100_000  # words a block holds at least, on average
DIGITS = 1024  # parts a block that straddles its target is cut into, up to twice
UNITS = 2_000  # units of such a part that are looked at one by one
BROADCAST_BYTES = 16 << 20  # plan rows up to this size are broadcast, more are joined by shuffle


def words_in(text: Column) -> Column:
    """How many runs of anything but ASCII white space the text has; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fill_targets(sizes: Sequence[int], weights: Sequence[float], total: float, most: float) -> list[float]:
    """Shares of ``total`` by weight, none above ``most`` times its size; the excess is shared again."""
    targets = [0.0] * len(sizes)
    open_, left = [i for i, w in enumerate(weights) if w > 0], float(total)
    while open_:
        level = left / math.fsum(weights[i] for i in open_)
        full = [i for i in open_ if level * weights[i] > most * sizes[i]]
        if not full:
            for i in open_:
                targets[i] = level * weights[i]
            break
        for i in full:
            targets[i] = float(most * sizes[i])
        left -= math.fsum(targets[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return targets


def _fill(units: list[tuple[int, int]], rest: float) -> list[int]:
    """Units (key, words) whose words come near ``rest``: in order while they fit, then the largest that fit."""
    taken, at = [], 0
    while at < len(units) and units[at][1] <= rest:
        rest -= units[at][1]
        taken.append(units[at][0])
        at += 1
    left = []
    for words, key in sorted(((w, k) for k, w in units[at:]), reverse=True):
        if words <= rest:
            rest -= words
            taken.append(key)
        else:
            left.append((words, key))
    if left and min(left)[0] - rest < rest:
        taken.append(min(left)[1])
    return taken


def split_quotas(quotas: Sequence[int], shards: int, seed: int) -> np.ndarray:
    """Blocks of each source (column) for each shard (row): a tree of multivariate hypergeometric draws.

    A node halves its shards; its left half takes its share of the node's blocks, drawn without replacement
    over the sources. Every draw has its own generator, named by the seed and the node.
    """
    out = np.zeros((shards, len(quotas)), dtype=np.int64)
    nodes = [(0, shards, np.asarray(quotas, dtype=np.int64))]
    while nodes:
        low, high, held = nodes.pop()
        if high - low == 1:
            out[low] = held
            continue
        middle, total = (low + high) // 2, int(held.sum())
        draw = np.random.default_rng([seed, low, high])
        taken = total * (middle - low) // (high - low)
        left = draw.multivariate_hypergeometric(held, taken, method="marginals") if total else held
        nodes += [(low, middle, left), (middle, high, held - left)]
    return out


@dataclass
class Share:
    """What is decided for one source."""

    source: str | None
    words: int
    rows: int
    target: float
    blocks: int
    seed: int
    epochs: int = 0
    quota: int = 0  # whole blocks of the last, partial epoch
    cut1: int = -1  # digits of the block in part, -1 where it was not cut further
    cut2: int = -1
    extras: list[int] = field(default_factory=list)
    cuts: list[int] = field(default_factory=list)  # first draw of each shard
    rest: float = 0.0

    def affine(self, epoch: int) -> tuple[int, int]:
        """A permutation of the blocks, b -> (a * b + c) mod blocks."""
        draw = np.random.default_rng([self.seed, epoch])
        a = int(draw.integers(1, self.blocks + 1))
        while math.gcd(a, self.blocks) != 1:
            a = a % self.blocks + 1
        return a, int(draw.integers(self.blocks))

    def positions(self, epoch: int) -> np.ndarray:
        a, c = self.affine(epoch)
        return (a * np.arange(self.blocks, dtype=np.int64) + c) % self.blocks


PLAN = T.StructType(
    [
        T.StructField("_source", T.StringType()),
        T.StructField("source_size", T.LongType()),
        T.StructField("target", T.DoubleType()),
        T.StructField("_blocks", T.LongType()),
        T.StructField("_epochs", T.IntegerType()),
        T.StructField("_quota", T.LongType()),
        T.StructField("_cut1", T.IntegerType()),
        T.StructField("_cut2", T.IntegerType()),
        T.StructField("_extras", T.ArrayType(T.LongType())),
        T.StructField("_cuts", T.ArrayType(T.LongType())),
        T.StructField("_a", T.ArrayType(T.LongType())),
        T.StructField("_c", T.ArrayType(T.LongType())),
    ]
)


@dataclass(frozen=True)
class Mixture:
    """``weights`` maps the sorted sources (code points, null last) to their weights."""

    weights: Callable[[list[str | None]], list[float]]
    share: float = 1.0  # words of the mix, as a share of all words
    copies: int = 2  # a row is taken so many times at most
    words_per_shard: int = 2_000_000
    max_shards: int = 65_536
    seed: int = 17

    def place(self, docs: DataFrame) -> DataFrame:
        """Adds size, source_size, target, taken and placements (array of copy, shard) to ``docs(doc_id, text, source)``.

        Other columns pass through; a column that has one of the new names is replaced. The unit is the row:
        rows equal in doc_id, source and text move together, all others alone. Defined cases: a null or empty
        text has size 0 and is taken as often as its block; a null source is a source, sorted last; a source
        without words has target 0; no rows give no rows. Reruns give the same rows.
        """
        docs = docs.drop("size", "source_size", "target", "taken", "placements")
        key = F.xxhash64("doc_id", "source", "text")
        sized = written(
            docs.select(F.col("source").alias("_source"), words_in(F.col("text")).alias("size"), key.alias("_key")),
            "sizes",
        )
        plan, bytes_ = self._plan(sized)
        plan = F.broadcast(plan) if bytes_ <= BROADCAST_BYTES else plan
        rows = docs.withColumn("size", words_in(F.col("text"))).withColumn("_key", key)
        joined = rows.join(plan, rows["source"].eqNullSafe(plan["_source"]))
        placed = joined.withColumn("placements", self._placements())
        return placed.select(
            *docs.columns,
            "size",
            "source_size",
            "target",
            (F.col("size") * F.size("placements")).cast("long").alias("taken"),
            "placements",
        )

    def mix(self, docs: DataFrame) -> DataFrame:
        """The mix itself: each row as often as it is taken, with mix_shard and mix_order.

        A shard lies in one partition, in the order of its local shuffle.
        """
        return beside(docs.drop("mix_shard", "mix_order"), ["doc_id", "text", "source"], self._drawn)

    def _drawn(self, base: DataFrame) -> DataFrame:
        placed = self.place(base)
        rows = placed.select(*[c for c in base.columns], F.explode("placements").alias("_p"))
        drawn = rows.select(
            *base.columns,
            F.col("_p.shard").alias("mix_shard"),
            F.xxhash64("doc_id", "text", "_p.copy", F.lit(self.seed)).alias("mix_order"),
        )
        return drawn.repartition("mix_shard").sortWithinPartitions("mix_shard", "mix_order")

    def _plan(self, sized: DataFrame) -> tuple[DataFrame, int]:
        spark = sized.sparkSession
        totals = sized.groupBy("_source").agg(F.sum("size").alias("w"), F.count(F.lit(1)).alias("n")).collect()
        totals = sorted(totals, key=lambda r: (r["_source"] is None, r["_source"] or ""))
        if not totals:
            return spark.createDataFrame([], PLAN), 0
        words = [r["w"] for r in totals]
        every = sum(words)
        targets = fill_targets(words, self.weights([r["_source"] for r in totals]), self.share * every, self.copies)
        block = max(BLOCK_WORDS, -(-every // MAX_BLOCKS))
        shares = [
            Share(r["_source"], r["w"], r["n"], t, max(1, -(-r["w"] // block)), seed=self.seed * 1_000_003 + i)
            for i, (r, t) in enumerate(zip(totals, targets, strict=True))
        ]
        self._cut(sized, shares)
        drawn = [s.epochs * s.blocks + s.quota + (s.epochs < self.copies) for s in shares]
        shards = max(1, min(self.max_shards, -(-int(sum(targets)) // self.words_per_shard)))
        split = split_quotas(drawn, shards, self.seed)
        firsts = np.vstack([np.zeros((1, len(shares)), dtype=np.int64), np.cumsum(split, axis=0)[:-1]])
        for i, s in enumerate(shares):
            s.cuts = firsts[:, i].tolist()
        rows = []
        for s in shares:
            moves = [s.affine(e) for e in range(self.copies)]
            a, c = [m[0] for m in moves], [m[1] for m in moves]
            rows.append((s.source, s.words, s.target, s.blocks, s.epochs, s.quota, s.cut1, s.cut2, s.extras, s.cuts, a, c))
        return spark.createDataFrame(rows, PLAN), sum(8 * (len(r[8]) + len(r[9]) + 16) for r in rows)

    def _cut(self, sized: DataFrame, shares: list[Share]) -> None:
        """Finds, for every source, where its permuted order reaches the target."""
        spark = sized.sparkSession
        for s in shares:
            s.epochs = min(self.copies, int(s.target // s.words)) if s.words else 0
            s.rest = max(0.0, s.target - s.epochs * s.words) if s.epochs < self.copies else 0.0
        by_source = {s.source: s for s in shares}
        known = spark.createDataFrame([(s.source, s.blocks) for s in shares], "_s string, _blocks long")
        rows = sized.join(F.broadcast(known) if len(shares) <= 100_000 else known, F.col("_source").eqNullSafe(F.col("_s")))
        rows = rows.withColumn("_block", F.pmod("_key", "_blocks"))
        sums = rows.groupBy("_source", "_block").agg(F.sum("size").alias("w"), F.count(F.lit(1)).alias("n")).collect()
        held: dict[str | None, tuple[np.ndarray, np.ndarray]] = {
            s.source: (np.zeros(s.blocks, dtype=np.int64), np.zeros(s.blocks, dtype=np.int64)) for s in shares
        }
        for r in sums:
            held[r["_source"]][0][r["_block"]], held[r["_source"]][1][r["_block"]] = r["w"], r["n"]
        marks = []  # the block of each source that is taken in part
        for s in shares:
            if s.epochs >= self.copies:
                continue
            order = np.argsort(s.positions(s.epochs), kind="stable")
            ahead = np.cumsum(held[s.source][0][order])
            s.quota = int(min(np.searchsorted(ahead, s.rest, side="right"), s.blocks - 1))
            s.rest -= float(ahead[s.quota - 1]) if s.quota else 0.0
            part = int(order[s.quota])
            marks.append((s.source, part, int(held[s.source][1][part])))
        for level in (1, 2):
            wide = [m for m in marks if m[2] > UNITS]
            if not wide:
                break
            digit = F.pmod(F.xxhash64("_key", F.lit(level)), F.lit(DIGITS))
            inside = self._inside(rows, wide, by_source).withColumn("_digit", digit)
            parts: dict[str | None, list[tuple[int, int, int]]] = {}
            for r in inside.groupBy("_source", "_digit").agg(F.sum("size").alias("w"), F.count(F.lit(1)).alias("n")).collect():
                parts.setdefault(r["_source"], []).append((r["_digit"], r["w"], r["n"]))
            narrowed = {}
            for source, listed in parts.items():
                s, ahead = by_source[source], 0
                for digit_, w, n in sorted(listed):
                    if ahead + w > s.rest or digit_ == max(listed)[0]:
                        break
                    ahead += w
                s.rest -= ahead
                setattr(s, f"cut{level}", digit_)
                narrowed[source] = n
            marks = [(a, b, narrowed.get(a, n)) for a, b, n in marks]
        if not marks:
            return
        units = self._inside(rows, marks, by_source).groupBy("_source", "_key").agg(F.sum("size").alias("w"))
        listed_units: dict[str | None, list[tuple[int, int]]] = {}
        for r in units.collect():
            listed_units.setdefault(r["_source"], []).append((r["_key"], r["w"]))
        for source, found in listed_units.items():
            s = by_source[source]
            s.extras = _fill(sorted(found), s.rest)

    def _inside(self, rows: DataFrame, marks: list, by_source: dict[str | None, Share]) -> DataFrame:
        """The rows in the part of a block that still has to be cut, for the sources in ``marks``."""
        cuts = [(a, b, by_source[a].cut1, by_source[a].cut2) for a, b, _ in marks]
        part = rows.sparkSession.createDataFrame(cuts, "_m string, _part long, _d1 int, _d2 int")
        part = F.broadcast(part) if len(cuts) <= 100_000 else part
        inside = rows.join(part, F.col("_source").eqNullSafe(F.col("_m")) & (F.col("_block") == F.col("_part")))
        for level in (1, 2):
            digit = F.pmod(F.xxhash64("_key", F.lit(level)), F.lit(DIGITS))
            inside = inside.where((F.col(f"_d{level}") == -1) | (digit == F.col(f"_d{level}")))
        return inside

    def _placements(self) -> Column:
        block = F.pmod("_key", "_blocks")
        listed = F.array_contains("_extras", F.col("_key"))
        inside = listed
        for level in (2, 1):
            digit, cut = F.pmod(F.xxhash64("_key", F.lit(level)), F.lit(DIGITS)), F.col(f"_cut{level}")
            inside = F.when(cut == -1, listed).otherwise((digit < cut) | ((digit == cut) & inside))
        steps = [1 << i for i in range(self.max_shards.bit_length() - 1, -1, -1)]
        copies = []
        for epoch in range(self.copies):
            at = F.pmod(F.get("_a", F.lit(epoch)) * block + F.get("_c", F.lit(epoch)), F.col("_blocks"))
            drawn = (F.col("_epochs") > epoch) | (
                (F.col("_epochs") == epoch) & ((at < F.col("_quota")) | ((at == F.col("_quota")) & inside))
            )
            draw = F.lit(epoch) * F.col("_blocks") + at
            shard = _last_not_behind("_cuts", draw, steps)
            copies.append(F.when(drawn, F.struct(F.lit(epoch).alias("copy"), shard.alias("shard"))))
        return F.array_compact(F.array(*copies))


def _last_not_behind(cuts: str, draw: Column, steps: list[int]) -> Column:
    """The last index of the sorted ``cuts`` whose value is not above ``draw``, by halving steps."""

    def halve(low: Column, step: Column) -> Column:
        return F.when(F.get(cuts, low + step) <= draw, low + step).otherwise(low)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), halve)
