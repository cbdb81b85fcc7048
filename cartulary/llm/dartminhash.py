"""Near-dedup by DartMinHash signatures.

Darts fall on the plane of every element: a weight from 0 up and a rank from 0 up, one dart on average in a unit of
area, at places that only the element decides. A dart counts for a document if it falls within the element's weight
there. Each dart also names one of ``k`` coordinates, and a coordinate keeps its dart of lowest rank. Two documents
agree on a coordinate with the probability of their weighted Jaccard similarity. Ranks are walked in layers that
double, and a document stops at the first layer that leaves no coordinate empty: about k ln k darts, whatever its length.

Documents that share a band of a signature become candidates. A shingle that no other candidate has is common to no pair, so
a text can only have a partner if enough of its shingles are left; unlike texts round a shared passage, and copies with many
changes of their own, leave their bands by that count. The rest is tied to two representatives of the band, one of them
the text with the smallest share of shingles of its own, so a band of m documents gives 2m candidate pairs. Pairs are
checked on their whole shingle sets; groups are the connected components of the pairs that pass. Bands that then hold more
than one class are gone through in rounds with more and more representatives, until every pair of a band is in one
class, checked, or told apart by what is known: 1 - Jaccard is a metric, so texts whose likeness to a representative
differs by more than a pair may differ are no pair; and what two have in common is common with a representative, or is
outside it and shared, so two that have too few of either are no pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartulary.llm.common import beside, connected, sieved, written
from cartulary.llm.shingles import WIDTH, jaccard, mix, shingle_hashes, slices
from cartulary.operators.hotkeys import lookup

BANDS, ROWS = 25, 5
SIMILAR = 0.8

_FIRST = 2.0**-8  # rank at which the first layer ends
_LAYER, _DART, _CELL = (np.uint64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3))


def _poisson_table(width: float) -> np.ndarray:
    """Cumulated probabilities of 0, 1, 2, ... darts in a layer of that width."""
    n = np.arange(int(width + 12 * np.sqrt(width) + 16))
    log = n * np.log(width) - width - np.concatenate(([0.0], np.cumsum(np.log(n[1:]))))
    return np.cumsum(np.exp(log))


def signatures(
    elements: Sequence[np.ndarray], k: int = BANDS * ROWS, weights: Sequence[np.ndarray] | None = None
) -> np.ndarray:
    """One row of ``k`` dart hashes for each set of elements (int64 hashes, each once); without elements all 0.

    ``weights`` are positive; without them every element weighs 1.
    """
    out = np.zeros((len(elements), k), dtype=np.uint64)
    lengths = np.array([len(e) for e in elements], dtype=np.int64)
    if not lengths.sum():
        return out
    cells = np.concatenate(elements).astype(np.uint64)
    owner = np.repeat(np.arange(len(elements)), lengths)
    part = np.ones(len(cells))  # of the unit cell of weight that belongs to the element
    if weights is not None:  # an element of weight w has ceil(w) cells, the last one in part
        w = np.concatenate(weights).astype(np.float64)
        n = np.maximum(1, np.ceil(w)).astype(np.int64)
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        cells, owner = np.repeat(cells, n), np.repeat(owner, n)
        part = np.minimum(1.0, np.repeat(w, n) - nth)
        cells = cells + nth.astype(np.uint64) * _CELL
    best = np.full(len(elements) * k, np.inf)
    layer, low, high = 0, 0.0, _FIRST
    while len(cells):
        table = _poisson_table(high - low)
        drawn = mix(cells + np.uint64((layer + 1) * int(_LAYER) & 0xFFFFFFFFFFFFFFFF))
        share = (drawn >> np.uint64(11)) * 2.0**-53
        some = np.flatnonzero(share >= table[0])
        n = np.searchsorted(table, share[some], side="right")
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        source = np.repeat(some, n)
        dart = mix(drawn[source] + (nth + 1).astype(np.uint64) * _DART)
        inside = (mix(dart + _CELL) >> np.uint64(11)) * 2.0**-53 < part[source]
        dart, doc = dart[inside], owner[source][inside]
        rank = low + (high - low) * (mix(dart) >> np.uint64(11)) * 2.0**-53
        at = doc * k + (mix(dart ^ _LAYER) % np.uint64(k)).astype(np.int64)
        order = np.lexsort((dart, rank, at))
        at, rank, dart = at[order], rank[order], dart[order]
        first = np.concatenate(([True], at[1:] != at[:-1])) if len(at) else np.zeros(0, dtype=bool)
        at, rank, dart = at[first], rank[first], dart[first]
        open_ = np.isinf(best[at])  # an earlier layer has lower ranks
        best[at[open_]] = rank[open_]
        out.reshape(-1)[at[open_]] = dart[open_]
        unfilled = np.isinf(best.reshape(len(elements), k)).any(axis=1)
        live = unfilled[owner]
        cells, owner, part = cells[live], owner[live], part[live]
        layer, low, high = layer + 1, high, 2 * high
    return out


def band_keys(found: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A long for each band, different for different bands."""
    keys = np.zeros((len(found), bands), dtype=np.uint64)
    grouped = found[:, : bands * rows].reshape(len(found), bands, rows)
    for i in range(rows):
        keys = mix(keys * _CELL + grouped[:, :, i] + np.arange(bands, dtype=np.uint64)[None, :])
    return keys.view(np.int64)


def _node(shingles: np.ndarray) -> int:
    """A long that stands for a set of shingles."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def signed(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, text_hash, node, bands) of ``docs(doc_id, text, text_hash)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                sets = shingle_hashes([(t or "").encode("utf-8") for t in part.column(1).to_pylist()], width)
                keys = band_keys(signatures(sets))
                columns = [
                    part.column(0),
                    part.column(2),
                    pa.array([_node(s) for s in sets], type=pa.int64()),
                    pa.array([row if len(s) else row[:0] for row, s in zip(keys, sets, strict=True)], type=pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "node", "bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, text_hash long, node long, bands array<long>"
    return docs.select("doc_id", "text", "text_hash").mapInArrow(run, schema)


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """(node, size, shingles): the shingle hashes of each text as binary, and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0):
                sets = shingle_hashes([(t or "").encode("utf-8") for t in part.column(0).to_pylist()], width)
                columns = [
                    pa.array([_node(s) for s in sets], type=pa.int64()),
                    pa.array([len(s) for s in sets], type=pa.int64()),
                    pa.array([s.tobytes() for s in sets], type=pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "size", "shingles"])

    return docs.select("text").mapInArrow(run, "node long, size long, shingles binary")


def _shared(sets: DataFrame) -> DataFrame:
    """(node, size, shared) of ``sets(node, size, shingles)``: how many shingles of each another one has too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                found = [np.frombuffer(s, dtype=np.int64) for s in part.column(1).to_pylist()]
                owners = np.repeat(part.column(0).to_numpy(), [len(f) for f in found])
                yield pa.RecordBatch.from_arrays([pa.array(owners), pa.array(np.concatenate(found))], names=["node", "h"])

    each = sets.select("node", "shingles").mapInArrow(run, "node long, h long")
    once = each.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("node")).where("n = 1")
    own = once.groupBy("node").agg(F.count(F.lit(1)).alias("own"))
    return sets.select("node", "size").join(own, "node", "left").select("node", "size", (F.col("size") - F.coalesce("own", F.lit(0))).alias("shared"))


def _likeness(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs(a, b)`` of nodes with the Jaccard similarity of their ``sets(node, shingles)``, as (a, b, like)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(i).to_pylist() for i in (2, 3))
            like = [jaccard(np.frombuffer(x, dtype=np.int64), np.frombuffer(y, dtype=np.int64)) for x, y in zip(a, b, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(like, type=pa.float64())], names=["a", "b", "like"])

    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(left, "a").join(right, "b")
    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long, like double")


def _ordered(x: str, y: str) -> list[Column]:
    return [F.greatest(x, y).alias("a"), F.least(x, y).alias("b")]


def _linked(keys: DataFrame, ends: DataFrame, sets: DataFrame, like: DataFrame, least: float) -> DataFrame:
    """(node, label): the classes of all pairs that share a key of ``keys(node, size, shared, key)`` and are alike.

    ``ends(key, low, low_size, high, high_size)`` are the first representatives, ``like(a, b, like)`` what came of the check
    against them.
    """
    labels = written(connected(like.where(F.col("like") >= least)), "labels")
    members = keys.join(ends, "key")
    for end in ("low", "high"):
        known = like.withColumnRenamed("like", f"to_{end}")
        members = members.withColumns({"a": F.greatest("node", end), "b": F.least("node", end)}).join(known, ["a", "b"], "left")
        members = members.withColumn(f"to_{end}", F.when(F.col("node") == F.col(end), 1.0).otherwise(F.col(f"to_{end}"))).drop("a", "b")
        to = F.col(f"to_{end}")
        members = members.withColumn(f"in_{end}", F.round(to * (F.col("size") + F.col(f"{end}_size")) / (1 + to)))  # shingles in common
    told = ("size", "shared", "to_low", "to_high", "in_low", "in_high")
    members = members.select("key", "node", *told, F.col("node").isin(F.col("low"), F.col("high")).alias("done"))
    members = written(members, "members")
    checked, classes, each = like.select("a", "b"), 16, 4
    while True:
        classed = members.join(labels, "node", "left").withColumn("class", F.coalesce("label", "node")).drop("label")
        mixed = classed.groupBy("key").agg(F.min("class").alias("c"), F.max("class").alias("d")).where("c < d")
        members = written(classed.join(mixed.select("key"), "key", "left_semi").where("not done"), "members")
        reps = members.groupBy("key", F.pmod(F.xxhash64("class", "key"), F.lit(classes)), F.pmod(F.xxhash64("node", "key"), F.lit(each)))
        one = F.struct(F.xxhash64("key", "node"), "node", "class", *told)
        reps = written(reps.agg(F.min(one).alias("rep")).select("key", "rep"), "representatives")
        if reps.isEmpty():
            return labels
        apart = F.col("class") != F.col("rep.class")
        for end in ("to_low", "to_high"):
            apart &= F.abs(F.col(end) - F.col(f"rep.{end}")) <= 1 - least + 1e-9
        common = least / (1 + least) * (F.col("size") + F.col("rep.size"))  # shingles that a pair has in common, at least
        apart &= F.least("shared", "rep.shared") >= common - 1e-6
        for end in ("in_low", "in_high"):  # what two have in common is in the representative, or is shared outside it
            inside = F.least(end, f"rep.{end}")
            outside = F.least(F.col("shared") - F.col(end), F.col("rep.shared") - F.col(f"rep.{end}"))
            apart &= inside + outside >= common - 1e-6
        met = members.join(reps, "key").where(apart).select(*_ordered("node", "rep.node")).distinct()
        new = written(met.join(checked, ["a", "b"], "left_anti"), "candidates")
        found = written(_likeness(new, sets), "likeness")
        checked = checked.unionByName(found.select("a", "b"))
        more = found.where(F.col("like") >= least).select("a", "b")
        if not more.isEmpty():
            edges = labels.select(F.col("node").alias("a"), F.col("label").alias("b"))
            labels = written(connected(edges.unionByName(more)), "labels")
        used = reps.select("key", F.col("rep.node").alias("node"), F.lit(True).alias("used"))
        members = members.drop("class").join(used, ["key", "node"], "left")
        members = members.withColumn("done", F.coalesce("used", F.lit(False))).drop("used")
        classes, each = classes * 8, each * 8


def _hash(text: str = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def near_classes(docs: DataFrame, least: float = SIMILAR, width: int = WIDTH) -> DataFrame:
    """The near-duplicate class of each distinct (doc_id, text) of ``docs``; other columns are ignored.

    Returns doc_id, text_hash, rows (how many rows carry both), class_id (the smallest doc_id of the class), class_size
    (its rows), keeper (true for one row of the result per class: the smallest doc_id, then text_hash). Texts are
    alike from a Jaccard similarity of ``least`` over their sets of ``width``-word shingles; a class is what such pairs
    connect. Texts of fewer words are one shingle; null and empty texts have none and are one class. A null doc_id
    is the last to be kept. Signatures are random: a pair at 0.8 shares no band, and is missed, once in 20,000.
    """
    rows = docs.select("doc_id", "text").withColumn("text_hash", _hash())
    table = written(signed(rows, width), "signatures")
    counted = table.groupBy("node", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("rows"))
    counted = written(counted, "nodes")

    keys = table.select("node", F.explode("bands").alias("key"))
    more = keys.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("key")
    keys = written(keys.join(more, "key", "left_semi").distinct(), "band-nodes")

    known = counted.withColumn("_at", F.xxhash64("doc_id", "text_hash"))
    asked = known.join(keys.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min("_at").alias("_at"))
    asked = written(asked.select("_at").distinct(), "asked")
    marked = rows.withColumn("_at", F.xxhash64("doc_id", "text_hash"))
    few = sieved(marked, F.col("_at"), asked, F.col("_at")).join(asked, "_at", "left_semi")
    sets = written(_sets(few, width).dropDuplicates(["node"]), "shingles")

    able = written(_shared(sets).where(F.col("shared") >= least * F.col("size") - 1e-6), "able")
    keys = written(keys.join(able, "node"), "band-able")
    order = F.struct(-F.col("shared") / F.col("size"), "node", "size")
    sized = F.struct("node", "size")
    ends = keys.groupBy("key").agg(F.min(order).alias("low"), F.min(sized).alias("a"), F.max(sized).alias("b")).where("a.node < b.node")
    ends = ends.withColumn("high", F.when(F.col("low.node") == F.col("b.node"), F.col("a")).otherwise(F.col("b")))
    named = [F.col(f"{end}.{c}").alias(alias) for end in ("low", "high") for c, alias in (("node", end), ("size", f"{end}_size"))]
    ends = written(ends.select("key", *named), "bands")
    keys = written(keys.join(ends, "key", "left_semi"), "band-members")
    tied = keys.join(ends, "key").select("node", F.explode(F.array("low", "high")).alias("end")).where("node <> end")
    pairs = written(tied.select(*_ordered("node", "end")).distinct(), "candidates")

    labels = _linked(keys, ends, sets, written(_likeness(pairs, sets), "likeness"), least)

    classed = written(counted.join(labels, "node", "left").withColumn("class", F.coalesce("label", "node")), "classed")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("text_hash"))
    facts = classed.groupBy("class").agg(F.min(order).alias("first"), F.sum("rows").alias("class_size"))
    return lookup(classed, written(facts, "class-facts"), ["class"], "inner").select(
        "doc_id",
        "text_hash",
        "rows",
        F.col("first.doc_id").alias("class_id"),
        "class_size",
        (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))).alias("keeper"),
    )


def keep_one(docs: DataFrame, least: float = SIMILAR, width: int = WIDTH) -> DataFrame:
    """``docs`` with one row of each near-duplicate class, all columns as they are.

    Rows that stay are not moved, save those that a sieve of the dropped ones cannot tell apart.
    """
    return beside(docs, ["doc_id", "text"], lambda d: _one_each(d, least, width))


def _one_each(docs: DataFrame, least: float, width: int) -> DataFrame:
    classes = written(near_classes(docs, least, width), "classes")
    change = classes.where(~F.col("keeper") | (F.col("rows") > 1))
    change = change.select(F.xxhash64("doc_id", "text_hash").alias("_at"), "keeper").groupBy("_at").agg(F.max("keeper").alias("_one"))
    marked = docs.withColumn("_at", F.xxhash64(F.col("doc_id"), _hash()))
    met = sieved(marked, F.col("_at"), change, F.col("_at"))
    rest = sieved(marked, F.col("_at"), change, F.col("_at"), inside=False)
    looked = met.join(change, "_at", "left")
    single = looked.where(F.col("_one").isNull()).drop("_one")
    repeated = looked.where("_one").drop("_one").dropDuplicates(["_at"])
    return rest.unionByName(single).unionByName(repeated).drop("_at")
