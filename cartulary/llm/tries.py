"""The prefix trie of conversations: which beginnings they share, and what sharing them saves.

1. A turn becomes an id of fixed width: 16 bytes of a digest of role and text, then the length of the text in bytes, big
   endian. A conversation is the ids of its turns in a row, its key; texts are not shuffled.
2. Equal keys are one, with the digest of their conversation ids. The ids are sorted by ranges, joined to pieces where
   they lie, and only the pieces of a key pass through its one digest, as a stream.
3. Keys are sorted by ranges, so that any shared beginning, also that of a third of all conversations, is spread over as
   many ranges as it needs. Each range builds an adaptive radix tree and emits the nodes at whole turns.
4. What the first or last key of a range shares with its neighbours is a border node. A range counts what it owns of
   it, the sums of all ranges make it whole. All other nodes are whole where they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartulary.llm.common import written
from cartulary.llm.radix import RadixTree
from cartulary.operators.hotkeys import lookup

DIGEST, SIZE = 16, 4
WIDTH = DIGEST + SIZE  # bytes of a turn
RANGE_BYTES = 16 << 20  # of keys, for each range
PIECE_IDS = 8_192  # conversation ids joined to one piece
NO_ENDS = hashlib.sha256(b"").hexdigest()


def turn_ids(role: Column, text: Column) -> Column:
    """The id of a turn, as hex digits; null role or text is empty."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    said = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.concat(F.substring(F.sha2(said, 256), 1, 2 * DIGEST), F.lpad(F.lower(F.hex(F.octet_length(text))), 2 * SIZE, "0"))


def sequences(rows: DataFrame) -> DataFrame:
    """(conv_id, turns): hex ids of the turns of each conversation of ``rows(conv_id, turn, role, text)``, in order.

    Null turns come first, rows of equal turn stand in the order of their ids, so that reruns agree. Rows without conv_id
    are no conversation.
    """
    each = rows.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(
            F.col("turn").isNotNull().alias("known"),
            F.col("turn").cast("long").alias("turn"),
            turn_ids(F.col("role"), F.col("text")).alias("id"),
        ).alias("one"),
    )
    grouped = each.groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).alias("all"))
    return grouped.select("conv_id", F.transform("all", lambda t: t["id"]).alias("turns"))


def keys_of(convs: DataFrame) -> DataFrame:
    """(conv_id, key) of ``convs(conv_id, turns)``."""
    return convs.select("conv_id", F.unhex(F.array_join("turns", "")).alias("key"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, conv_id) to (key, first, n, ids): stretches of one key, their ids joined by commas."""
    key, ids = None, []

    def flush() -> pa.RecordBatch:
        said = ",".join(map(str, ids))
        columns = [pa.array([key], pa.binary()), pa.array([ids[0]], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([said])]
        return pa.RecordBatch.from_arrays(columns, names=["key", "first", "n", "ids"])

    ready: list[pa.RecordBatch] = []
    for batch in batches:
        for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if ids and (k != key or len(ids) == PIECE_IDS):
                ready.append(flush())
                ids = []
                if len(ready) == 1_000:
                    yield from _joined(ready)
                    ready = []
            key = k
            ids.append(c)
    if ids:
        ready.append(flush())
    yield from _joined(ready)


def _joined(ready: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if ready:
        yield from pa.Table.from_batches(ready).combine_chunks().to_batches()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces, sorted by key and first id, to (key, first, n, ends): one digest goes through all pieces of a key."""
    key, first, n, digest = None, 0, 0, None
    names = ["key", "first", "n", "ends"]
    for batch in batches:
        out: list[tuple] = []
        for k, f, m, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if digest is not None and k == key:
                digest.update(b"," + ids.encode())
                n += m
                continue
            if digest is not None:
                out.append((key, first, n, digest.hexdigest()))
            key, first, n, digest = k, f, m, hashlib.sha256(ids.encode())
        if out:
            yield _rows(out, names)
    if digest is not None:
        yield _rows([(key, first, n, digest.hexdigest())], names)


def _rows(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = {"key": pa.binary(), "node": pa.binary(), "parent": pa.binary(), "ends": pa.string(), "border": pa.bool_()}
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.int64())) for c, n in zip(columns, names, strict=True)], names=names)


def distinct_keys(convs: DataFrame) -> DataFrame:
    """(key, first, n, ends) of ``convs(conv_id, key)``: each key once, its smallest and its number of conversations.

    ``ends`` is the digest of their ids, ascending, joined by commas. A key of many conversations is cut into pieces by
    ranges of ids before it meets in one place, as one row for thousands of ids.
    """
    hashed = convs.select("key", "conv_id", F.xxhash64("key").alias("h"))
    ranges = hashed.repartitionByRange("h", "conv_id").sortWithinPartitions("h", "key", "conv_id")
    pieces = ranges.select("key", "conv_id").mapInArrow(_pieces, "key binary, first long, n long, ids string")
    met = pieces.repartition("key").sortWithinPartitions("key", "first")
    return met.mapInArrow(_digests, "key binary, first long, n long, ends string")


def _ranges(keys: DataFrame, range_bytes: int) -> tuple[DataFrame, dict[int, tuple[int, int]]]:
    """``keys`` sorted into ranges, with ``part``; and what each range shares with its neighbours.

    For a range: how many turns its first key shares with the last key before it, and its last key with the first key
    behind it. Two numbers for each range reach the driver, no keys.
    """
    size = keys.agg(F.sum(F.length("key") + 64).alias("s")).first()["s"] or 0
    count = max(1, -(-size // range_bytes))
    sorted_ = keys.repartitionByRange(count, "key").sortWithinPartitions("key")
    ranged = written(sorted_.withColumn("part", F.spark_partition_id()), "ranges")
    ends = ranged.groupBy("part").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    before = ends.select(F.col("part").alias("other"), F.col("high").alias("before"))
    behind = ends.select(F.col("part").alias("other"), F.col("low").alias("behind"))
    known = sorted(r["part"] for r in ends.select("part").collect())  # ranges may be empty
    following = F.create_map(*[F.lit(x) for pair in zip(known, known[1:] + [-1], strict=True) for x in pair]) if known else None
    preceding = F.create_map(*[F.lit(x) for pair in zip(known, [-1] + known[:-1], strict=True) for x in pair]) if known else None
    if not known:
        return ranged, {}
    met = ends.join(before, F.element_at(preceding, F.col("part")) == before["other"], "left").drop("other")
    met = met.join(behind, F.element_at(following, F.col("part")) == behind["other"], "left").drop("other")

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, low, high, ahead, after = (c.to_pylist() for c in batch.columns)
            rows = [(p, turns_shared(a, b), turns_shared(c, d)) for p, a, b, c, d in zip(part, ahead, low, high, after, strict=True)]
            if rows:
                yield _rows(rows, ["part", "ahead", "behind"])

    told = met.select(F.col("part").cast("long").alias("part"), "low", "high", "before", "behind").mapInArrow(
        shared, "part long, ahead long, behind long"
    )
    return ranged, {r["part"]: (r["ahead"], r["behind"]) for r in told.collect()}


def turns_shared(a: bytes | None, b: bytes | None) -> int:
    """With how many equal turns two keys begin; -1 if there is none of them."""
    if a is None or b is None:
        return -1
    low, high = 0, min(len(a), len(b)) // WIDTH
    while low < high:
        middle = (low + high + 1) // 2
        if a[low * WIDTH : middle * WIDTH] == b[low * WIDTH : middle * WIDTH]:
            low = middle
        else:
            high = middle - 1
    return low


NODE = "node binary, parent binary, depth long, conv_id long, parent_conv long, n_convs long, n_children long, n_leaves long, saved long, ends string, border boolean"
_NAMES = [part.split()[0] for part in NODE.split(", ")]


class _Open:
    """A node whose subtree is being walked."""

    __slots__ = ("children", "depth", "ends", "first", "inner", "leaves", "n", "saved", "waiting")

    def __init__(self, depth: int) -> None:
        self.depth = depth
        self.n = self.children = self.leaves = self.saved = 0
        self.inner = False  # something lies below it in this range
        self.first: int | None = None
        self.ends: str | None = None
        self.waiting: list[list] = []  # rows of children, which still lack their parent's conv_id


def nodes_of(keys: list[tuple[bytes, int, int, str]], ahead: int, behind: int) -> Iterator[tuple]:
    """The nodes of one range of (key, first, n, ends), rows of ``NODE``, by the tree's own walk.

    ``ahead`` and ``behind`` are what ``turns_shared`` says of its ends and the ranges beside it. Nodes up to these
    depths on the way to the first and last key, and the root, are border nodes: they hold what this range owns of them.
    A node that a range before this one knows already is owned there.
    """
    if not keys:
        return
    tree = RadixTree()
    for key, first, n, ends in keys:
        tree.put(key, (first, n, ends))
    lowest, highest = keys[0][0], keys[-1][0]
    path = bytearray()
    opened: list[_Open] = [_Open(0)]

    def digest(depth: int) -> bytes:
        return hashlib.blake2b(bytes(path[: depth * WIDTH]), digest_size=16).digest()

    def on_border(depth: int) -> bool:
        if depth == 0:
            return True
        head = bytes(path[: depth * WIDTH])
        return (depth <= ahead and lowest.startswith(head)) or (depth <= behind and highest.startswith(head))

    def owned(depth: int) -> bool:
        if depth == 0:
            return ahead < 0
        return not (depth <= ahead and lowest.startswith(bytes(path[: depth * WIDTH])))

    def close() -> Iterator[tuple]:
        """The node at the end of ``path`` is done: its row waits for its parent, or goes out."""
        node = opened.pop()
        border, mine = on_border(node.depth), owned(node.depth)
        size = int.from_bytes(path[node.depth * WIDTH - SIZE : node.depth * WIDTH], "big") if node.depth else 0
        goes_on = node.depth <= behind and highest.startswith(bytes(path[: node.depth * WIDTH]))  # in the next range
        if not node.inner and not goes_on:
            node.leaves += 1
        # Its share of (n - 1) x size: all of n here, the one less where it is owned.
        node.saved += (node.n - (1 if mine else 0)) * size
        for row in node.waiting:
            row[4] = None if border else node.first
            yield tuple(row)
        row = [
            digest(node.depth) if border else None, None, node.depth, node.first, None, node.n, node.children, node.leaves, node.saved, node.ends, border
        ]
        if not opened:
            yield tuple(row)
            return
        above = opened[-1]
        above.inner = True
        above.n += node.n
        above.children += 1 if mine else 0
        above.leaves += node.leaves
        above.saved += node.saved
        if node.first is not None:
            above.first = node.first if above.first is None else min(above.first, node.first)
        if border or on_border(above.depth):
            row[1] = digest(above.depth)
            yield tuple(row)
        else:
            above.waiting.append(row)

    walk: list = [(tree.root, None)]
    while walk:
        node, back_to = walk.pop()
        if node is None:  # all below is done: back to the depth and path from before
            depth, length = back_to
            while opened[-1].depth > depth:
                yield from close()
            del path[length:]
            continue
        walk.append((None, (opened[-1].depth, len(path))))
        path += node.path
        while (opened[-1].depth + 1) * WIDTH <= len(path):  # only whole turns are nodes
            opened.append(_Open(opened[-1].depth + 1))
        if node.value is not None:
            first, n, ends = node.value
            here = opened[-1]
            here.n += n
            here.first = first if here.first is None else min(here.first, first)
            here.ends = ends
        walk.extend((below, None) for _, below in reversed(list(node.children)))
    yield from close()


def _range_nodes(ranged: DataFrame, shared: dict[int, tuple[int, int]]) -> DataFrame:
    def build(table: pa.Table) -> pa.Table:
        key, first, n, ends, part = (table.column(c).to_pylist() for c in ("key", "first", "n", "ends", "part"))
        rows = sorted(zip(key, first, n, ends, strict=True))
        found = nodes_of(rows, *shared[part[0]])
        batches, ready = [], []
        for row in found:
            ready.append(row)
            if len(ready) == 10_000:
                batches.append(_rows(ready, _NAMES))
                ready = []
        if ready:
            batches.append(_rows(ready, _NAMES))
        return pa.Table.from_batches(batches)

    return ranged.groupBy("part").applyInArrow(build, NODE)


def prefix_nodes(convs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row for each node of the prefix trie of ``convs(conv_id, key)``.

    Columns: conv_id (the smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256. No conversations, no nodes. A conversation without turns is a member of the root alone.
    A conversation is the unit of work: its key, 20 bytes a turn, has to fit into a task. ``range_bytes`` sets how many
    bytes of keys go to one range, and changes nothing else.
    """
    keys = written(distinct_keys(convs), "keys")
    ranged, shared = _ranges(keys, range_bytes)
    nodes = written(_range_nodes(ranged, shared), "nodes")
    parts = nodes.where("border")
    whole = parts.groupBy("node", "depth").agg(
        F.max("parent").alias("parent"),
        F.min("conv_id").alias("conv_id"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")],
        F.max("ends").alias("ends"),
    )
    whole = written(whole, "border")
    facts = whole.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv"))
    columns = ["depth", "conv_id", "parent_conv", "n_convs", "n_children", "n_leaves", "saved", "ends"]
    inside = nodes.where("not border")
    done = inside.where("parent is null").select(columns)
    # The parent is a border node, which may have any share of all nodes as its children.
    open_ = inside.where("parent is not null").drop("parent_conv").select("parent", *[c for c in columns if c != "parent_conv"])
    below = lookup(open_, facts, ["parent"]).select(columns)
    up = facts.withColumnRenamed("parent", "p")
    borders = whole.join(up, F.col("parent") == F.col("p"), "left").select(columns)
    return (
        done.unionByName(below)
        .unionByName(borders)
        .select(
            "conv_id",
            "depth",
            F.col("parent_conv").alias("parent_conv_id"),
            "n_convs",
            "n_children",
            "n_leaves",
            F.col("saved").alias("saved_tokens"),
            F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"),
        )
    )
