"""The prefix trie against a plain one, with ranges of every size; the radix tree; odd and empty tables."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cartulary.llm.q_tries import op13, rebuilt
from cartulary.llm.radix import RadixTree
from cartulary.llm.tries import keys_of, prefix_nodes, sequences, turns_shared


def plain(convs: dict[int, list[tuple[str, str]]]) -> set[tuple]:
    members, kids = defaultdict(list), defaultdict(set)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                kids[tuple(turns[: d - 1])].add(tuple(turns[:d]))
    out = set()
    for path, who in members.items():
        below = [p for p in members if p[: len(path)] == path]
        ends = sorted(c for c in who if len(convs[c]) == len(path))
        out.add(
            (
                min(who),
                len(path),
                min(members[path[:-1]]) if path else None,
                len(who),
                len(kids[path]),
                sum(not kids[p] for p in below),
                sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in below if p),
                hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
            )
        )
    return out


def rows_of(df):
    names = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
    got = [tuple(r) for r in df.select(*names).collect()]
    assert len(got) == len(set(got))
    return set(got)


def table(spark, convs):
    rows = [(c, i, r, t) for c, turns in convs.items() for i, (r, t) in enumerate(turns)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)


@pytest.mark.parametrize("range_bytes", [64, 400, 5_000, 1 << 24])
def test_nodes_whatever_the_ranges(spark, range_bytes):
    draw = random.Random(range_bytes)
    # A third begins alike, a third is the same conversation, some end where others go on.
    words = ["", "a", "é", "longer text"]
    convs = {}
    for c in range(90):
        turns = [(draw.choice(["user", "assistant"]), draw.choice(words)) for _ in range(draw.randint(1, 5))]
        if c % 3 == 0:
            turns = [("system", "common")] * draw.randint(1, 4) + turns
        if c % 3 == 1:
            turns = [("user", "same"), ("assistant", "same")]
        convs[c - 5] = turns
    keys = keys_of(sequences(table(spark, convs)))
    assert rows_of(prefix_nodes(keys, range_bytes)) == plain(convs)


def test_long_conversation_and_turnless_one(spark):
    convs = {1: [("user", str(i)) for i in range(3_000)], 2: [("user", str(i)) for i in range(2_990)], 3: []}
    keys = keys_of(sequences(table(spark, convs))).unionByName(spark.createDataFrame([(3, bytearray())], "conv_id long, key binary"))
    got = rows_of(prefix_nodes(keys))
    assert len(got) == 3_001
    assert {(r[0], r[3]) for r in got if r[1] == 0} == {(1, 3)}
    assert {(r[3], r[5]) for r in got if r[1] == 2_990} == {(2, 1)}


def test_many_conversations_end_in_one_node(spark):
    ids = spark.range(-3, 30_000).select(F.col("id").alias("conv_id"))
    rows = ids.select("conv_id", F.lit(0).alias("turn"), F.lit("user").alias("role"), F.lit("hi").alias("text"))
    got = rows_of(prefix_nodes(keys_of(sequences(rows))))
    ends = hashlib.sha256(",".join(map(str, range(-3, 30_000))).encode()).hexdigest()
    empty = hashlib.sha256(b"").hexdigest()
    assert got == {(-3, 0, None, 30_003, 1, 1, 30_002 * 2, empty), (-3, 1, -3, 30_003, 0, 1, 30_002 * 2, ends)}


def test_rebuilt_takes_the_first_turns_of_its_family(spark):
    convs = {c: [("user", f"{c}.{i}") for i in range(c % 7 + 1)] for c in [*range(5, 24), 31]}
    got = {r["conv_id"]: r["turns"] for r in rebuilt(sequences(table(spark, convs))).collect()}
    own = {r["conv_id"]: r["turns"] for r in sequences(table(spark, convs)).collect()}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        assert got[c] == own.get(c - c % 5, [])[:h] + turns[h:], c


def test_odd_rows(spark):
    rows = [
        (None, 0, "user", "left out"),
        (5, 1, None, None),
        (5, None, "user", "first"),
        (6, 0, "", ""),
        (6, 0, "", ""),
        (7, 0, "user", "first"),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("id", F.lit(1)).withColumn("key", F.lit(2))
    want = plain({5: [("user", "first"), ("", "")], 6: [("", "")] * 2, 7: [("user", "first")]})
    assert rows_of(prefix_nodes(keys_of(sequences(frame)))) == want


def test_query_on_odd_and_empty_tables(spark, odd, empty):
    assert op13(spark, odd).where("depth = 0").collect()[0]["n_convs"] == 4
    assert op13(spark, empty).count() == 0


def test_radix_tree_holds_every_key_and_grows_its_layouts():
    draw = random.Random(5)
    keys = {bytes(draw.randrange(256) for _ in range(draw.randint(0, 6))) for _ in range(5_000)} | {bytes([7, i]) for i in range(40)}
    tree = RadixTree()
    for key in draw.sample(sorted(keys), len(keys)):
        tree.put(key, len(key) + 1)
    found, walk = {}, [(tree.root, b"")]
    while walk:
        node, before = walk.pop()
        path = before + node.path
        if node.value is not None:
            found[path] = node.value
        assert node is tree.root or node.value is not None or len(node.children) > 1  # paths are compressed
        assert [b for b, _ in node.children] == sorted(n.path[0] for _, n in node.children)
        walk.extend((n, path) for _, n in node.children)
    assert found == {k: len(k) + 1 for k in keys}
    assert {"sorted4", "sorted16", "full"} <= set(tree.layouts())
    few = RadixTree()
    for i in range(40):
        few.put(bytes([i, 1]), 1)
    assert few.layouts() == {"indexed": 1}


def test_turns_shared():
    a, b, c = (bytes([x]) * 20 for x in (1, 2, 3))
    assert turns_shared(a + b, a + c) == 1
    assert turns_shared(a + b, a + b + c) == 2
    assert turns_shared(b"", a) == 0
    assert turns_shared(None, a) == -1
