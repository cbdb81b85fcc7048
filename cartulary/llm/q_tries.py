"""The conversation trie query: conversations rebuilt so that they share beginnings, and the nodes of their trie."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.llm.common import written
from cartulary.llm.registry import query, table
from cartulary.llm.tries import keys_of, prefix_nodes, sequences

FAMILY, MOST_SHARED = 5, 8

# The CRC-32 of a decimal number: each digit is mixed in, then eight steps of the reversed polynomial.
_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(conv_id::VARCHAR, ''),
    lambda s: [ascii(s)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384::BIGINT * (c & 1)) END), 4294967295::BIGINT)"""

SQL = f"""
WITH turns AS (
    SELECT conv_id, turn, strlen(coalesce(text, '')) AS size,
        sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS id
    FROM conversations WHERE conv_id IS NOT NULL),
own AS (
    SELECT conv_id, list({{'id': id, 'size': size}} ORDER BY turn NULLS FIRST, id) AS turns FROM turns GROUP BY conv_id),
drawn AS (SELECT *, {_CRC} % {MOST_SHARED + 1} AS h, conv_id - conv_id % {FAMILY} AS base FROM own),
rebuilt AS (
    SELECT d.conv_id, list_concat(coalesce(b.turns[1:d.h], []), coalesce(d.turns[d.h + 1:], [])) AS turns
    FROM drawn d LEFT JOIN own b ON b.conv_id = d.base),
members AS (
    SELECT conv_id, unnest(range(0, len(turns) + 1)) AS depth, turns FROM rebuilt),
nodes AS (
    SELECT list_transform(turns[1:depth], lambda t: t.id) AS path, depth, min(conv_id) AS conv_id, count(*) AS n,
        coalesce(max(turns[depth].size), 0) AS size,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE depth = len(turns)), '')) AS ends
    FROM members GROUP BY 1, 2),
below AS (
    SELECT path[1:depth - 1] AS path, depth - 1 AS depth, count(*) AS children FROM nodes WHERE depth > 0 GROUP BY 1, 2),
whole AS (
    SELECT n.*, coalesce(b.children, 0) AS children
    FROM nodes n LEFT JOIN below b ON b.path = n.path AND b.depth = n.depth),
above AS (SELECT *, unnest(range(0, depth + 1)) AS up FROM whole),
sums AS (
    SELECT path[1:up] AS path, up AS depth, sum((children = 0)::BIGINT) AS leaves, sum((n - 1) * size) AS saved
    FROM above GROUP BY 1, 2)
SELECT w.conv_id, w.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, w.n::BIGINT AS n_convs,
    w.children::BIGINT AS n_children, s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, w.ends AS ends_sha256
FROM whole w JOIN sums s ON s.path = w.path AND s.depth = w.depth
LEFT JOIN nodes p ON p.path = w.path[1:w.depth - 1] AND p.depth = w.depth - 1
"""


def rebuilt(convs: DataFrame) -> DataFrame:
    """``convs(conv_id, turns)`` with the first turns of each taken from the one its family is named after.

    A family are the ids from one multiple of five up to the next; an id draws how many turns it takes. A family has
    five members at most, so the join has no hot key.
    """
    drawn = convs.withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (MOST_SHARED + 1)).cast("int"))
    based = drawn.withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY)
    heads = convs.where(F.col("conv_id") % FAMILY == 0)
    heads = heads.select(F.col("conv_id").alias("base"), F.slice("turns", 1, MOST_SHARED).alias("head"))
    none = F.array().cast("array<string>")
    taken = F.slice(F.coalesce("head", none), F.lit(1), F.col("h"))
    kept = F.slice("turns", F.col("h") + 1, F.size("turns"))
    return based.join(heads, "base", "left").select("conv_id", F.concat(taken, kept).alias("turns"))


@query("op13_prefix_trie", SQL)
def op13(spark, sf_dir):
    convs = written(sequences(table(spark, sf_dir, "conversations")), "sequences")
    return prefix_nodes(written(keys_of(rebuilt(convs)), "conversation-keys"))
