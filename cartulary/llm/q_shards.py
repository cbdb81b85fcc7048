"""The sharding query: eight equal shards under the `key` law."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartulary.llm.registry import query, table
from cartulary.llm.shards import shard_documents

SHARDS = 8


@query("op7_rendezvous_shards")
def op7(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    placed = shard_documents(docs, [1.0] * SHARDS, grown=[1.0] * (SHARDS + 1))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )
