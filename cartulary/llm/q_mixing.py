"""The mixing query: all sources at weights 3, 1, 2, together half as many words again."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartulary.llm.mixing import Mixture
from cartulary.llm.registry import query, table


def in_turn(sources):
    """Weights 3, 1, 2, repeating."""
    return [(3.0, 1.0, 2.0)[i % 3] for i in range(len(sources))]


MIXTURE = Mixture(weights=in_turn, share=1.5, copies=2)


@query("op1_mix_sources")
def op1(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return MIXTURE.place(docs).select(
        "doc_id", "size", "source_size", "target", "taken", F.transform("placements", lambda p: p.shard).alias("shards")
    )
