"""The whitening query: every usable embedding in its first four whitened components."""

from __future__ import annotations

from cartulary.llm.registry import query, table
from cartulary.llm.whitening import whitened


@query("op11_bit_sliced_whitening")
def op11(spark, sf_dir):
    return whitened(table(spark, sf_dir, "embeddings"))
