"""The main text query: every page with its article."""

from __future__ import annotations

from cartulary.llm.registry import query, table
from cartulary.llm.wrappers import main_texts


@query("op12_wrapper_induction")
def op12(spark, sf_dir):
    return main_texts(table(spark, sf_dir, "pages"))
