"""The near-dedup query: every document with its class."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartulary.llm.dartminhash import near_classes
from cartulary.llm.registry import query, table


@query("op8_dart_minhash")
def op8(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    classes = near_classes(docs)
    # A row for each document, also where rows repeat an id and a text.
    each = classes.withColumn("_row", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    return each.select("doc_id", "class_id", "class_size", (F.col("keeper") & (F.col("_row") == 1)).alias("kept"))
