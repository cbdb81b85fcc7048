"""The toxicity query: fitted on four fifths of the labels, applied to every document."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cartulary.llm.registry import query, table
from cartulary.llm.toxicity import fit

THRESHOLD = 0.5


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def fitted(spark, docs, sf_dir):
    """The model of the query: labels whose rows are not held out."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return fit(docs, labels.where(~held_out(F.col("doc_id"))))


@query("op2_toxicity")
def op2(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = fitted(spark, docs, sf_dir).score(docs)
    return scored.select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
