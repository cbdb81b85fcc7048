"""The exact-dedup query: two snapshots by age, and the newest documents as the incoming batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartulary.llm.exact import dedup
from cartulary.llm.registry import query, table

SNAPSHOT_ENDS = (0.4, 0.8)  # shares of the ids at which the snapshots end

OP5_SQL = """
WITH normal AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM normal WINDOW same AS (PARTITION BY t)
"""


@query("op5_exact_dedup", OP5_SQL)
def op5(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ends = docs.agg(F.percentile_approx("doc_id", list(SNAPSHOT_ENDS)).alias("at")).first()["at"] or []
    parts, low = [], F.lit(True)
    for end in sorted(set(ends)):
        parts.append(docs.where(low & (F.col("doc_id") <= end)))
        low = F.col("doc_id") > end
    newest = docs.where(low | F.col("doc_id").isNull())
    return dedup(parts, newest).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )
