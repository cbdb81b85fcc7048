"""The tokenizer query: encode every document, decode the ids again, keep digests of both."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from cartulary.llm.bpe import Tokenizer, decode, encode
from cartulary.llm.registry import query, table

VOCABULARY = "byte_bpe_50k.tiktoken"


def tokenizer() -> Tokenizer:
    return Tokenizer.read(public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def ids_text(ids):
    """Decimal ids with one space between them."""
    return F.replace(F.btrim(F.col(ids).cast("string"), F.lit("[]")), F.lit(","))


@query("op6_byte_bpe")
def op6(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    tok = tokenizer()
    coded = encode(docs, tok).select("doc_id", "token_ids")
    return decode(coded, tok).select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(ids_text("token_ids"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
