"""Notes kept inside JSON text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cartulary.functions.markup import let
from cartulary.functions.text import longest_string, squeeze


def json_notes(text: Column, shown: Column | None = None, strings: Column | None = None) -> Column:
    """Key ``notes`` of the widest ``{...}`` in the text.

    Text that does not parse is tried again without trailing commas. A missing, blank or
    non-string note falls back to ``shown`` and then to the longest of ``strings``.
    """
    filled = lambda c: F.nullif(squeeze(c), F.lit(""))
    unquoted = lambda c: F.regexp_replace(F.trim(c), '^"+|"+$', "")
    sources = [filled(let(F.regexp_extract(text, r"(?s)\{.*\}", 0), _note_of_block))]
    if shown is not None:
        sources.append(filled(unquoted(shown)))
    if strings is not None:
        sources.append(filled(longest_string(F.transform(strings, unquoted))))
    return F.coalesce(*sources, F.lit(""))


def _note_of_block(block: Column) -> Column:
    mended = F.regexp_replace(block, r",(\s*[}\]])", "$1")
    parsed = F.coalesce(F.try_parse_json(block), F.try_parse_json(mended))
    note = F.try_variant_get(parsed, "$.notes", "variant")
    return let(
        note,
        lambda n: F.when(F.schema_of_variant(n) == "STRING", F.try_variant_get(n, "$", "string")),
    )
