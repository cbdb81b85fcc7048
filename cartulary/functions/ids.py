"""Record ids out of dirty cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cartulary.functions.text import longest_string, strip_edges, unescape_html

DIGITS = r"\p{Nd}+"


def _untagged(raw: Column) -> Column:
    text = unescape_html(F.trim(F.coalesce(raw, F.lit(""))))
    return strip_edges(F.regexp_replace(text, "<[^>]*>", ""))


def place_id(raw: Column) -> Column:
    """First run of digits once tags are gone, ``""`` when there is none."""
    return F.regexp_extract(_untagged(raw), DIGITS, 0)


def place_id_or_raw(raw: Column) -> Column:
    """First run of digits, or the cleaned text itself."""
    text = _untagged(raw)
    return F.coalesce(F.nullif(F.regexp_extract(text, DIGITS, 0), F.lit("")), text)


def _bare(raw: Column) -> Column:
    text = strip_edges(F.replace(F.coalesce(raw, F.lit("")), F.lit("\ufeff"), F.lit("")))
    return F.regexp_replace(F.regexp_replace(text, '^"+|"+$', ""), "^'+|'+$", "")


def ticket_id(raw: Column) -> Column:
    """Longest run of digits, the first one on ties."""
    text = _bare(raw)
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    text = F.regexp_replace(text, r"(?i)<\s*br\s*/?\s*>", "")
    return longest_string(F.regexp_extract_all(text, F.lit(f"({DIGITS})"), F.lit(1)))


def ticket_id_alnum(raw: Column) -> Column:
    """Digits when only digits and punctuation are there, else the text without leading noise."""
    text = F.regexp_replace(_bare(raw), r"\s+", "")
    return F.when(text.rlike(r"^[\W_]*\d[\d\W_]*$"), F.regexp_replace(text, r"\D", "")).otherwise(
        F.regexp_replace(text, "^[^A-Za-z0-9]+", "")
    )
