"""Cleaning of text cells."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Named and numeric HTML entities that are decoded. `&amp;` must come last so
# that a doubly escaped entity is decoded once only.
HTML_ENTITIES = [
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&apos;", "'"),
    ("&#39;", "'"),
    ("&#x27;", "'"),
    ("&nbsp;", "\u00a0"),
    ("&#160;", "\u00a0"),
    ("&copy;", "©"),
    ("&reg;", "®"),
    ("&middot;", "·"),
    ("&bull;", "•"),
    ("&ndash;", "–"),
    ("&mdash;", "—"),
    ("&hellip;", "…"),
    ("&lsquo;", "‘"),
    ("&rsquo;", "’"),
    ("&ldquo;", "“"),
    ("&rdquo;", "”"),
    ("&amp;", "&"),
]

# A header token holding one of these letters is a time stamp.
TIME_MARKS = ["AM", "PM", "CDT", "UTC", "GMT"]

BLANK = r"[\s\u00a0]"
BLANKS = " \t\n\r\x0b\x0c\u00a0"


def unescape_html(text: Column) -> Column:
    return reduce(
        lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), HTML_ENTITIES, text
    )


def strip_edges(text: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.trim(text, F.lit(BLANKS))


def squeeze(text: Column) -> Column:
    """Collapse runs of white space (non-breaking too) to one blank and trim."""
    return F.trim(F.regexp_replace(text, rf"{BLANK}+", " "))


def fill_blank(text: Column) -> Column:
    """Missing values become the empty string."""
    return F.coalesce(text.cast("string"), F.lit(""))


def clean_markings(text: Column) -> Column:
    """Drop square brackets and quotes, keep everything else."""
    return F.regexp_replace(text, r"""[\[\]"']+""", "")


def clean_list(text: Column) -> Column:
    """``['a ', '', 'b']`` becomes ``a, b``; anything but a list only loses its markings."""
    cell = strip_edges(text)
    # A bracketed tuple needs a comma to be one; a comma before the closing bracket is allowed.
    listed = F.when(cell.rlike(r"(?s)^\(.*,.*\)$"), F.regexp_replace(cell, r"^\(|\)$", "")).when(
        cell.rlike(r"(?s)^\[.*\]$"), F.regexp_replace(cell, r"^\[|\]$", "")
    )
    body = F.regexp_replace(listed, r",\s*$", "")
    items = F.from_json(
        F.concat(F.lit("["), body, F.lit("]")),
        "array<string>",
        {"allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true"},
    )
    usable = items.isNotNull() & ~F.exists(items, lambda i: i.isNull())
    kept = F.filter(F.transform(items, strip_edges), lambda i: i != "")
    return F.when(usable, F.array_join(kept, ", ")).otherwise(clean_markings(cell))


def title_level2(title: Column) -> Column:
    """Text before the first spaced dash, cut after its first ``(...)``."""
    head = F.split(title, r"\s+[–-]\s+", 2)[0]
    cut = F.regexp_extract(head, r"^.+?\([^)]*\)", 0)
    return strip_edges(F.when(cut != "", cut).otherwise(head))


def header_tokens(tokens: Column) -> Column:
    """Drop time stamps and bare numbers from a list of version-header tokens."""
    marks = "|".join(TIME_MARKS)
    return F.filter(
        tokens,
        lambda t: ~t.rlike(marks) & ~F.regexp_replace(t, "[.() -]", "").rlike(r"^\p{Nd}+$"),
    )


def brand_text(marker: Column, value: Column, has_link: Column) -> Column:
    """Brand shown in a value cell: quoted text, else text without its numeric id."""
    value = strip_edges(F.coalesce(value, F.lit("")))
    quoted = F.regexp_extract(value, r'"([^"]+)"', 1)
    bare = squeeze(F.regexp_replace(squeeze(F.regexp_replace(value, r"\(\d+\)", "")), '^"+|"+$', ""))
    return (
        F.when(F.lower(strip_edges(F.coalesce(marker, F.lit("")))) == "none", "None")
        .when(quoted != "", strip_edges(quoted))
        .when(bare.rlike("[A-Za-z]"), bare)
        .when(has_link, "not visible")
        .otherwise("None")
    )


def brand_strip_paren(text: Column) -> Column:
    """Drop one trailing ``(...)``."""
    return F.regexp_replace(text, r"\s*\([^)]*\)$", "")


def to_number(text: Column) -> Column:
    return text.try_cast("double")


def distinct_in_order(items: Column, sep: str = ", ") -> Column:
    """First-seen distinct items in one text."""
    return F.array_join(F.array_distinct(items), sep)


def longest_string(items: Column) -> Column:
    """Longest item, the first one on ties."""
    return F.reduce(
        items, F.lit(""), lambda best, x: F.when(F.length(x) > F.length(best), x).otherwise(best)
    )
