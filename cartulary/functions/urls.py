"""Links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cartulary.functions.text import strip_edges


def normalize_url(href: Column) -> Column:
    """Drop the scheme and a leading ``www.``; blank becomes null."""
    rest = F.regexp_replace(href, r"^[a-zA-Z][a-zA-Z0-9+.-]*:", "")
    rest = F.regexp_replace(rest, r"^//(www\.)?", "")
    rest = F.regexp_replace(F.replace(rest, F.lit("?#"), F.lit("#")), r"[?#]$", "")
    return F.when(href != "", rest)


def hyperlink_cell(cell: Column) -> Column:
    """URL of a spreadsheet cell: HYPERLINK formula, plain link or bare domain."""
    text = strip_edges(F.coalesce(cell, F.lit("")))
    formula = F.regexp_extract(text, r"""(?i)HYPERLINK\(["']([^"']+)["']""", 1)
    return (
        F.when(formula != "", formula)
        .when(text.startswith("http://") | text.startswith("https://"), text)
        .when(text.contains(".") & ~text.contains(" "), F.concat(F.lit("https://"), text))
        .otherwise("")
    )


def url_prefer(*candidates: Column) -> Column:
    """First link that is present; the word ``None`` counts as present."""
    return F.coalesce(*candidates)


def external_urls(urls: Column, excluded_domain: str) -> Column:
    """http(s) links off the excluded domain and its subdomains, first-seen distinct."""
    host = lambda u: F.lower(F.regexp_extract(u, r"^https?://([^/?#]*)", 1))
    inside = lambda h: (h == excluded_domain) | h.endswith("." + excluded_domain)
    trimmed = F.transform(urls, strip_edges)
    return F.array_distinct(
        F.filter(trimmed, lambda u: u.rlike("^https?://") & ~inside(host(u)))
    )
