"""Fields out of stored web pages.

A page is text, not a tree. It is cut once at its labels, inside the row that holds it; a field
runs from its label to the next one and its value from the first value container on. Every field
is then a lookup in that array, so a field job reads a page once and has no shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartulary.functions.markup import (
    TAG,
    all_matches,
    behind_first,
    contents,
    decoded,
    first_match,
    first_of,
    let,
    live_markup,
    visible,
)
from cartulary.functions.text import distinct_in_order, strip_edges
from cartulary.functions.times import parse_edit_ts
from cartulary.functions.urls import external_urls
from cartulary.operators.recipes import fixed_output

LABEL_BLOCK = r"""<div\b[^>]*\bclass=["'][^"']*\bcol-label__label\b[^"']*["'][^>]*>"""
TITLE_LABEL = r"""<div\b[^>]*\btitle=["']"""
# Tags that end a line of visible text.
LINE_TAGS = "br|p|div|li|ul|ol|pre|tr|table|h[1-6]"


def _class(name: str) -> str:
    """Attributes of an open tag whose class list holds the name."""
    return rf"""[^>]*\bclass=["'](?:[^"']*\s)?{re.escape(name)}(?:\s[^"']*)?["'][^>]*"""


# ---------------------------------------------------------------- the page cut at its labels


def value_cell(markup: Column) -> Column:
    """Markup from the first value container on, null without one."""
    return first_match(markup, rf"(?is)<div\b{_class('col-value')}>(.*)\z")


def label_cells(html: Column) -> Column:
    """``array<struct<label, titled, cell>>``: labels that have a value container.

    A label is a ``div`` with a title or a label block with a text.
    """
    pieces = F.split(html, rf"(?i)(?={TITLE_LABEL}|{LABEL_BLOCK})")
    title = lambda p: first_match(p, rf"""(?is)\A{TITLE_LABEL}([^"']*)""")
    block = lambda p: visible(first_match(p, rf"(?is)\A{LABEL_BLOCK}(.*?)</div"))

    def entry(p: Column) -> Column:
        return let(
            title(p),
            lambda t: F.struct(
                F.coalesce(t, block(p)).alias("label"),
                t.isNotNull().alias("titled"),
                value_cell(p).alias("cell"),
            ),
        )

    return F.filter(F.transform(pieces, entry), lambda e: e["label"].isNotNull() & e["cell"].isNotNull())


def titled_rows(html: Column) -> Column:
    """``array<struct<label, markup>>``: every titled ``div`` and the markup up to the next one.

    Label blocks do not cut here, so they may stand inside a value.
    """
    pieces = F.split(html, rf"(?i)(?={TITLE_LABEL})")
    rows = F.transform(
        pieces,
        lambda p: F.struct(
            first_match(p, rf"""(?is)\A{TITLE_LABEL}([^"']*)""").alias("label"), p.alias("markup")
        ),
    )
    return F.filter(rows, lambda r: r["label"].isNotNull())


def readable(pages: DataFrame) -> DataFrame:
    """Pages without comments, scripts and styles, with their ``cells`` and ``rows`` cut out.

    What a job does not use is pruned.
    """
    live = pages.withColumn("html", live_markup(F.col("html")))
    return live.withColumn("cells", label_cells(F.col("html"))).withColumn(
        "rows", titled_rows(F.col("html"))
    )


def cell_of(cells: Column, label: str) -> Column:
    """Value markup of a label; a titled label goes before a label block."""
    return let(
        F.filter(cells, lambda c: c["label"] == label),
        lambda found: F.coalesce(
            first_of(F.filter(found, lambda c: c["titled"])), first_of(found)
        )["cell"],
    )


def row_of(rows: Column, label: str) -> Column:
    """Markup of a titled row."""
    return first_of(F.filter(rows, lambda r: r["label"] == label))["markup"]


def next_block(row: Column) -> Column:
    """Markup of the ``div`` that follows the label of a row."""
    return first_match(row, r"(?is)</div>\s*<div\b[^>]*>(.*)\z")


# ---------------------------------------------------------------- fields


def _texts(markup: Column, tag: str) -> Column:
    return F.filter(F.transform(contents(markup, rf"<{tag}\b[^>]*>", tag), visible), lambda x: x != "")


def label_value(cells: Column, label: str) -> Column:
    """Text of the value beside a label, null when the label is absent."""
    return visible(cell_of(cells, label))


def status_value(cells: Column, label: str = "Show In Client") -> Column:
    return F.coalesce(label_value(cells, label), F.lit(""))


def categories(cells: Column, label: str = "Modern Category") -> Column:
    """Span texts of a field, else its link texts, distinct in order."""
    found = let(
        cell_of(cells, label),
        lambda cell: let(
            _texts(cell, "span"), lambda spans: F.when(F.size(spans) > 0, spans).otherwise(_texts(cell, "a"))
        ),
    )
    return F.coalesce(distinct_in_order(found), F.lit(""))


def urls(cells: Column, excluded_domain: str, label: str = "URL") -> Column:
    """External link targets of a field, distinct in order."""
    hrefs = all_matches(cell_of(cells, label), r"""(?i)<a\b[^>]*\bhref=["']([^"']+)["']""")
    links = external_urls(F.transform(hrefs, decoded), excluded_domain)
    return F.coalesce(F.array_join(links, ", "), F.lit(""))


def table_column(html: Column, cells: Column, label: str, table_class: str, column: int = 2) -> Column:
    """One cell of each table row of a field, distinct in order.

    Without the label, any table of the given class on the page is taken.
    """
    tables = contents(html, rf"<table\b{_class(table_class)}>", "table")
    markup = F.coalesce(cell_of(cells, label), F.array_join(tables, " "))
    found = F.transform(
        F.split(markup, r"(?i)<tr\b"),
        lambda r: visible(
            F.try_element_at(contents(r, r"<td\b[^>]*>", "td"), F.lit(column))
        ),
    )
    return F.coalesce(
        distinct_in_order(F.filter(found, lambda x: x.isNotNull() & (x != ""))), F.lit("")
    )


PROFILE_COLUMNS = ["status", "vendors", "categories", "urls"]


def profile(
    ids: DataFrame, pages: DataFrame, excluded_domain: str, key: str = "place_id"
) -> DataFrame:
    """One row per asked id with all profile fields; blanks where there is no page.

    ``pages`` comes from `readable`.
    """
    html, cells = F.col("html"), F.col("cells")
    found = pages.select(
        key,
        status_value(cells).alias("status"),
        table_column(html, cells, "Vendor Contributions", "vendor-contributions-table").alias("vendors"),
        categories(cells).alias("categories"),
        urls(cells, excluded_domain).alias("urls"),
    )
    return fixed_output(ids, found, key, PROFILE_COLUMNS)


BADGE = rf"(?is)<\w+\b({_class('audit-badge')})>(.*?)</"
PLAIN_BADGE = r"""(?is)<span\b([^>]*\bclass=["'][^"']*badge[^"']*["'][^>]*)>(.*?)</"""


def badge(rows: Column, label: str) -> Column:
    """Badge text of a field, ``""`` without one."""
    text = let(
        row_of(rows, label),
        lambda row: F.coalesce(first_match(row, BADGE, 2), first_match(row, PLAIN_BADGE, 2)),
    )
    return F.coalesce(visible(text), F.lit(""))


def badge_hover(rows: Column, label: str) -> Column:
    """Hover title of a field's badge, ``""`` without one."""
    attrs = first_match(row_of(rows, label), BADGE, 1)
    title = first_match(attrs, r"""(?i)\btitle=["']([^"']*)["']""")
    return F.coalesce(strip_edges(decoded(title)), F.lit(""))


def category_badges(rows: Column, label: str = "Modern Category") -> Column:
    """``array<struct<name, badge>>`` of a field's rows; rows that lack either are skipped."""
    parts = F.split(
        row_of(rows, label), rf"(?i)<div\b(?={_class('audit-row')}>)(?={_class('row-details')}>)"
    )
    name = rf"(?is)<\w+\b{_class('category-display')}>(.*?)</"
    mark = rf"(?is)<\w+\b(?={_class('badge')}>){_class('audit-badge')}>(.*?)</"
    pairs = F.transform(
        behind_first(parts),
        lambda p: F.struct(
            visible(first_match(p, name)).alias("name"), visible(first_match(p, mark)).alias("badge")
        ),
    )
    return F.filter(pairs, lambda x: x["name"].isNotNull() & x["badge"].isNotNull())


PLACEHOLDER = "__placeholder__"


def _day_hours(box: Column) -> Column:
    """Map of the day rows inside the hours box; the last row of a day wins."""
    rows = behind_first(F.split(box, rf"(?i)<div\b(?={_class('row')}>){_class('row-details')}>"))
    entries = F.filter(
        F.transform(
            rows,
            lambda r: F.struct(
                visible(first_match(r, rf"(?is){LABEL_BLOCK}(.*?)</div")).alias("day"),
                visible(first_match(r, rf"(?is)<div\b{_class('col-value')}>(.*?)</div")).alias("hours"),
            ),
        ),
        lambda e: e["day"].isNotNull() & e["hours"].isNotNull(),
    )

    def as_map(found: Column) -> Column:
        days = F.array_distinct(F.transform(found, lambda e: e["day"]))
        last = lambda d: F.element_at(F.filter(found, lambda e: e["day"] == d), -1)["hours"]
        return F.map_from_arrays(days, F.transform(days, last))

    return let(entries, as_map)


def hours_map(html: Column) -> Column:
    """Day to hours text; a single placeholder entry when no hours are kept; empty without the field."""
    box = first_match(
        html, rf"""(?is)\bdata-test-id=["']hours["'][^>]*>(.*?)(?={TITLE_LABEL}|\z)"""
    )
    placeholder = rf"(?is)<\w+\b{_class('text-placeholder')}>(.*?)</"
    return let(
        box,
        lambda b: F.when(b.isNull(), F.create_map().cast("map<string,string>"))
        .when(b.rlike(r"""(?i)\bclass=["'][^"']*hours-collection"""), _day_hours(b))
        .otherwise(
            F.create_map(
                F.lit(PLACEHOLDER), F.coalesce(visible(first_match(b, placeholder)), F.lit(""))
            )
        ),
    )


# Markers that carry the place title.
TITLE_MARKERS = ["place-header__title", "place__title", "place-title"]


def place_name(html: Column, rows: Column) -> Column:
    """Name row, else a title marker, else a heading of the header, else any first-level heading.

    Each of them is looked for only when those before it gave nothing.
    """
    shown = lambda c: F.nullif(visible(c), F.lit(""))
    heading = lambda c, tag: first_of(_texts(c, tag))
    in_row = let(
        row_of(rows, "Name"),
        lambda row: F.coalesce(first_of(_texts(row, "span")), shown(next_block(row))),
    )
    marker = [
        shown(first_match(html, rf"""(?is)\bdata-test-id=["']{m}["'][^>]*>(.*?)</"""))
        for m in TITLE_MARKERS
    ]
    header = first_of(contents(html, r"<header\b[^>]*>", "header"))
    banner = first_match(
        html, r"""(?is)<div\b[^>]*\bclass=["'][^"']*place-header[^"']*["'][^>]*>(.*)\z"""
    )
    titles = lambda c: F.coalesce(heading(c, "h1"), heading(c, "h2"))
    return F.coalesce(
        in_row, *marker, let(header, titles), let(banner, titles), heading(html, "h1"), F.lit("")
    )


def edit_rows(pages: DataFrame, key: str = "place_id") -> DataFrame:
    """``(key, pos, edit_ts, description)`` of every dated row of an edit list."""
    html = live_markup(F.col("html"))
    rows = behind_first(F.split(html, rf"(?i)<div\b{_class('audit-row')}>"))

    def entry(row: Column) -> Column:
        cell = lambda cut, label: visible(next_block(row_of(cut, label)))
        return let(
            titled_rows(row),
            lambda cut: F.struct(
                parse_edit_ts(cell(cut, "Date")).alias("edit_ts"), cell(cut, "Description").alias("description")
            ),
        )

    # Read before they are exploded: a filter on a column worked out later is pushed below it, with all its work once more.
    # Outer: else the optimizer cuts every page twice, the first time to see whether it has rows.
    listed = pages.select(key, F.posexplode_outer(F.transform(rows, entry)).alias("pos", "entry"))
    dated = listed.filter(F.col("entry.edit_ts").isNotNull() & F.col("entry.description").isNotNull())
    return dated.select(key, "pos", "entry.edit_ts", "entry.description")


# Possessive, so that a string with many escapes takes a loop and not the stack.
JSON_BLANKS = r'("[^"\\]*+(?:\\.[^"\\]*+)*+")|\s+'


def minify_json(text: Column) -> Column:
    """Drop blanks outside strings; keys and numbers stay as written."""
    return F.regexp_replace(text, JSON_BLANKS, "$1")


def visible_lines(markup: Column) -> Column:
    """Non-blank lines of visible text."""
    broken = F.regexp_replace(markup, rf"(?i)</?(?:{LINE_TAGS})\b[^>]*>", "\n")
    text = decoded(F.regexp_replace(broken, TAG, ""))
    return F.filter(F.transform(F.split(text, r"[\r\n]+"), strip_edges), lambda x: x != "")


def corrections(rows: Column, label: str = "Corrections") -> Column:
    """Lists, JSON blocks, other code and text lines of one field, as a struct of texts."""

    def code_texts(cell: Column) -> Column:
        found = contents(cell, r"<code\b[^>]*>", "code")
        texts = F.transform(found, lambda c: strip_edges(decoded(F.regexp_replace(c, TAG, ""))))
        return F.filter(texts, lambda c: c != "")

    is_json = lambda c: c.rlike(r"^[{\[]") & F.try_parse_json(c).isNotNull()

    def as_texts(cell: Column) -> Column:
        return let(
            code_texts(cell),
            lambda codes: F.struct(
                F.array_join(_texts(cell, "li"), " ; ").alias("list_items"),
                F.array_join(F.transform(F.filter(codes, is_json), minify_json), " || ").alias(
                    "json_blocks"
                ),
                F.array_join(F.filter(codes, lambda c: ~is_json(c)), " || ").alias("code_blocks"),
                F.array_join(F.array_distinct(visible_lines(cell)), " | ").alias("all_text"),
            ),
        )

    return let(F.coalesce(next_block(row_of(rows, label)), F.lit("")), as_texts)
