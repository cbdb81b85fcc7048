"""Blocks to sections with bullets, numeric points, charts and images.

Blocks come with their section, so lines are cut where they lie. Every window and group is one page row or one
section of it; they share one exchange of the lines by ``page_row``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartulary.functions.markup import let
from cartulary.functions.text import strip_edges
from cartulary.operators.blocks import PAGE, PAGE_ROW, TITLE_SECTION

KEYS = [PAGE, PAGE_ROW, "section_no"]
LINE_ORDER = ["block_no", "sub", "line_no"]

# Line patterns, tried in the order of `line_class`.
TOTAL_SAMPLE = r"(?i)^\s*total\s+sample\s*:\s*(\d+)\s*$"
CHART_WORDS = "bar|pie|line|column"
CHART_CHOICE = (
    rf"(?i)^\s*(?:\[chart=({CHART_WORDS})\]|:::\s*chart\s*=\s*({CHART_WORDS})|\(({CHART_WORDS})\))\s*$"
)
SPLIT_FLAG = r"(?i)^\s*(?:\[split\]|:::\s*split\s*=\s*(?:yes|true|1))\s*$"
NUMERIC = [
    r"^\s*([^\-:\t]+)\s*[-:]\s*([+-]?\d+(?:\.\d+)?)\s*$",
    r"^\s*([^\t]+)\t([+-]?\d+(?:\.\d+)?)\s*$",
]
KEY_VALUE = [r"^\s*([^\-:\t]+)\s*[-:]\s*(.+?)\s*$", r"^\s*([^\t]+)\t(.+?)\s*$"]
SHORT_LABEL = r"^[A-Za-z0-9].{0,40}$"
LINE_BREAKS = r"[\n•;|]"
# No key-value line is without one of these.
PAIR_MARK = r"[-:\t]"
DEFAULT_TITLE = "Deck"
DEFAULT_GROUP = "Group 1"


def _is_title() -> Column:
    return (F.col("type") == "heading") & (F.col("level") <= 2)


def deck_titles(blocks: DataFrame) -> DataFrame:
    """First heading of level 1 or 2 of each page."""
    title = F.min_by("text", F.when(_is_title(), F.col("block_no")))
    found = blocks.groupBy(PAGE_ROW, PAGE).agg(F.coalesce(title, F.lit(DEFAULT_TITLE)).alias("title"))
    return found.select(PAGE, "title")


def assign_sections(blocks: DataFrame) -> DataFrame:
    """Blocks with ``section_no``, which they have from ``extract_blocks``.

    The page title is section -1 on its own. Any other heading opens a section, and what stands
    before the first one is section 0.
    """
    return blocks.withColumn("section_no", F.col("section_no").cast("bigint"))


def section_lines(sections: DataFrame) -> DataFrame:
    """``(page_id, section_no, block_no, sub, line_no, source, line, alt)`` in reading order.

    List items stay whole. A paragraph is cut at line ends, bullets, semicolons and bars, unless
    it is the sample size. Headings and images are one line each. Blank lines are dropped, but a
    heading stays.
    """
    kind = F.col("type")
    text = F.coalesce(strip_edges(F.col("text")), F.lit(""))
    para = F.when(text.rlike(TOTAL_SAMPLE), F.array(text)).otherwise(F.split(text, LINE_BREAKS))
    lines = (
        F.when(kind == "list", F.col("items"))
        .when(kind == "paragraph", para)
        .when(kind == "image", F.array("src"))
        .otherwise(F.array(text))
    )
    source = F.when(kind == "list", "item").otherwise(kind)
    return (
        sections.select(
            *KEYS, "block_no", "sub", source.alias("source"), "alt",
            F.posexplode_outer(lines).alias("line_no", "line"),
        )
        .withColumn("line", strip_edges(F.col("line")))
        .filter((F.col("line") != "") | (F.col("source") == "heading"))
    )


def pseudo_lines(sections: DataFrame) -> DataFrame:
    """Text lines only: those of paragraphs and lists."""
    return section_lines(sections).filter(F.col("source").isin("item", "paragraph")).drop("alt")


def _group(line: Column, patterns: list[str], group: int) -> Column:
    first, second = patterns
    return F.when(line.rlike(first), F.regexp_extract(line, first, group)).when(
        line.rlike(second), F.regexp_extract(line, second, group)
    )


def line_class(line: Column, source: Column) -> Column:
    """heading and image by source, else total, chart, split, number, pair, label or text:
    the first test that fits."""
    marked = line.rlike(PAIR_MARK)
    return (
        F.when(source.isin("heading", "image"), source)
        .when((source == "paragraph") & line.rlike(TOTAL_SAMPLE), "total")
        .when(line.rlike(CHART_CHOICE), "chart")
        .when(line.rlike(SPLIT_FLAG), "split")
        .when(marked & (line.rlike(NUMERIC[0]) | line.rlike(NUMERIC[1])), "number")
        .when(marked & (line.rlike(KEY_VALUE[0]) | line.rlike(KEY_VALUE[1])), "pair")
        .when(line.rlike(SHORT_LABEL), "label")
        .otherwise("text")
    )


def number_label(line: Column) -> Column:
    return strip_edges(_group(line, NUMERIC, 1))


def number_value(line: Column) -> Column:
    return _group(line, NUMERIC, 2).try_cast("double")


def pair_key(line: Column) -> Column:
    return strip_edges(_group(line, KEY_VALUE, 1))


def pair_value(line: Column) -> Column:
    return strip_edges(_group(line, KEY_VALUE, 2))


def number_text(value: Column) -> Column:
    """Whole numbers without decimals, others as the shortest text of the double, never with an exponent.

    The text of a double is one digit, a point, more digits and, outside 0.001 to 10,000,000, an
    exponent; the point is moved by it. Beyond the digits of a double a whole number ends in zeros.
    """
    text = value.cast("string")
    sign = F.when(text.startswith("-"), "-").otherwise("")
    mantissa = F.regexp_extract(text, r"^-?(\d+\.\d+)(?:E|$)", 1)
    digits = F.regexp_replace(F.replace(mantissa, F.lit("."), F.lit("")), "(?<=.)0+$", "")
    power = F.coalesce(F.regexp_extract(text, r"E(-?\d+)$", 1).try_cast("int"), F.lit(0))
    ahead = F.length(F.substring_index(mantissa, ".", 1)) + power  # digits before the point
    moved = (
        F.when(ahead <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -ahead), digits))
        .when(F.length(digits) <= ahead, F.rpad(digits, ahead, "0"))
        .otherwise(F.concat(F.left(digits, ahead), F.lit("."), F.substring(digits, ahead + 1, F.lit(400))))
    )
    return F.when(value == 0, "0").when(mantissa == "", text).otherwise(F.concat(sign, moved))


def classified_lines(sections: DataFrame) -> DataFrame:
    """Lines with their class and everything read out of them.

    ``group_name`` is the latest short label above a numeric line in its section.
    """
    line, kind = F.col("line"), F.col("class")
    above = (
        Window.partitionBy(PAGE_ROW, "section_no")
        .orderBy(*LINE_ORDER)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    t = _carry_split(section_lines(sections).withColumn("class", line_class(line, F.col("source"))))
    label = F.last(F.when(kind == "label", line), ignorenulls=True).over(above)
    choice = F.lower(F.concat(*(F.regexp_extract(line, CHART_CHOICE, g) for g in (1, 2, 3))))
    value = F.when(kind == "number", number_value(line))
    name = F.when(kind == "number", number_label(line)).when(kind == "pair", pair_key(line))
    shown = F.when(kind == "number", number_text(value)).when(kind == "pair", pair_value(line))
    return t.select(
        *KEYS, *LINE_ORDER, "source", "line", "alt", "class",
        name.alias("label"),
        value.alias("value"),
        F.concat(name, F.lit(": "), shown).alias("bullet"),
        F.when(kind == "number", F.coalesce(label, F.lit(DEFAULT_GROUP))).alias("group_name"),
        F.when(kind == "chart", choice).alias("chart"),
        F.when(
            kind == "total",
            F.concat(F.lit("Total sample: "), F.regexp_extract(line, TOTAL_SAMPLE, 1)),
        ).alias("subtitle"),
    )


def _carry_split(lines: DataFrame) -> DataFrame:
    """A split flag holds until a section is shown: that of a section that is not goes on to the next one that is.

    A section is shown that has a title or any content; a chart choice and a label are none and end with their section.
    """
    ahead = (
        Window.partitionBy(PAGE_ROW)
        .orderBy("section_no")
        .rangeBetween(Window.currentRow, Window.unboundedFollowing)
    )
    shows = F.col("class").isin("total", "number", "pair", "text", "image") | (
        (F.col("class") == "heading") & (F.col("line") != "")
    )
    held = F.min(F.when(shows, F.col("section_no"))).over(ahead)
    at = F.when(F.col("class") == "split", F.coalesce(held, F.col("section_no")))
    return lines.withColumn("section_no", F.coalesce(at, F.col("section_no")))


def _ordered(value: Column, when: Column) -> Column:
    """Values in line order, as an array."""
    picked = F.collect_list(F.when(when, F.struct(*LINE_ORDER, value.alias("v"))))
    return F.transform(F.sort_array(picked), lambda x: x["v"])


def _charts(points: Column, choice: Column, asked: Column) -> Column:
    """Points of a section as charts.

    One chart per group when asked for or when there are several groups, else one for all. The
    share of a point is null when its chart sums to nothing.
    """

    def chart(name: Column, number: Column, members: Column) -> Column:
        total = F.reduce(members, F.lit(0.0), lambda sum_, p: sum_ + p["value"])
        auto = F.when(F.size(members).between(2, 6), "pie").otherwise("bar")
        data = let(
            total,
            lambda t: F.transform(
                members,
                lambda p: F.struct(
                    p["label"].alias("label"),
                    p["value"].alias("value"),
                    F.when(t > 0, p["value"] / t).alias("share"),
                ),
            ),
        )
        return F.struct(
            (number + 1).alias("chart_no"),
            name.alias("chart_group"),
            F.coalesce(choice, auto).alias("chart_type"),
            data.alias("data"),
        )

    def all_charts(groups: Column) -> Column:
        apart = asked | (F.size(groups) > 1)
        names = F.when(apart, groups).when(F.size(groups) > 0, F.array(F.lit("all"))).otherwise(groups)
        return F.transform(
            names,
            lambda name, i: let(
                F.filter(points, lambda p: ~apart | (p["group_name"] == name)),
                lambda members: chart(name, i, members),
            ),
        )

    return let(F.array_distinct(F.transform(points, lambda p: p["group_name"])), all_charts)


def gathered_sections(lines: DataFrame) -> DataFrame:
    """One row per section with everything its lines hold, in line order: one group-by."""
    kind, order = F.col("class"), F.struct(*LINE_ORDER)
    point = F.struct("label", "value", "group_name")
    image = F.struct(F.col("line").alias("path"), F.col("alt").alias("alt"))
    gathered = lines.groupBy(*KEYS).agg(
        F.min_by("line", F.when(kind == "heading", order)).alias("title"),
        F.max_by("subtitle", F.when(kind == "total", order)).alias("subtitle"),
        _ordered(F.col("bullet"), kind.isin("number", "pair")).alias("bullets"),
        _ordered(F.col("line"), kind == "text").alias("paragraphs"),
        _ordered(point, kind == "number").alias("points"),
        F.max_by("chart", F.when(kind == "chart", order)).alias("choice"),
        F.max(kind == "split").alias("asked"),
        _ordered(image, kind == "image").alias("images"),
    )
    charts = _charts(F.col("points"), F.col("choice"), F.col("asked"))
    return gathered.withColumn("charts", charts).drop("points", "choice", "asked")


def section_charts(lines: DataFrame) -> DataFrame:
    """``(page_id, section_no, chart_no, chart_group, chart_type, label, value, share)``"""
    charts = gathered_sections(lines).select(*KEYS, F.inline_outer("charts")).filter("chart_no is not null")
    return charts.select(
        *KEYS, "chart_no", "chart_group", "chart_type", F.inline("data")
    )


def section_images(lines: DataFrame) -> DataFrame:
    """Images of each section in order and the one kept separately, the last one met."""
    found = gathered_sections(lines).filter(F.size("images") > 0)
    return found.select(*KEYS, "images", F.element_at("images", -1).alias("image"))


def section_plan(blocks: DataFrame) -> DataFrame:
    """One nested row per slide: the page title, then every section that holds something."""
    found = gathered_sections(classified_lines(assign_sections(blocks)))
    shown = (
        (F.coalesce("title", F.lit("")) != "")
        | F.col("subtitle").isNotNull()
        | (F.size("bullets") > 0)
        | (F.size("paragraphs") > 0)
        | (F.size("images") > 0)
    )
    is_title = F.col("section_no") == TITLE_SECTION
    return found.filter(is_title | shown).select(
        *KEYS,
        F.when(is_title, "title").otherwise("content").alias("layout"),
        "title", "subtitle", "bullets", "paragraphs", "charts",
        F.try_element_at("images", F.lit(-1)).alias("image"),
        "images",
    )
