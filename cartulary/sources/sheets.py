"""Files with a layout of their own: sectioned reports, sheets with a header block, proofs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartulary.operators.hotkeys import lookup

SECTION_KINDS = ["Count", "Duplicate", "Average"]


def _csv_cells(line: Column, width: int) -> Column:
    schema = ", ".join(f"c{i} STRING" for i in range(1, width + 1))
    return F.from_csv(line, schema, {"escape": '"'})


def _report_lines(spark: SparkSession, path: str) -> DataFrame:
    """(report, file, split, id, line, blank): the lines of reports that say something or part sections.

    A separator is an empty line, or commas only when a fixed-width writer made it. Lines of nothing but blanks are
    neither. Ids grow along a split. Files that Spark numbered as parts are one report, in the order of their names; any
    other file is a report of its own.
    """
    name = F.col("_metadata.file_path")
    folder = F.regexp_replace(name, r"/[^/]*$", "")
    lines = spark.read.text(path).select(
        F.when(F.regexp_extract(name, r"[^/]*$", 0).startswith("part-"), folder).otherwise(name).alias("report"),
        name.alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("id"),
        F.rtrim(F.col("value"), F.lit("\r")).alias("line"),
    )
    return lines.withColumn("blank", F.col("line").rlike("^,*$")).filter(F.col("blank") | (F.trim("line") != ""))


def _carried(marked: DataFrame) -> DataFrame:
    """What each split of a report has to know of those before it, one row for each.

    ``opens``: its first line begins a section. ``sections`` and ``said``: how many sections begin and lines stand before
    it. ``head`` and ``head_at``: the header line of the section that is open where it begins, and its number.
    """
    split = ["report", "file", "split"]
    facts = marked.groupBy(*split).agg(
        F.min_by("blank", "id").alias("first_blank"),
        F.max_by("blank", "id").alias("last_blank"),
        F.min_by("line", "id").alias("first_line"),
        F.count_if("starts").alias("starts"),
        F.count_if(~F.col("blank")).alias("lines"),
        F.max(F.when(F.col("starts"), F.struct("id", "line", "nth"))).alias("last"),
    )
    order = Window.partitionBy("report").orderBy("file", "split")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    opens = ~F.col("first_blank") & F.coalesce(F.lag("last_blank").over(order), F.lit(True))
    facts = facts.withColumn("opens", opens).withColumn("said", F.coalesce(F.sum("lines").over(earlier), F.lit(0)))
    own = F.when(F.col("last").isNotNull(), F.struct(F.col("last.line").alias("line"), (F.col("said") + F.col("last.nth")).alias("at")))
    own = F.coalesce(own, F.when(F.col("opens"), F.struct(F.col("first_line").alias("line"), (F.col("said") + 1).alias("at"))))
    facts = facts.withColumn("own", own)
    carried = F.last("own", ignorenulls=True).over(earlier)
    begun = F.col("starts") + F.col("opens").cast("int")
    return facts.withColumn("carried", carried).select(
        *split,
        "opens",
        "said",
        F.coalesce(F.sum(begun).over(earlier), F.lit(0)).alias("sections"),
        F.col("carried.line").alias("head"),
        F.col("carried.at").alias("head_at"),
    )


def read_sectioned_report(spark: SparkSession, path: str) -> DataFrame:
    """Sections of reports: ``(file, section_no, line_no, section, kind, label, pct, amount)``.

    ``file`` is the report: a file, or the folder of one that was written in parts. A section is a header line and the
    lines up to the next separator; its third header word names the kind. One without lines gives no rows.

    Splits are read each by its own task. Windows hold one split; what is open at its beginning comes from one row for
    each split before it, so a section may be of any length and cross splits and files.
    """
    split = ["report", "file", "split"]
    within = Window.partitionBy(*split).orderBy("id")
    lines = _report_lines(spark, path)
    before = F.lag("blank").over(within)
    marked = lines.select(
        "*",
        (~F.col("blank") & before).alias("starts"),  # null on the first line of a split
        F.sum((~F.col("blank")).cast("bigint")).over(within).alias("nth"),
    )
    met = marked.join(_carried(marked), split)
    starts = F.coalesce(F.col("starts"), F.col("opens"))
    met = met.withColumn("starts", starts).withColumn("at", F.col("said") + F.col("nth"))
    head = F.last(F.when(F.col("starts"), F.struct("line", "at")), ignorenulls=True).over(within)
    placed = met.select(
        "report",
        "line",
        "blank",
        "starts",
        "at",
        (F.col("sections") + F.sum(F.col("starts").cast("int")).over(within) - 1).alias("section_no"),
        F.coalesce(head, F.when(F.col("head_at").isNotNull(), F.struct(F.col("head").alias("line"), F.col("head_at").alias("at")))).alias("head"),
    )
    title = _csv_cells(F.col("head.line"), 3)
    cells = _csv_cells(F.col("line"), 3)
    return placed.filter(~F.col("blank") & ~F.col("starts")).select(
        F.col("report").alias("file"),
        F.col("section_no").cast("bigint").alias("section_no"),
        (F.col("at") - F.col("head.at") - 1).alias("line_no"),
        title["c1"].alias("section"),
        F.when(title["c3"].isin(SECTION_KINDS), title["c3"]).alias("kind"),
        F.coalesce(cells["c1"], F.lit("")).alias("label"),
        F.coalesce(cells["c2"], F.lit("")).alias("pct"),
        F.coalesce(cells["c3"], F.lit("")).alias("amount"),
    )


# The sheet keeps its facts in column B, rows 1-8, and its ids in column W.
HEADER_ROWS = {
    "project_name": 1,
    "project_tab": 2,
    "link": 3,
    "warnings_col": 4,
    "start_row": 5,
    "last_ran_date": 6,
    "last_avg_ticket_runtime": 7,
    "last_total_runtime": 8,
}
IDS_TYPE_ROW = 10
IDS_COLUMN = 23
FIRST_BODY_ROW = 3
LAST_ROW_OFFSET = 1


def read_sheet_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, row, line)`` of every line, numbered from 1 inside its file.

    Files are read in splits, each by its own task. Ids grow by one along a split, so a line's
    place in it needs no sort; a window over the splits of a file, one row per split, gives how
    many lines stand before each.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("id"),
        F.rtrim(F.col("value"), F.lit("\r")).alias("line"),
    )
    earlier = (
        Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    )
    splits = (
        lines.groupBy("file", "split")
        .agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .select(
            "file", "split", "first_id", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")
        )
    )
    numbered = lookup(lines, splits, ["file", "split"])
    row = F.col("before") + F.col("id") - F.col("first_id") + 1
    return numbered.select("file", row.alias("row"), "line")


def header_block(lines: DataFrame, link_base: str = "") -> DataFrame:
    """One row of facts per header-less sheet, from its numbered lines.

    The facts are picked by row number in one aggregate per sheet, summed up before the shuffle.
    """
    cells = _csv_cells(F.col("line"), IDS_COLUMN)
    b = F.trim(F.coalesce(cells["c2"], F.lit("")))
    w = F.trim(F.coalesce(cells[f"c{IDS_COLUMN}"], F.lit("")))
    grid = lines.select("file", "row", b.alias("b"), w.alias("w"))

    def fact(name: str) -> Column:
        cell = F.max(F.when(F.col("row") == HEADER_ROWS[name], F.col("b")))
        return F.nullif(cell, F.lit("")).alias(name)

    facts = grid.groupBy("file").agg(
        *(fact(name) for name in HEADER_ROWS),
        F.nullif(F.max(F.when(F.col("row") == IDS_TYPE_ROW, F.col("w"))), F.lit("")).alias(
            "ids_type"
        ),
        F.max(F.when((F.col("row") >= FIRST_BODY_ROW) & (F.col("w") != ""), F.col("row"))).alias(
            "last_row"
        ),
    )
    return facts.select(
        "file",
        "project_name",
        "project_tab",
        F.concat(F.lit(link_base), F.col("link")).alias("link"),
        F.upper("warnings_col").alias("warnings_col"),
        F.when(F.col("start_row").rlike(r"^\d+$"), F.col("start_row").try_cast("int")).alias(
            "start_row"
        ),
        "last_ran_date",
        F.col("last_avg_ticket_runtime").try_cast("double").alias("last_avg_ticket_runtime"),
        "last_total_runtime",
        "ids_type",
        (F.col("last_row") + LAST_ROW_OFFSET).alias("last_id_row"),
    )


def read_header_block(spark: SparkSession, path: str, link_base: str = "") -> DataFrame:
    return header_block(read_sheet_lines(spark, path), link_base)
