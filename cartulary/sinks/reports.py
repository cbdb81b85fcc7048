"""The sectioned report as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartulary.operators.reports import line_order, report_lines


def _csv_line() -> Column:
    cells = F.to_csv(F.struct("c1", "c2", "c3"), {"emptyValue": "", "escape": '"'})
    return F.when((F.col("c1") == "") & (F.col("c2") == "") & (F.col("c3") == ""), "").otherwise(cells)


def write_sectioned_report(sections: DataFrame, path: str, single_file: bool = False) -> None:
    """Sections one after the other, a blank row after each, in files that follow one another in the order of their names.

    ``single_file`` asks for one file, which one task writes: for reports of counts, not for long lists of duplicates.
    """
    lines = report_lines(sections)
    if single_file:
        lines = lines.repartition(1).sortWithinPartitions(*line_order())
    else:
        lines = lines.orderBy(*line_order())
    lines.select(_csv_line().alias("value")).write.mode("overwrite").text(path)
