"""CSV and Parquet output. Folders hold one file per task unless a single file is the point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartulary.functions.text import clean_markings, fill_blank


def write_csv(df: DataFrame, path: str, compression: str | None = None) -> None:
    writer = df.write.mode("overwrite").option("header", True).option("escape", '"')
    if compression:
        writer = writer.option("compression", compression)
    writer.csv(path)


def write_csv_single(df: DataFrame, path: str) -> None:
    """One file with a header: for results of an aggregate, whose rows are few.

    ``coalesce(1)`` would pull the work of the last stage into one task, so the rows are
    moved by an exchange first and only the writing is single.
    """
    write_csv(df.repartition(1), path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_partitioned(
    df: DataFrame, path: str, by: tuple[str, ...] = ("year", "month"), rows_per_file: int = 5_000_000
) -> None:
    """Parquet under one folder per value of ``by``.

    Rows of one folder are brought together so that it does not get a file from every task. The
    rebalance lets adaptive execution cut a hot month into several tasks of even size.
    """
    df.hint("rebalance", *by).write.mode("overwrite").option(
        "maxRecordsPerFile", rows_per_file
    ).partitionBy(*by).parquet(path)


def archive_path(df: DataFrame, root: str, day: Column | None = None) -> str:
    """``root/archive/YYYYMMDD`` of the session's current date."""
    day = F.current_date() if day is None else day
    stamp = df.sparkSession.range(1).select(F.date_format(day, "yyyyMMdd")).first()[0]
    return f"{root.rstrip('/')}/archive/{stamp}"


def write_archive(df: DataFrame, root: str) -> str:
    path = archive_path(df, root)
    write_csv(df, path)
    return path


def write_cleaned_column(df: DataFrame, column: str, full_path: str, column_path: str) -> None:
    """The table with one column cleaned, and that column alone.

    The second table is read back from the first instead of holding the input in memory.
    """
    cleaned = df.withColumn(column, clean_markings(fill_blank(F.col(column))))
    write_parquet(cleaned, full_path)
    write_csv(df.sparkSession.read.parquet(full_path).select(column), column_path)
