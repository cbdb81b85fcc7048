"""CSV, text and Parquet tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The schema expected of a people sheet.
PEOPLE_SCHEMA = T.StructType(
    [
        T.StructField("id", T.IntegerType(), True),
        T.StructField("name", T.StringType(), True),
        T.StructField("age", T.IntegerType(), True),
    ]
)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV, every column a string; no inference pass over the data."""
    return spark.read.option("header", True).option("escape", '"').csv(path)


def header_names(spark: SparkSession, path: str) -> list[str]:
    """Column names as the header line gives them."""
    return spark.read.option("header", True).option("escape", '"').csv(path).columns


def read_csv_checked(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read with a fixed schema; a line that does not fit keeps its text in ``_corrupt``.

    Columns are found by their names in the header, wherever they stand; one that is missing is null.
    """
    names = header_names(spark, path)
    types = {f.name: f.dataType for f in schema.fields}
    corrupt = T.StructField("_corrupt", T.StringType(), True)
    as_written = T.StructType([*(T.StructField(n, types.get(n, T.StringType()), True) for n in names), corrupt])
    lines = (
        spark.read.schema(as_written)
        .option("header", True)
        .option("escape", '"')
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt")
        .csv(path)
    )
    found = lambda f: F.col(f"`{f.name}`") if f.name in names else F.lit(None).cast(f.dataType).alias(f.name)
    return lines.select(*(found(f) for f in schema.fields), "_corrupt")


def schema_mismatches(actual: DataFrame, expected: T.StructType) -> list[tuple[str, str, str]]:
    """(column, expected type, found type) for every column that differs; empty when it fits."""
    found = {f.name: f.dataType.simpleString() for f in actual.schema.fields}
    wanted = {f.name: f.dataType.simpleString() for f in expected.fields}
    names = [*wanted, *(n for n in found if n not in wanted)]
    return [
        (n, wanted.get(n, ""), found.get(n, ""))
        for n in names
        if wanted.get(n) != found.get(n)
    ]


def schema_report(
    spark: SparkSession, path: str, expected: T.StructType, corrupt_column: str = "_corrupt"
) -> DataFrame:
    """Per expected column: rows read and rows whose line did not fit the schema, in one pass.

    ``found_at`` is the column's place in the header, null when it is missing; ``in_place`` whether that is the
    place the schema gives it. Columns the schema does not know follow with type ``unexpected``.
    """
    df = read_csv_checked(spark, path, expected)
    names = header_names(spark, path)
    counts = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col(corrupt_column).isNotNull()).alias("n_misfits"),
        *(F.count(F.col(f.name)).alias(f"filled_{i}") for i, f in enumerate(expected.fields)),
    )
    per_column = F.array(
        *(
            F.struct(
                F.lit(f.name).alias("column"),
                F.lit(f.dataType.simpleString()).alias("type"),
                F.col(f"filled_{i}").alias("n_filled"),
                F.lit(names.index(f.name) + 1 if f.name in names else None).cast("int").alias("found_at"),
                F.lit(names[i : i + 1] == [f.name]).alias("in_place"),
            )
            for i, f in enumerate(expected.fields)
        ),
        *(
            F.struct(
                F.lit(n).alias("column"),
                F.lit("unexpected").alias("type"),
                F.lit(None).cast("bigint").alias("n_filled"),
                F.lit(names.index(n) + 1).cast("int").alias("found_at"),
                F.lit(False).alias("in_place"),
            )
            for n in names
            if n not in expected.fieldNames()
        ),
    )
    return counts.select("n_rows", "n_misfits", F.inline(per_column))


def newest_file(
    spark: SparkSession, folder: str, exclude: Iterable[str] = (), pattern: str = "*.csv"
) -> str | None:
    """Path of the file written last in the folder itself, leaving out the named ones.

    Only file listings are read: the content column is pruned. Equal times go to the later path.
    """
    listing = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .load(folder)
        .select("path", "modificationTime")
        .filter(~F.element_at(F.split("path", "/"), -1).isin([*exclude, ""]))
    )
    row = listing.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path")).first()
    return row["path"]


def read_newest_csv(spark: SparkSession, folder: str, exclude: Iterable[str] = ()) -> DataFrame:
    path = newest_file(spark, folder, exclude)
    if path is None:
        raise FileNotFoundError(f"no CSV file in {folder}")
    return read_csv(spark, path)


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row per line, column ``value``."""
    return spark.read.text(path)
