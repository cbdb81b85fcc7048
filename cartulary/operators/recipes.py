"""Everyday table steps: filters, fills, joins, unions, group-bys, a running mean."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from cartulary.functions.ids import place_id
from cartulary.functions.text import fill_blank, strip_edges
from cartulary.operators.hotkeys import lookup, one_each


def with_constant(df: DataFrame, name: str, value: object) -> DataFrame:
    return df.withColumn(name, F.lit(value))


def filter_date_range(df: DataFrame, column: str, first: str, last: str) -> DataFrame:
    """Both ends included. Plain comparisons, so they reach a Parquet scan."""
    kind = df.schema[column].dataType
    return df.filter(F.col(column).between(F.lit(first).cast(kind), F.lit(last).cast(kind)))


def filter_contains(df: DataFrame, column: str, word: str) -> DataFrame:
    return df.filter(F.col(column).contains(word))


def filter_missing_id(df: DataFrame, raw: str, out: str = "place_id") -> DataFrame:
    """Clean the id and skip the rows left without one."""
    return df.withColumn(out, place_id(F.col(raw))).filter(F.col(out) != "")


def contested_field(*columns: str) -> Column:
    """First non-empty of several columns, trimmed and lower-cased."""
    tidy = [F.nullif(strip_edges(F.col(c)), F.lit("")) for c in columns]
    return F.lower(F.coalesce(*tidy, F.lit("")))


def filter_contested_field(df: DataFrame, *columns: str, wanted: str = "hours") -> DataFrame:
    return df.filter(contested_field(*columns) == wanted)


# History filter key and panel label per field.
HOURS_MODE = ("hours_period", "Hours")
PRESENCE_MODE = ("presence_period", "Show In Client")


def map_mode(field: Column) -> Column:
    """``hours`` or anything else to (filter key, panel label)."""
    as_struct = lambda m: F.struct(
        F.lit(m[0]).alias("filter_key"), F.lit(m[1]).alias("panel_label")
    )
    is_hours = F.lower(strip_edges(fill_blank(field))) == "hours"
    return F.when(is_hours, as_struct(HOURS_MODE)).otherwise(as_struct(PRESENCE_MODE))


def field_option(option: Column) -> Column:
    """``hours`` / ``show`` to a filter key; any other word asks for no filter."""
    word = F.lower(strip_edges(option))
    return F.when(word == "hours", HOURS_MODE[0]).when(word == "show", PRESENCE_MODE[0])


def fill_nulls(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    return df.fillna(dict(values))


def fixed_output(
    ids: DataFrame, results: DataFrame, key: str, columns: Sequence[str]
) -> DataFrame:
    """Every id with a fixed list of text columns; blanks where there is no result.

    Of several results of an id one is taken, the same on every run, so no id is repeated. Equal ids stay, and
    are spread however many there are.
    """
    found = lookup(ids, one_each(results.select(key, *columns), [key]), [key])
    return found.select(*ids.columns, *(fill_blank(F.col(c)).alias(c) for c in columns))


def join_inner(
    left: DataFrame, right: DataFrame, keys: Sequence[str], right_unique: bool = False
) -> DataFrame:
    """Equi-join. Adaptive execution cuts skewed partitions by their measured size.

    Where it is off and the right side has one row per key, hot keys of the left are looked for and spread.
    """
    if right_unique and left.sparkSession.conf.get("spark.sql.adaptive.enabled") != "true":
        return lookup(left, right, keys, "inner")
    return left.join(right, list(keys), "inner")


def union_all(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows of both by position, duplicates kept."""
    return first.union(second)


def distinct_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def sum_by(df: DataFrame, by: Sequence[str], value: str, out: str = "total") -> DataFrame:
    return df.groupBy(*by).agg(F.sum(value).alias(out))


def count_by(df: DataFrame, by: Sequence[str], out: str = "count") -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias(out))


def duplicate_names(df: DataFrame, name: str) -> DataFrame:
    return count_by(df, [name]).filter(F.col("count") > 1)


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing values per column and whether to raise an alert, all columns in one pass."""
    counts = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in columns))
    per_column = F.array(
        *(F.struct(F.lit(c).alias("column"), F.col(c).alias("n_null")) for c in columns)
    )
    return counts.select(F.inline(per_column)).withColumn("alert", F.col("n_null") > 0)


def observe_nulls(
    df: DataFrame, columns: Sequence[str], name: str = "nulls"
) -> tuple[DataFrame, Observation]:
    """The same counts gathered while another job runs over the table."""
    watch = Observation(name)
    return df.observe(watch, *(F.count_if(F.col(c).isNull()).alias(c) for c in columns)), watch


def pair_correlations(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Correlation of each column pair, all pairs in one pass."""
    one = df.agg(*(F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)))
    per_pair = F.array(
        *(
            F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), F.col(f"r{i}").alias("r"))
            for i, (a, b) in enumerate(pairs)
        )
    )
    return one.select(F.inline(per_pair))


def running_mean(
    df: DataFrame, day: str, value: str, out: str = "moving_avg", by: Sequence[str] = ()
) -> DataFrame:
    """Mean of all rows up to and including the row's day; rows of one day share it.

    Rows are first summed per day. Only these sums go through the ordered window, so its
    partition is bounded by the calendar even without ``by``; ``day`` must be a date.
    """
    if df.schema[day].dataType.simpleString() != "date":
        raise TypeError(f"{day} must be a date column")
    days = df.groupBy(*by, day).agg(
        F.sum(value).alias("_s"), F.count(F.col(value)).alias("_n")
    )
    upto = Window.partitionBy(*by).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    means = days.select(
        *by,
        day,
        F.try_divide(
            F.sum("_s").over(upto).cast("double"), F.sum("_n").over(upto).cast("double")
        ).alias(out),
    )
    return df.join(means, [*by, day], "left")  # as few rows as there are days; adaptive execution cuts a hot day
