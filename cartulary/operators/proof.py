"""Lines of a proof document: counts, top lists, event tables, date counts, fallback text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.internal import InternalFunction

from cartulary.sources.proofs import fields_json

TOP_SHOWN = 10
DATES_SHOWN = 20
FALLBACK_ROWS = 5
KNOWN_TYPES = ["category_counts", "top_list", "events", "date_counts"]


def route(sections: DataFrame) -> DataFrame:
    """Sections with the form they are shown in; unknown types go to the fallback."""
    return sections.withColumn(
        "route", F.when(F.col("type").isin(KNOWN_TYPES), F.col("type")).otherwise("fallback")
    )


def sort_count_desc(rows: DataFrame, by: list[str], label: str = "label", count: str = "count") -> DataFrame:
    """Labels by count, largest first, then in the order given. A missing count is 0.

    One range-partitioned sort; a list need not fit in a task.
    """
    n = F.coalesce(F.col(count), F.lit(0))
    return rows.withColumn(count, n).withColumn(label, F.coalesce(F.col(label), F.lit("?"))).orderBy(
        *by, F.desc(count), "pos"
    )


def _printed(rows: DataFrame, number: str) -> Column:
    """A number as it was written where that is known; a missing one is 0."""
    written = f"{number}_text"
    return F.coalesce(F.col(written) if written in rows.columns else F.col(number).cast("string"), F.lit("0"))


def _head_and_rest(rows: DataFrame, by: list[str], order: list[Column], line: Column, pos: str, shown: int) -> DataFrame:
    """``(by, rank, line)`` of the first rows of each list by ``order``, with a line that stands for all others.

    One aggregate: each task keeps a heap of ``shown`` rows and a count for each list, whatever their length. A list whose
    only row has no ``pos`` is empty and says so.
    """
    here = F.col(pos).isNotNull()
    ranked = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], line.alias("line"))
    heads = rows.groupBy(*by).agg(
        InternalFunction.collect_top_k(F.when(here, ranked), shown, True).alias("_head"),
        (F.count_if(here) - shown).alias("_hidden"),
    )

    def entry(rank: Column, text: Column) -> Column:
        return F.struct(rank.cast("int").alias("rank"), text.alias("line"))

    first = F.transform("_head", lambda r, i: entry(i + 1, r["line"]))
    rest = F.when(
        F.col("_hidden") > 0,
        F.array(entry(F.lit(shown + 1), F.concat(F.lit("… and "), F.col("_hidden").cast("string"), F.lit(" more")))),
    ).otherwise(F.array().cast("array<struct<rank:int,line:string>>"))
    nothing = F.array(entry(F.lit(1), F.lit("No data")))
    lines = F.when(F.size("_head") == 0, nothing).otherwise(F.concat(first, rest))
    return heads.select(*by, F.inline(lines))


def count_lines(rows: DataFrame, by: list[str], label: str = "label", count: str = "count") -> DataFrame:
    """``(by, count, pos, line)``: a line for each label, to be sorted by count; ``No data`` for an empty list."""
    line = F.concat(F.coalesce(F.col(label), F.lit("?")), F.lit(": "), _printed(rows, count))
    none = F.col("pos").isNull()
    return rows.select(
        *by, F.coalesce(F.col(count), F.lit(0)).alias(count), "pos", F.when(none, "No data").otherwise(line).alias("line")
    )


def top_list(
    rows: DataFrame, by: list[str], label: str = "label", count: str = "count", tie: str = "pos"
) -> DataFrame:
    """``(by, rank, line)``: the ten largest counts and a line for the rest of each list; ties stay in the order of ``tie``."""
    n = F.coalesce(F.col(count), F.lit(0))
    line = F.concat(F.coalesce(F.col(label), F.lit("?")), F.lit(" — "), _printed(rows, count))
    return _head_and_rest(rows, by, [-n, F.col(tie)], line, tie, TOP_SHOWN)


def date_counts(rows: DataFrame, by: list[str], pos: str = "pos") -> DataFrame:
    """``(by, rank, line)``: the first twenty dates in the order given and a line for the rest."""
    line = F.concat(F.coalesce(F.col("date"), F.lit("?")), F.lit(": "), _printed(rows, "value"))
    return _head_and_rest(rows, by, [F.col(pos)], line, pos, DATES_SHOWN)


def date_range(first: Column, last: Column) -> Column:
    """``Range: a → b``; a missing end shows as ``?``, without both there is no line."""
    filled = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("?"))
    none = F.coalesce(F.nullif(first, F.lit("")), F.nullif(last, F.lit(""))).isNull()
    return F.when(~none, F.concat(F.lit("Range: "), filled(first), F.lit(" → "), filled(last)))


def events_table(rows: DataFrame, by: list[str]) -> DataFrame:
    """``id, flag, date`` of each event; ``entity_id`` before ``id``, blanks for what is missing."""
    blank = lambda *cs: F.coalesce(*(F.col(c) for c in cs), F.lit(""))
    return rows.select(
        *by,
        blank("entity_id", "id").alias("id"),
        blank("flag").alias("flag"),
        blank("date").alias("date"),
    )


def fallback(sections: DataFrame, keep: list[str]) -> DataFrame:
    """All attributes of a section but its data as JSON, and its first five data rows as JSON, one a line."""
    rows = F.transform(F.slice("data", 1, FALLBACK_ROWS), lambda r: F.to_json(r))
    return sections.select(*keep, fields_json(F.col("fields")).alias("attributes"), F.coalesce(F.array_join(rows, "\n"), F.lit("")).alias("rows"))


def footnote(source: Column, run_id: Column, generated_at: Column) -> Column:
    """``Source: … • Run: …``; the run falls back to the time it was made, empty parts go."""
    filled = lambda c: F.nullif(c, F.lit(""))
    return F.concat_ws(
        " • ",
        F.concat(F.lit("Source: "), filled(source)),
        F.concat(F.lit("Run: "), F.coalesce(filled(run_id), filled(generated_at))),
    )
