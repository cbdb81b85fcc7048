"""Column reports asked for by a config table.

A report takes two passes over the table whatever the number of config rows: one global aggregate
holds every count that belongs to a known label (no shuffle of rows), and one group-by counts
every label that is found in the data.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartulary.functions.headers import normalize_headers
from cartulary.functions.text import clean_list, fill_blank

FLAGS = ["aggregate", "root_only", "separate_nodes", "average", "duplicate", "clean"]
DEFAULT_DELIMITER = "|"
SECTIONS = "sections"  # metadata of section_no: [number, title, kind] of each section, also of those without rows
REPORT_COLUMNS = ["section_no", "entry_no", "section", "kind", "label", "pct", "n", "text"]


# ---------------------------------------------------------------- config


def parse_config(config: DataFrame) -> DataFrame:
    """Config rows with boolean flags, lower-cased values and a delimiter."""
    cfg = normalize_headers(config, "snake")
    has = lambda c: c in cfg.columns
    flag = lambda c: F.lower(F.trim(fill_blank(F.col(c)))).isin("yes", "true")
    delimiter = F.coalesce(F.col("delimiter"), F.lit("|")) if has("delimiter") else F.lit("|")
    return cfg.select(
        F.trim(F.col("column")).alias("column"),
        (F.lower(fill_blank(F.col("value"))) if has("value") else F.lit("")).alias("value"),
        delimiter.alias("delimiter"),
        *((flag(c) if has(c) else F.lit(False)).alias(c) for c in FLAGS),
    )


@dataclass(frozen=True)
class Ask:
    """One config row."""

    column: str
    value: str
    delimiter: str
    aggregate: bool
    root_only: bool
    separate_nodes: bool
    average: bool
    duplicate: bool
    clean: bool


def load_config(config: DataFrame) -> list[Ask]:
    """The config in row order. The driver holds it, whatever its length."""
    return [Ask(**r.asDict()) for r in parse_config(config).collect()]


# ---------------------------------------------------------------- cell tests


def _quoted(text: str) -> str:
    """The text as a literal inside a pattern."""
    return re.sub(r"([^\w\s])", r"\\\1", text)


def root_of(cell: Column, delimiter: str) -> Column:
    return F.substring_index(cell, delimiter, 1)


def nodes_of(cell: Column, delimiter: str) -> Column:
    """Trimmed, lower-cased nodes of a cell."""
    parts = F.split(cell, rf"\s*{_quoted(delimiter)}\s*", -1)
    return F.transform(parts, lambda p: F.lower(F.trim(p)))


def has_node(cell: Column, value: str, delimiter: str = DEFAULT_DELIMITER) -> Column:
    """Whether the value stands as a whole node, blind to case; a blank value finds blank nodes."""
    d = _quoted(delimiter)
    return F.lower(cell).rlike(rf"(?:^|{d})\s*{_quoted(value)}\s*(?:{d}|$)")


def is_number_cell(cell: Column) -> Column:
    return cell.rlike(r"^\d+(\.\d+)?%?$")


def share(n: Column, total: Column) -> Column:
    return F.round(F.try_divide(n * 100.0, total), 2)


# ---------------------------------------------------------------- the report


@dataclass
class _Plan:
    """What one pass over the table has to count."""

    known: list  # (section_no, entry_no, label, count expression)
    averages: list  # (section_no, column)
    single: list  # (section_no, entry_no, replaces, label expression)
    nodes: list  # (section_no, entry_no, replaces, array-of-labels expression)
    wanted: list  # (section_no, entry_no, label) of value lists, zero counts kept
    kinds: dict  # section_no -> (title, kind)

    @property
    def found(self) -> list:
        return self.single + self.nodes


def _labelled(label: Column) -> Column:
    return F.when(label == "", "None").otherwise(label)


def _plan(asks: Sequence[Ask], cells: dict[str, Column]) -> _Plan:
    plan = _Plan([], [], [], [], [], {})
    by_column: dict[str, list[Ask]] = {}
    for ask in asks:
        by_column.setdefault(ask.column, []).append(ask)
    for no, (column, entries) in enumerate(by_column.items(), start=1):
        cell = cells[column]
        if any(e.duplicate for e in entries):
            plan.kinds[no] = (column.upper(), "Duplicate")
            plan.single.append((no, 0, False, cell))
            continue
        if any(e.average for e in entries):
            plan.kinds[no] = (column.upper(), "Average")
            plan.averages.append((no, cell))
            continue
        plan.kinds[no] = (column.upper(), "Count")
        wanted = [e for e in entries if e.value]
        if wanted:
            _plan_values(plan, no, cell, wanted)
            continue
        blanks: list[tuple[int, Column]] = []
        distributed = False
        for i, e in enumerate(entries, start=1):
            looked = root_of(cell, e.delimiter) if e.root_only else cell
            if e.separate_nodes:
                labels = F.transform(nodes_of(cell, e.delimiter), _labelled)
                plan.nodes.append((no, i, False, labels))
                distributed = True
            elif e.aggregate:
                plan.single.append((no, i, True, _labelled(F.lower(F.trim(looked)))))
                distributed = True
            else:
                blanks.append((i, F.count_if(has_node(looked, "", e.delimiter))))
        if distributed:
            plan.known += [(no, i, "None", n) for i, n in blanks]
        elif blanks:
            plan.known.append((no, 1, "None", reduce(Column.__add__, (n for _, n in blanks))))
    return plan


_SPACE = " \t\n\x0b\f\r"


def _overlaps(delimiter: str) -> bool:
    """Whether two occurrences of a delimiter can overlap in a way that matters: blanks are trimmed anyway."""
    return delimiter.strip(_SPACE) != "" and any(delimiter.startswith(delimiter[i:]) for i in range(1, len(delimiter)))


def _is_node_run(ask: Ask) -> bool:
    """Whether ``has_node`` finds the value exactly where it is a run of whole nodes with its delimiters between, trimmed."""
    return ask.delimiter != "" and not _overlaps(ask.delimiter) and ask.value == ask.value.strip(_SPACE)


def _searched_runs(cell: Column, delimiter: str, lengths: Sequence[int]) -> Column:
    """The distinct runs of so many nodes of a cell as ``has_node`` sees them: lower-cased first, then cut and trimmed."""
    text = F.regexp_replace(F.lower(cell), r"[\u0085\u2028\u2029]\z", "")  # a line end at the end is none for ``$``
    nodes = F.split(text, _quoted(delimiter), -1)

    def trimmed(run: Column) -> Column:
        return F.trim(run, F.lit(_SPACE))

    def runs(length: int) -> Column:
        if length == 1:
            return F.transform(nodes, trimmed)
        starts = F.when(F.size(nodes) >= length, F.sequence(F.lit(1), F.size(nodes) - length + 1))
        joined = F.transform(starts, lambda i: trimmed(F.array_join(F.slice(nodes, i, length), delimiter)))
        return F.coalesce(joined, F.array().cast("array<string>"))

    found = [runs(n) for n in lengths]
    return F.array_distinct(F.concat(*found) if len(found) > 1 else found[0])


def _plan_values(plan: _Plan, no: int, cell: Column, wanted: Sequence[Ask]) -> None:
    """A list of values: the nodes of a cell, and its runs of nodes for values that hold the delimiter, are looked up in it.

    What is left, values that begin or end with blanks and delimiters that can overlap themselves, is tested value by
    value. A value asked for twice keeps its first place and its last answer.
    """
    place: dict[str, int] = {}
    last: dict[str, Ask] = {}
    for e in wanted:
        place.setdefault(e.value, len(place) + 1)
        last[e.value] = e
    alike: dict[tuple, list[str]] = {}
    for value, e in last.items():
        if e.separate_nodes or _is_node_run(e):
            plan.wanted.append((no, place[value], value))
            alike.setdefault((e.delimiter, e.root_only and not e.separate_nodes, e.separate_nodes), []).append(value)
        else:
            looked = root_of(cell, e.delimiter) if e.root_only else cell
            plan.known.append((no, place[value], value, F.count_if(has_node(looked, value, e.delimiter))))
    for (delimiter, root_only, each), values in alike.items():
        if each:
            nodes = F.transform(nodes_of(cell, delimiter), clean_list)
        else:
            lengths = sorted({v.count(delimiter) + 1 for v in values})
            nodes = _searched_runs(root_of(cell, delimiter) if root_only else cell, delimiter, lengths)
        plan.nodes.append((no, 0, False, F.filter(nodes, lambda x: x.isin(values))))


def _known_rows(report: DataFrame, plan: _Plan) -> DataFrame:
    """All counts of known labels, the averages and the row count from one aggregate."""
    measures = [F.count(F.lit(1)).alias("rows")]
    for i, (_, _, _, expr) in enumerate(plan.known):
        measures.append(expr.alias(f"k{i}"))
    for i, (_, cell) in enumerate(plan.averages):
        plain = F.regexp_replace(cell, "%+$", "").try_cast("double")
        measures += [
            F.every(is_number_cell(cell)).alias(f"ok{i}"),
            F.avg(plain).alias(f"avg{i}"),
            F.bool_or(cell.endswith("%")).alias(f"unit{i}"),
        ]
    one = report.agg(*measures)

    def line(no: int, entry: int, label, n, pct, text) -> Column:
        title, kind = plan.kinds.get(no, ("Total rows", "Total"))
        return F.struct(
            F.lit(no).alias("section_no"),
            F.lit(entry).alias("entry_no"),
            F.lit(title).alias("section"),
            F.lit(kind).alias("kind"),
            F.lit(label).cast("string").alias("label"),
            pct.cast("double").alias("pct"),
            n.cast("bigint").alias("n"),
            text.cast("string").alias("text"),
        )

    nothing = F.lit(None)
    lines = [line(0, 0, "report_rows", F.col("rows"), nothing, nothing)]
    for i, (no, entry, label, _) in enumerate(plan.known):
        lines.append(
            line(no, entry, label, F.col(f"k{i}"), share(F.col(f"k{i}"), F.col("rows")), nothing)
        )
    for i, (no, _) in enumerate(plan.averages):
        mean = F.concat(
            F.format_string("%.2f", F.col(f"avg{i}")), F.when(F.col(f"unit{i}"), "%").otherwise("")
        )
        numeric = F.coalesce(F.col(f"ok{i}"), F.lit(False))
        lines.append(
            line(
                no, 0, "", nothing,
                F.when(numeric, F.round(F.col(f"avg{i}"), 2)),
                F.when(numeric, mean).otherwise("Non-digit field"),
            )
        )
    return one.select(F.inline(F.array(*lines)))


def _found_counts(report: DataFrame, plan: _Plan) -> DataFrame:
    """Counts of the labels found in the data: one explode, one group-by, partial sums first."""

    def tagged(no: int, entry: int, replaces: bool, label: Column) -> Column:
        return F.struct(
            F.lit(no).alias("section_no"),
            F.lit(entry).alias("entry_no"),
            F.lit(replaces).alias("replaces"),
            label.alias("label"),
        )

    def each(no: int, entry: int, replaces: bool, labels: Column) -> Column:
        return F.transform(labels, lambda label: tagged(no, entry, replaces, label))

    # Cells that are one label each stay clear of array functions, which run uncompiled.
    asked = [F.array(*(tagged(*one) for one in plan.single))] if plan.single else []
    asked += [each(*many) for many in plan.nodes]
    return (
        report.select(F.inline_outer(F.concat(*asked) if len(asked) > 1 else asked[0]))
        .filter("section_no is not null")  # outer, else all labels are worked out once more to see which rows have some
        .groupBy("section_no", "entry_no", "replaces", "label")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _zero_counts(found: DataFrame, plan: _Plan) -> DataFrame:
    """A zero for every value of a list: keeps those that never occur, and their order."""
    zeros = [(no, entry, False, label, 0) for no, entry, label in plan.wanted]
    return found.sparkSession.createDataFrame(zeros, "section_no int, entry_no int, replaces boolean, label string, n bigint")


def _merge_entries(found: DataFrame, listed: set[int]) -> DataFrame:
    """One count per label from the counts of several config rows.

    They act in order: a distribution of values replaces, the others add. A label has at most a
    few counts per config row. Labels of the ``listed`` sections keep the place they were given.
    """
    parts = F.sort_array(F.collect_list(F.struct("entry_no", "replaces", "n")))
    n = F.reduce(
        "parts",
        F.lit(0).cast("bigint"),
        lambda acc, p: F.when(p["replaces"], p["n"]).otherwise(acc + p["n"]),
    )
    gathered = found.groupBy("section_no", "label").agg(
        parts.alias("parts"), F.max("entry_no").alias("entry_no")
    )
    place = F.when(F.col("section_no").isin(*listed), F.col("entry_no")).otherwise(0) if listed else F.lit(0)
    return gathered.select("section_no", place.alias("entry_no"), "label", n.alias("n"))


def build_report(report: DataFrame, config: DataFrame | Sequence[Ask]) -> DataFrame:
    """All sections: ``section_no, entry_no, section, kind, label, pct, n, text``.

    Section 0 gives the number of config rows and of report rows. ``entry_no`` is the order asked
    for; labels found in the data share one and are ordered by label, duplicates by count.
    """
    asks = list(config) if isinstance(config, (list, tuple)) else load_config(config)
    table = normalize_headers(report, "lower")
    used = list(dict.fromkeys(a.column for a in asks))
    missing = [c for c in used if c not in table.columns]
    if missing:
        raise ValueError(f"no such report column: {', '.join(missing)}")
    cleaned = {a.column for a in asks if a.clean}
    table = table.select(
        *((clean_list(fill_blank(F.col(c))) if c in cleaned else fill_blank(F.col(c))).alias(c)
          for c in used)
    )
    plan = _plan(asks, {c: F.col(c) for c in used})
    known = _known_rows(table, plan)
    totals = table.sparkSession.range(1).select(
        F.lit(0).alias("section_no"), F.lit(0).alias("entry_no"),
        F.lit("Total rows").alias("section"), F.lit("Total").alias("kind"),
        F.lit("config_rows").alias("label"), F.lit(None).cast("double").alias("pct"),
        F.lit(len(asks)).cast("bigint").alias("n"), F.lit(None).cast("string").alias("text"),
    )
    listed = [[0, "Total rows", "Total"], *([no, *named] for no, named in plan.kinds.items())]

    def told(sections: DataFrame) -> DataFrame:
        return sections.withMetadata("section_no", {SECTIONS: json.dumps(listed)})

    if not plan.found:
        return told(totals.unionByName(known))
    counted = known.collect()
    n_rows = next(r["n"] for r in counted if r["label"] == "report_rows" and r["section_no"] == 0)
    known = table.sparkSession.createDataFrame(counted, known.schema)

    found = _found_counts(table, plan)
    open_sections = [no for no, *_ in plan.found]
    blanks_beside = [no for no, *_ in plan.known if no in open_sections]
    alone = known
    if blanks_beside:
        # Blank counts asked for next to a distribution add to its label None.
        is_beside = F.col("section_no").isin(open_sections) & (F.col("kind") == "Count")
        beside = known.filter(is_beside)
        found = found.unionByName(
            beside.select("section_no", "entry_no", F.lit(False).alias("replaces"), "label", "n")
        )
        alone = known.filter(~is_beside)
    if plan.wanted:
        found = found.unionByName(_zero_counts(found, plan))
    if plan.wanted or blanks_beside or len(set(open_sections)) < len(open_sections):
        merged = _merge_entries(found, {no for no, *_ in plan.wanted})
    else:
        merged = found.select("section_no", F.lit(0).alias("entry_no"), "label", "n")
    titles = F.create_map(*(F.lit(x) for no in plan.kinds for x in (no, plan.kinds[no][0])))
    kinds = F.create_map(*(F.lit(x) for no in plan.kinds for x in (no, plan.kinds[no][1])))
    labelled = (
        merged.select(
            "section_no",
            "entry_no",
            F.element_at(titles, F.col("section_no")).alias("section"),
            F.element_at(kinds, F.col("section_no")).alias("kind"),
            "label",
            "n",
        )
        .filter((F.col("kind") == "Count") | (F.col("n") > 1))
        .withColumn(
            "pct", F.when(F.col("kind") == "Count", share(F.col("n"), F.lit(n_rows)))
        )
        .withColumn("text", F.lit(None).cast("string"))
    )
    return told(reduce(DataFrame.unionByName, [totals, alone, labelled.select(*REPORT_COLUMNS)]))


def report_lines(sections: DataFrame) -> DataFrame:
    """Report rows as printed cells ``c1, c2, c3`` with the keys that order them.

    Each section gets its header row and a blank row after it, also one without rows.
    """
    pct = F.when(F.col("pct").isNotNull(), F.concat(F.format_string("%.2f", "pct"), F.lit("%")))
    kind = F.col("kind")
    body = sections.filter((kind != "Total") | (F.col("label") == "config_rows")).select(
        "section_no",
        F.lit(1).alias("part"),
        "entry_no",
        F.when(kind == "Duplicate", -F.col("n"))
        .when((kind == "Count") & (F.col("label") == "None"), F.lit(-1))
        .otherwise(F.lit(0))
        .alias("rank"),
        F.when(kind == "Total", F.col("section"))
        .when(F.col("text") == "Non-digit field", F.col("text"))
        .otherwise(F.col("label"))
        .alias("c1"),
        F.when(kind == "Count", pct).otherwise("").alias("c2"),
        F.when((kind == "Average") & (F.col("text") != "Non-digit field"), F.col("text"))
        .when(kind == "Average", "")
        .otherwise(F.col("n").cast("string"))
        .alias("c3"),
    )
    known = sections.schema["section_no"].metadata.get(SECTIONS)
    if known is None:
        raise ValueError("the sections of a report are those build_report gives")
    edges = []
    for no, title, named in json.loads(known):
        if named != "Total":
            edges.append((no, 0, 0, 0, title, "%" if named == "Count" else "", named))
        edges.append((no, 2, 0, 0, "", "", ""))
    shape = "section_no int, part int, entry_no int, rank bigint, c1 string, c2 string, c3 string"
    return body.unionByName(sections.sparkSession.createDataFrame(edges, shape))


def line_order() -> list[Column]:
    return [F.col(c) for c in ("section_no", "part", "entry_no", "rank", "c1")]


# ---------------------------------------------------------------- fixed label reports


def label_counts(df: DataFrame, column: str, labels: Sequence[str]) -> DataFrame:
    """Count and share of each wanted label in the order given, zero rows kept: one aggregate."""
    return field_counts(df, [column], labels).select(
        "label_no", "label", F.col("n_0").alias("n"), F.col("pct_0").alias("pct")
    )


def field_counts(df: DataFrame, columns: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """One label list counted over several columns: ``label_no, label, n_i, pct_i``."""
    one = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *(
            F.count_if(F.col(c) == label).alias(f"m{i}_{j}")
            for i, c in enumerate(columns)
            for j, label in enumerate(labels)
        ),
    )
    lines = [
        F.struct(
            F.lit(j + 1).alias("label_no"),
            F.lit(label).alias("label"),
            *(F.col(f"m{i}_{j}").alias(f"n_{i}") for i in range(len(columns))),
            *(share(F.col(f"m{i}_{j}"), F.col("rows")).alias(f"pct_{i}")
              for i in range(len(columns))),
        )
        for j, label in enumerate(labels)
    ]
    return one.select(F.inline(F.array(*lines)))


def side_by_side(df: DataFrame, lists: Sequence[tuple[str, Sequence[str]]]) -> DataFrame:
    """Several label lists next to each other, short ones padded with blanks.

    One aggregate counts every label; the rows are laid out from that single line.
    """
    one = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *(
            F.count_if(F.col(column) == label).alias(f"m{i}_{j}")
            for i, (column, labels) in enumerate(lists)
            for j, label in enumerate(labels)
        ),
    )
    lines = []
    for j in range(max(len(labels) for _, labels in lists)):
        cells = [F.lit(j + 1).alias("line_no")]
        for i, (_, labels) in enumerate(lists):
            here = j < len(labels)
            n = F.col(f"m{i}_{j}") if here else F.lit(None).cast("bigint")
            pct = share(n, F.col("rows")) if here else F.lit(None).cast("double")
            cells += [
                F.lit(labels[j] if here else "").alias(f"label_{i}"),
                n.alias(f"n_{i}"),
                pct.alias(f"pct_{i}"),
            ]
        lines.append(F.struct(*cells))
    return one.select(F.inline(F.array(*lines)))


# Label lists and column names of the ticket report.
TICKET_TYPES = ["POI Datascience", "POI Change Details", "POI Remove", "POI Add"]
LAST_EDITOR_RESOLUTIONS = ["Complete", "Reject"]
LEVEL_RESOLUTIONS = ["Approved", "Rejected"]
YES_NO = ["Yes", "No", "N/A"]
SUGGESTED_FIELDS = [
    "Closures",
    "Brand",
    "Name",
    "URL",
    "Address",
    "Geocode",
    "Phone",
    "Hours",
    "Modern Category",
    "Category",
    "Included Parent",
    "Good-to-know Tag",
    "Comment",
    "New POI",
]
RESOLUTION_COLUMNS = [
    ("Ticket type", TICKET_TYPES),
    ("Last Editor Resolution", LAST_EDITOR_RESOLUTIONS),
    ("L1 Resolution", LEVEL_RESOLUTIONS),
    ("L2 Resolution", LEVEL_RESOLUTIONS),
]
FIELD_COLUMNS = [
    "Suggested fields",
    "Edited fields",
    "Other markings made along with procedural marking?",
]
QUESTION_COLUMNS = [
    "Are customer issues resolved?",
    "Any attribute errors remain on the POI?",
    "Are there still discrepancies between research indicators and POI data?",
    "All customer-suggested fields edited?",
    "All customer-suggested fields have a corresponding dependent edit?",
]


def ticket_report(df: DataFrame) -> dict[str, DataFrame]:
    """The three sections of the fixed ticket report."""
    return {
        "resolutions": side_by_side(df, RESOLUTION_COLUMNS),
        "fields": field_counts(df, FIELD_COLUMNS, SUGGESTED_FIELDS),
        "questions": field_counts(df, QUESTION_COLUMNS, YES_NO),
    }
