"""Report sections: the worked example, edge cells, and the text round trip."""

import pytest

from cartulary.operators import reports as rp
from cartulary.session import scratch_path
from cartulary.sinks.reports import write_sectioned_report
from cartulary.sources.sheets import read_header_block, read_sectioned_report

SHEET = [("1", "A | b", "50%", "Bo"), ("2", "b", "25%", "Bo"), ("3", "", "75%", "Al"), ("4", "a", "10%", "Cy")]


def report(spark, *config, rows=SHEET):
    sheet = spark.createDataFrame(rows, "id string, Tags string, ` SCORE` string, name string")
    names = list(dict.fromkeys(k for c in config for k in c))
    cfg = spark.createDataFrame(
        [tuple(c.get(n) for n in names) for c in config], ", ".join(f"`{n}` string" for n in names)
    )
    return rp.build_report(sheet, cfg)


def lines(df):
    rows = df.filter("section_no > 0").collect()
    return sorted((r["label"], r["pct"], r["n"]) for r in rows)


@pytest.mark.parametrize(
    "config,want",
    [
        ({"column": "tags", "value": "a"}, [("a", 50.0, 2)]),
        ({"column": "tags", "value": "b", "root_only": "Yes"}, [("b", 25.0, 1)]),
        ({"column": "tags", "separate_nodes": "true"}, [("None", 25.0, 1), ("a", 50.0, 2), ("b", 50.0, 2)]),
        (
            {"column": "tags", "aggregate": "yes"},
            [("None", 25.0, 1), ("a", 25.0, 1), ("a | b", 25.0, 1), ("b", 25.0, 1)],
        ),
        ({"column": "tags", "aggregate": "no"}, [("None", 25.0, 1)]),
        ({"column": "name", "duplicate": "yes"}, [("Bo", None, 2)]),
    ],
)
def test_worked_sections(spark, config, want):
    assert lines(report(spark, config)) == want


def test_averages(spark):
    got = report(spark, {"column": "score", "average": "yes"}, {"column": "name", "average": "yes"})
    assert {r["section"]: r["text"] for r in got.filter("section_no > 0").collect()} == {
        "SCORE": "40.00%",
        "NAME": "Non-digit field",
    }


def test_totals_count_config_and_report(spark):
    got = report(spark, {"column": "tags"}, {"column": "tags", "value": "a"})
    assert {r["label"]: r["n"] for r in got.filter("section_no = 0").collect()} == {
        "config_rows": 2,
        "report_rows": 4,
    }


def test_value_is_taken_literally_and_last_answer_wins(spark):
    rows = [("1", "c++ | x", "", ""), ("2", "cpp", "", ""), ("3", " C++ ", "", "")]
    got = report(
        spark, {"column": "tags", "value": "C++"}, {"column": "tags", "value": "c++", "root_only": "yes"}, rows=rows
    )
    assert lines(got) == [("c++", 66.67, 2)]


def test_missing_column_is_named(spark):
    with pytest.raises(ValueError, match="zip"):
        report(spark, {"column": "zip"})


def test_empty_cells_and_nulls(spark):
    rows = [("1", None, None, None), ("2", "x|", None, None)]
    got = report(spark, {"column": "tags", "separate_nodes": "yes"}, rows=rows)
    assert lines(got) == [("None", 100.0, 2), ("x", 50.0, 1)]


def test_text_round_trip(spark):
    built = report(
        spark,
        {"column": "tags", "aggregate": "yes"},
        {"column": "name", "duplicate": "yes"},
        {"column": "score", "average": "yes"},
    )
    path = scratch_path(spark, "report")
    write_sectioned_report(built, path)
    text = [r["value"] for r in spark.read.text(path).collect()]
    assert text == [
        "Total rows,,3", "",
        "TAGS,%,Count", "None,25.00%,1", "a,25.00%,1", "a | b,25.00%,1", "b,25.00%,1", "",
        "NAME,,Duplicate", "Bo,,2", "",
        "SCORE,,Average", ",,40.00%", "",
    ]
    back = read_sectioned_report(spark, path).collect()
    assert [(r["section"], r["kind"], r["label"], r["amount"]) for r in sorted(back, key=lambda r: (r["section_no"], r["line_no"]))] == [
        ("TAGS", "Count", "None", "1"), ("TAGS", "Count", "a", "1"), ("TAGS", "Count", "a | b", "1"),
        ("TAGS", "Count", "b", "1"), ("NAME", "Duplicate", "Bo", "2"), ("SCORE", "Average", "", "40.00%"),
    ]


def test_labels_with_commas_and_quotes_survive(spark):
    rows = [("1", 'a, "b"', "", "")]
    path = scratch_path(spark, "quoted")
    write_sectioned_report(report(spark, {"column": "tags", "aggregate": "yes"}, rows=rows), path)
    assert read_sectioned_report(spark, path).first()["label"] == 'a, "b"'


def test_header_block(spark):
    cells = [["k", x] + [""] * 21 for x in ("Proj", "", "doc/1", " ab ", "x1", "1/2/2025", "n/a", "00:10")]
    cells += [[""] * 23, [""] * 22 + ["place ids"], [""] * 22 + ["7"], [""] * 23]
    path = scratch_path(spark, "sheet")
    spark.createDataFrame([("\n".join(",".join(c) for c in cells),)], "value string").write.text(path)
    got = read_header_block(spark, path, link_base="https://docs.test/").first()
    assert (got["project_name"], got["project_tab"], got["link"]) == ("Proj", None, "https://docs.test/doc/1")
    assert (got["warnings_col"], got["start_row"], got["last_avg_ticket_runtime"]) == ("AB", None, None)
    assert (got["ids_type"], got["last_id_row"]) == ("place ids", 12)


def test_fixed_reports(spark):
    df = spark.createDataFrame([("Yes", "No"), ("Yes", "odd"), (None, "No")], "a string, b string")
    got = rp.field_counts(df, ["a", "b"], rp.YES_NO).collect()
    assert [(r["label"], r["n_0"], r["pct_0"], r["n_1"]) for r in got] == [
        ("Yes", 2, 66.67, 0), ("No", 0, 0.0, 2), ("N/A", 0, 0.0, 0),
    ]
    rows = rp.side_by_side(df, [("a", ["Yes", "No"]), ("b", ["odd"])]).collect()
    assert [(r["label_0"], r["n_0"], r["label_1"], r["n_1"]) for r in rows] == [("Yes", 2, "odd", 1), ("No", 0, "", None)]


def test_sections_without_rows_keep_their_header(spark):
    rows = [("1", "a", "1%", "x"), ("2", "b", "2%", "y")]
    path = scratch_path(spark, "empty-section")
    write_sectioned_report(report(spark, {"column": "name", "duplicate": "yes"}, {"column": "tags", "aggregate": "yes"}, rows=rows), path)
    text = [r["value"] for r in spark.read.text(path).collect()]
    assert text == ["Total rows,,2", "", "NAME,,Duplicate", "", "TAGS,%,Count", "a,50.00%,1", "b,50.00%,1", ""]
    assert {r["section"] for r in read_sectioned_report(spark, path).collect()} == {"TAGS"}


def _as_one_text(text):
    """Sections of a text, read in one piece: (section_no, line_no, section, label)."""
    sections, here = [], None
    for line in text.split("\n"):
        if not line.strip(","):
            here = None
        elif line.strip():
            if here is None:
                here = []
                sections.append(here)
            here.append(line.split(","))
    return sorted((i, j, s[0][0], cells[0]) for i, s in enumerate(sections) for j, cells in enumerate(s[1:]))


@pytest.mark.parametrize("cut", [1, 7, 40, 100_000])
def test_sections_cross_splits_and_files(spark, tmp_path, cut):
    """A report in many parts, each in many splits: sections of no, one and very many lines."""
    lines = ["", "A,%,Count"] + [f"a{i},1%,{i}" for i in range(300)] + ["", ",,", "B,,Duplicate", "", "  ", "C,,Average", " ", ",,1%"]
    lines += ["", "D,%,Count"] + [f"d{i},,{i}" for i in range(40)] + ["", "", "E,x,odd", "e,,1"]
    for n, at in enumerate(range(0, len(lines), cut)):
        (tmp_path / f"part-{n:05}.txt").write_text("\n".join(lines[at : at + cut]) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        got = read_sectioned_report(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted((r["section_no"], r["line_no"], r["section"], r["label"]) for r in got) == _as_one_text("\n".join(lines))
    assert {(r["section"], r["kind"]) for r in got} == {("A", "Count"), ("C", "Average"), ("D", "Count"), ("E", None)}


def test_files_of_other_names_are_reports_of_their_own(spark, tmp_path):
    (tmp_path / "one.csv").write_text("A,%,Count\na,,1\n")
    (tmp_path / "two.csv").write_text("b,,2\n\nB,%,Count\r\nc,,3")
    got = read_sectioned_report(spark, str(tmp_path)).collect()
    assert sorted((r["file"].rsplit("/", 1)[1], r["section_no"], r["section"], r["label"]) for r in got) == [
        ("one.csv", 0, "A", "a"), ("two.csv", 1, "B", "c"),
    ]


def test_a_report_in_several_files_comes_back(spark):
    rows = [(str(i), f"tag {i % 4_000:04}", "", "") for i in range(5_000)]
    path = scratch_path(spark, "long-report")
    built = report(spark, {"column": "tags", "aggregate": "yes"}, {"column": "name", "duplicate": "yes"}, rows=rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_sectioned_report(built, path)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).count() > 3
    got = read_sectioned_report(spark, path).filter("section = 'TAGS'").orderBy("line_no").collect()
    assert [r["label"] for r in got] == sorted(f"tag {i:04}" for i in range(4_000))
    assert [r["line_no"] for r in got] == list(range(4_000)) and {r["section_no"] for r in got} == {1}
