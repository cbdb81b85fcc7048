"""Readers, writers and proof documents."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartulary.operators import proof
from cartulary.operators.recipes import null_counts, observe_nulls
from cartulary.session import scratch_path
from cartulary.sinks import tables as sink
from cartulary.sources import proofs, sheets, tables


def test_newest_file(spark):
    folder = scratch_path(spark, "drop")
    for name in ("first", "second"):
        spark.createDataFrame([(name,)], "c string").coalesce(1).write.mode("append").option("header", True).csv(folder)
    newest = tables.newest_file(spark, folder)
    assert spark.read.option("header", True).csv(newest).first()["c"] == "second"
    other = tables.newest_file(spark, folder, exclude=[newest.rsplit("/", 1)[1]])
    assert other != newest
    with pytest.raises(FileNotFoundError):
        tables.read_newest_csv(spark, folder, exclude=[p.rsplit("/", 1)[1] for p in (newest, other)])


def test_schema_check(spark):
    path = scratch_path(spark, "people")
    sink.write_csv(spark.createDataFrame([(1, "a", "x"), (2, "b", "7")], "id int, name string, age string"), path)
    found = spark.read.option("header", True).csv(path)
    assert tables.schema_mismatches(found, tables.PEOPLE_SCHEMA) == [("id", "int", "string"), ("age", "int", "string")]
    typed = found.select(F.col("id").cast("int"), "name", F.col("age").try_cast("int").alias("age"))
    assert tables.schema_mismatches(typed, tables.PEOPLE_SCHEMA) == []
    extra = T.StructType([*tables.PEOPLE_SCHEMA.fields, T.StructField("zip", T.StringType())])
    assert ("zip", "string", "") in tables.schema_mismatches(typed, extra)
    report = {r["column"]: r for r in tables.schema_report(spark, path, tables.PEOPLE_SCHEMA).collect()}
    assert (report["age"]["n_rows"], report["age"]["n_misfits"], report["age"]["n_filled"]) == (2, 1, 1)


def test_text_with_commas_and_quotes_survives_csv(spark):
    path = scratch_path(spark, "quotes")
    df = spark.createDataFrame([('a, "b"', "x\\y")], "a string, b string")
    sink.write_csv(df, path)
    assert tuple(tables.read_csv(spark, path).first()) == ('a, "b"', "x\\y")


def test_partitions_and_archive(spark):
    df = spark.createDataFrame([(1, 2024, 1), (2, 2024, 2)], "v int, year int, month int")
    path = scratch_path(spark, "parts")
    sink.write_partitioned(df, path)
    assert spark.read.parquet(path + "/year=2024/month=2").first()["v"] == 2
    root = scratch_path(spark, "root")
    where = sink.write_archive(df, root)
    assert where.startswith(f"{root}/archive/20") and len(where.rsplit("/", 1)[1]) == 8


def test_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    got = {r["column"]: (r["n_null"], r["alert"]) for r in null_counts(df, ["a", "b"]).collect()}
    assert got == {"a": (0, False), "b": (1, True)}
    watched, seen = observe_nulls(df, ["b"])
    assert watched.count() == 2 and seen.get == {"b": 1}


PROOF = {
    "run_id": "",
    "meta": {"source_doc": "a.xlsx", "generated_at": "2025"},
    "sections": [
        {"id": "t", "title": "T", "type": "top_list", "data": [{"label": f"l{i}", "count": i} for i in range(12)]},
        {"id": "e", "title": "E", "type": "events", "data": [{"entity_id": 771, "flag": "no", "date": "1999-05-02"}, {"id": "z"}]},
        {"id": "d", "type": "date_counts", "data": [{"date": f"2023-01-{i:02}", "value": i} for i in range(1, 26)],
         "summary": {"min": "2023-01-01"}},
        {"id": "o", "title": "O", "type": "odd", "owner": {"name": "me"}, "n": 1.50, "data": [{"label": "x", "bar": 2}] * 7},
        {"id": "n", "type": "top_list"},
        {"id": "f", "type": "top_list", "data": [None, {"count": 1.5}, {"label": "big", "count": 10**40, "foo": [1]}, {"label": "b", "count": 1.5}]},
        "no section",
    ],
}


@pytest.fixture(scope="module")
def document(spark):
    path = scratch_path(spark, "proof")
    spark.createDataFrame([(json.dumps(PROOF, indent=1),)], "value string").write.text(path)
    return proofs.read_proof(spark, path)


def test_proof_lists(document):
    rows = proofs.proof_rows(document)
    lists = proof.top_list(rows.filter("type = 'top_list'"), ["section_id"]).orderBy("rank")
    top = lists.filter("section_id = 't'").collect()
    assert [r["line"] for r in lists.filter("section_id = 'n'").collect()] == ["No data"]
    assert [r["line"] for r in lists.filter("section_id = 'f'").collect()] == ["big — 1.0E40", "? — 1.5", "b — 1.5"]
    assert {r["others"] for r in rows.filter("section_id = 'f'").collect()} == {"{}", '{"foo":[1]}'}
    counts = proof.count_lines(rows.filter("type = 'top_list'"), ["section_id"]).filter("section_id <> 't'").collect()
    assert {(r["section_id"], r["line"]) for r in counts} == {("n", "No data"), ("f", "?: 1.5"), ("f", "b: 1.5"), ("f", "big: 1.0E40")}
    assert [r["line"] for r in top][:2] == ["l11 — 11", "l10 — 10"]
    assert len(top) == 11 and top[-1]["line"] == "… and 2 more"
    dates = proof.date_counts(rows.filter("type = 'date_counts'"), ["section_id"]).orderBy("rank").collect()
    assert (dates[0]["line"], dates[20]["line"], len(dates)) == ("2023-01-01: 1", "… and 5 more", 21)
    sorted_rows = proof.sort_count_desc(rows.filter("section_id = 't'"), ["section_id"]).collect()
    assert sorted_rows[0]["label"] == "l11"


def test_proof_tables(document):
    rows = proofs.proof_rows(document).filter("type = 'events'")
    got = [tuple(r) for r in proof.events_table(rows, ["pos"]).orderBy("pos").collect()]
    assert got == [(0, "771", "no", "1999-05-02"), (1, "z", "", "")]


def test_proof_texts(document):
    routed = {r["id"]: r["route"] for r in proof.route(document).collect()}
    kinds = {"t": "top_list", "e": "events", "d": "date_counts", "o": "fallback", "n": "top_list", "f": "top_list"}
    assert routed == kinds | {None: "fallback"}
    shown = proof.fallback(document.filter("type = 'odd'"), ["id"]).first()
    assert json.loads(shown["attributes"]) == {"id": "o", "title": "O", "type": "odd", "owner": {"name": "me"}, "n": 1.5}
    assert json.loads(shown["rows"].split("\n")[0]) == {"label": "x", "bar": 2}
    assert shown["rows"].count("\n") == 4
    note = document.select(
        proof.footnote(F.col("meta.source_doc"), F.col("run_id"), F.col("meta.generated_at")).alias("x"),
        proof.date_range(F.col("summary.min"), F.col("summary.max")).alias("r"),
        "id",
    ).collect()
    assert note[0]["x"] == "Source: a.xlsx • Run: 2025"
    assert {r["id"]: r["r"] for r in note}["d"] == "Range: 2023-01-01 → ?"
    assert {r["id"]: r["r"] for r in note}["t"] is None


def test_sheet_lines_across_splits(spark):
    path = scratch_path(spark, "long")
    lines = [f"line {i}" for i in range(1, 4001)]
    for name in "ab":
        spark.createDataFrame([("\n".join(lines),)], "value string").write.text(f"{path}/{name}")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        assert spark.read.text(f"{path}/*").rdd.getNumPartitions() > 4
        got = sheets.read_sheet_lines(spark, f"{path}/*").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    for file in {r["file"] for r in got}:
        mine = sorted((r["row"], r["line"]) for r in got if r["file"] == file)
        assert mine == list(enumerate(lines, start=1))
