"""Readers and writers: each query writes a table to the shared scratch folder and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartulary.operators import recipes, reports
from cartulary.plans.proofs import proof_document
from cartulary.plans.registry import query, table
from cartulary.plans.reports import FULL_ASKS, SHEET, ask, sheet
from cartulary.session import scratch_path
from cartulary.sinks import reports as report_sink
from cartulary.sinks import tables as sink
from cartulary.sources import proofs, sheets
from cartulary.sources import tables as source

SUPPLIER_SQL = """SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name,
                         CAST(s_nationkey AS VARCHAR) AS s_nationkey FROM supplier"""


def suppliers(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey")


@query(
    "src_csv",
    """SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, source, CAST(n_chars AS VARCHAR) AS n_chars
       FROM documents""",
)
def src_csv(spark, sf):
    path = scratch_path(spark, "src_csv")
    sink.write_csv(table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars"), path)
    return source.read_csv(spark, path)


@query(
    "src_csv_schema_check",
    """WITH r AS (SELECT count(*) AS n_rows, count(*) FILTER (WHERE event_type = 'view') AS n_misfits FROM events)
       SELECT 'id' AS "column", 'int' AS type, n_rows, n_misfits, n_rows AS n_filled, 2 AS found_at, false AS in_place FROM r
       UNION ALL SELECT 'name', 'string', n_rows, n_misfits, n_rows, 3, false FROM r
       UNION ALL SELECT 'age', 'int', n_rows, n_misfits, n_rows - n_misfits, 1, false FROM r
       UNION ALL SELECT 'note', 'unexpected', n_rows, n_misfits, NULL, 4, false FROM r""",
)
def src_csv_schema_check(spark, sf):
    age = F.when(F.col("event_type") == "view", "old").otherwise(F.col("user_id").cast("string"))
    people = table(spark, sf, "events").select(
        age.alias("age"), F.col("event_id").alias("id"), F.col("event_type").alias("name"), F.lit("x").alias("note")
    )
    path = scratch_path(spark, "people")
    sink.write_csv(people, path)
    return source.schema_report(spark, path, source.PEOPLE_SCHEMA)


@query(
    "src_newest_file",
    "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation",
)
def src_newest_file(spark, sf):
    folder = scratch_path(spark, "inbox")
    for name, part in (("region", ""), ("nation", ""), ("customer", "/below")):  # folders below do not count
        df = table(spark, sf, name)
        df.select(*df.columns[:3]).coalesce(1).write.mode("append").option("header", True).csv(folder + part)
    return source.read_newest_csv(spark, folder, exclude=["report_config.csv"])


@query(
    "src_text_logs",
    """SELECT event_type, props, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1, 2""",
)
def src_text_logs(spark, sf):
    line = F.concat_ws(" ", F.col("ts").cast("string"), F.upper("event_type"), F.col("props"))
    path = scratch_path(spark, "logs")
    table(spark, sf, "events").select(line.alias("value")).write.text(path)
    errors = recipes.filter_contains(source.read_log_lines(spark, path), "value", "ERROR")
    kind = F.lower(F.regexp_extract("value", "[A-Z]{3,}", 0)).alias("event_type")
    return errors.groupBy(kind, F.regexp_extract("value", r"ERROR (.*)", 1).alias("props")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "src_sectioned_report",
    SHEET
    + """SELECT section, 'Count' AS kind, label, printf('%.2f%%', round(n * 100.0 / rows, 2)) AS pct, CAST(n AS VARCHAR) AS amount,
                CAST(row_number() OVER (PARTITION BY section ORDER BY label <> 'None', label) - 1 AS BIGINT) AS line_no FROM (
           SELECT 'KIND' AS section, CASE WHEN kind = '' THEN 'None' ELSE lower(kind) END AS label,
                  count(*) AS n FROM s GROUP BY 2
           UNION ALL SELECT 'TAGS', lower(tag), count(*) FROM (SELECT unnest([tag1, tag2]) AS tag FROM s) GROUP BY 2), total
         UNION ALL SELECT 'NAME', 'Duplicate', name, '', CAST(count(*) AS VARCHAR),
                          CAST(row_number() OVER (ORDER BY count(*) DESC, name) - 1 AS BIGINT) FROM s
                   GROUP BY name HAVING count(*) > 1""",
)
def src_sectioned_report(spark, sf):
    path = scratch_path(spark, "report")
    asks = [ask("kind", aggregate=True), ask("name", duplicate=True), ask("tags", separate_nodes=True)]
    report_sink.write_sectioned_report(reports.build_report(sheet(spark, sf), asks), path)
    back = sheets.read_sectioned_report(spark, path)
    return back.select("section", "kind", "label", "pct", "amount", "line_no")


@query(
    "src_sheet_header_block",
    """SELECT CAST(n_nationkey AS VARCHAR) AS sheet, n_name AS project_name, 'R' || n_regionkey AS project_tab,
              'doc/' || n_nationkey AS link, 'AB' AS warnings_col,
              CASE WHEN n_nationkey > 12 THEN n_nationkey END AS start_row, CAST(NULL AS VARCHAR) AS last_ran_date,
              CASE WHEN n_regionkey > 1 THEN 1.5 END::DOUBLE AS last_avg_ticket_runtime, '00:10' AS last_total_runtime,
              'place ids' AS ids_type,
              CAST(10 + (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) + 1 AS BIGINT) AS last_id_row
       FROM nation""",
)
def src_sheet_header_block(spark, sf):
    """One sheet per nation, written as a file: ten rows of facts, the ids of its customers, a row that does not count."""
    text = lambda c: F.col(c).cast("string")
    facts = F.array(
        F.col("n_name"), F.concat(F.lit("R"), text("n_regionkey")), F.concat(F.lit("doc/"), text("n_nationkey")), F.lit(" ab "),
        F.when(F.col("n_nationkey") > 12, text("n_nationkey")).otherwise("x1"), F.lit(" "),
        F.when(F.col("n_regionkey") > 1, "1.5").otherwise("n/a"), F.lit("00:10"), F.lit(""), F.lit(""),
    )
    gap = "," * 21
    head = table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("sheet"),
        F.posexplode(
            F.transform(
                facts,
                lambda x, i: F.concat(F.lit("k,"), x, F.lit(gap), F.when(i == 9, "place ids").otherwise(""), F.lit(",z")),
            )
        ).alias("at", "value"),
    )
    ids = table(spark, sf, "customer").select(
        F.col("c_nationkey").alias("sheet"),
        (F.col("c_custkey") + 10).alias("at"),
        F.concat(F.lit("," + gap), text("c_custkey"), F.lit(",z")).alias("value"),
    )
    last = table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("sheet"), F.lit((1 << 62)).alias("at"), F.lit("," + gap + " ,z").alias("value")
    )
    path = scratch_path(spark, "sheets")
    rows = head.withColumn("at", F.col("at").cast("bigint")).unionByName(ids).unionByName(last)
    # A sheet is a file, so one task writes it, in its order.
    ordered = rows.repartition("sheet").sortWithinPartitions("sheet", "at")
    ordered.select("sheet", "value").write.partitionBy("sheet").text(path)
    block = sheets.read_header_block(spark, f"{path}/*")
    return block.withColumn("sheet", F.regexp_extract("file", r"/sheet=(\d+)/", 1)).drop("file")


@query(
    "src_sheet_lines",
    "SELECT CAST(doc_id AS VARCHAR) || ',' || lang AS line, source, true AS in_range FROM documents",
)
def src_sheet_lines(spark, sf):
    """Numbering lines of files must neither lose nor repeat a row number: distinct ones from 1 to the number of lines."""
    path = scratch_path(spark, "sheets")
    docs = table(spark, sf, "documents")
    docs.select(F.concat_ws(",", F.col("doc_id").cast("string"), "lang", "source").alias("value")).write.text(path)
    lines = sheets.read_sheet_lines(spark, path)
    once = lines.select("file", "row", F.split("line", ",").alias("c")).dropDuplicates(["file", "row"])
    counted = once.join(lines.groupBy("file").agg(F.count(F.lit(1)).alias("n")), "file")
    return counted.select(
        F.concat_ws(",", F.col("c")[0], F.col("c")[1]).alias("line"),
        F.col("c")[2].alias("source"),
        F.col("row").between(1, F.col("n")).alias("in_range"),
    )


@query(
    "src_proof_json",
    """WITH c AS (SELECT event_type AS kind, count(*) AS n FROM events GROUP BY 1),
            p AS (SELECT *, row_number() OVER (ORDER BY '{"label":"' || kind) - 1 AS pos FROM c),
            r AS (SELECT 'run-' || (SELECT count(*) FROM events) AS run_id),
            a AS (SELECT '{"id":"odd","owner":"team","share":1.5,"title":"Odd","type":"other"}' AS odd)
       SELECT run_id, s.id AS section_id, s.type, '{"id":"' || s.id || '","title":"' || s.title || '","type":"' || s.type || '"}' AS attributes,
              CAST(pos AS INTEGER) AS pos, kind AS label, CAST(n AS DOUBLE) AS count, CAST(n AS VARCHAR) AS count_text, '{}' AS others
       FROM r, p, (VALUES ('kinds', 'Kinds', 'category_counts'), ('top', 'Top', 'top_list')) AS s(id, title, type)
       UNION ALL
       SELECT run_id, 'odd', 'other', odd, CAST(row_number() OVER (ORDER BY '{"foo":"' || kind) - 1 AS INTEGER), NULL, n + 0.5,
              n || '.5', '{"bar":{"n":' || n || '},"foo":"' || kind || '"}' FROM r, p, a
       UNION ALL
       SELECT run_id, 'none', 'top_list', '{"id":"none","type":"top_list"}', NULL, NULL, NULL, NULL, NULL FROM r""",
)
def src_proof_json(spark, sf):
    path = scratch_path(spark, "proof")
    proof_document(spark, sf).write.text(path)
    sections = proofs.read_proof(spark, path).withColumn("attributes", proofs.fields_json(F.col("fields")))
    return proofs.proof_rows(sections).select(
        "run_id", "section_id", "type", "attributes", "pos", "label", "count", "count_text", "others"
    )


@query("sink_csv", SUPPLIER_SQL)
def sink_csv(spark, sf):
    path = scratch_path(spark, "csv")
    sink.write_csv(suppliers(spark, sf), path)
    sink.write_csv(suppliers(spark, sf), path)  # overwrites
    return source.read_csv(spark, path)


@query("sink_csv_gzip", SUPPLIER_SQL)
def sink_csv_gzip(spark, sf):
    path = scratch_path(spark, "gz")
    sink.write_csv(suppliers(spark, sf), path, compression="gzip")
    return spark.read.option("header", True).option("pathGlobFilter", "*.csv.gz").csv(path)


@query(
    "sink_csv_single",
    """SELECT event_type AS category, CAST(count(*) AS VARCHAR) AS count, 1 AS files FROM events GROUP BY 1""",
)
def sink_csv_single(spark, sf):
    path = scratch_path(spark, "single")
    counts = recipes.count_by(
        table(spark, sf, "events").select(F.col("event_type").alias("category")), ["category"]
    )
    sink.write_csv_single(counts, path)
    back = source.read_csv(spark, path)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(path)
    return back.withColumn("files", files.agg(F.count("path").cast("int").alias("n")).scalar())


@query("sink_parquet", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def sink_parquet(spark, sf):
    path = scratch_path(spark, "parquet")
    sink.write_parquet(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), path)
    return spark.read.parquet(path)


@query(
    "sink_parquet_partitioned",
    """SELECT o_orderkey, o_totalprice, CAST(year(o_orderdate) AS INTEGER) AS year,
              CAST(month(o_orderdate) AS INTEGER) AS month FROM orders""",
)
def sink_parquet_partitioned(spark, sf):
    orders = table(spark, sf, "orders").select(
        "o_orderkey", "o_totalprice", F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")
    )
    path = scratch_path(spark, "by_month")
    sink.write_partitioned(orders, path)
    return spark.read.parquet(path)


@query("sink_archive_dated", SUPPLIER_SQL)
def sink_archive_dated(spark, sf):
    return source.read_csv(spark, sink.write_archive(suppliers(spark, sf), scratch_path(spark, "root")))


@query(
    "sink_cleaned_column",
    "SELECT p_partkey, p_brand || ', x' AS brand FROM part",
)
def sink_cleaned_column(spark, sf):
    full, column = scratch_path(spark, "full"), scratch_path(spark, "column")
    parts = table(spark, sf, "part").select(
        "p_partkey", F.concat(F.lit("['"), "p_brand", F.lit("', \"x\"]")).alias("brand")
    )
    sink.write_cleaned_column(parts, "brand", full, column)
    only = source.read_csv(spark, column)
    both = spark.read.parquet(full)
    # The column alone holds the same cells as the table.
    kept = only.groupBy("brand").agg(F.count(F.lit(1)).alias("n"))
    same = both.groupBy("brand").agg(F.count(F.lit(1)).alias("n"))
    return recipes.lookup(both, kept.join(same, ["brand", "n"]).select("brand"), ["brand"], "inner")


@query(
    "sink_sectioned_report",
    SHEET
    + """, rated AS (SELECT c1, printf('%.2f%%', round(n * 100.0 / rows, 2)) AS c2, CAST(n AS VARCHAR) AS c3 FROM (
             SELECT CASE WHEN kind = '' THEN 'None' ELSE lower(kind) END AS c1, count(*) AS n FROM s GROUP BY 1
             UNION ALL SELECT lower(tag), count(*) FROM (SELECT unnest([tag1, tag2]) AS tag FROM s) GROUP BY 1
             UNION ALL SELECT 'promo', 2 * count(*) FILTER (WHERE lower(p_type) = 'promo') FROM s
             UNION ALL SELECT lower(brand), count(*) FROM s GROUP BY 1), total)
         SELECT c1, c2, c3 FROM (
           SELECT 'Total rows' AS c1, '' AS c2, '6' AS c3
           UNION ALL SELECT section, CASE kind WHEN 'Count' THEN '%' ELSE '' END, kind FROM (VALUES
             ('KIND', 'Count'), ('NAME', 'Duplicate'), ('SCORE', 'Average'), ('TAGS', 'Count'),
             ('PATH', 'Count'), ('BRAND', 'Count')) AS h(section, kind)
           UNION ALL SELECT '', '', '' FROM generate_series(1, 7)
           UNION ALL FROM rated
           UNION ALL SELECT name, '', CAST(count(*) AS VARCHAR) FROM s GROUP BY 1 HAVING count(*) > 1
           UNION ALL SELECT '', '', printf('%.2f%%', round(avg(score), 2)) FROM s)""",
)
def sink_sectioned_report(spark, sf):
    """Text of the whole report, read back line by line."""
    path = scratch_path(spark, "sections")
    report_sink.write_sectioned_report(reports.build_report(sheet(spark, sf), FULL_ASKS), path)
    lines = spark.read.text(path).select(F.from_csv("value", "c1 string, c2 string, c3 string").alias("c"))
    return lines.select(*[F.coalesce(f"c.{c}", F.lit("")).alias(c) for c in ("c1", "c2", "c3")])
