"""Proof documents: counts over `events` and `part` play the sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartulary.operators import proof
from cartulary.operators.recipes import count_by
from cartulary.plans.registry import query, table
from cartulary.session import scratch_path
from cartulary.sources.proofs import proof_rows, read_proof


def proof_document(spark, sf):
    """One proof document: event counts, lists of them with fields nobody asked for, and a section without rows.

    Its data rows are counts per event type, a handful.
    """
    events = table(spark, sf, "events")
    counts = count_by(events, ["event_type"])
    plain = F.struct(F.col("event_type").alias("label"), F.col("count").alias("count"))
    odd = F.struct(
        F.col("event_type").alias("foo"),
        (F.col("count") + 0.5).alias("count"),
        F.struct(F.col("count").alias("n"), F.lit(None).cast("string").alias("gone")).alias("bar"),
    )
    one = counts.agg(
        F.sum("count").alias("total"),
        F.array_join(F.sort_array(F.collect_list(F.to_json(plain))), ",").alias("plain"),
        F.array_join(F.sort_array(F.collect_list(F.to_json(odd))), ",").alias("odd"),
    )
    text = F.format_string(
        '{"run_id": "run-%d", "meta": {"source_doc": "events", "generated_at": "2024-02-01"},\n "sections": [\n'
        '{"id": "kinds", "title": "Kinds", "type": "category_counts", "data": [%s]},\n'
        '{"id": "top", "title": "Top", "type": "top_list", "data": [%s]},\n'
        '{"id": "odd", "title": "Odd", "type": "other", "owner": "team", "share": 1.50, "data": [%s]},\n'
        '{"id": "none", "type": "top_list", "data": []}]}',
        "total",
        "plain",
        "plain",
        "odd",
    )
    return one.select(text.alias("value"))


def top_rows(spark, sf):
    """Counts of part names per brand: one list per brand, ties in order of the name."""
    counts = count_by(table(spark, sf, "part"), ["p_brand", "p_name"])
    return counts.select("p_brand", F.col("p_name").alias("label"), F.col("p_name").alias("pos"), "count")


@query(
    "topk_with_rest",
    """WITH c AS (SELECT p_brand, p_name, count(*) AS n FROM part GROUP BY 1, 2),
            r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_name) AS rank FROM c)
       SELECT p_brand, CAST(rank AS INTEGER) AS rank, p_name || ' — ' || n AS line FROM r WHERE rank <= 10
       UNION ALL SELECT p_brand, 11, '… and ' || (count(*) - 10) || ' more' FROM c GROUP BY 1 HAVING count(*) > 10""",
)
def topk_with_rest(spark, sf):
    return proof.top_list(top_rows(spark, sf), ["p_brand"])


@query(
    "sort_count_desc",
    """SELECT p_brand, coalesce(label, '?') AS label, count FROM (
         SELECT p_brand, CASE WHEN p_size <= 25 THEN p_type END AS label,
                CASE WHEN p_size <= 25 THEN count(*) ELSE 0 END AS count
         FROM part GROUP BY p_brand, p_type, p_size) ORDER BY p_brand, count DESC""",
)
def sort_count_desc(spark, sf):
    counts = count_by(table(spark, sf, "part"), ["p_brand", "p_type", "p_size"])
    known = F.col("p_size") <= 25
    rows = counts.select(
        "p_brand",
        F.when(known, F.col("p_type")).alias("label"),
        F.when(known, F.col("count")).alias("count"),
        F.concat_ws("/", "p_type", F.col("p_size").cast("string")).alias("pos"),
    )
    return proof.sort_count_desc(rows, ["p_brand"]).drop("pos")


@query(
    "limit_first_n_with_rest",
    """WITH d AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2),
            r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day) AS rank FROM d),
            s AS (SELECT event_type, min(day) AS lo, max(day) AS hi, count(*) AS k FROM d GROUP BY 1)
       SELECT event_type, CAST(rank AS INTEGER) AS rank, day || ': ' || n AS line FROM r WHERE rank <= 20
       UNION ALL SELECT event_type, 21, '… and ' || (k - 20) || ' more' FROM s WHERE k > 20
       UNION ALL SELECT event_type, 0, 'Range: ' || CASE WHEN event_type = 'view' THEN '?' ELSE CAST(lo AS VARCHAR) END
                        || ' → ' || hi FROM s""",
)
def limit_first_n_with_rest(spark, sf):
    day = F.to_date("ts").cast("string")
    days = table(spark, sf, "events").groupBy("event_type", day.alias("date")).agg(
        F.count(F.lit(1)).alias("value")
    )
    lines = proof.date_counts(days, ["event_type"], pos="date")
    low = F.when(F.col("event_type") != "view", F.min("date"))
    ranges = days.groupBy("event_type").agg(proof.date_range(low, F.max("date")).alias("line"))
    return lines.unionByName(ranges.select("event_type", F.lit(0).alias("rank"), "line"))


@query(
    "events_table",
    """SELECT event_id, CASE WHEN event_type = 'view' THEN '' WHEN event_type = 'click' THEN 'i' || event_id
                             ELSE CAST(user_id AS VARCHAR) END AS id,
              CASE WHEN event_type = 'error' THEN 'yes' ELSE '' END AS flag,
              CAST(CAST(ts AS DATE) AS VARCHAR) AS date FROM events""",
)
def events_table(spark, sf):
    kind = F.col("event_type")
    rows = table(spark, sf, "events").select(
        "event_id",
        F.when(~kind.isin("view", "click"), F.col("user_id").cast("string")).alias("entity_id"),
        F.when(kind != "view", F.concat(F.lit("i"), F.col("event_id").cast("string"))).alias("id"),
        F.when(kind == "error", "yes").alias("flag"),
        F.to_date("ts").cast("string").alias("date"),
    )
    return proof.events_table(rows, ["event_id"])


def sections(spark, sf):
    """One proof document per order with one small section: its status names the type, its clerk is an attribute
    nobody asked for. Written as a line of JSON each and read back."""
    status = F.col("o_orderstatus")
    kind = F.when(status == "F", "top_list").when(status == "O", "events").otherwise("odd")
    row = F.struct(F.col("o_orderpriority").alias("label"), F.col("o_custkey").alias("count"), status.alias("foo"))
    section = F.struct(
        F.col("o_orderkey").cast("string").alias("id"),
        F.col("o_orderpriority").alias("title"),
        kind.alias("type"),
        (F.col("o_custkey") + 0.5).alias("limit"),
        F.col("o_custkey").alias("owner"),
        F.array_repeat(row, (F.col("o_custkey") % 8).cast("int")).alias("data"),
    )
    path = scratch_path(spark, "proofs")
    docs = table(spark, sf, "orders").select(F.to_json(F.struct(F.array(section).alias("sections"))).alias("value"))
    docs.write.text(path)
    return read_proof(spark, path, one_per_line=True)


@query(
    "section_route",
    """SELECT CAST(o_orderkey AS VARCHAR) AS id,
              CASE o_orderstatus WHEN 'F' THEN 'top_list' WHEN 'O' THEN 'events' ELSE 'fallback' END AS route
       FROM orders""",
)
def section_route(spark, sf):
    return proof.route(sections(spark, sf)).select("id", "route")


@query(
    "section_fallback",
    """SELECT o_orderkey AS key,
              '{"id":"' || o_orderkey || '","limit":' || o_custkey || '.5,"owner":' || o_custkey || ',"title":"'
                || o_orderpriority || '","type":"odd"}' AS attributes,
              array_to_string(list_transform(generate_series(1, least(o_custkey % 8, 5)),
                lambda i: '{"count":' || o_custkey || ',"foo":"' || o_orderstatus || '","label":"' || o_orderpriority
                  || '"}'), chr(10)) AS rows
       FROM orders WHERE o_orderstatus NOT IN ('F', 'O')""",
)
def section_fallback(spark, sf):
    odd = proof.route(sections(spark, sf)).filter("route = 'fallback'")
    shown = proof.fallback(odd, ["id"])
    return shown.select(F.col("id").cast("bigint").alias("key"), "attributes", "rows")


@query(
    "proof_top_lists",
    """SELECT CAST(o_orderkey AS VARCHAR) AS section_id, CAST(i AS INTEGER) AS rank,
              CASE WHEN o_custkey % 8 = 0 THEN 'No data' ELSE o_orderpriority || ' — ' || o_custkey END AS line
       FROM orders, generate_series(1, 8) AS g(i)
       WHERE o_orderstatus = 'F' AND i <= greatest(o_custkey % 8, 1)""",
)
def proof_top_lists(spark, sf):
    """The lists of all documents, one of eight without rows."""
    lists = proof_rows(sections(spark, sf).filter("type = 'top_list'"))
    return proof.top_list(lists, ["section_id"])


@query(
    "footnote",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Source: ' || o_orderpriority || ' • Run: ' || o_custkey
                          WHEN 'O' THEN 'Run: ' || o_custkey ELSE 'Run: gen ' || o_custkey END AS footnote
       FROM orders""",
)
def footnote(spark, sf):
    status, customer = F.col("o_orderstatus"), F.col("o_custkey").cast("string")
    source = F.when(status == "F", F.col("o_orderpriority")).when(status == "O", "")
    run = F.when(status.isin("F", "O"), customer).otherwise("")
    made = F.concat(F.lit("gen "), customer)
    return table(spark, sf, "orders").select("o_orderkey", proof.footnote(source, run, made).alias("footnote"))
