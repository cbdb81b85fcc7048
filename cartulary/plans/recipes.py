"""Table steps, joins and group-bys."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartulary.functions import headers
from cartulary.functions.text import fill_blank
from cartulary.operators import recipes as r
from cartulary.plans.registry import query, table


@query("view_sql", "SELECT event_id, event_type, value FROM events WHERE value > 100")
def view_sql(spark, sf):
    table(spark, sf, "events").select("event_id", "event_type", "value").createOrReplaceTempView(
        "data_view"
    )
    return spark.sql("SELECT * FROM data_view WHERE value > 100")


@query(
    "hdr_normalize",
    "SELECT s_suppkey AS supplier_key, s_name AS supplier_name, s_acctbal AS account_balance"
    " FROM supplier",
)
def hdr_normalize(spark, sf):
    raw = table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    return headers.normalize_headers(
        raw.toDF("\ufeffSupplier Key ", " Supplier Name", "ACCOUNT balance"), "snake"
    )


@query("col_resolve", "SELECT c_custkey AS a, c_name AS b, c_mktsegment AS c FROM customer")
def col_resolve(spark, sf):
    df = table(spark, sf, "customer").withColumnRenamed("c_name", "Customer  Name")
    found = [headers.resolve_column(df, w) for w in ("c_custkey", " customer name", "5")]
    return df.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(found, "abc")))


@query("col_letter_range", "SELECT l_partkey, l_suppkey, l_linenumber, l_returnflag FROM lineitem")
def col_letter_range(spark, sf):
    return headers.select_letters(table(spark, sf, "lineitem"), ["b-d, I"])


@query("with_constant", "SELECT o_orderkey, 'value' AS new_column FROM orders")
def with_constant(spark, sf):
    return r.with_constant(table(spark, sf, "orders").select("o_orderkey"), "new_column", "value")


@query(
    "filter_date_range",
    "SELECT o_orderkey, o_totalprice FROM orders"
    " WHERE o_orderdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-12-31'",
)
def filter_date_range(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    return r.filter_date_range(orders, "o_orderdate", "1997-01-01", "1997-12-31").drop("o_orderdate")


@query("filter_contains", "SELECT doc_id, n_chars FROM documents WHERE contains(text, 'the')")
def filter_contains(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "n_chars", "text")
    return r.filter_contains(docs, "text", "the").drop("text")


@query(
    "filter_missing_id",
    "SELECT o_orderpriority AS raw_tail, CAST(o_orderkey AS VARCHAR) AS place_id FROM orders"
    " WHERE o_orderstatus <> 'P'",
)
def filter_missing_id(spark, sf):
    dirty = F.when(F.col("o_orderstatus") == "P", "n/a").otherwise(
        F.concat(F.lit("&lt;br&gt;"), F.col("o_orderkey").cast("string"), F.lit(" x"))
    )
    orders = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("raw_tail"), dirty.alias("raw"))
    return r.filter_missing_id(orders, "raw").drop("raw")


@query(
    "filter_contested_field",
    "SELECT event_id FROM events WHERE event_type = 'error' OR event_type = 'view'",
)
def filter_contested_field(spark, sf):
    kind = F.col("event_type")
    e = table(spark, sf, "events").select(
        "event_id",
        F.when(kind == "error", " Hours ").when(kind == "click", "Show In Client").alias("Contested Field"),
        F.when(kind == "view", "HOURS").otherwise("Show In Client").alias("Contested Field Column"),
    )
    return r.filter_contested_field(e, "Contested Field", "Contested Field Column").select("event_id")


@query(
    "map_mode",
    """SELECT event_id,
              CASE WHEN event_type = 'error' THEN 'hours_period' ELSE 'presence_period' END AS filter_key,
              CASE WHEN event_type = 'error' THEN 'Hours' ELSE 'Show In Client' END AS panel_label,
              CASE WHEN event_type = 'error' THEN 'hours_period'
                   WHEN event_type = 'view' THEN 'presence_period' ELSE '' END AS option_key
       FROM events""",
)
def map_mode(spark, sf):
    kind = F.col("event_type")
    field = F.when(kind == "error", " HOURS").when(kind == "click", "x")
    option = F.when(kind == "error", "Hours").when(kind == "view", "show ").otherwise("all")
    e = table(spark, sf, "events").select(
        "event_id", r.map_mode(field).alias("m"), F.coalesce(r.field_option(option), F.lit("")).alias("option_key")
    )
    return e.select("event_id", "m.*", "option_key")


@query(
    "fill_nulls",
    """SELECT event_id,
              CASE WHEN event_type = 'click' THEN 0 ELSE CAST(user_id AS INTEGER) END AS age,
              CASE WHEN event_type = 'view' THEN 'Unknown' ELSE event_type END AS name
       FROM events""",
)
def fill_nulls(spark, sf):
    kind = F.col("event_type")
    e = table(spark, sf, "events").select(
        "event_id",
        F.when(kind != "click", F.col("user_id").cast("int")).alias("age"),
        F.when(kind != "view", kind).alias("name"),
    )
    return r.fill_nulls(e, {"age": 0, "name": "Unknown"})


@query(
    "fill_blank_string",
    "SELECT event_id, CASE WHEN event_type = 'view' THEN '' ELSE CAST(user_id AS VARCHAR) END AS cell"
    " FROM events",
)
def fill_blank_string(spark, sf):
    cell = F.when(F.col("event_type") != "view", F.col("user_id"))
    return table(spark, sf, "events").select("event_id", fill_blank(cell).alias("cell"))


@query(
    "fixed_output_blank_on_error",
    """SELECT o.o_orderkey, o.o_custkey,
              coalesce(CAST(c.c_name AS VARCHAR), '') AS c_name,
              coalesce(c.c_mktsegment, '') AS c_mktsegment
       FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey AND c.c_acctbal > 0""",
)
def fixed_output(spark, sf):
    ids = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    known = table(spark, sf, "customer").filter("c_acctbal > 0").withColumnRenamed("c_custkey", "o_custkey")
    return r.fixed_output(ids, known, "o_custkey", ["c_name", "c_mktsegment"])


@query(
    "join_inner",
    """SELECT l_orderkey, l_linenumber, o_orderpriority, l_quantity
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)
def join_inner(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    return r.join_inner(lines, orders, ["l_orderkey"], right_unique=True)


@query(
    "agg_sum_by",
    """SELECT l_returnflag AS category, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total
       FROM lineitem GROUP BY 1""",
)
def agg_sum_by(spark, sf):
    lines = table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("category"), F.col("l_extendedprice").cast("decimal(18,2)").alias("value")
    )
    return r.sum_by(lines, ["category"], "value").withColumn("total", F.col("total").cast("double"))


@query("agg_count_by", "SELECT event_type AS category, count(*) AS count FROM events GROUP BY 1")
def agg_count_by(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("category"))
    return r.count_by(e, ["category"])


@query(
    "agg_duplicate_names",
    "SELECT p_name AS filename, count(*) AS count FROM part GROUP BY 1 HAVING count(*) > 1",
)
def agg_duplicate_names(spark, sf):
    return r.duplicate_names(table(spark, sf, "part").select(F.col("p_name").alias("filename")), "filename")


@query("distinct_rows", "SELECT DISTINCT l_suppkey, l_returnflag, l_linestatus FROM lineitem")
def distinct_rows(spark, sf):
    return r.distinct_rows(table(spark, sf, "lineitem").select("l_suppkey", "l_returnflag", "l_linestatus"))


@query(
    "dq_null_alert",
    """SELECT 'quality' AS "column", count(*) FILTER (WHERE quality IS NULL) AS n_null,
              count(*) FILTER (WHERE quality IS NULL) > 0 AS alert
       FROM documents LEFT JOIN labels USING (doc_id)
       UNION ALL
       SELECT 'text', count(*) FILTER (WHERE text IS NULL), count(*) FILTER (WHERE text IS NULL) > 0
       FROM documents""",
)
def dq_null_alert(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    labelled = r.lookup(docs, table(spark, sf, "labels").select("doc_id", "quality"), ["doc_id"])
    return r.null_counts(labelled, ["quality", "text"])


@query(
    "corr_pairs",
    """SELECT 'l_quantity' AS first, 'l_extendedprice' AS second,
              round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem
       UNION ALL
       SELECT 'l_discount', 'l_tax', round(corr(l_discount, l_tax), 6) FROM lineitem""",
)
def corr_pairs(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    pairs = [("l_quantity", "l_extendedprice"), ("l_discount", "l_tax")]
    return r.pair_correlations(lines, pairs).withColumn("r", F.round("r", 6))


@query(
    "win_running_mean",
    """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date,
              round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER w AS DOUBLE) / count(*) OVER w, 4)
                AS moving_avg
       FROM orders WINDOW w AS (ORDER BY CAST(o_orderdate AS DATE))""",
)
def win_running_mean(spark, sf):
    orders = table(spark, sf, "orders").select(
        "o_orderkey",
        F.to_date("o_orderdate").alias("date"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("value"),
    )
    out = r.running_mean(orders, "date", "value").drop("value")
    return out.withColumn("moving_avg", F.round("moving_avg", 4))


@query(
    "win_running_mean_by",
    """SELECT l_orderkey, l_linenumber, l_returnflag, CAST(l_shipdate AS DATE) AS date,
              round(CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) OVER w AS DOUBLE) / count(*) OVER w, 4)
                AS moving_avg
       FROM lineitem WINDOW w AS (PARTITION BY l_returnflag ORDER BY CAST(l_shipdate AS DATE))""",
)
def win_running_mean_by(spark, sf):
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_returnflag",
        F.to_date("l_shipdate").alias("date"),
        F.col("l_quantity").cast("decimal(18,2)").alias("value"),
    )
    out = r.running_mean(lines, "date", "value", by=["l_returnflag"]).drop("value")
    return out.withColumn("moving_avg", F.round("moving_avg", 4))


@query(
    "set_union_all",
    """SELECT c_custkey AS id, c_name AS name FROM customer
       UNION ALL SELECT s_suppkey, s_name FROM supplier
       UNION ALL SELECT s_suppkey, s_name FROM supplier""",
)
def set_union_all(spark, sf):
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    suppliers = table(spark, sf, "supplier").select("s_suppkey", "s_name")
    return r.union_all(r.union_all(customers, suppliers), suppliers)
