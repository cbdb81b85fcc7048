"""Column reports: `part`, `lineitem`, `orders` and `customer` play the report sheet."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartulary.operators import reports as rp
from cartulary.plans.registry import query, table

PLAIN = dict(
    value="", delimiter="|", aggregate=False, root_only=False, separate_nodes=False,
    average=False, duplicate=False, clean=False,
)


def ask(column, **options):
    return rp.Ask(column, **{**PLAIN, **options})


def sheet(spark, sf):
    """A report sheet out of `part`; column names in mixed case on purpose."""
    name, kind, size = F.col("p_name"), F.col("p_type"), F.col("p_size")
    return table(spark, sf, "part").select(
        F.concat_ws(" | ", F.split(name, " ")[0], F.split(name, " ")[1]).alias(" Tags"),
        F.when(size > 40, "").when(size > 30, None).otherwise(kind).alias("Kind "),
        F.concat(size.cast("string"), F.lit("%")).alias("Score"),
        name.alias("NAME"),
        F.concat(F.lit("['"), F.col("p_brand"), F.lit(" ', '', 'x']")).alias("Brand"),
        F.concat_ws(";", kind, F.lower(kind), F.lit(" q ")).alias("path"),
    )


SHEET = """
WITH s AS (
  SELECT split_part(p_name, ' ', 1) || ' | ' || split_part(p_name, ' ', 2) AS tags,
         CASE WHEN p_size > 30 THEN '' ELSE p_type END AS kind,
         p_size AS score, p_name AS name, p_brand || ', x' AS brand,
         split_part(p_name, ' ', 1) AS tag1, split_part(p_name, ' ', 2) AS tag2, p_type
  FROM part), total AS (SELECT count(*) AS rows FROM s)
"""
SECTION = ["section", "label", "pct", "n"]


def section(spark, sf, *asks):
    built = rp.build_report(sheet(spark, sf), list(asks))
    return built.filter("section_no > 0").select(*SECTION)


def counted(body: str) -> str:
    """Add the share to a query that yields section, label, n."""
    return SHEET + f"SELECT section, label, n, round(n * 100.0 / rows, 2) AS pct FROM ({body}), total"


@query(
    "rpt_config_parse",
    """SELECT 'brand ' || p_partkey AS "column", lower(p_type) AS value,
              CASE WHEN p_size > 25 THEN '|' ELSE ';' END AS delimiter,
              p_size > 10 AS aggregate, p_size <= 10 AS root_only, false AS separate_nodes,
              p_size > 20 AND p_size <= 30 AS average, false AS duplicate, false AS clean
       FROM part""",
)
def rpt_config_parse(spark, sf):
    size = F.col("p_size")
    config = table(spark, sf, "part").select(
        F.concat(F.lit(" brand "), F.col("p_partkey").cast("string"), F.lit(" ")).alias(" Column"),
        F.col("p_type").alias("Value"),
        F.when(size <= 25, ";").alias("delimiter"),
        F.when(size > 10, " YES ").otherwise("no").alias("Aggregate"),
        F.when(size <= 10, "True").alias("root only"),
        F.when((size > 20) & (size <= 30), "yes").otherwise("y").alias("average"),
    )
    return rp.parse_config(config)


@query(
    "rpt_clean_column",
    counted("SELECT 'BRAND' AS section, lower(brand) AS label, count(*) AS n FROM s GROUP BY 2"),
)
def rpt_clean_column(spark, sf):
    return section(spark, sf, ask("brand", clean=True, aggregate=True))


@query(
    "rpt_total",
    """SELECT 'config_rows' AS label, CAST(2 AS BIGINT) AS n
       UNION ALL SELECT 'report_rows', count(*) FROM part""",
)
def rpt_total(spark, sf):
    built = rp.build_report(sheet(spark, sf), [ask("kind", aggregate=True), ask("kind", value="promo")])
    return built.filter("section_no = 0").select("label", "n")


@query(
    "rpt_duplicates",
    SHEET + "SELECT 'NAME' AS section, name AS label, count(*) AS n FROM s GROUP BY 2 HAVING count(*) > 1",
)
def rpt_duplicates(spark, sf):
    return section(spark, sf, ask("name", duplicate=True)).drop("pct")


@query(
    "rpt_average",
    """SELECT 'DISCOUNT' AS section, round(avg(CAST(round(l_discount * 100) AS INTEGER)), 2) AS pct,
              '%' AS unit FROM lineitem
       UNION ALL SELECT 'FLAG', NULL, 'Non-digit field'""",
)
def rpt_average(spark, sf):
    lines = table(spark, sf, "lineitem").select(
        F.concat(F.round(F.col("l_discount") * 100).cast("int").cast("string"), F.lit("%")).alias("discount"),
        F.col("l_returnflag").alias("flag"),
    )
    built = rp.build_report(lines, [ask("discount", average=True), ask("flag", average=True)])
    unit = F.when(F.col("text").endswith("%"), "%").otherwise(F.col("text"))
    return built.filter("section_no > 0").select("section", "pct", unit.alias("unit"))


@query(
    "rpt_value_count",
    counted(
        """SELECT 'TAGS' AS section, w.label, count(*) FILTER (WHERE tag1 = w.label OR tag2 = w.label) AS n
           FROM s, (VALUES ('red'), ('widget'), ('no such')) AS w(label) GROUP BY 2"""
    ),
)
def rpt_value_count(spark, sf):
    asks = [ask("tags", value=x) for x in ("red", "widget", "no such")]
    return section(spark, sf, *asks)


MANY = [
    "small", "large", "red", "blue", "green", "ring", "widget", "gear", "bolt", "nut", "steel", "brass",
    "copper", "tin", "cog", "pin", "rod", "cap", "x1", "x2",
]


@query(
    "rpt_value_list",
    SHEET
    + f"""SELECT CAST(w.no + 1 AS INTEGER) AS entry_no, w.label, count(*) FILTER (WHERE tag1 = w.label OR tag2 = w.label) AS n
          FROM s, (VALUES {", ".join(f"({i}, '{x}')" for i, x in enumerate(MANY))}) AS w(no, label) GROUP BY 1, 2""",
)
def rpt_value_list(spark, sf):
    """A list of values too long to test one by one."""
    built = rp.build_report(sheet(spark, sf), [ask("tags", value=x) for x in MANY])
    return built.filter("section_no > 0").select("entry_no", "label", "n")


@query(
    "rpt_root_only",
    counted(
        """SELECT 'TAGS' AS section, w.label, count(*) FILTER (WHERE tag1 = w.label) AS n
           FROM s, (VALUES ('red'), ('widget')) AS w(label) GROUP BY 2"""
    ),
)
def rpt_root_only(spark, sf):
    asks = [ask("tags", value=x, root_only=True) for x in ("red", "widget")]
    return section(spark, sf, *asks)


@query(
    "rpt_node_value_count",
    counted(
        """SELECT 'PATH' AS section, w.label,
                  2 * count(*) FILTER (WHERE lower(p_type) = w.label)
                  + count(*) FILTER (WHERE w.label = 'q') AS n
           FROM s, (VALUES ('promo'), ('q')) AS w(label) GROUP BY 2"""
    ),
)
def rpt_node_value_count(spark, sf):
    asks = [ask("path", value=x, separate_nodes=True, delimiter=";") for x in ("promo", "q")]
    return section(spark, sf, *asks)


@query(
    "rpt_node_distribution",
    counted(
        """SELECT 'TAGS' AS section, lower(unnest([tag1, tag2])) AS label, 1 AS one FROM s""".join(
            ("SELECT section, label, count(*) AS n FROM (", ") GROUP BY 1, 2")
        )
    ),
)
def rpt_node_distribution(spark, sf):
    return section(spark, sf, ask("tags", separate_nodes=True))


@query(
    "rpt_value_distribution",
    counted(
        """SELECT 'KIND' AS section, CASE WHEN kind = '' THEN 'None' ELSE lower(kind) END AS label,
                  count(*) AS n FROM s GROUP BY 2"""
    ),
)
def rpt_value_distribution(spark, sf):
    return section(spark, sf, ask("kind", aggregate=True))


@query(
    "rpt_blank_count",
    counted("SELECT 'KIND' AS section, 'None' AS label, count(*) FILTER (WHERE kind = '') AS n FROM s"),
)
def rpt_blank_count(spark, sf):
    return section(spark, sf, ask("kind"))


@query(
    "rpt_percent",
    """SELECT lower(l_returnflag || '-' || l_linestatus) AS label, count(*) AS n,
              round(count(*) * 100.0 / (SELECT count(*) FROM lineitem), 2) AS pct
       FROM lineitem GROUP BY 1""",
)
def rpt_percent(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.concat_ws("-", "l_returnflag", "l_linestatus").alias("flags"))
    built = rp.build_report(lines, [ask("flags", aggregate=True)])
    return built.filter("section_no > 0").select("label", "n", "pct")


@query(
    "rpt_mixed_entries",
    counted(
        """SELECT 'KIND' AS section, CASE WHEN kind = '' THEN 'None' ELSE lower(kind) END AS label,
                  2 * count(*) + CASE WHEN kind = '' THEN count(*) ELSE 0 END AS n
           FROM s GROUP BY kind"""
    ),
)
def rpt_mixed_entries(spark, sf):
    """Several open config rows of one column act one after the other."""
    return section(
        spark, sf, ask("kind", separate_nodes=True), ask("kind", aggregate=True),
        ask("kind", separate_nodes=True), ask("kind"),
    )


@query(
    "join_report_config",
    SHEET
    + """SELECT section, entry_no, label, n, round(n * 100.0 / rows, 2) AS pct FROM (
           SELECT 'TAGS' AS section, 1 AS entry_no, 'red' AS label,
                  count(*) FILTER (WHERE tag1 = 'red' OR tag2 = 'red') AS n FROM s
           UNION ALL SELECT 'TAGS', 2, 'ring', count(*) FILTER (WHERE tag1 = 'ring' OR tag2 = 'ring') FROM s
           UNION ALL SELECT 'KIND', 1, 'promo', count(*) FILTER (WHERE lower(kind) = 'promo') FROM s
         ), total""",
)
def join_report_config(spark, sf):
    config = spark.createDataFrame(
        [("tags ", "red"), ("kind", "PROMO"), ("tags", "Ring")], "Column string, Value string"
    )
    built = rp.build_report(sheet(spark, sf), config)
    return built.filter("section_no > 0").select("section", "entry_no", "label", "n", "pct")


FULL_ASKS = [
    ask("kind", aggregate=True),
    ask("name", duplicate=True),
    ask("score", average=True),
    ask("tags", separate_nodes=True),
    ask("path", value="promo", separate_nodes=True, delimiter=";"),
    ask("brand", clean=True, aggregate=True),
]
FULL_SQL = (
    SHEET
    + """, counts AS (
      SELECT 1 AS section_no, 'KIND' AS section, CASE WHEN kind = '' THEN 'None' ELSE lower(kind) END AS label,
             count(*) AS n, 0 AS entry_no FROM s GROUP BY 3
      UNION ALL SELECT 4, 'TAGS', lower(tag), count(*), 0
                FROM (SELECT unnest([tag1, tag2]) AS tag FROM s) GROUP BY 3
      UNION ALL SELECT 5, 'PATH', 'promo', 2 * count(*) FILTER (WHERE lower(p_type) = 'promo'), 1 FROM s
      UNION ALL SELECT 6, 'BRAND', lower(brand), count(*), 0 FROM s GROUP BY 3)
    SELECT section_no, entry_no, section, 'Count' AS kind, label, round(n * 100.0 / rows, 2) AS pct, n
    FROM counts, total
    UNION ALL SELECT 2, 0, 'NAME', 'Duplicate', name, NULL, count(*) FROM s GROUP BY name HAVING count(*) > 1
    UNION ALL SELECT 3, 0, 'SCORE', 'Average', '', round(avg(score), 2), NULL FROM s
    UNION ALL SELECT 0, 0, 'Total rows', 'Total', 'report_rows', NULL, count(*) FROM s
    UNION ALL SELECT 0, 0, 'Total rows', 'Total', 'config_rows', NULL, 6"""
)


@query("rpt_full", FULL_SQL)
def rpt_full(spark, sf):
    return rp.build_report(sheet(spark, sf), FULL_ASKS).drop("text")


PRIORITIES = ["1-URGENT", "2-HIGH", "5-LOW", "9-NEVER"]


@query(
    "rpt_fixed_labels",
    """SELECT CAST(w.no AS INTEGER) AS label_no, w.label,
              count(*) FILTER (WHERE o_orderpriority = w.label) AS n,
              round(count(*) FILTER (WHERE o_orderpriority = w.label) * 100.0 / count(*), 2) AS pct
       FROM orders, (VALUES (1, '1-URGENT'), (2, '2-HIGH'), (3, '5-LOW'), (4, '9-NEVER')) AS w(no, label)
       GROUP BY 1, 2""",
)
def rpt_fixed_labels(spark, sf):
    return rp.label_counts(table(spark, sf, "orders"), "o_orderpriority", PRIORITIES)


@query(
    "rpt_side_by_side",
    """WITH t AS (SELECT count(*) AS rows FROM orders),
            a AS (SELECT CAST(no AS INTEGER) AS no, label, (SELECT count(*) FROM orders WHERE o_orderpriority = label) AS n
                  FROM (VALUES (1, '1-URGENT'), (2, '2-HIGH'), (3, '5-LOW'), (4, '9-NEVER')) AS w(no, label)),
            b AS (SELECT no, label, (SELECT count(*) FROM orders WHERE o_orderstatus = label) AS n
                  FROM (VALUES (1, 'F'), (2, 'O')) AS w(no, label))
       SELECT a.no AS line_no, a.label AS label_0, a.n AS n_0, round(a.n * 100.0 / rows, 2) AS pct_0,
              coalesce(b.label, '') AS label_1, b.n AS n_1, round(b.n * 100.0 / rows, 2) AS pct_1
       FROM a LEFT JOIN b USING (no), t""",
)
def rpt_side_by_side(spark, sf):
    lists = [("o_orderpriority", PRIORITIES), ("o_orderstatus", ["F", "O"])]
    return rp.side_by_side(table(spark, sf, "orders"), lists)


def tickets(spark, sf):
    """A ticket sheet out of `lineitem`, with the column names of the fixed report."""
    pick = lambda labels, n: F.element_at(
        F.array(*map(F.lit, labels)), (n % len(labels) + 1).cast("int")
    )
    key = F.col("l_partkey")
    number = F.col("l_linenumber")
    columns = {
        "Ticket type": pick(rp.TICKET_TYPES, number),
        "Last Editor Resolution": pick(rp.LAST_EDITOR_RESOLUTIONS, key),
        "L1 Resolution": pick(rp.LEVEL_RESOLUTIONS, number),
        "L2 Resolution": F.when(F.col("l_returnflag") == "R", "Rejected").otherwise("Open"),
    }
    columns.update({c: pick(rp.SUGGESTED_FIELDS, key + i) for i, c in enumerate(rp.FIELD_COLUMNS)})
    columns.update({c: pick(rp.YES_NO, number + i) for i, c in enumerate(rp.QUESTION_COLUMNS)})
    return table(spark, sf, "lineitem").select(*(e.alias(c) for c, e in columns.items()))


def _values(labels):
    return ", ".join(f"({i}, '{x}')" for i, x in enumerate(labels))


def _matrix_sql(labels, base, n_columns):
    """Counts of label number ``(base + column) % size`` in each column."""
    size = len(labels)
    cells = ", ".join(
        f"count(*) FILTER (WHERE ({base} + {i}) % {size} = w.no) AS n_{i}, "
        f"round(count(*) FILTER (WHERE ({base} + {i}) % {size} = w.no) * 100.0 / count(*), 2) AS pct_{i}"
        for i in range(n_columns)
    )
    return (
        f"SELECT CAST(w.no + 1 AS INTEGER) AS label_no, w.label, {cells} FROM lineitem,"
        f" (VALUES {_values(labels)}) AS w(no, label) GROUP BY 1, 2"
    )


@query("rpt_field_triplet", _matrix_sql(rp.SUGGESTED_FIELDS, "l_partkey", 3))
def rpt_field_triplet(spark, sf):
    return rp.ticket_report(tickets(spark, sf))["fields"]


@query("rpt_yes_no_matrix", _matrix_sql(rp.YES_NO, "l_linenumber", 5))
def rpt_yes_no_matrix(spark, sf):
    return rp.ticket_report(tickets(spark, sf))["questions"]
