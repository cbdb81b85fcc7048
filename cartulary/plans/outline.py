"""Section jobs: real pages and documents for the outline, supplier rows for numeric sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartulary.operators import blocks as bl
from cartulary.operators import outline as ol
from cartulary.plans.pages import _cat, block_sql
from cartulary.plans.registry import query, table


def note_pages(spark, sf):
    """Every document with headings around its text: two sections and a lead."""
    html = _cat(
        "<p>Lead note</p><h3>Part ", F.col("lang"), "</h3><p>", F.col("text"), "</p><h2>Title ", F.col("doc_id"),
        "</h2><ul><li>", F.col("source"), " - ", F.col("n_chars"), "</li></ul><h2>Rest</h2><p>",
        F.substring_index("text", "\n", 1), "</p>",
    )
    return table(spark, sf, "documents", dealt=True).select(F.col("doc_id").alias("page_id"), html.alias("html"))


NOTE_SQL = """(SELECT doc_id AS page_id, '<p>Lead note</p><h3>Part ' || lang || '</h3><p>' || text || '</p><h2>Title '
  || doc_id || '</h2><ul><li>' || source || ' - ' || n_chars || '</li></ul><h2>Rest</h2><p>'
  || split_part(text, chr(10), 1) || '</p>' AS html FROM documents)"""

SECTION_CTES = """, title AS (
  SELECT page_id, min(block_no) FILTER (WHERE type = 'heading' AND level <= 2) AS no FROM blocks GROUP BY 1),
sections AS (
  SELECT b.*, sum(CASE WHEN type = 'heading' THEN 1 ELSE 0 END)
                OVER (PARTITION BY b.page_id ORDER BY block_no, sub) AS section_no
  FROM blocks b JOIN title t USING (page_id) WHERE type <> 'heading' OR t.no IS NULL OR b.block_no <> t.no)
"""
_TRIMMED = "regexp_replace(regexp_replace({x}, '^[\\s\\x{{00a0}}]+', ''), '[\\s\\x{{00a0}}]+$', '')"
_BARS = "'\\s*\\n+|\\s*•\\s*|\\s*;\\s*|\\s*\\|\\s*'"
LINE_CTES = (
    SECTION_CTES
    + f""", pieces AS (
  SELECT page_id, section_no, block_no, sub, CASE WHEN type = 'list' THEN 'item' ELSE 'paragraph' END AS source,
         CASE WHEN type = 'list' THEN items
              WHEN regexp_matches(text, '(?i)^\\s*total\\s+sample\\s*:\\s*\\d+\\s*$') THEN [text]
              ELSE regexp_split_to_array(text, {_BARS}) END AS parts
  FROM sections WHERE type IN ('list', 'paragraph')),
numbered AS (
  SELECT page_id, section_no, block_no, sub, source, unnest(generate_series(1, len(parts))) - 1 AS line_no,
         unnest(parts) AS part FROM pieces),
lines AS (SELECT page_id, CAST(section_no AS BIGINT) AS section_no, block_no, sub, source, CAST(line_no AS INTEGER) AS line_no,
                 {_TRIMMED.format(x='part')} AS line FROM numbered),
classed AS (
  SELECT *, CASE WHEN source = 'paragraph' AND regexp_matches(line, '(?i)^\\s*total\\s+sample\\s*:\\s*\\d+\\s*$') THEN 'total'
    WHEN regexp_matches(line, '(?i)^\\s*(\\[chart=(bar|pie|line|column)\\]|:::\\s*chart\\s*=\\s*(bar|pie|line|column)|\\((bar|pie|line|column)\\))\\s*$') THEN 'chart'
    WHEN regexp_matches(line, '(?i)^\\s*(\\[split\\]|:::\\s*split\\s*=\\s*(yes|true|1))\\s*$') THEN 'split'
    WHEN regexp_matches(line, '^\\s*[^\\-:\\t]+\\s*[-:]\\s*[+-]?\\d+(\\.\\d+)?\\s*$')
      OR regexp_matches(line, '^\\s*[^\\t]+\\t[+-]?\\d+(\\.\\d+)?\\s*$') THEN 'number'
    WHEN regexp_matches(line, '^\\s*[^\\-:\\t]+\\s*[-:]\\s*.+?\\s*$') OR regexp_matches(line, '^\\s*[^\\t]+\\t.+?\\s*$') THEN 'pair'
    WHEN regexp_matches(line, '^[A-Za-z0-9].{{0,40}}$') THEN 'label' ELSE 'text' END AS class
  FROM lines WHERE line <> '')
"""
)


def note_lines(spark, sf):
    return ol.classified_lines(ol.assign_sections(bl.extract_blocks(note_pages(spark, sf))))


@query(
    "sec_deck_title",
    block_sql("pages")
    + """SELECT page_id, coalesce(min_by(text, block_no) FILTER (WHERE type = 'heading' AND level <= 2), 'Deck') AS title
         FROM blocks GROUP BY 1""",
)
def sec_deck_title(spark, sf):
    return ol.deck_titles(bl.extract_blocks(table(spark, sf, "pages", dealt=True)))


@query(
    "sec_assign",
    block_sql(NOTE_SQL)
    + SECTION_CTES
    + "SELECT page_id, CAST(section_no AS BIGINT) AS section_no, block_no, type, text FROM sections",
)
def sec_assign(spark, sf):
    sections = ol.assign_sections(bl.extract_blocks(note_pages(spark, sf)))
    return sections.filter("section_no >= 0").select("page_id", "section_no", "block_no", "type", "text")


@query(
    "sec_pseudo_lines",
    block_sql(NOTE_SQL) + LINE_CTES + "SELECT page_id, section_no, block_no, source, line FROM classed",
)
def sec_pseudo_lines(spark, sf):
    sections = ol.assign_sections(bl.extract_blocks(note_pages(spark, sf)))
    return ol.pseudo_lines(sections).drop("sub", "line_no", "page_row")


@query(
    "sec_line_class",
    block_sql("pages") + LINE_CTES + "SELECT page_id, section_no, block_no, class FROM classed",
)
def sec_line_class(spark, sf):
    lines = ol.classified_lines(ol.assign_sections(bl.extract_blocks(table(spark, sf, "pages", dealt=True))))
    texts = lines.filter("class not in ('heading', 'image')")
    return texts.select("page_id", "section_no", "block_no", "class")


# One survey page per supplier: figures in groups, chart wishes, free text.
def survey_pages(spark, sf):
    key, nation, balance = F.col("s_suppkey"), F.col("s_nationkey"), F.col("s_acctbal")
    cents = balance.cast("decimal(12,2)")
    html = _cat(
        "<h1>", F.col("s_name"), "</h1><h2>Figures</h2><p>Total sample : ", key, "</p><p>Ticket source</p>",
        "<ul><li>store - ", nation, "</li><li>Zone: North ", nation, "</li></ul>",
        "<p>web\t86; [Chart=", F.when(nation > 12, "Bar").otherwise("line"), "] | note; Channel • phone: ", cents, "</p>",
        "<h3>Second</h3><ul><li>a - 1</li><li>b: 2.50</li><li>Total sample: ", key, "</li></ul>",
        F.when(nation > 18, "<p>[split]</p>"), F.when(nation < 6, "<p>(pie)</p><p>::: chart = column</p>"),
        "<p>", F.repeat(F.concat(F.lit("long text "), F.col("s_name"), F.lit(" ")), F.lit(3)), "</p>",
        "<h2>Third</h2><p>only - 7</p><img src='a", key, ".png' alt='x'><img src=' '><p>x<img src='b.png'></p><h2></h2>",
    )
    return table(spark, sf, "supplier").select(key.alias("page_id"), html.alias("html"))


def survey_lines(spark, sf):
    return ol.classified_lines(ol.assign_sections(bl.extract_blocks(survey_pages(spark, sf))))


BALANCE = "CAST(CAST(s_acctbal AS DECIMAL(12,2)) AS DOUBLE)"
POINTS = f"""
WITH p AS (
  SELECT s_suppkey AS page_id, 1 AS section_no, 1 AS n, 'store' AS label, CAST(s_nationkey AS DOUBLE) AS value,
         'Ticket source' AS group_name, s_nationkey, s_name FROM supplier
  UNION ALL SELECT s_suppkey, 1, 2, 'web', 86.0, 'Ticket source', s_nationkey, s_name FROM supplier
  UNION ALL SELECT s_suppkey, 1, 3, 'phone', {BALANCE}, 'Channel', s_nationkey, s_name FROM supplier
  UNION ALL SELECT s_suppkey, 2, 1, 'a', 1.0, 'Group 1', s_nationkey, s_name FROM supplier
  UNION ALL SELECT s_suppkey, 2, 2, 'b', 2.5, 'Group 1', s_nationkey, s_name FROM supplier
  UNION ALL SELECT s_suppkey, 2, 3, 'Total sample', CAST(s_suppkey AS DOUBLE), 'Group 1', s_nationkey, s_name FROM supplier
  UNION ALL SELECT s_suppkey, 3, 1, 'only', 7.0, 'Group 1', s_nationkey, s_name FROM supplier),
c AS (
  SELECT *, CASE WHEN section_no = 1 THEN CASE WHEN s_nationkey > 12 THEN 'bar' ELSE 'line' END
                 WHEN section_no = 2 THEN CASE WHEN s_nationkey < 6 THEN 'column' ELSE 'pie' END
                 ELSE 'bar' END AS chart_type,
         CASE WHEN section_no = 1 OR (section_no = 2 AND s_nationkey > 18) THEN group_name ELSE 'all' END AS chart_group,
         CASE WHEN section_no = 1 AND n = 3 THEN 2 ELSE 1 END AS chart_no FROM p)
"""


@query("sec_kv_numeric", POINTS + "SELECT page_id, CAST(section_no AS BIGINT) AS section_no, label, value FROM p")
def sec_kv_numeric(spark, sf):
    lines = survey_lines(spark, sf).filter("class = 'number'")
    return lines.select("page_id", "section_no", "label", "value")


@query(
    "sec_kv_text",
    "SELECT s_suppkey AS page_id, 'Zone: North ' || s_nationkey AS bullet FROM supplier",
)
def sec_kv_text(spark, sf):
    return survey_lines(spark, sf).filter("class = 'pair'").select("page_id", "bullet")


@query(
    "sec_group",
    POINTS + "SELECT page_id, CAST(section_no AS BIGINT) AS section_no, label, group_name FROM p",
)
def sec_group(spark, sf):
    lines = survey_lines(spark, sf).filter("class = 'number'")
    return lines.select("page_id", "section_no", "label", "group_name")


_NUMBER = """CASE WHEN value = floor(value) THEN CAST(CAST(value AS BIGINT) AS VARCHAR)
  ELSE rtrim(CAST(CAST(value AS DECIMAL(18,6)) AS VARCHAR), '0') END"""


@query(
    "sec_bullets",
    POINTS
    + f"""SELECT page_id, CAST(section_no AS BIGINT) AS section_no, label || ': ' || {_NUMBER} AS bullet FROM p
          UNION ALL SELECT s_suppkey, 1, 'Zone: North ' || s_nationkey FROM supplier""",
)
def sec_bullets(spark, sf):
    lines = survey_lines(spark, sf).filter("bullet is not null")
    return lines.select("page_id", "section_no", "bullet")


@query(
    "sec_subtitle",
    "SELECT s_suppkey AS page_id, CAST(1 AS BIGINT) AS section_no, 'Total sample: ' || s_suppkey AS subtitle FROM supplier",
)
def sec_subtitle(spark, sf):
    plan = ol.section_plan(bl.extract_blocks(survey_pages(spark, sf)))
    return plan.filter("subtitle is not null").select("page_id", "section_no", "subtitle")


@query(
    "sec_chart_choice",
    POINTS
    + """SELECT DISTINCT page_id, CAST(section_no AS BIGINT) AS section_no, chart_no, chart_type FROM (
           SELECT *, count(*) OVER (PARTITION BY page_id, section_no, chart_group) AS k FROM c)""",
)
def sec_chart_choice(spark, sf):
    charts = ol.section_charts(survey_lines(spark, sf))
    return charts.select("page_id", "section_no", "chart_no", "chart_type").distinct()


@query(
    "sec_chart_split",
    POINTS + "SELECT page_id, CAST(section_no AS BIGINT) AS section_no, chart_no, chart_group, label, value FROM c",
)
def sec_chart_split(spark, sf):
    charts = ol.section_charts(survey_lines(spark, sf))
    return charts.select("page_id", "section_no", "chart_no", "chart_group", "label", "value")


@query(
    "sec_share",
    POINTS
    + """SELECT page_id, CAST(section_no AS BIGINT) AS section_no, label,
                round(CASE WHEN total > 0 THEN value / total END, 6) AS share
         FROM (SELECT *, sum(value) OVER (PARTITION BY page_id, section_no, chart_group) AS total FROM c)""",
)
def sec_share(spark, sf):
    charts = ol.section_charts(survey_lines(spark, sf))
    return charts.select("page_id", "section_no", "label", F.round("share", 6).alias("share"))


@query(
    "sec_images",
    """SELECT s_suppkey AS page_id, CAST(3 AS BIGINT) AS section_no, 'a' || s_suppkey || '.png b.png' AS paths,
              'b.png' AS image FROM supplier""",
)
def sec_images(spark, sf):
    images = ol.section_images(survey_lines(spark, sf))
    return images.select(
        "page_id", "section_no", F.array_join("images.path", " ").alias("paths"), F.col("image.path").alias("image")
    )


@query(
    "sec_plan",
    POINTS
    + f"""SELECT page_id, section_no, layout, title, subtitle, bullets, paragraphs, charts, images FROM (
      SELECT page_id, CAST(section_no AS BIGINT) AS section_no, 'content' AS layout,
             CASE section_no WHEN 1 THEN 'Figures' WHEN 2 THEN 'Second' ELSE 'Third' END AS title,
             CASE WHEN section_no = 1 THEN 'Total sample: ' || page_id END AS subtitle,
             string_agg(CASE WHEN section_no = 1 AND n = 1
                             THEN label || ': ' || {_NUMBER} || '|Zone: North ' || s_nationkey
                             ELSE label || ': ' || {_NUMBER} END, '|' ORDER BY n) AS bullets,
             CASE WHEN section_no = 2 THEN trim(repeat('long text ' || any_value(s_name) || ' ', 3)) ELSE '' END AS paragraphs,
             string_agg(chart_no || chart_type || ':' || label, '|' ORDER BY n) AS charts,
             CASE WHEN section_no = 3 THEN 'a' || page_id || '.png|b.png' ELSE '' END AS images
      FROM c GROUP BY page_id, section_no
      UNION ALL SELECT s_suppkey, -1, 'title', s_name, NULL, '', '', '', '' FROM supplier)""",
)
def sec_plan(spark, sf):
    """Nested columns written as text, for the comparison only."""
    plan = ol.section_plan(bl.extract_blocks(survey_pages(spark, sf)))
    points = F.flatten(
        F.transform(
            "charts",
            lambda c: F.transform(
                c["data"],
                lambda p: F.concat(c["chart_no"].cast("string"), c["chart_type"], F.lit(":"), p["label"]),
            ),
        )
    )
    return plan.select(
        "page_id", "section_no", "layout", "title", "subtitle", F.array_join("bullets", "|").alias("bullets"),
        F.array_join("paragraphs", "|").alias("paragraphs"), F.array_join(points, "|").alias("charts"),
        F.array_join("images.path", "|").alias("images"),
    )


@query(
    "sec_plan_documents",
    block_sql(NOTE_SQL)
    + LINE_CTES
    + """, s AS (SELECT page_id, section_no,
               count(*) FILTER (WHERE class = 'text') AS paragraphs, count(*) FILTER (WHERE class IN ('number', 'pair')) AS bullets,
               md5(string_agg(line, chr(10) ORDER BY block_no, sub, line_no) FILTER (WHERE class = 'text')) AS text_md5
             FROM classed GROUP BY 1, 2),
      h AS (SELECT page_id, section_no, min_by(text, block_no) FILTER (WHERE type = 'heading') AS title
            FROM sections GROUP BY 1, 2)
      SELECT h.page_id, CAST(h.section_no AS BIGINT) AS section_no, title, CAST(coalesce(bullets, 0) AS INTEGER) AS bullets,
             CAST(coalesce(paragraphs, 0) AS INTEGER) AS paragraphs, text_md5
      FROM h LEFT JOIN s ON h.page_id = s.page_id AND h.section_no = s.section_no
      WHERE title <> '' OR bullets > 0 OR paragraphs > 0
      UNION ALL SELECT page_id, -1, text, NULL, NULL, NULL FROM blocks JOIN title USING (page_id) WHERE block_no = no""",
)
def sec_plan_documents(spark, sf):
    plan = ol.section_plan(bl.extract_blocks(note_pages(spark, sf)))
    size = lambda c: F.when(F.col("layout") == "content", F.size(c))
    return plan.select(
        "page_id", "section_no", "title", size("bullets").alias("bullets"), size("paragraphs").alias("paragraphs"),
        F.when(F.size("paragraphs") > 0, F.md5(F.array_join("paragraphs", "\n"))).alias("text_md5"),
    )
