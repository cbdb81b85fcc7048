"""Field jobs on labelled pages. Each customer row is written out as a page of labelled fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartulary.operators import blocks as bl
from cartulary.operators import pages as pg
from cartulary.plans.registry import query, table


def _cat(*parts):
    return F.concat(*(F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts))


def _row(label, *value, title=True):
    head = f'<div class="col-label" title="{label}">' if title else '<div class="col-label">'
    return _cat(
        f'<div class="row row-details">{head}<div class="col-label__label"> {label} </div></div>'
        '<div class="col-value text-break">',
        *value,
        "</div></div>\n",
    )


def customer_pages(spark, sf, where="true"):
    key, name, segment = F.col("c_custkey"), F.col("c_name"), F.col("c_mktsegment")
    nation, rich = F.col("c_nationkey"), F.col("c_acctbal") > 0
    badge = lambda text, hover: _cat('<span title=" by ', hover, '" class="badge audit-badge"> ', text, " </span>")
    html = _cat(
        '<html><body><!-- <div title="Name">no</div> --><script>if (a<b) "<h1>no</h1>"</script><header><h1>Top ', nation, "</h1></header>",
        _row("Name", "<span> </span><span> ", name, " &amp; Co </span>"),
        _row("Show In Client", '<div class="col-value">', F.when(rich, "Yes\n  (Open)").otherwise("No&nbsp;(Closed)"), "</div>"),
        _row(
            "Modern Category",
            F.when(rich, _cat('<span class="text-muted">', segment, "</span><span>x<b>y</b></span><span>", segment, "</span>")),
            "<a href='/c'>", segment, "</a>",
        ),
        _row(
            "URL",
            '<a href="https://www.', F.lower(segment), ".test/", key, '?a=1&amp;b=2">x</a>'
            '<a class="z" href="http://maps.corp.test/x">in</a><a href="mailto:a@b">m</a>'
            '<a href="https://www.', F.lower(segment), ".test/", key, '?a=1&amp;b=2">again</a>',
            F.when(rich, '<a href="http://corp.tests/y">y</a>'),
        ),
        _row(
            "Vendor Contributions",
            '<table class="t vendor-contributions-table"><thead><tr><th>i</th><th>who</th></tr></thead><tbody>'
            "<tr><td>1</td><td> ", segment, "&nbsp; <i>x</i></td></tr><tr><td>2</td><td>N", nation,
            "</td></tr><tr><td>3</td><td>N", nation, "</td></tr><tr><td>4</td></tr><tr><td>5</td><td> </td></tr></tbody></table>",
            title=False,
        ),
        '<div class="audit-row"><div title="Hours">Hours</div><div data-test-id="hours" class="panel">',
        F.when(
            rich,
            _cat(
                '<div class="my-hours-collection"><div class="row row-details"><div class="col-label__label">Monday</div>'
                '<div class="col-value">9-', nation, '</div></div><div class="row row-details">'
                '<div class="col-label__label">Tuesday</div><div class="col-value"> closed </div></div></div>',
            ),
        ).otherwise('<span class="text-placeholder"> None </span>'),
        F.when(nation > 5, badge("Edited", nation)).otherwise('<span class="my-badge">old</span>'),
        "</div></div>",
        '<div class="x"><div title="Locked">Locked</div><div class="panel">'
        '<div class="audit-row row-details"><span class="category-display">', segment, "</span>", badge("Locked", key), "</div>"
        '<div class="row-details audit-row"><span class="category-display">no badge</span></div>'
        '<div class="audit-row row-details"><span class="category-display">N', nation, "</span>", badge("Open", key), "</div>"
        "</div></div></body></html>",
    )
    return table(spark, sf, "customer", dealt=True).filter(where).select(key.alias("place_id"), html.alias("html"))


def _field(name, sql, make):
    @query(name, f"SELECT c_custkey AS place_id, {sql} AS out FROM customer")
    def run(spark, sf):
        pages = pg.readable(customer_pages(spark, sf))
        return pages.select("place_id", make(F.col("html"), F.col("cells"), F.col("rows")).alias("out"))

    return run


STATUS_SQL = "CASE WHEN c_acctbal > 0 THEN 'Yes (Open)' ELSE 'No (Closed)' END"
CATEGORY_SQL = "CASE WHEN c_acctbal > 0 THEN c_mktsegment || ', x y' ELSE c_mktsegment END"
URL_SQL = (
    "'https://www.' || lower(c_mktsegment) || '.test/' || c_custkey || '?a=1&b=2'"
    " || CASE WHEN c_acctbal > 0 THEN ', http://corp.tests/y' ELSE '' END"
)
VENDOR_SQL = "c_mktsegment || ' x, N' || c_nationkey"

_field("html_label_value", "c_name || ' & Co'", lambda h, c, r: pg.label_value(c, "Name"))
_field("html_status_value", STATUS_SQL, lambda h, c, r: pg.status_value(c))
_field("html_categories", CATEGORY_SQL, lambda h, c, r: pg.categories(c))
_field("html_urls", URL_SQL, lambda h, c, r: pg.urls(c, "corp.test"))
_field(
    "html_table_column", VENDOR_SQL,
    lambda h, c, r: pg.table_column(h, c, "Vendor Contributions", "vendor-contributions-table"),
)
_field(
    "html_badge",
    "CASE WHEN c_nationkey > 5 THEN 'Edited/by ' || c_nationkey ELSE 'old/' END",
    lambda h, c, r: F.concat(pg.badge(r, "Hours"), F.lit("/"), pg.badge_hover(r, "Hours")),
)
_field(
    "html_category_badges",
    "c_mktsegment || '=Locked;N' || c_nationkey || '=Open'",
    lambda h, c, r: F.array_join(
        F.transform(pg.category_badges(r, "Locked"), lambda x: F.concat(x["name"], F.lit("="), x["badge"])), ";"
    ),
)
_field(
    "html_hours_map",
    "CASE WHEN c_acctbal > 0 THEN 'Monday=9-' || c_nationkey || ';Tuesday=closed' ELSE '__placeholder__=None' END",
    lambda h, c, r: F.array_join(
        F.transform(F.map_entries(pg.hours_map(h)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";"
    ),
)


@query(
    "html_profile",
    f"""SELECT o_orderkey, place_id, coalesce(status, '') AS status, coalesce(vendors, '') AS vendors,
               coalesce(categories, '') AS categories, coalesce(urls, '') AS urls
        FROM (SELECT o_orderkey, o_custkey AS place_id FROM orders) LEFT JOIN (
          SELECT c_custkey AS place_id, {STATUS_SQL} AS status, {VENDOR_SQL} AS vendors,
                 {CATEGORY_SQL} AS categories, {URL_SQL} AS urls
          FROM customer WHERE c_mktsegment <> 'MACHINERY') USING (place_id)""",
)
def html_profile(spark, sf):
    asked = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("place_id"))
    found = pg.readable(customer_pages(spark, sf, "c_mktsegment <> 'MACHINERY'"))
    return pg.profile(asked, found, "corp.test")


@query(
    "html_place_name",
    """SELECT page_id, coalesce(trim(regexp_replace(replace(replace(replace(replace(regexp_replace(
                regexp_extract(html, '(?is)<h1\\b[^>]*>(.*?)</h1\\s*>', 1), '<[^>]*>', ' ', 'g'),
                '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '[\\s\\x{00a0}]+', ' ', 'g')), '') AS name
       FROM pages""",
)
def html_place_name(spark, sf):
    pages = pg.readable(table(spark, sf, "pages", dealt=True))
    return pages.select("page_id", pg.place_name(F.col("html"), F.col("rows")).alias("name"))


@query(
    "html_place_name_fields",
    """SELECT c_custkey AS place_id, CASE WHEN c_nationkey > 12 THEN c_name || ' & Co'
              WHEN c_nationkey > 6 THEN 'Top ' || c_nationkey ELSE 'M ' || c_name END AS name FROM customer""",
)
def html_place_name_fields(spark, sf):
    """Name row, header heading, and a title marker that comes before the heading."""
    nation = F.regexp_extract("html", r"<h1>Top (\d+)</h1>", 1).cast("int")
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("place_id"), "c_name")
    marked = F.concat(F.lit('<b data-test-id="place-title">M <i>'), F.col("c_name"), F.lit("</i></b>"))
    renamed = F.replace("html", F.lit('title="Name"'), F.lit('title="Nom"'))
    html = (
        F.when(nation > 12, F.col("html"))
        .when(nation > 6, renamed)
        .otherwise(F.concat(renamed, F.replace(F.replace(marked, F.lit("<i>"), F.lit("")), F.lit("</i>"), F.lit(""))))
    )
    both = customer_pages(spark, sf).join(customers, "place_id").select("place_id", html.alias("html"))
    return pg.readable(both).select("place_id", pg.place_name(F.col("html"), F.col("rows")).alias("name"))


@query(
    "html_edit_rows",
    """SELECT user_id AS place_id, event_id, CAST(pos AS INTEGER) AS pos,
              date_trunc('minute', ts) + INTERVAL (pos) DAY AS edit_ts, event_type || ' ' || pos AS description
       FROM events, (VALUES (0), (2)) AS p(pos)""",
)
def html_edit_rows(spark, sf):
    """Three edit rows per event page, the middle one without a usable date."""
    def row(date, text):
        return _cat(
            '<div class="audit-row x"><div title="Date">Date</div><div> ', date, ' </div><div title="Description">D</div>'
            "<div><p> ", text, " </p></div></div>",
        )

    second = F.date_format(F.timestamp_add("DAY", F.lit(2), F.col("ts")), "MMM d, yyyy hh:mm a")
    html = _cat(
        "<div>", row(_cat(F.date_format("ts", "yyyy-MM-dd HH:mm"), " UTC"), _cat(F.col("event_type"), " 0")),
        row("yesterday", "lost"), row(_cat(second, " CDT"), _cat("<b>", F.col("event_type"), "</b> 2")), "</div>",
    )
    listed = table(spark, sf, "events", dealt=True).select(
        F.struct(F.col("user_id"), F.col("event_id")).alias("place_id"), html.alias("html")
    )
    return pg.edit_rows(listed).select(
        F.col("place_id.user_id").alias("place_id"), F.col("place_id.event_id").alias("event_id"),
        "pos", "edit_ts", "description",
    )


@query(
    "html_corrections",
    """SELECT event_id, 'first ' || event_type || ' ; n' || user_id AS list_items,
              '{"b":"x y","a":' || user_id || '}' AS json_blocks,
              '{bad ' || event_type || '} || x = 1' AS code_blocks,
              'first ' || event_type || ' | n' || user_id || ' | note | {"b": "x y", "a": ' || user_id
                || ' } | {bad ' || event_type || '} | x = 1' AS all_text
       FROM events""",
)
def html_corrections(spark, sf):
    kind, user = F.col("event_type"), F.col("user_id")
    html = _cat(
        '<div title="Corrections">C</div><div class="v"><ul><li> first <b>', kind, "</b></li><li></li><li>n", user,
        "</li></ul><p>note</p><p>note</p>", '<div><code>{"b": "x y", "a": ', user, " }</code></div><p><code>{bad ", kind,
        '}</code></p><br><code>x = 1</code></div><div title="Next">N</div><div><li>no</li></div>',
    )
    listed = pg.readable(table(spark, sf, "events", dealt=True).select("event_id", html.alias("html")))
    return listed.select("event_id", pg.corrections(F.col("rows")).alias("c")).select("event_id", "c.*")


# The block rules once more, in SQL: tokens, list depth, blocks, list items.
_ENTITIES = [
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "''"), ("&nbsp;", " "),
    ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"),
]


def _decoded(x):
    for entity, char in _ENTITIES:
        x = f"replace({x}, '{entity}', '{char}')"
    return x


_EDGE = "[\\s\\x{00a0}\\x04]*"
_CUT = f"regexp_replace(regexp_replace(text, '<[^>]*>', chr(4), 'g'), '{_EDGE}\\x04{_EDGE}', chr(4), 'g')"


def block_sql(source):
    """CTEs `blocks` and `images` over a relation with page_id and html."""
    return f"""
WITH body AS (
  SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
    '(?s)<!--.*?-->', '', 'g'), '(?is)<script\\b.*?</script\\s*>', '', 'g'),
    '(?is)<style\\b.*?</style\\s*>', '', 'g'), '(?is)<head\\b.*?</head\\s*>', '', 'g') AS html FROM {source}),
cut AS (
  SELECT page_id, string_split(regexp_replace(
    regexp_replace(html, '(?is)^(\\s*(?:<!doctype[^>]*>\\s*|<html\\b[^>]*>\\s*)*)([^<\\s])', '\\1<p>\\2'),
    '(?i)<(/?(?:h1|h2|h3|p|ul|ol|li|img|br|{bl.CONTAINERS}))\\b([^>]*)>',
    chr(1) || '\\1' || chr(2) || '\\2' || chr(3), 'g'), chr(1)) AS parts FROM body),
raw AS (SELECT page_id, unnest(generate_series(1, len(parts))) - 1 AS pos, unnest(parts) AS t FROM cut),
sp AS (
  SELECT page_id, pos, CASE WHEN contains(t, chr(2)) THEN lower(split_part(t, chr(2), 1)) ELSE '' END AS tag,
         CASE WHEN contains(t, chr(2)) THEN split_part(split_part(t, chr(3), 1), chr(2), 2) ELSE '' END AS attrs,
         CASE WHEN contains(t, chr(2)) THEN split_part(t, chr(3), 2) ELSE t END AS text FROM raw),
tok AS (
  SELECT page_id, pos, tag, attrs, regexp_replace(regexp_replace({_decoded(_CUT)}, '^{_EDGE}', ''), '{_EDGE}$', '') AS text,
         CASE WHEN tag IN ('ul', 'ol') THEN 1 WHEN tag IN ('/ul', '/ol') THEN -1 ELSE 0 END AS step FROM sp),
d1 AS (SELECT *, sum(step) OVER (PARTITION BY page_id ORDER BY pos) AS total FROM tok),
d2 AS (SELECT *, total - least(0, min(total) OVER (PARTITION BY page_id ORDER BY pos)) AS depth FROM d1),
m1 AS (
  SELECT *, CASE WHEN depth = 0 AND tag IN ('h1', 'h2', 'h3', 'p') THEN tag
                 WHEN depth = 0 AND (tag IN ('/h1', '/h2', '/h3', '/p', '/ul', '/ol')
                      OR regexp_full_match(tag, '/?({bl.CONTAINERS})')) THEN 'loose'
                 WHEN tag IN ('ul', 'ol') AND depth = 1 THEN 'list' END AS sets FROM d2),
m2 AS (SELECT *, coalesce(last_value(sets IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY pos
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'loose') AS mode FROM m1),
m3 AS (SELECT *, coalesce(lag(mode) OVER (PARTITION BY page_id ORDER BY pos), 'loose') AS before FROM m2),
b1 AS (
  SELECT *, sum(CASE WHEN (depth = 0 AND tag IN ('h1', 'h2', 'h3', 'p')) OR (tag IN ('ul', 'ol') AND depth = 1)
                       OR (mode = 'loose' AND (tag IN ('br', 'img') OR before <> 'loose')) THEN 1 ELSE 0 END)
              OVER (PARTITION BY page_id ORDER BY pos) AS block_no FROM m3),
b2 AS (
  SELECT *, sum(CASE WHEN depth = 1 AND tag = 'li' THEN 1 ELSE 0 END) OVER w AS item_no,
         coalesce(last_value(CASE WHEN depth = 1 AND tag = 'li' THEN true WHEN depth = 1 AND tag = '/li' THEN false END
                  IGNORE NULLS) OVER (PARTITION BY page_id, block_no ORDER BY pos
                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS in_item
  FROM b1 WINDOW w AS (PARTITION BY page_id, block_no ORDER BY pos)),
items AS (
  SELECT page_id, block_no, item_no,
         replace(coalesce(string_agg(text, chr(4) ORDER BY pos) FILTER (WHERE text <> ''), ''), chr(4), ' ') AS text
  FROM b2 WHERE mode = 'list' AND in_item GROUP BY 1, 2, 3),
lists AS (SELECT page_id, block_no, list(text ORDER BY item_no) AS items FROM items GROUP BY 1, 2),
whole AS (
  SELECT page_id, block_no, min_by(mode, pos) AS mode, min_by(tag, pos) AS tag,
         coalesce(string_agg(text, chr(4) ORDER BY pos) FILTER (WHERE text <> ''), '') AS text
  FROM b2 GROUP BY 1, 2),
blocks AS (
  SELECT page_id, CAST(block_no AS BIGINT) AS block_no, 0 AS sub,
         CASE WHEN mode IN ('h1', 'h2', 'h3') THEN 'heading' WHEN mode = 'list' THEN 'list' ELSE 'paragraph' END AS type,
         CASE WHEN mode IN ('h1', 'h2', 'h3') THEN CAST(substr(mode, 2, 1) AS INTEGER) END AS level,
         CASE WHEN mode = 'list' THEN tag = 'ol' END AS ordered,
         CASE WHEN mode <> 'list' THEN replace(text, chr(4), CASE WHEN mode IN ('h1', 'h2', 'h3') THEN '' ELSE ' ' END) END AS text,
         CASE WHEN mode = 'list' THEN coalesce(items, []) END AS items
  FROM whole LEFT JOIN lists USING (page_id, block_no)
  WHERE mode IN ('h1', 'h2', 'h3', 'list') OR text <> ''),
images AS (
  SELECT page_id, CAST(block_no AS BIGINT) AS block_no, CAST(CASE WHEN mode = 'loose' THEN -1 ELSE pos END AS INTEGER) AS sub,
         regexp_extract(attrs, '(?i)\\bsrc\\s*=\\s*["'']([^"'']*)["'']', 1) AS src,
         nullif(regexp_extract(attrs, '(?i)\\balt\\s*=\\s*["'']([^"'']*)["'']', 1), '') AS alt
  FROM b2 WHERE tag = 'img' AND mode NOT IN ('h1', 'h2', 'h3') AND (mode <> 'list' OR in_item))
"""


def shown_blocks(blocks):
    return blocks.select(
        "page_id", "block_no", "sub", "type", "level", "ordered", "text",
        F.array_join("items", "|").alias("items"),
    )


@query(
    "blk_extract",
    block_sql("pages")
    + """SELECT page_id, block_no, sub, type, level, ordered, text,
                array_to_string(items, '|') AS items FROM blocks""",
)
def blk_extract(spark, sf):
    return shown_blocks(bl.extract_blocks(table(spark, sf, "pages", dealt=True)))


# Every document as a page, its paragraphs cut by breaks and given a picture and nested lists.
DOCUMENT_PAGES_SQL = """(SELECT doc_id AS page_id, 'Lead<br>in <img src="' || source || '.png" alt="">'
  || '<h2>' || lang || ' <b>' || source || '</b></h2><p>' || replace(text, chr(10), '<br/>') || '<img alt="a&amp;b" src="p' || doc_id
  || '.png"><div>after</div><ol><li>one <img src="li.png"><ul><li>deep</li></ul></li>loose<li>two</ol></ul>tail'
  AS html FROM documents)"""


def document_pages(spark, sf):
    docs = table(spark, sf, "documents", dealt=True)
    html = _cat(
        'Lead<br>in <img src="', F.col("source"), '.png" alt=""><h2>', F.col("lang"), " <b>", F.col("source"), "</b></h2><p>",
        F.replace("text", F.lit("\n"), F.lit("<br/>")), '<img alt="a&amp;b" src="p', F.col("doc_id"),
        '.png"><div>after</div><ol><li>one <img src="li.png"><ul><li>deep</li></ul></li>loose<li>two</ol></ul>tail',
    )
    return docs.select(F.col("doc_id").alias("page_id"), html.alias("html"))


@query(
    "blk_extract_documents",
    block_sql(DOCUMENT_PAGES_SQL)
    + """SELECT page_id, block_no, sub, type, level, ordered, text,
                array_to_string(items, '|') AS items FROM blocks""",
)
def blk_extract_documents(spark, sf):
    made = bl.extract_blocks(document_pages(spark, sf))
    return shown_blocks(made.filter("type <> 'image'"))


@query(
    "blk_images",
    block_sql(DOCUMENT_PAGES_SQL) + f"SELECT page_id, block_no, sub, src, {_decoded('alt')} AS alt FROM images",
)
def blk_images(spark, sf):
    return bl.image_blocks(document_pages(spark, sf)).select("page_id", "block_no", "sub", "src", "alt")
