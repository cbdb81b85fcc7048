"""Column expressions over cells that the test tables provide."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartulary.functions import ids, notes, text, times, urls
from cartulary.plans.registry import query, table

L = F.lit


def _s(name):
    return F.col(name).cast("string")


def _one(name, sql, source, key, make, out="out"):
    """Register one expression over one table: key column and result."""

    @query(name, sql)
    def run(spark, sf):
        return table(spark, sf, source).select(key, make().alias(out))

    return run


_one(
    "fn_place_id",
    "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS out FROM orders",
    "orders", "o_orderkey",
    lambda: ids.place_id(F.concat(L("&lt;br a='1'&gt; no. "), _s("o_orderkey"), L(" "), _s("o_custkey"))),
)
_one(
    "fn_place_id_or_raw",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'n/a & x'
                               ELSE CAST(o_custkey AS VARCHAR) END AS out FROM orders""",
    "orders", "o_orderkey",
    lambda: ids.place_id_or_raw(
        F.when(F.col("o_orderstatus") == "F", " <i>n/a &amp; x</i>").otherwise(
            F.concat(L("<b>"), _s("o_custkey"), L("</b>"))
        )
    ),
)
_one(
    "fn_ticket_id",
    """SELECT o_orderkey, CASE WHEN length(CAST(o_custkey AS VARCHAR)) > length(CAST(o_orderkey AS VARCHAR))
              THEN CAST(o_custkey AS VARCHAR) ELSE CAST(o_orderkey AS VARCHAR) END AS out FROM orders""",
    "orders", "o_orderkey",
    lambda: ids.ticket_id(
        F.concat(L('\ufeff"&lt;BR /&gt;'), _s("o_orderkey"), L(" x "), _s("o_custkey"), L('"'))
    ),
)
_one(
    "fn_ticket_id_alnum",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'T' || o_orderkey || '-' || o_custkey
                               ELSE o_orderkey || '' || o_custkey END AS out FROM orders""",
    "orders", "o_orderkey",
    lambda: ids.ticket_id_alnum(
        F.when(
            F.col("o_orderstatus") == "F", F.concat(L("## T "), _s("o_orderkey"), L("-"), _s("o_custkey"))
        ).otherwise(F.concat(L("#_"), _s("o_orderkey"), L(" -"), _s("o_custkey"), L("!")))
    ),
)
_one(
    "fn_clean_markings",
    "SELECT c_custkey, c_name || ', ' || c_mktsegment || '-x' AS out FROM customer",
    "customer", "c_custkey",
    lambda: text.clean_markings(
        F.concat(L("['"), F.col("c_name"), L("', \""), F.col("c_mktsegment"), L('-x"]'))
    ),
)
_one(
    "fn_clean_list",
    """SELECT c_custkey, CASE WHEN c_nationkey > 12 THEN c_name || ', ' || c_nationkey
                              ELSE c_mktsegment || ' of ' || c_name END AS out FROM customer""",
    "customer", "c_custkey",
    lambda: text.clean_list(
        F.when(
            F.col("c_nationkey") > 12,
            F.concat(L("[' "), F.col("c_name"), L("', '', "), _s("c_nationkey"), L("]")),
        ).otherwise(F.concat(L("["), F.col("c_mktsegment"), L(" of '"), F.col("c_name"), L("']")))
    ),
)
_one(
    "fn_normalize_url",
    "SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '^www\\.', '') AS out FROM pages",
    "pages", "page_id",
    lambda: urls.normalize_url(F.col("url")),
)
_one(
    "fn_hyperlink_cell",
    """SELECT page_id, CASE WHEN length(url) < 34 THEN url WHEN length(url) < 38 THEN url
              WHEN length(url) < 42 THEN 'https://a' || page_id || '.test/x' ELSE '' END AS out FROM pages""",
    "pages", "page_id",
    lambda: urls.hyperlink_cell(
        F.when(F.length("url") < 34, F.concat(L('=hyperlink("'), F.col("url"), L('","t")')))
        .when(F.length("url") < 38, F.concat(L(" "), F.col("url")))
        .when(F.length("url") < 42, F.concat(L("a"), _s("page_id"), L(".test/x")))
        .otherwise("Oren Salon")
    ),
)
_one(
    "fn_title_level2",
    """SELECT c_custkey, CASE WHEN c_nationkey > 12 THEN c_mktsegment || ' (' || c_nationkey || ')'
                              ELSE c_mktsegment END AS out FROM customer""",
    "customer", "c_custkey",
    lambda: text.title_level2(
        F.when(
            F.col("c_nationkey") > 12,
            F.concat("c_mktsegment", L(" ("), _s("c_nationkey"), L(") tail – "), F.col("c_name")),
        ).otherwise(F.concat("c_mktsegment", L(" -  (x) "), F.col("c_name")))
    ),
)
_one(
    "fn_header_tokens",
    """SELECT event_id, CASE WHEN event_type = 'view' THEN '---' ELSE event_type || ' ' || user_id END AS out
       FROM events""",
    "events", "event_id",
    lambda: F.array_join(
        text.header_tokens(
            F.array(
                F.date_format("ts", "yyyy-MM-dd hh:mm a"),
                F.when(F.col("event_type") == "view", "---").otherwise(F.concat_ws(" ", "event_type", _s("user_id"))),
                F.concat(_s("user_id"), L("-2 (3).")),
            )
        ),
        " | ",
    ),
)
_one(
    "fn_brand_text",
    """SELECT p_partkey, CASE WHEN p_size > 40 THEN 'None' WHEN p_size > 30 THEN p_brand
              WHEN p_size > 20 THEN p_name WHEN p_size > 10 THEN 'not visible' ELSE 'None' END AS out FROM part""",
    "part", "p_partkey",
    lambda: text.brand_text(
        F.when(F.col("p_size") > 40, " NONE "),
        F.when(F.col("p_size") > 30, F.concat(L('x " '), F.col("p_brand"), L(' " (79)')))
        .when(F.col("p_size") > 20, F.concat(F.replace("p_name", L(" "), L("   ")), L(" ("), _s("p_partkey"), L(")")))
        .otherwise(F.concat(L("("), _s("p_partkey"), L(")"))),
        F.col("p_size") > 10,
    ),
)
_one(
    "fn_brand_strip_paren",
    "SELECT p_partkey, p_brand || ' (x) y' AS out FROM part",
    "part", "p_partkey",
    lambda: text.brand_strip_paren(F.concat("p_brand", L(" (x) y ("), _s("p_size"), L(")"))),
)
_one(
    "fn_url_prefer",
    """SELECT page_id, CASE WHEN length(url) < 34 THEN 'None' WHEN length(url) < 42 THEN url END AS out
       FROM pages""",
    "pages", "page_id",
    lambda: urls.url_prefer(
        F.when(F.length("url") < 34, "None"), F.when(F.length("url") < 42, F.col("url"))
    ),
)
_one(
    "fn_external_urls",
    """SELECT page_id, CASE WHEN regexp_extract(url, '^https?://([^/?#]*)', 1) = 'example.net'
              OR regexp_extract(url, '^https?://([^/?#]*)', 1) LIKE '%.example.net'
              THEN 'https://z.test/' || page_id ELSE url || ' https://z.test/' || page_id END AS out FROM pages""",
    "pages", "page_id",
    lambda: F.array_join(
        urls.external_urls(
            F.array(
                F.col("url"), L("ftp://a.test"), F.concat(L("https://z.test/"), _s("page_id")), F.col("url"),
                L("http://www.example.net/q"), L("/local"),
            ),
            "example.net",
        ),
        " ",
    ),
)
_one(
    "fn_parse_version_ts",
    "SELECT event_id, date_trunc('minute', ts) AS out FROM events",
    "events", "event_id",
    lambda: times.parse_version_ts(F.concat(F.date_format("ts", "yyyy-MM-dd hh:mm a"), L(" CDT"))),
)
_one(
    "fn_parse_edit_ts",
    """SELECT event_id, CASE WHEN event_type = 'click' THEN date_trunc('day', ts) WHEN event_type = 'view' THEN NULL
              ELSE date_trunc('minute', ts) END AS out FROM events""",
    "events", "event_id",
    lambda: times.parse_edit_ts(
        F.when(F.col("event_type") == "click", F.date_format("ts", "yyyy-MM-dd"))
        .when(F.col("event_type") == "view", F.col("props"))
        .when(F.col("event_type") == "error", F.concat(F.date_format("ts", "MMM d, yyyy  hh:mm a"), L(" UTC")))
        .otherwise(F.date_format("ts", " yyyy-MM-dd HH:mm"))
    ),
)
_one(
    "fn_parse_closure_date",
    """SELECT event_id, CASE WHEN event_type IN ('click', 'signup', 'purchase') THEN date_trunc('day', ts)
              WHEN event_type = 'view' THEN NULL ELSE date_trunc('minute', ts) END AS out FROM events""",
    "events", "event_id",
    lambda: times.parse_closure_date(
        F.when(F.col("event_type") == "click", F.date_format("ts", "yyyy-MM-dd"))
        .when(F.col("event_type") == "signup", F.date_format("ts", "M/d/yyyy"))
        .when(F.col("event_type") == "purchase", F.date_format("ts", "MMM d, yyyy"))
        .when(F.col("event_type") == "view", "soon")
        .otherwise(F.date_format("ts", "MM/dd/yyyy hh:mm a"))
    ),
)
_one(
    "fn_fmt_mdy",
    "SELECT event_id, strftime(ts, '%-m/%-d/%Y') AS out FROM events",
    "events", "event_id",
    lambda: times.fmt_mdy(F.col("ts")),
)
_one(
    "fn_fmt_iso",
    """SELECT event_id, CASE WHEN event_type = 'view' THEN ''
              WHEN event_type = 'click' THEN strftime(ts, '%Y-%m-%dT%H:%M:00')
              ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS out FROM events""",
    "events", "event_id",
    lambda: times.fmt_iso(
        F.when(F.col("event_type") == "click", F.date_trunc("minute", "ts").cast("timestamp_ntz")).when(
            F.col("event_type") != "view", F.col("ts")
        )
    ),
)
_one(
    "fn_json_notes",
    """SELECT event_id, CASE WHEN event_type = 'view' THEN 'shown' WHEN event_type = 'click' THEN 'longest one'
              ELSE 'k ' || json_extract_string(props, '$.k') || ' ' || event_type END AS out FROM events""",
    "events", "event_id",
    lambda: notes.json_notes(
        F.when(F.col("event_type").isin("view", "click"), F.concat(L("x "), F.col("props"))).otherwise(
            F.concat(
                L('head {"notes": " k   '), F.regexp_extract("props", r"\d+", 0), L("\\n "), F.col("event_type"),
                L('", "z": [1, 2,],} tail'),
            )
        ),
        F.when(F.col("event_type") == "view", '"shown"'),
        F.array(L("ab"), L('"longest  one"'), L("longest two")),
    ),
)
_one(
    "fn_squeeze",
    "SELECT doc_id, trim(regexp_replace(text, '[\\s\\x{00a0}]+', ' ', 'g')) AS out FROM documents",
    "documents", "doc_id",
    lambda: text.squeeze(F.col("text")),
)
_one(
    "fn_to_number",
    "SELECT event_id, CASE WHEN event_type = 'view' THEN NULL ELSE value END AS out FROM events",
    "events", "event_id",
    lambda: text.to_number(F.when(F.col("event_type") == "view", F.col("props")).otherwise(_s("value"))),
)


@query(
    "distinct_in_order",
    """WITH w AS (SELECT conv_id, turn, i, list_extract(words, i) AS word FROM (
                    SELECT conv_id, turn, string_split(text, ' ') AS words,
                           unnest(generate_series(1, len(string_split(text, ' ')))) AS i FROM conversations)),
            f AS (SELECT conv_id, turn, word, min(i) AS first FROM w GROUP BY 1, 2, 3)
       SELECT conv_id, turn, string_agg(word, ', ' ORDER BY first) AS out FROM f GROUP BY 1, 2""",
)
def distinct_in_order(spark, sf):
    words = F.split("text", " ")
    return table(spark, sf, "conversations").select("conv_id", "turn", text.distinct_in_order(words).alias("out"))


@query(
    "longest_string",
    """WITH w AS (SELECT doc_id, i, list_extract(words, i) AS word FROM (
                    SELECT doc_id, string_split(text, ' ') AS words,
                           unnest(generate_series(1, len(string_split(text, ' ')))) AS i FROM documents)),
            r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length(word) DESC, i) AS k FROM w)
       SELECT doc_id, word AS out FROM r WHERE k = 1""",
)
def longest_string(spark, sf):
    words = F.split("text", " ")
    return table(spark, sf, "documents").select("doc_id", text.longest_string(words).alias("out"))
