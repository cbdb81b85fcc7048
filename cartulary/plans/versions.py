"""Version and edit histories: `events` plays the history, one user is one place."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartulary.operators import edits, recipes
from cartulary.operators import versions as v
from cartulary.plans.registry import query, table

THRESHOLD = "2024-01-10 00:00:00"


def threshold():
    return F.lit(THRESHOLD).cast("timestamp_ntz")


def history(spark, sf, *fields):
    """`versions` with the asked fields derived from `events`."""
    kind, value, eid = F.col("event_type"), F.col("value"), F.col("event_id").cast("string")
    derived = {
        "event_type": kind,
        "brand": F.when(kind == "purchase", F.concat(F.lit("B"), eid)).otherwise("None"),
        "name": F.concat(F.lit("N"), eid),
        "url": F.when(value > 20, F.concat(F.lit("u/"), eid)),
        "source": F.concat(F.lit("S"), eid),
        "changed_fields": F.array(kind),
        "hours_badge": F.when(value > 150, "edited").otherwise("published"),
        "hours_badge_hover": F.floor(value / 150).cast("string"),
        "modern_cat_badge": F.when((kind == "purchase") & (value > 50), "edited").otherwise("locked"),
        "modern_cat_badge_hover": F.when(value > 100, "x").otherwise(None),
        "parent": F.when(value > 100, F.concat(F.lit("P"), eid)).otherwise("None"),
        "badge": F.when(kind.isin("error", "view"), "Edited").otherwise("Published"),
        "header": F.array(
            F.lit("System Revert"), F.date_format("ts", "yyyy-MM-dd hh:mm a"), eid, kind
        ),
        "notes_json": F.concat(
            F.lit("prelude "),
            F.replace("props", F.lit("}"), F.concat(F.lit(', "notes": " v   '), kind, F.lit(' ",} end'))),
        ),
    }
    return table(spark, sf, "events").select(
        F.col("user_id").alias("place_id"),
        F.col("ts").alias("version_ts"),
        F.col("event_id").alias("entry_id"),
        *(derived[f].alias(f) for f in fields),
    )


HISTORY = """
WITH v AS (
  SELECT user_id AS place_id, ts AS version_ts, event_id AS entry_id, event_type, value, props,
         CASE WHEN event_type = 'purchase' THEN 'B' || event_id ELSE 'None' END AS brand,
         'N' || event_id AS name,
         CASE WHEN value > 20 THEN 'u/' || event_id END AS url,
         'S' || event_id AS source,
         CASE WHEN value > 100 THEN 'P' || event_id ELSE 'None' END AS parent,
         CASE WHEN event_type IN ('error', 'view') THEN 'Edited' ELSE 'Published' END AS badge,
         CASE WHEN value > 150 THEN 'edited' ELSE 'published' END AS hours_badge,
         CAST(CAST(floor(value / 150) AS BIGINT) AS VARCHAR) AS hours_badge_hover,
         CASE WHEN event_type = 'purchase' AND value > 50 THEN 'edited' ELSE 'locked' END
           AS modern_cat_badge,
         CASE WHEN value > 100 THEN 'x' END AS modern_cat_badge_hover,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn
  FROM events)
"""
ASOF = (
    HISTORY
    + f""", chosen AS (
  SELECT * FROM (
    SELECT v.*, row_number() OVER (PARTITION BY place_id ORDER BY
             version_ts < TIMESTAMP '{THRESHOLD}' DESC,
             CASE WHEN version_ts < TIMESTAMP '{THRESHOLD}' THEN -rn ELSE rn END) AS pick
    FROM v) WHERE pick = 1)
"""
)


@query(
    "join_asof_before",
    ASOF + "SELECT place_id, version_ts, entry_id, event_type FROM chosen",
)
def join_asof_before(spark, sf):
    return v.asof_before(history(spark, sf, "event_type"), threshold(), ["event_type"])


@query(
    "join_asof_before_per_place",
    HISTORY
    + """, t AS (SELECT c_custkey AS place_id,
                    TIMESTAMP '2024-01-01' + INTERVAL (c_nationkey) DAY AS threshold FROM customer),
    j AS (SELECT v.*, row_number() OVER (PARTITION BY v.place_id ORDER BY
             version_ts < threshold DESC,
             CASE WHEN version_ts < threshold THEN -rn ELSE rn END) AS pick
          FROM v JOIN t USING (place_id))
    SELECT place_id, version_ts, entry_id FROM j WHERE pick = 1""",
)
def join_asof_before_per_place(spark, sf):
    asked = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("place_id"),
        F.timestamp_add("DAY", F.col("c_nationkey"), F.lit("2024-01-01").cast("timestamp_ntz")).alias(
            "threshold"
        ),
    )
    with_threshold = recipes.lookup(history(spark, sf), asked, ["place_id"], "inner")
    return v.asof_before(with_threshold, F.col("threshold"))


@query(
    "join_nearest_edit",
    """WITH t AS (SELECT event_id, user_id,
                         CASE WHEN value <= 200 THEN ts END AS target_ts
                  FROM events WHERE event_type = 'signup'),
            e AS (SELECT event_id AS edit_id, user_id, ts AS edit_ts, 'note ' || event_id AS description
                  FROM events WHERE event_type = 'error'),
            j AS (SELECT t.event_id, t.user_id AS place_id, t.target_ts, e.edit_ts, e.edit_id, e.description,
                         row_number() OVER (PARTITION BY t.event_id ORDER BY
                           coalesce(CAST(e.edit_ts AS DATE) = CAST(t.target_ts AS DATE), false) DESC,
                           CASE WHEN CAST(e.edit_ts AS DATE) = CAST(t.target_ts AS DATE) THEN 0
                                ELSE abs(epoch_us(e.edit_ts) - epoch_us(t.target_ts)) END,
                           e.edit_ts DESC, e.edit_id DESC) AS pick
                  FROM t LEFT JOIN e ON t.user_id = e.user_id)
       SELECT event_id, place_id, target_ts, edit_ts, edit_id, description FROM j WHERE pick = 1""",
)
def join_nearest_edit(spark, sf):
    events = table(spark, sf, "events")
    targets = events.filter("event_type = 'signup'").select(
        "event_id", F.col("user_id").alias("place_id"), F.when(F.col("value") <= 200, F.col("ts")).alias("target_ts")
    )
    found = events.filter("event_type = 'error'").select(
        F.col("user_id").alias("place_id"),
        F.col("ts").alias("edit_ts"),
        F.col("event_id").alias("edit_id"),
        F.concat(F.lit("note "), F.col("event_id").cast("string")).alias("description"),
    )
    return edits.nearest_edit(targets, found)


@query(
    "filter_version_field",
    """SELECT e.user_id AS place_id, e.event_id AS entry_id
       FROM events e
       WHERE (e.event_type = 'purchase' AND e.value > 100)
          OR e.user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 100)""",
)
def filter_version_field(spark, sf):
    touched = F.when(F.col("value") > 100, F.array("event_type")).otherwise(F.array(F.lit("other")))
    e = table(spark, sf, "events").select(
        F.col("user_id").alias("place_id"), F.col("event_id").alias("entry_id"), touched.alias("changed_fields")
    )
    return v.filter_by_field(e, "purchase").select("place_id", "entry_id")


@query(
    "filter_version_field_skip",
    "SELECT user_id AS place_id, event_id AS entry_id FROM events WHERE event_type = 'purchase'",
)
def filter_version_field_skip(spark, sf):
    kept = v.filter_by_field(history(spark, sf, "changed_fields"), "purchase", keep_unfiltered=False)
    return kept.select("place_id", "entry_id")


@query(
    "ver_ordered",
    "SELECT user_id AS place_id, ts AS version_ts, event_id AS entry_id FROM events"
    " WHERE event_type <> 'view' ORDER BY 1, 2, 3",
)
def ver_ordered(spark, sf):
    text = F.when(F.col("event_type") != "view", F.col("ts").cast("string")).otherwise("no date")
    e = table(spark, sf, "events").select(
        F.col("user_id").alias("place_id"),
        text.try_cast("timestamp_ntz").alias("version_ts"),
        F.col("event_id").alias("entry_id"),
    )
    return v.ordered_versions(e)


FIRST_BRAND = (
    HISTORY
    + """, w AS (SELECT v.*, lag(name) OVER p AS before_name, lag(url) OVER p AS before_url,
                lag(rn) OVER p AS before_rn
         FROM v WINDOW p AS (PARTITION BY place_id ORDER BY rn)),
   f AS (SELECT * FROM (SELECT w.*, row_number() OVER (PARTITION BY place_id ORDER BY rn) AS k
                        FROM w WHERE brand <> 'None') WHERE k = 1),
   l AS (SELECT * FROM (SELECT w.*, row_number() OVER (PARTITION BY place_id ORDER BY rn DESC) AS k
                        FROM w) WHERE k = 1)
"""
)


@query(
    "ver_first_brand",
    FIRST_BRAND
    + """SELECT l.place_id, f.rn IS NOT NULL AS found, f.version_ts, f.entry_id,
                coalesce(f.brand, 'None') AS brand, f.source, f.url,
                CASE WHEN f.rn IS NULL THEN l.name ELSE f.before_name END AS prior_name,
                CASE WHEN f.rn IS NULL THEN l.url ELSE f.before_url END AS prior_url
         FROM l LEFT JOIN f USING (place_id)""",
)
def ver_first_brand(spark, sf):
    return v.first_brand(history(spark, sf, "brand", "source", "name", "url"))


@query(
    "ver_first_brand_self",
    FIRST_BRAND
    + """SELECT l.place_id, coalesce(f.brand, 'None') AS brand,
                CASE WHEN f.rn IS NULL THEN l.name
                     WHEN f.before_rn IS NULL THEN f.name ELSE f.before_name END AS prior_name
         FROM l LEFT JOIN f USING (place_id)""",
)
def ver_first_brand_self(spark, sf):
    found = v.first_brand(history(spark, sf, "brand", "name"), self_prior=True)
    return found.select("place_id", "brand", "prior_name")


@query(
    "ver_parent_first",
    HISTORY
    + """SELECT p.place_id, f.version_ts, coalesce(f.parent, 'None') AS parent, f.source
         FROM (SELECT DISTINCT place_id FROM v) p LEFT JOIN (
           SELECT * FROM (SELECT v.*, row_number() OVER (PARTITION BY place_id ORDER BY rn) AS k
                          FROM v WHERE parent <> 'None') WHERE k = 1) f USING (place_id)""",
)
def ver_parent_first(spark, sf):
    found = v.parent_first(history(spark, sf, "parent", "source"))
    return found.select("place_id", "version_ts", "parent", "source")


TRACKED = ["hours_badge", "hours_badge_hover", "modern_cat_badge", "modern_cat_badge_hover"]


@query(
    "ver_first_change",
    HISTORY
    + f""", s AS (SELECT v.*, row_number() OVER p AS n,
                  lag(hours_badge) OVER p IS DISTINCT FROM hours_badge
                  OR lag(hours_badge_hover) OVER p IS DISTINCT FROM hours_badge_hover
                  OR lag(modern_cat_badge) OVER p IS DISTINCT FROM modern_cat_badge
                  OR lag(modern_cat_badge_hover) OVER p IS DISTINCT FROM modern_cat_badge_hover
                  AS differs
           FROM v WHERE version_ts >= TIMESTAMP '{THRESHOLD}'
           WINDOW p AS (PARTITION BY place_id ORDER BY rn)),
      c AS (SELECT place_id, min(n) FILTER (WHERE differs AND n > 1) AS change, max(n) AS last FROM s GROUP BY 1)
    SELECT s.place_id, s.version_ts, s.entry_id, c.change IS NOT NULL AS changed,
           CASE WHEN c.change IS NULL THEN 'No change was detected'
                ELSE strftime(s.version_ts, '%Y-%m-%dT%H:%M:%S.%f') END AS changed_at,
           s.hours_badge, s.hours_badge_hover, s.modern_cat_badge, s.modern_cat_badge_hover
    FROM s JOIN c ON s.place_id = c.place_id AND s.n = coalesce(c.change - 1, c.last)""",
)
def ver_first_change(spark, sf):
    return v.first_change(history(spark, sf, *TRACKED), threshold(), TRACKED)


@query(
    "ver_present_vs_edited",
    ASOF
    + """SELECT c.c_custkey AS place_id,
                coalesce(strftime(a.version_ts, '%-m/%-d/%Y'), '') AS edited_at,
                coalesce('System Revert | ' || a.event_type, '') AS version_header,
                c.c_mktsegment AS present_badge, coalesce(a.badge, '') AS edited_badge,
                c.c_mktsegment || ' (' || c.c_nationkey || ')' AS source_level_2
         FROM customer c LEFT JOIN chosen a ON c.c_custkey = a.place_id""",
)
def ver_present_vs_edited(spark, sf):
    places = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("place_id"),
        F.col("c_mktsegment").alias("present_badge"),
        F.concat(
            "c_mktsegment", F.lit(" ("), F.col("c_nationkey").cast("string"), F.lit(") rest – "), "c_name"
        ).alias("title"),
    )
    return v.present_vs_edited(
        places, history(spark, sf, "badge", "header"), threshold(), "badge", "header", "title"
    )


@query(
    "ver_header_asof",
    ASOF + "SELECT place_id, 'System Revert | ' || event_type AS version_header FROM chosen",
)
def ver_header_asof(spark, sf):
    return v.header_asof(history(spark, sf, "header"), threshold())


@query(
    "ver_notes_asof",
    ASOF
    + "SELECT place_id, CASE WHEN badge = 'Edited' THEN 'v ' || event_type ELSE '' END AS rca_note FROM chosen",
)
def ver_notes_asof(spark, sf):
    return v.notes_asof(history(spark, sf, "badge", "notes_json"), threshold())
