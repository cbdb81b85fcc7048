"""Weekly hours: expressions and intervals built from the times of `events`."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartulary.operators import intervals as iv
from cartulary.operators import timetext as tx
from cartulary.plans.registry import query, table

def _minutes():
    return F.hour("ts") * 60 + F.minute("ts")



def _text(*parts):
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _atom(minutes, start=None):
    """`[(t2h9m15){h1m30}]` at the time of the event."""
    at = _minutes() if start is None else start
    hours, rest = F.floor(minutes / 60).cast("int"), (minutes % 60).cast("int")
    return _text(
        "[(t", F.dayofweek("ts"), "h", F.floor(at / 60).cast("int"), "m", (at % 60).cast("int"), "){h", hours,
        "m", rest, "}]",
    )


def _length():
    return (F.floor("value").cast("int") % 400) + 1


EVENT_SQL = """
WITH e AS (SELECT event_id, user_id, event_type, ts, dayofweek(ts) + 1 AS wd,
                  hour(ts) * 60 + minute(ts) AS m, CAST(floor(value) AS INTEGER) % 400 + 1 AS len FROM events)
"""


def cells(spark, sf, cell):
    return table(spark, sf, "events", dealt=True).select(F.col("event_id").alias("key"), cell.alias("cell"))


def flat(spark, sf, kinds):
    """Intervals per user, from an event of the given kinds to its length later."""
    return (
        table(spark, sf, "events")
        .filter(F.col("event_type").isin(kinds))
        .select(
            F.col("user_id").alias("key"),
            F.dayofweek("ts").alias("weekday"),
            _minutes().cast("int").alias("start_min"),
            F.least(_minutes() + _length(), F.lit(1440)).cast("int").alias("end_min"),
        )
    )


A, B = ["error", "view", "click"], ["purchase", "signup"]
# Minutes laid out one by one: slow and plain, which is what an oracle should be.
MINUTE_SQL = (
    EVENT_SQL
    + """, covered AS (
  SELECT DISTINCT user_id AS key, wd, event_type IN ('error', 'view', 'click') AS is_a,
         unnest(range(m, least(m + len, 1440))) AS minute FROM e),
a AS (SELECT key, wd, minute FROM covered WHERE is_a),
b AS (SELECT key, wd, minute FROM covered WHERE NOT is_a),
s AS ({pick}),
g AS (SELECT key, wd, minute, minute - row_number() OVER (PARTITION BY key, wd ORDER BY minute) AS run FROM s)
SELECT key, CAST(wd AS INTEGER) AS weekday, CAST(min(minute) AS INTEGER) AS start_min,
       CAST(max(minute) + 1 AS INTEGER) AS end_min FROM g GROUP BY key, wd, run
"""
)


@query("tx_union", MINUTE_SQL.replace("{pick}", "SELECT * FROM a"))
def tx_union(spark, sf):
    return iv.union(flat(spark, sf, A))


@query("tx_intersect", MINUTE_SQL.replace("{pick}", "SELECT * FROM a INTERSECT SELECT * FROM b"))
def tx_intersect(spark, sf):
    return iv.intersect(flat(spark, sf, A), flat(spark, sf, B))


@query("tx_subtract", MINUTE_SQL.replace("{pick}", "SELECT * FROM a EXCEPT SELECT * FROM b"))
def tx_subtract(spark, sf):
    return iv.subtract(flat(spark, sf, A), flat(spark, sf, B))


@query(
    "join_interval_intersect",
    EVENT_SQL
    + """, x AS (SELECT DISTINCT user_id AS key, wd, m AS s, least(m + len, 1440) AS e,
                        event_type IN ('error', 'view', 'click') AS is_a FROM e),
      p AS (SELECT *, max(e) OVER (PARTITION BY key, wd, is_a ORDER BY s, e
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM x),
      i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END)
                        OVER (PARTITION BY key, wd, is_a ORDER BY s, e) AS island FROM p),
      u AS (SELECT key, wd, is_a, min(s) AS s, max(e) AS e FROM i GROUP BY key, wd, is_a, island)
    SELECT a.key, CAST(a.wd AS INTEGER) AS weekday, CAST(greatest(a.s, b.s) AS INTEGER) AS start_min,
           CAST(least(a.e, b.e) AS INTEGER) AS end_min, CAST(a.s AS INTEGER) AS a_start, CAST(a.e AS INTEGER) AS a_end,
           CAST(b.s AS INTEGER) AS b_start, CAST(b.e AS INTEGER) AS b_end
    FROM u a JOIN u b ON a.key = b.key AND a.wd = b.wd AND a.is_a AND NOT b.is_a AND a.s < b.e AND b.s < a.e""",
)
def join_interval_intersect(spark, sf):
    return iv.join_overlap(flat(spark, sf, A), flat(spark, sf, B))


def mixed_cell():
    """A different kind of cell for each event type."""
    kind = F.col("event_type")
    return (
        F.when(kind == "click", F.concat(F.lit("open "), _atom(_length()), F.lit("+"), _atom(F.lit(30)), F.lit(" x")))
        .when(kind == "view", F.lit("no hours"))
        .when(kind == "error", F.concat(F.lit("[["), _atom(F.lit(45)), F.lit(" then "), _atom(F.lit(15)), F.lit("+]")))
        .otherwise(F.concat(F.lit("["), _atom(_length()), F.lit("-"), _atom(F.lit(10)), F.lit("]")))
    )


MIXED_SQL = EVENT_SQL + """, t AS (SELECT *,
  '[(t' || wd || 'h' || (m // 60) || 'm' || (m % 60) || '){h' AS front FROM e)
"""


@query(
    "tx_extract",
    MIXED_SQL
    + """SELECT event_id AS key, CASE event_type WHEN 'click' THEN front || (len // 60) || 'm' || (len % 60) || '}]'
                WHEN 'view' THEN NULL WHEN 'error' THEN NULL
                ELSE '[' || front || (len // 60) || 'm' || (len % 60) || '}]-' || front || '0m10}]]' END AS expression
         FROM t""",
)
def tx_extract(spark, sf):
    c = cells(spark, sf, mixed_cell())
    return c.select("key", tx.extract_expression("cell").alias("expression"))


@query(
    "tx_snippets",
    MIXED_SQL
    + """SELECT event_id AS key, CASE event_type
             WHEN 'click' THEN front || (len // 60) || 'm' || (len % 60) || '}] ' || front || '0m30}]'
             WHEN 'view' THEN '' WHEN 'error' THEN front || '0m45}] ' || front || '0m15}]'
             ELSE front || (len // 60) || 'm' || (len % 60) || '}] ' || front || '0m10}]' END AS snippets
         FROM t""",
)
def tx_snippets(spark, sf):
    c = cells(spark, sf, mixed_cell())
    return c.select("key", F.array_join(tx.snippets(F.col("cell")), " ").alias("snippets"))


def nested(spark, sf):
    """`[A]+[B]*[[C]-[D]]` around the time of each event."""
    text = F.concat(
        _atom(_length()), F.lit(" + "), _atom(F.lit(300)), F.lit("*["), _atom(F.lit(200)), F.lit("-"),
        _atom(F.lit(20), F.least(_minutes() + 50, F.lit(1439))), F.lit("]"),
    )
    return cells(spark, sf, text)


@query("tx_parse", "SELECT event_id AS key, 4 AS n_atoms, '0 1 2 3 - * +' AS ops FROM events")
def tx_parse(spark, sf):
    parsed = tx.with_parsed(nested(spark, sf), whole=True)
    return parsed.select(
        "key", F.size("parsed.atoms").alias("n_atoms"), F.array_join("parsed.ops", " ").alias("ops")
    )


@query(
    "tx_atoms",
    EVENT_SQL
    + """SELECT event_id AS key, CAST(n AS INTEGER) AS atom_no,
                't' || wd || ' h' || (s // 60) || ' m' || (s % 60) AS quals,
                'h' || (d // 60) || ' m' || (d % 60) AS durs
         FROM (SELECT *, CASE WHEN n = 3 THEN least(m + 50, 1439) ELSE m END AS s,
                      list_extract([len, 300, 200, 20], n + 1) AS d FROM e, range(4) AS r(n))""",
)
def tx_atoms(spark, sf):
    atoms = tx.explode_atoms(tx.with_parsed(nested(spark, sf), whole=True))
    return atoms.select(
        "key", "atom_no", F.array_join("quals", " ").alias("quals"), F.array_join("durs", " ").alias("durs")
    )


@query(
    "tx_atom_intervals",
    EVENT_SQL
    + """, d AS (SELECT *, CASE event_type WHEN 'click' THEN generate_series(0, 6)
                          WHEN 'view' THEN generate_series(0, 2) ELSE [0] END AS days FROM e
                 WHERE event_type <> 'signup')
       SELECT event_id AS key, 0 AS atom_no, CAST((wd - 1 + unnest(days)) % 7 + 1 AS INTEGER) AS weekday,
              CAST(m AS INTEGER) AS start_min, CAST(least(m + len, 1440) AS INTEGER) AS end_min FROM d""",
)
def tx_atom_intervals(spark, sf):
    """All days, a run of days, one day, and an atom without a start."""
    kind = F.col("event_type")
    h, m = F.floor(_minutes() / 60).cast("int"), (_minutes() % 60).cast("int")
    lasts = _text("h", F.floor(_length() / 60).cast("int"), "m", (_length() % 60).cast("int"))
    # The hour is always given, so an event at midnight starts there.
    text = (
        F.when(kind == "click", _text("[(h", h, "m", m, "){", lasts, "}]"))
        .when(kind == "view", _text("[(t", F.dayofweek("ts"), "h", h, "m", m, "){d3", lasts, "}]"))
        .when(kind == "signup", _text("[(t", F.dayofweek("ts"), "){", lasts, "}]"))
        .otherwise(_text("[(t", F.dayofweek("ts"), "h", h, "m", m, "){", lasts, "}]"))
    )
    return tx.atom_interval_table(tx.explode_atoms(tx.with_parsed(cells(spark, sf, text))))


# [A]+[B]*[[C]-[D]]: A from m, B and C from m, D 50 minutes later; minutes laid out one by one.
WEEKLY_SQL = (
    EVENT_SQL
    + """, r AS (SELECT event_id AS key, wd, unnest(range(m, 1440)) AS minute, m, len FROM e),
    s AS (SELECT key, wd, minute FROM r WHERE minute < m + len OR
            (minute < m + 300 AND minute < m + 200
             AND NOT (minute >= least(m + 50, 1439) AND minute < least(m + 50, 1439) + 20))),
    g AS (SELECT key, wd, minute, minute - row_number() OVER (PARTITION BY key, wd ORDER BY minute) AS run FROM s)
    SELECT key, CAST(wd AS INTEGER) AS weekday, CAST(min(minute) AS INTEGER) AS start_min,
           CAST(max(minute) + 1 AS INTEGER) AS end_min FROM g GROUP BY key, wd, run"""
)


@query("tx_weekly", WEEKLY_SQL)
def tx_weekly(spark, sf):
    return tx.weekly(nested(spark, sf))


def _clock_sql(x):
    return (
        f"(CASE WHEN ({x} // 60) % 12 = 0 THEN 12 ELSE ({x} // 60) % 12 END) || ':' || "
        f"lpad(CAST({x} % 60 AS VARCHAR), 2, '0') || CASE WHEN {x} < 720 THEN ' am' ELSE ' pm' END"
    )


RANGE_SQL = f"{_clock_sql('m')} || '–' || {_clock_sql('stop')}"


@query(
    "tx_fmt_range",
    EVENT_SQL + f"SELECT event_id, {RANGE_SQL} AS hours FROM (SELECT *, least(m + len, 1440) AS stop FROM e)",
)
def tx_fmt_range(spark, sf):
    stop = F.least(_minutes() + _length(), F.lit(1440))
    return table(spark, sf, "events").select("event_id", tx.fmt_range(_minutes(), stop).alias("hours"))


DAY_NAMES = ", ".join(f"({i}, '{d}')" for i, d in enumerate(tx.WEEKDAYS, start=1))


@query(
    "tx_week_table",
    EVENT_SQL
    + f"""SELECT event_id AS key, string_agg(d.name || chr(10) ||
              CASE WHEN d.no = wd THEN {RANGE_SQL} ELSE 'Closed' END, chr(10) ORDER BY d.no) AS week
       FROM (SELECT *, least(m + len, 1440) AS stop FROM e), (VALUES {DAY_NAMES}) AS d(no, name)
       GROUP BY event_id""",
)
def tx_week_table(spark, sf):
    parsed = tx.with_parsed(cells(spark, sf, _atom(_length())))
    return parsed.select("key", tx.week_lines(tx.weekly_intervals(F.col("parsed"))).alias("week"))


@query(
    "tx_column",
    EVENT_SQL
    + f"""SELECT event_id AS key, CASE event_type WHEN 'view' THEN '' WHEN 'signup'
                THEN 'No (Closed permanently on ' || strftime(min(ts), '%Y-%m-%d') || ')'
              ELSE string_agg(d.name || chr(10) || CASE WHEN d.no = wd AND event_type <> 'error' THEN {RANGE_SQL}
                   ELSE 'Closed' END, chr(10) ORDER BY d.no) END AS translated
       FROM (SELECT *, least(m + len, 1440) AS stop FROM e), (VALUES {DAY_NAMES}) AS d(no, name)
       GROUP BY event_id, event_type""",
)
def tx_column(spark, sf):
    """Only the first bracket piece of a flat cell counts; a closure mark wins."""
    kind = F.col("event_type")
    date = F.date_format("ts", "'(y'yyyy'M'M'd'd')'")
    cell = (
        F.when(kind == "view", "  ")
        .when(kind == "signup", _text("PERM_CLOSED:[", date, "] ", _atom(F.lit(60))))
        .when(kind == "error", _text("TEMP_CLOSED:[", date, "(y2025M3d28)]"))
        .otherwise(_text(_atom(_length()), "+[(t1h1){h1}]"))
    )
    return tx.translate_column(cells(spark, sf, cell), "cell").drop("cell")


@query(
    "tx_perm_closed",
    """SELECT event_id AS key, CASE event_type WHEN 'view' THEN NULL WHEN 'click' THEN 'No (Closed permanently)'
              WHEN 'error' THEN NULL ELSE 'No (Closed permanently on ' || strftime(ts, '%Y-%m-%d') || ')' END AS line
       FROM events""",
)
def tx_perm_closed(spark, sf):
    kind, date = F.col("event_type"), F.date_format("ts", "'(y'yyyy'M'M'd'd')'")
    cell = (
        F.when(kind == "view", "open")
        .when(kind == "click", "PERM_CLOSED : [soon]")
        .when(kind == "error", _text("TEMP_CLOSED:[", date, "]"))
        .otherwise(_text("x PERM_CLOSED:[", date, "]"))
    )
    return cells(spark, sf, cell).select("key", tx.perm_closed(F.col("cell")).alias("line"))


@query(
    "tx_specials_text",
    """SELECT event_id AS key, CASE event_type WHEN 'view' THEN NULL WHEN 'click' THEN NULL
              WHEN 'error' THEN 'Temporarily closed from ' || strftime(ts, '%B %-d, %Y') || ' to March 28'
              ELSE 'Permanently closed on ' || strftime(ts, '%B %-d, %Y') END AS line FROM events""",
)
def tx_specials_text(spark, sf):
    kind, date = F.col("event_type"), F.date_format("ts", "'(y'yyyy'M'M'd'd')'")
    cell = (
        F.when(kind == "view", "open")
        .when(kind == "click", _text("TEMP_CLOSED:[", date, "]"))
        .when(kind == "error", _text("TEMP_CLOSED:[", date, "(M3d28)]"))
        .otherwise(_text("PERM_CLOSED:[", date, "]"))
    )
    return cells(spark, sf, cell).select("key", tx.specials_text(F.col("cell")).alias("line"))


@query(
    "tx_describe",
    EVENT_SQL
    + f""", w AS (SELECT *, (CASE WHEN (m // 60) % 12 = 0 THEN 12 ELSE (m // 60) % 12 END) || ':' ||
                  lpad(CAST(m % 60 AS VARCHAR), 2, '0') || CASE WHEN m < 720 THEN ' AM' ELSE ' PM' END AS clock,
                  array_to_string(list_filter([
                    CASE WHEN len >= 60 THEN (len // 60) || ' hour' || CASE WHEN len // 60 = 1 THEN '' ELSE 's' END END,
                    CASE WHEN len % 60 > 0 THEN (len % 60) || ' minute' || CASE WHEN len % 60 = 1 THEN '' ELSE 's' END END],
                    lambda x: x IS NOT NULL), ' and ') AS lasts, d.name
           FROM e JOIN (VALUES {DAY_NAMES}) AS d(no, name) ON d.no = wd)
       SELECT event_id AS key, replace(clock || ' for ' || lasts || ' on ' || name || ' except ' || clock
              || ' for 10 minutes on ' || name, '12:00 AM', 'midnight') AS words FROM w""",
)
def tx_describe(spark, sf):
    text = F.concat(F.lit("["), _atom(_length()), F.lit("-"), _atom(F.lit(10)), F.lit("]"))
    parsed = tx.with_parsed(cells(spark, sf, text), whole=True)
    return parsed.select("key", tx.describe(F.col("parsed")).alias("words"))
