"""Fields, blocks and sections of pages: worked examples and generated pages with known answers."""

import io
import random
import time
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from cartulary.operators import blocks as bl
from cartulary.operators import outline as ol
from cartulary.operators import pages as pg
from cartulary.plans import registry


def one_page(spark, html):
    return spark.createDataFrame([(1, html)], "page_id bigint, html string")


def field(spark, html, make):
    df = pg.readable(one_page(spark, html))
    return df.select(make(F.col("html"), F.col("cells"), F.col("rows")).alias("x")).first()["x"]


def row(label, value):
    return f'<div title="{label}">{label}</div><div class="col-value">{value}</div>'


CASES = [
    (row("A", "x <b>y</b>"), lambda h, c, r: pg.label_value(c, "A"), "x y"),
    (row("A", "x"), lambda h, c, r: pg.label_value(c, "B"), None),
    # A title goes before a label block, wherever it stands.
    (
        '<div class="col-label__label">A</div><div class="col-value">late</div>' + row("A", "first"),
        lambda h, c, r: pg.label_value(c, "A"),
        "first",
    ),
    (row("Show In Client", "No\n (Closed)"), lambda h, c, r: pg.status_value(c), "No (Closed)"),
    ("<p>none</p>", lambda h, c, r: pg.status_value(c), ""),
    (row("Modern Category", "<a>b</a><a>a</a><a>b</a>"), lambda h, c, r: pg.categories(c), "b, a"),
    (
        "<table class='vendor-contributions-table'><tr><td>1</td><td>V</td></tr></table>",
        lambda h, c, r: pg.table_column(h, c, "Vendor Contributions", "vendor-contributions-table"),
        "V",
    ),
    (row("Hours", '<span class="x-badge">old</span>'), lambda h, c, r: pg.badge(r, "Hours"), "old"),
    (row("Hours", "no"), lambda h, c, r: pg.badge(r, "Hours"), ""),
    (row("Hours", "no"), lambda h, c, r: pg.badge_hover(r, "Hours"), ""),
    (
        row("Hours", '<i class="badge audit-badge" title=" by A&amp;B ">Edited</i>'),
        lambda h, c, r: F.concat(pg.badge(r, "Hours"), pg.badge_hover(r, "Hours")),
        "Editedby A&B",
    ),
    ("<p>x</p>", lambda h, c, r: pg.hours_map(h), {}),
    (
        '<div data-test-id="hours"><span class="text-placeholder">None</span></div>',
        lambda h, c, r: pg.hours_map(h),
        {"__placeholder__": "None"},
    ),
    ("<div title='Name'>Name</div><div> <i>Bo</i> </div>", lambda h, c, r: pg.place_name(h, r), "Bo"),
    ("<header><h2>Top</h2></header><h1>Low</h1>", lambda h, c, r: pg.place_name(h, r), "Top"),
    ("<h1> </h1><h1>Low</h1>", lambda h, c, r: pg.place_name(h, r), "Low"),
    ("<p>x</p>", lambda h, c, r: pg.place_name(h, r), ""),
]


def test_fields(spark):
    """All cases in one job: every page is read by every expression."""
    df = pg.readable(
        spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "page_id int, html string")
    )
    made = [c[1](F.col("html"), F.col("cells"), F.col("rows")).alias(f"x{i}") for i, c in enumerate(CASES)]
    rows = {r["page_id"]: r for r in df.select("page_id", *made).collect()}
    assert [rows[i][f"x{i}"] for i in range(len(CASES))] == [c[2] for c in CASES]


def test_corrections(spark):
    html = (
        '<div title="Corrections">C</div><div><ul><li>a</li><li>b</li></ul><code>{"k": [1, "x  y"]}</code>'
        '<p>t</p><code>[bad</code></div><div title="Z">Z</div>'
    )
    got = field(spark, html, lambda h, c, r: pg.corrections(r))
    assert got["list_items"] == "a ; b"
    assert got["json_blocks"] == '{"k":[1,"x  y"]}'
    assert got["code_blocks"] == "[bad"
    assert got["all_text"] == 'a | b | {"k": [1, "x  y"]} | t | [bad'
    empty = field(spark, "<p>x</p>", lambda h, c, r: pg.corrections(r))
    assert tuple(empty) == ("", "", "", "")


def blocks_of(spark, pages):
    """Blocks of many pages, each as a short tuple."""
    df = spark.createDataFrame(list(enumerate(pages)), "page_id bigint, html string")
    out = [[] for _ in pages]
    for r in bl.extract_blocks(df).orderBy("page_id", "block_no", "sub").collect():
        shown = {
            "heading": ("heading", r["level"], r["text"]),
            "list": ("list", r["ordered"], r["items"]),
            "image": ("image", r["src"], r["alt"]),
            "paragraph": ("paragraph", r["text"]),
        }
        out[r["page_id"]].append(shown[r["type"]])
    return out


EXAMPLES = [
    (
        "<h1>Title</h1><p>hello</p><ul><li>a</li></ul><h2>Next</h2>",
        [("heading", 1, "Title"), ("paragraph", "hello"), ("list", False, ["a"]), ("heading", 2, "Next")],
    ),
    ("<h1>Big <b>bold</b> x</h1>", [("heading", 1, "Bigboldx")]),
    ("<p>a <b> b</b>c<br>d &amp;\n e</p>", [("paragraph", "a b c d &\n e")]),
    (
        "<body>one<br/>two <i>three</i><div>four</div><br>",
        [("paragraph", "one"), ("paragraph", "two three four")],
    ),
    # Bare text at the start of a page stands in an implied paragraph.
    ("one<br/>two <i>three</i><div>four</div><br>", [("paragraph", "one two three"), ("paragraph", "four")]),
    ("<h4>low</h4> text", [("paragraph", "low text")]),
    ("<p>x<img src='1.png' alt='A'>y</p>z", [("paragraph", "x y"), ("image", "1.png", "A"), ("paragraph", "z")]),
    ("<i>a</i><img src=\"2.png\">b", [("paragraph", "a"), ("image", "2.png", None), ("paragraph", "b")]),
    (
        "<ol><li>a<ul><li>b</li></ul> c</li>stray<li><p>d</p><img src='3'></li></ol>",
        [("list", True, ["a b c", "d"]), ("image", "3", None)],
    ),
    ("<ul></ul>", [("list", False, [])]),
    (
        "<head><title>t</title></head><!-- <p>c</p> --><script>'<p>s</p>'</script><b>x</b></ul></p>y",
        [("paragraph", "x y")],
    ),
    ("", []),
]


def test_blocks(spark):
    assert blocks_of(spark, [html for html, _ in EXAMPLES]) == [want for _, want in EXAMPLES]


def generated(rng):
    """A page and its blocks, made together."""
    html, want = [], []
    word = lambda: rng.choice(["red", "ring", "Zone: 4", "x - 7"])
    for _ in range(rng.randint(1, 12)):
        kind = rng.choice(["h", "p", "list", "img", "text"])
        if kind == "h":
            level, text = rng.randint(1, 3), word()
            html.append(f"<h{level} id='x'>{text}</h{level}>")
            want.append(("heading", level, text))
        elif kind == "p":
            a, b = word(), word()
            html.append(f"<p>{a} <b>{b}</b></p>")
            want.append(("paragraph", f"{a} {b}"))
        elif kind == "list":
            items = [word() for _ in range(rng.randint(0, 3))]
            tag = rng.choice(["ul", "ol"])
            deep = "<ul><li>in</li></ul>" if rng.random() < 0.4 else ""
            html.append(f"<div><{tag}>" + "".join(f"<li>{x}{deep}</li>" for x in items) + f"</{tag}></div>")
            want.append(("list", tag == "ol", [x + (" in" if deep else "") for x in items]))
        elif kind == "img":
            html.append(f"<img src='{len(want)}.png'>")
            want.append(("image", f"{len(want)}.png", None))
        else:
            a = word()
            html.append(f"<br>{a}<span> tail</span><br>")
            want.append(("paragraph", f"{a} tail"))
    return "".join(html), want


def test_generated_pages(spark):
    rng = random.Random(11)
    made = [generated(rng) for _ in range(80)]
    assert blocks_of(spark, [html for html, _ in made]) == [want for _, want in made]


def plan(spark, html):
    rows = ol.section_plan(bl.extract_blocks(one_page(spark, html))).orderBy("section_no").collect()
    return [r.asDict(recursive=True) for r in rows]


def test_plan_of_the_short_page(spark):
    got = plan(spark, EXAMPLES[0][0])
    assert [(r["layout"], r["title"], r["section_no"]) for r in got] == [("title", "Title", -1), ("content", "Next", 1)]


def test_section_figures(spark):
    html = (
        "<h2>Deck</h2><h2>S</h2><ul><li>Ticket source</li><li>store - 13</li><li>web - 86</li><li>Zone: North</li></ul>"
        "<p>Total sample: 99</p><p>" + "long text " * 6 + "</p>"
    )
    got = plan(spark, html)[1]
    assert got["bullets"] == ["store: 13", "web: 86", "Zone: North"]
    assert got["subtitle"] == "Total sample: 99"
    assert got["paragraphs"] == [("long text " * 6).strip()]
    (chart,) = got["charts"]
    assert (chart["chart_type"], chart["chart_group"]) == ("pie", "all")
    assert [(p["label"], p["value"], round(p["share"], 2)) for p in chart["data"]] == [("store", 13.0, 0.13), ("web", 86.0, 0.87)]


def test_groups_and_wishes(spark):
    html = (
        "<h3>S</h3><p>a: 1.50; b: 2 | One • c: -4; [chart=LINE]</p><p>d - 0</p><h3>T</h3><p>Date - 10/30/2024 - 16; e - 1; e - 2</p>"
        "<h3>U</h3><p>::: split = yes</p><p>f - 1</p><p>(bar)</p>"
    )
    s, t, u = plan(spark, html)
    assert s["bullets"] == ["a: 1.5", "b: 2", "c: -4", "d: 0"]
    assert [(c["chart_group"], c["chart_type"], [p["label"] for p in c["data"]]) for c in s["charts"]] == [
        ("Group 1", "line", ["a", "b"]), ("One", "line", ["c", "d"]),
    ]
    assert [p["share"] for p in s["charts"][1]["data"]] == [None, None]
    assert t["bullets"] == ["Date: 10/30/2024 - 16", "e: 1", "e: 2"]
    assert [p["label"] for p in t["charts"][0]["data"]] == ["e", "e"]
    assert [(c["chart_group"], c["chart_type"]) for c in u["charts"]] == [("Group 1", "bar")]


def test_split_ahead_of_content_moves_on(spark):
    got = plan(spark, "<p>[split]</p><h3>S</h3><p>a - 1; b - 2</p>")
    assert [c["chart_group"] for c in got[0]["charts"]] == ["Group 1"]
    got = plan(spark, "<p>[split]; z - 1</p><h3>S</h3><p>a - 1; b - 2</p>")
    assert [c["chart_group"] for c in got[1]["charts"]] == ["all"]


def test_split_holds_until_a_section_is_shown(spark):
    (got,) = plan(spark, "<h2></h2><p>[split]</p><h2>Next</h2><p>a - 1</p>")[1:]
    assert [(got["title"], c["chart_group"]) for c in got["charts"]] == [("Next", "Group 1")]
    # Over several that are not shown; a chart choice and a label end with their section.
    html = "<h1>T</h1><h3></h3><p>[split]; (bar); short</p><h3></h3><p>(line)</p><h3>S</h3><p>a - 1; b - 2</p><h3>U</h3><p>c - 1</p>"
    _, s, u = plan(spark, html)
    assert [(c["chart_group"], c["chart_type"]) for c in s["charts"]] == [("Group 1", "pie")]
    assert [c["chart_group"] for c in u["charts"]] == ["all"]
    _, s, u = plan(spark, "<h1>T</h1><h3></h3><p>[split]; 1 - 1</p><h3>S</h3><p>a - 1</p>")
    assert [c["chart_group"] for c in s["charts"] + u["charts"]] == ["Group 1", "all"]


def test_pages_of_equal_or_no_id_stay_apart(spark):
    html = "<h1>{0}</h1><p>{0} - 1</p><ul><li>{0}</ul><img src='{0}'>"
    rows = [(1, html.format("A")), (1, html.format("B")), (None, html.format("C")), (None, html.format("D")), (2, None), (1, html.format("A"))]
    df = spark.createDataFrame(rows, "page_id bigint, html string").repartition(3)
    found = {}
    for r in bl.extract_blocks(df).orderBy("block_no", "sub").collect():
        found.setdefault((r["page_id"], r["page_row"]), []).append(r["text"] or r["src"] or r["items"])
    want = [(i, [x, f"{x} - 1", [x], x]) for i, x in ((1, "A"), (1, "B"), (None, "C"), (None, "D"), (1, "A"))]
    assert sorted(map(str, ((k[0], v) for k, v in found.items()))) == sorted(map(str, want))
    plans = ol.section_plan(bl.extract_blocks(df)).collect()
    assert sorted((str(r["page_id"]), r["bullets"][0]) for r in plans if r["bullets"]) == [
        ("1", "A: 1"), ("1", "A: 1"), ("1", "B: 1"), ("None", "C: 1"), ("None", "D: 1"),
    ]
    titles = [(r["page_id"], r["title"]) for r in ol.deck_titles(bl.extract_blocks(df)).collect()]
    assert sorted(map(str, titles)) == sorted(map(str, [(1, "A"), (1, "A"), (1, "B"), (None, "C"), (None, "D")]))


def test_blocks_are_found_without_a_shuffle(spark):
    plan_ = bl.extract_blocks(one_page(spark, "<p>x</p>"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan_


def test_control_characters_are_text(spark):
    assert blocks_of(spark, ["<p>a\x01b\x04<b>c</b>\x02</p>"]) == [[("paragraph", "a\x01b\x04 c \x02")]]


def test_tags_that_never_end_take_linear_time(spark):
    cell = '<div title="{}">C</div><div class="col-value">{}</div><div title="Next"></div>'
    html = cell.format("Modern Category", "<span>a" * 16_000 + "<a>b</a>") + cell.format("Corrections", "<li>x" * 16_000 + "<code>" * 16_000)
    html += cell.format("Name", "<span>" * 16_000) + "<h1>" * 16_000 + "<td>" * 16_000 + "<li" * 16_000
    df = pg.readable(spark.createDataFrame([("x",)], "a string").select(F.lit(html).alias("html")))
    start = time.perf_counter()
    got = df.select(
        pg.categories(F.col("cells")).alias("c"), pg.corrections(F.col("rows"))["list_items"].alias("l"),
        pg.place_name(F.col("html"), F.col("rows")).alias("n"),
    ).first()
    assert time.perf_counter() - start < 10
    assert (got["c"], got["l"]) == ("b", "")


def test_titles(spark):
    df = spark.createDataFrame(
        [(1, "<h3>a</h3><h2>b</h2><h1>c</h1>"), (2, "<p>x</p>")], "page_id bigint, html string"
    )
    titles = {r["page_id"]: r["title"] for r in ol.deck_titles(bl.extract_blocks(df)).collect()}
    assert titles == {1: "b", 2: "Deck"}


def test_content_before_the_title_flows_on(spark):
    long = "some text that is far too long to be taken as a label here"
    got = plan(spark, f"<h3>A</h3><p>{long}</p><h2>Title</h2><p>{long} too</p><h3>B</h3>")
    assert [(r["title"], r["paragraphs"]) for r in got] == [
        ("Title", []), ("A", [long, long + " too"]), ("B", []),
    ]


def test_number_text_keeps_every_digit(spark):
    cases = {
        1e-13: "0.0000000000001", 0.12345678901234: "0.12345678901234", 5.0: "5", -2.5: "-2.5", 1.5e10: "15000000000",
        123456789.25: "123456789.25", 1e45: "1" + "0" * 45, 0.0: "0", -0.0: "0", 0.0005: "0.0005",
    }
    df = spark.createDataFrame([(v,) for v in cases], "v double")
    assert {r["v"]: r["t"] for r in df.select("v", ol.number_text(F.col("v")).alias("t")).collect()} == cases


def test_long_strings_and_open_tags_take_bounded_time(spark):
    from cartulary.functions.markup import live_markup

    escapes = '{"a" : "' + '\\"' * 20_000 + '", "b" : 1}'
    df = spark.createDataFrame([(escapes,)], "t string")
    assert df.select(pg.minify_json(F.col("t")).alias("t")).first()["t"] == escapes.replace(" ", "")
    opened = "<script " * 10_000 + "<!-- " * 10_000
    df = spark.createDataFrame([(opened,), ("a<!-- x -->b<SCRIPT>q</script >c<script>d",), (None,)], "t string")
    got = [r["t"] for r in df.select(live_markup(F.col("t")).alias("t")).collect()]
    assert got == [opened, "abc<script>d", None]


def test_edit_rows_are_read_once(spark):
    made = queries()["html_edit_rows"](spark, "/root/testdata/sf0.001")
    with redirect_stdout(io.StringIO()) as plan:
        made.explain("formatted")
    assert plan.getvalue().count("yyyy-M-d h:m a") == 1  # each format is tried in one place


def test_a_dealt_table_has_tasks_by_its_rows(spark, monkeypatch):
    monkeypatch.setattr(registry, "ROWS_A_TASK", 50)
    many = registry.table(spark, "/root/testdata/sf0.001", "events", dealt=True)
    sizes = [r["count"] for r in many.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(sizes) == 1000 and len(sizes) == 20 and max(sizes) <= 60
