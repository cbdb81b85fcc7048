"""Main texts: the given pages against a plain reading, hand-made sites without an article element, odd markup, alignment."""

import html
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from cartulary.llm.domtree import read, says_boilerplate
from cartulary.llm.q_html import op12
from cartulary.llm.wrappers import Matching, Skeleton, content_nodes, main_texts

SCHEMA = "page_id long, url string, html string"


def plain(page):
    """The text of the pages given: what stands in their article, cut at its titles and paragraphs."""
    article = re.search(r"<article>(.*?)</article>", page, re.S).group(1)
    parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", p)).split()) for p in re.split(r"</?(?:h1|p)>", article)]
    return "\n".join(p for p in parts if p)


def texts(spark, rows):
    return {r["page_id"]: r["text"] for r in main_texts(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}


def test_query_on_the_given_pages(spark):
    where = "/root/testdata/sf0.001"
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{where}/pages.parquet").collect()}
    got = op12(spark, where).collect()
    assert len(got) == len(pages)
    for r in got:
        page = pages[r["page_id"]]
        assert (r["url"], r["text"], r["n_chars"]) == (page["url"], plain(page["html"]), len(plain(page["html"])))


def _site(i, draw):
    """A page whose markup says nothing: only other pages tell what is template."""

    def words(n):
        return " ".join(draw.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(draw.randrange(999)) for _ in range(n))

    body = [words(30) for _ in range(draw.randint(1, 6))]
    shown = "".join(f"<p>{p}</p>" for p in body) if i % 2 else "".join(f"<div><p>{p}</div>" for p in body)
    return (
        f"<html><title>{words(4)}</title><body><div class=x1><span>The Daily Site</span> <a href=/>Start</a> <a href=/n>News</a></div>"
        f"<div class=x2><h1>Title {i}</h1>{shown}<div class=x4>Our terms apply to all texts of this site.</div></div>"
        f"<div class=x3>Contact us by post or phone<br>All rights reserved</div></body></html>",
        "\n".join([f"Title {i}", *body]),
    )


def test_template_is_what_pages_share(spark):
    draw = random.Random(1)
    pages = [_site(i, draw) for i in range(24)]
    rows = [(i, f"https://Daily.example/{i}", page) for i, (page, _) in enumerate(pages)]
    assert texts(spark, rows) == {i: want for i, (_, want) in enumerate(pages)}


def test_a_page_unlike_the_others(spark):
    rows = [(i, "http://one.example/", f"<title>{i}</title><div class=a><section><div class=b>text {i} of the page</div></section></div>") for i in range(9)]
    rows.append((9, "http://one.example/", "<title>x</title><div class=a><section><p>another way</p></section></div>"))
    assert texts(spark, rows) == {i: f"text {i} of the page" for i in range(9)} | {9: "another way"}


def test_copies_are_no_template(spark):
    page = "<title>One</title><article><h1>One</h1><p>The same text.</p></article>"
    rows = [(i, "http://copies.example/", page) for i in range(40)] + [(99, "http://copies.example/b", page.replace("One", "Two").replace("same", "other"))]
    got = texts(spark, rows)
    assert got.pop(99) == "Two\nThe other text."
    assert set(got.values()) == {"One\nThe same text."} and len(got) == 40


LAYOUTS = {
    "marks": (
        "<header><h1>Site</h1></header><ul class='main-menu'><li>A</ul><main><h1>T</h1><p>a&nbsp; b<br>c</p><aside>no</aside>"
        "<div class='cookie-notice'>We use cookies</div><p>d &lt;e&gt; &#233;</p><form><label>Mail</label><input></form>"
        "<section id='comments'><h2>Comments</h2><article class='comment'><p>nice</p></article></section></main><footer>F</footer>",
        "T\na b c\nd <e> é",
    ),
    "form round the page": ("<form><div id=page><h1>T</h1><p>one</p><p>two</p></div><input name=q></form>", "T\none\ntwo"),
    "list and table": (
        "<article><h2>L</h2><ul><li>a<li>b</ul><table><tr><td>1<td>2<tr><td>3</table><dl><dt>k<dd>v</dl></article>",
        "L\na\nb\n1 2\n3\nk\nv",
    ),
    "broken": ("<article><p><b>a<i>b</p><p>c</b>d<!-- x --><p>e<script>var t='</p>';</script>f</article></div>rest", "ab\ncd\nef"),
    "line breaks": ("<div>a<br>b<br><br>c<br/> <br/>d</div>", "a b\nc\nd"),
    "hidden": ("<article><p hidden>x</p><p style='display: none'>y</p><p aria-hidden=true>w</p><p>z</p></article>", "z"),
    "quoted sign": ("<article title='a > b'><p class=\"q>r\">t</p></article>", "t"),
    "inline advert": ("<article><p>one <span class='ad'>buy</span> two</p></article>", "one\ntwo"),
    "header of the article": ("<article><header><h1>T</h1></header><p>x</p><footer>by</footer></article>", "T\nx"),
    "no markup": ("just text &amp more &unknown; a < b", "just text & more &unknown; a < b"),
    "empty": ("<html><head><title>t</title></head><body></body></html>", ""),
    "unclosed": ("<article><p>one<!-- never", "one"),
}


@pytest.fixture(scope="module")
def laid_out(spark):
    rows = [(i, f"http://host{i}.example/", page) for i, (page, _) in enumerate(LAYOUTS.values())]
    return texts(spark, rows)


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts(laid_out, name):
    assert laid_out[list(LAYOUTS).index(name)] == LAYOUTS[name][1]


def test_odd_and_empty_tables(spark, odd, empty):
    rows = [(1, None, None), (1, None, "<p>a"), (None, "x", "<p>b"), (None, "http:///", "<p>b"), (2, "http://h/", ""), (2, "http://h/", "<p>c")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit(1) for n in ("site", "skel", "nodes", "map", "text", "fixed")})
    got = sorted((str(r["page_id"]), str(r["url"]), r["text"], r["n_chars"]) for r in main_texts(df).collect())
    want = [(str(i), str(u), (h or "")[3:], len((h or "")[3:])) for i, u, h in rows]
    assert got == sorted(want)
    assert op12(spark, odd).count() == 9
    assert op12(spark, empty).count() == 0


def brute(a, i, b, j):
    """Simple tree matching by its definition."""
    if a.labels[i] != b.labels[j]:
        return 0
    x, y = a.children[i], b.children[j]
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for s in range(len(x)):
        for t in range(len(y)):
            best[s + 1][t + 1] = max(best[s][t + 1], best[s + 1][t], best[s][t] + brute(a, x[s], b, y[t]))
    return 1 + best[-1][-1]


def test_matching_is_the_best_one():
    draw = random.Random(7)

    def tree():
        lines, depth = ["0 r"], 0
        for _ in range(draw.randint(0, 14)):
            depth = draw.randint(1, depth + 1)
            lines.append(f"{depth} {draw.choice('pdu')}")
        return Skeleton("\n".join(lines))

    for _ in range(300):
        a, b = tree(), tree()
        match = Matching(a, b)
        assert match.weight == brute(a, 0, b, 0)
        pairs = [(i, j) for i, j in enumerate(match.pairs()) if j >= 0]
        assert len(pairs) == match.weight and len({j for _, j in pairs}) == len(pairs)
        for i, j in pairs[1:]:
            assert a.labels[i] == b.labels[j] and (a.parents[i], b.parents[j]) in pairs


def test_long_lists_are_matched_like_short_ones():
    def tree(n, first):
        return Skeleton("\n".join(["0 r", *(f"1 p\n2 c{i % 5}" for i in range(first, first + n))]))

    for n in (50, 4_500):  # a list and the same one moved by one place
        match = Matching(tree(n, 0), tree(n, 1))
        assert match.weight == 1 + 2 * (n - 1)
        assert match.pairs() == [0, -1, -1, *range(1, 2 * n - 1)]


def test_content_is_where_most_text_varies():
    tree = Skeleton("0 \n1 div\n2 #\n1 div\n2 div\n3 p\n4 #\n2 div\n3 #")
    assert content_nodes(tree, {2: 1, 6: 90, 8: 5}) == [(4, 7)]
    assert content_nodes(tree, {2: 1, 6: 50, 8: 50}) == [(3, 9)]
    assert content_nodes(tree, {}) == [(0, 9)]
    titled = Skeleton("0 \n1 div\n2 h1\n3 #\n2 div\n3 p\n4 #\n1 div\n2 #")
    assert content_nodes(titled, {3: 5, 6: 90, 8: 5}) == [(1, 7)]


def test_boilerplate_names():
    for name in ("ad", "ad-slot", "siteHeader", "reader-comments", "cookie_notice", "sidebar-left", "nav"):
        assert says_boilerplate(name), name
    for name in ("", "has-sidebar", "article", "content", "header-image-story", "shared-memory", "address", "shadow", "post"):
        assert not says_boilerplate(name), name


@pytest.mark.parametrize("page", ["<li>a" * 30_000, "<div>" * 30_000 + "x", "<i>" * 30_000 + "</b>" * 30_000, '<a title="' * 30_000, "<dt>a<dd><p>b" * 8_000, "<" * 50_000])
def test_long_pages_are_read_in_linear_time(page):
    start = time.perf_counter()
    read(page)
    assert time.perf_counter() - start < 5
