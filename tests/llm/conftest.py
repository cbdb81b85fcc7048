"""Small folders of tables: one with odd rows, one with empty tables; and a shared checkpoint folder."""

import pytest

SF = "/root/testdata/sf0.001"

LONG = " ".join(f"word{i % 977}" for i in range(30_000))
COPY = " ".join(f"copy{i}" for i in range(200))
DOCS = [
    (1, "Hello World, this is one line\nand another line of the text", "en", "web", 58),
    (2, "hello world, this is one line\nAND another line of the text", "en", "web", 58),
    (3, None, "en", "web", None),
    (4, "", None, "books", 0),
    (5, "", "de", None, 0),
    (6, LONG, "en", "books", len(LONG)),
    (7, LONG + " end", "en", "web", len(LONG) + 4),
    (8, COPY, "fr", "web", len(COPY)),
    (9, COPY, "fr", "books", len(COPY)),
    (10, COPY + " tail", "fr", None, len(COPY) + 5),
    (11, " \t\n ", "en", "web", 4),
    (12, "ünï çödé 😀 𝒳 ÀB\u00a0c", "xx", "wiki", 15),
    (13, "one", "en", "wiki", 3),
    (14, "a line that stays where it is\nthe quick brown fox jumps over the lazy dog again and again today", "en", "wiki", 99),
    (15, "the quick brown fox jumps over the lazy dog again and again todey\nthe last line of it", "en", "wiki", 87),
    (16, "x" * 20_000, "en", "web", 20_000),
]
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = [(1, 0, 0), (2, None, 1), (None, 1, 1), (8, 1, None), (13, 0, 1), (14, 1, 0), (14, 1, 1)]
PAGES = [
    (1, "http://Example.ORG/en/1x?q", "<p>"),
    (2, "https://sub.shop.com/de/x#y", None),
    (3, None, "<p>"),
    (4, "no scheme", "<p>"),
    (5, "", None),
    (6, "http://casino-win.net/a/", "<p>"),
    (7, "http://casino-win.net/a", "<p>"),
    (8, "a://b://c/d\ne?f", "<p>"),
    (9, "http://notexample.com/fr/", "<p>"),
]
CHATS = [
    (1, 0, "user", "hi"),
    (1, 1, "assistant", "a<b[c]\\d</s>"),
    (2, 0, "assistant", None),
    (3, 0, None, "x"),
    (3, 1, "assistant", ""),
    (4, None, "user", "no turn"),
    (4, 1, "assistant", "<end>\n"),
]
VECTORS = [(1, [1.0, -2.5], 0), (1, [1.0, -2.5], 0), (None, [0.0, 3.0], 1), (3, None, 1), (4, [float("nan"), 1.0], 1), (5, [], 0), (6, [2.0], 0)]


def _tables(spark, where, keep):
    rows = {
        "documents": (DOCS, DOC_SCHEMA),
        "labels": (LABELS, "doc_id long, quality int, toxic int"),
        "pages": (PAGES, "page_id long, url string, html string"),
        "conversations": (CHATS, "conv_id long, turn int, role string, text string"),
        "embeddings": (VECTORS, "vec_id long, embedding array<float>, label int"),
    }
    for name, (listed, schema) in rows.items():
        frame = spark.createDataFrame(listed if keep else [], schema)
        frame.repartition(3).write.parquet(f"{where}/{name}.parquet")
    return str(where)


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    return _tables(spark, tmp_path_factory.mktemp("odd"), True)


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    return _tables(spark, tmp_path_factory.mktemp("empty"), False)
