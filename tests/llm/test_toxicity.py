"""Hidden words: what spans decode to, and toxic texts whose words are hidden in every way."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from cartulary.llm import toxicity as tx

SF = "/root/testdata/sf0.01"
WORDS = "trash pathetic idiot disgusting worthless stupid clown scum loser moron".split()  # of the given toxic texts
SIGNS = dict(zip("oieastlbg", ["0", "1", "3", "4", "5", "7", "|", "8", "9"], strict=True))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")


@pytest.fixture(scope="module")
def model(spark, docs):
    return tx.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))


HIDDEN = {
    "idi0t": "idiot", "1d1ot": "idiot", "idio7": "idiot", "sh1+": "shi", "a$$": "as", "i d 1 o t": "idiot", "1 d 1 0 t": "idiot",
    "i...d...i...o...t": "idiot", "s h i": "shi", "stuupid": "stupid", "stuppid": "stupid", "st*pid": "stupid", "stttuuupid": "stupid",
    "ｓｔｕｐｉｄ": "stupid", "stu\ufeffpid": "stupid", "\u0455tupid": "stupid", "STU\u200bPID": "stupid", "p@thet1c": "pathetic", "c-l-o-w-n": "clown",
}


@pytest.mark.parametrize("hidden", HIDDEN)
def test_spans(model, hidden):
    assert tx.Restorer(model.language)([f"the of {hidden} and"]) == [f"the of {HIDDEN[hidden]} and"]


@pytest.mark.parametrize("plain", ["well, great!", "(one) two", "that 2024", "100% of 3", "x", "", "a\nb\nc", "7 of 8", "they're"])
def test_plain_texts_stay(model, plain):
    assert tx.Restorer(model.language)([plain]) == [plain]


def leet(word, draw):
    return "".join(SIGNS[c] if c in SIGNS and draw.random() < 0.6 else c for c in word)


def spaced(word, draw):
    return draw.choice([" ", ".", "-", "...", " - "]).join(word)


def repeated(word, draw):
    at = draw.randrange(len(word))
    return word[:at] + word[at] * draw.choice([2, 3, 5]) + word[at + 1 :]


WAYS = {"leet": leet, "spaced": spaced, "repeated": repeated, "leet spaced": lambda w, d: spaced(leet(w, d), d), "leet repeated": lambda w, d: leet(repeated(w, d), d)}


@pytest.mark.parametrize("way", WAYS)
def test_hidden_words_are_found(spark, docs, model, way):
    draw = random.Random(way)
    labels = duckdb.sql(f"SELECT doc_id, max(toxic) FROM '{SF}/labels.parquet' WHERE toxic IS NOT NULL GROUP BY 1").fetchall()
    toxic = {d for d, t in labels if t}
    found = [r for r in model.score(docs).collect() if r["doc_id"] in toxic and r["score"] >= 0.5 and re.search("|".join(WORDS), r["text"].lower())]
    assert len(found) > 10
    hide = lambda m: WAYS[way](m.group().lower(), draw)
    rows = [(r["doc_id"], re.sub(rf"(?i)\b(?:{'|'.join(WORDS)})\b", hide, r["text"])) for r in found]
    hidden = spark.createDataFrame(rows, "doc_id long, text string")
    caught = model.score(hidden).filter("score >= 0.5").count()
    assert caught >= 0.9 * len(found), (caught, len(found))


def test_clean_texts_stay_clean(spark, docs, model):
    labels = spark.read.parquet(f"{SF}/labels.parquet").filter("toxic = 0").select("doc_id").distinct()
    clean = docs.join(labels, "doc_id")
    odd = F.regexp_replace(F.regexp_replace("text", "(?i)o(?=n)", "0"), "the ", "t h e ")
    for text in (F.col("text"), odd):
        scored = model.score(clean.select("doc_id", text.alias("text")))
        assert scored.filter("score >= 0.5").count() <= 0.03 * scored.count()
