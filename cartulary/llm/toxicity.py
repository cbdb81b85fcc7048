"""Toxicity of texts that may hide their words: leetspeak, letters set apart, letters repeated.

1. A character language model is counted over all documents.
2. Characters nobody sees go, letters of other widths become plain. Suspicious spans become lattices: a sign may stand for
   a letter, a run of one letter for one or two of it, a gap between single letters for nothing, and each for itself.
   Viterbi decoding under the language model picks the likeliest reading.
3. The restored text is scored by a logistic regression over counts of its character 4- and 5-grams, fitted on labelled
   rows. Only grams that are much more frequent in toxic rows take part. Near copies would make any gram of theirs look
   toxic, so a gram counts only as often as it stands in different contexts.

Counting and scoring run in Arrow batches without a shuffle of texts. The driver holds one table of character
trigrams (at most 64^3 entries), the kept grams (at most MAX_GRAMS) and their counts in at most TRAIN_ROWS rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartulary.llm.common import written
from cartulary.llm.shingles import slices

TRAIN_ROWS = 8_000  # labelled rows a model is fitted on, at most
MAX_GRAMS = 1_000  # grams that enter the regression, the most telling ones
LEAST_SEEN = 4.0  # toxic rows, and different contexts in them, that a gram needs
LEAST_LIFT = 2.0  # times as frequent in toxic rows as in all
RIDGE = 0.3
STEPS = 400

# Signs and the letters they are read as.
READINGS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¥": "y", "µ": "u",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "і": "i", "х": "x", "у": "y", "ѕ": "s", "ј": "j", "ԁ": "d", "һ": "h",
    "к": "k", "м": "m", "т": "t", "в": "b", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t",
    "υ": "u", "χ": "x", "μ": "u", "ı": "i", "ɡ": "g",
}
WILD = "*"  # stands for any letter, or for nothing
LOOSE = "*+|"  # signs that may also stand between letters set apart
UNSEEN = "​‌‍⁠­﻿"  # fixed values: characters without width
LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿœ"  # fixed values

SIGN_COST, KEEP_COST, RUN_COST, DOUBLE_COST, GAP_COST, WILD_COST = -1.0, -4.0, -1.0, -4.0, -0.5, -2.0

# Classes of characters: 0 a border, 1.. the letters, then other letters and digits. Six bits each.
_OTHER, _DIGIT = len(LETTERS) + 1, len(LETTERS) + 2
_TABLE_SIZE = 0x2100
_CLASS = np.zeros(_TABLE_SIZE, dtype=np.uint8)
for _cp in range(_TABLE_SIZE):
    if chr(_cp).isalpha():
        _CLASS[_cp] = _OTHER
for _i, _ch in enumerate(LETTERS):
    _CLASS[ord(_ch)] = _i + 1
_CLASS[48:58] = _DIGIT
_SIGN = np.zeros(_TABLE_SIZE, dtype=bool)
_SIGN[[ord(c) for c in READINGS if ord(c) < _TABLE_SIZE]] = True
_SIGN[ord(WILD)] = True
_SPACE = np.zeros(_TABLE_SIZE, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32, 0x85, 0xA0]] = True


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts with a line end after each, cut to the table, and where each text starts."""
    joined = "\n".join(texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
    far = points >= _TABLE_SIZE
    if far.any():
        points = points.copy()
        points[far] = _TABLE_SIZE - 1
    return points, np.concatenate(([0], np.cumsum(lengths)[:-1]))


# -- language model -----------------------------------------------------------------------------------------


def trigram_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Counts of character trigrams over all texts, 64 x 64 x 64."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << 18, dtype=np.int64)
        for batch in batches:
            for part in slices(batch, 0):
                points, _ = _points([(t or "").lower() for t in part.column(0).to_pylist()])
                c = _CLASS[points].astype(np.int32)
                code = (c[:-2] << 12) | (c[1:-1] << 6) | c[2:]
                counts += np.bincount(code, minlength=1 << 18)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["code", "n"])

    found = docs.select(text).mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    table = np.zeros(1 << 18, dtype=np.float64)
    for row in found.collect():  # at most 64^3 rows
        table[row["code"]] = row["n"]
    return table.reshape(64, 64, 64)


def log_model(counts: np.ndarray) -> np.ndarray:
    """log P(c | a, b), backed off to bigrams and single characters."""
    one = counts.sum(axis=(0, 1)) + 0.5
    one /= one.sum()
    two = counts.sum(axis=0)
    two = (two + 20 * one) / (two.sum(axis=1, keepdims=True) + 20)
    three = (counts + 8 * two[None]) / (counts.sum(axis=2, keepdims=True) + 8)
    return np.log(three).astype(np.float32)


# -- decoding -----------------------------------------------------------------------------------------------


_HIDDEN = re.compile(f"[{UNSEEN}]")


def unveiled(text: str | None) -> str:
    """Lower case, without characters nobody sees, and with letters of other widths and styles as plain ones."""
    text = (text or "").lower()
    if text.isascii():
        return text
    if not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFKC", text).lower()
    return _HIDDEN.sub("", text)


def _units(span: str) -> list[list[tuple[str, float]]]:
    """The lattice of a span: for each stretch what it may say, and the cost. Plain readings cost least."""
    units: list[list[tuple[str, float]]] = []
    i = 0
    while i < len(span):
        ch, j = span[i], i + 1
        while j < len(span) and span[j] == ch:
            j += 1
        run, i = j - i, j
        if ch.isalpha() and ch not in READINGS:
            units.append([(ch, 0.0)] if run == 1 else [(ch, RUN_COST if run > 2 else DOUBLE_COST), (ch * 2, 0.0)])
        elif ch in READINGS or ch == WILD:
            letters = READINGS.get(ch, "abcdefghijklmnopqrstuvwxyz")
            cost = WILD_COST if ch == WILD else SIGN_COST
            read = [(letter, cost) for letter in letters]
            if run > 1 and ch != WILD:
                read += [(letter * 2, 2 * cost) for letter in letters]
            if ch in LOOSE:
                read.append(("", GAP_COST))
            units.append([*read, (ch * run, KEEP_COST)])
        else:
            while i < len(span) and not span[i].isalpha() and span[i] not in READINGS and span[i] != WILD:
                i += 1
            units.append([("", GAP_COST), (" ", 0.0)])
    return units


def decode_span(span: str, model: np.ndarray) -> str:
    """The likeliest reading of a lower-case span, its plain one included."""
    units = _units(span)
    table = model
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for options in units:
        reached: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (score, back) in states.items():
            for read, cost in options:
                x, y, total = a, b, score + cost
                for letter in read:
                    c = _class_of(letter)
                    total += float(table[x, y, c])
                    x, y = y, c
                if (x, y) not in reached or reached[x, y][0] < total:
                    reached[x, y] = (total, (read, back) if read else back)
        states = reached
    best = max(states.items(), key=lambda s: (s[1][0] + float(table[s[0][0], s[0][1], 0]), s[0]))[1][1]
    out = []
    while best is not None:
        out.append(best[0])
        best = best[1]
    return "".join(reversed(out))


def _class_of(ch: str) -> int:
    cp = ord(ch)
    return int(_CLASS[cp]) if cp < _TABLE_SIZE else _OTHER


def _edges(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of set flags begin and end."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False])).astype(np.int8)))
    return edge[::2], edge[1::2]


def _punctuation(points: np.ndarray, space: np.ndarray) -> np.ndarray:
    """Signs that do what they always do: exclamation marks that end a token, brackets that open one."""
    plain = np.zeros(len(points), dtype=bool)
    low, high = _edges(points == ord("!"))
    ends = (high == len(points)) | space[np.minimum(high, len(points) - 1)]
    first, last = _edges(points == ord("("))
    opens = (first == 0) | space[np.maximum(first - 1, 0)]
    for a, b in ((low[ends], high[ends]), (first[opens], last[opens])):
        step = np.zeros(len(points) + 1, dtype=np.int64)
        np.add.at(step, a, 1)
        np.add.at(step, b, -1)
        plain |= np.cumsum(step)[:-1] > 0
    return plain


def suspicious_spans(points: np.ndarray, model: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of spans to decode, in order and apart from each other.

    Tokens (no white space inside) of at least one plain letter, with a sign beside a letter or another sign on either side,
    with three equal letters in a row, or with a doubled letter that the model would rather read once; and three or
    more letters or signs that stand alone, two of them plain letters, with at most three characters between neighbours.
    """
    none = np.zeros(0, dtype=np.int64)
    n = len(points)
    if not n:
        return none, none
    kind = _CLASS[points]
    sign, space = _SIGN[points], _SPACE[points]
    letter = (kind > 0) & (kind < _DIGIT) & ~sign
    near = letter | sign
    beside = np.zeros(n, dtype=bool)
    beside[1:] |= near[:-1]
    beside[:-1] |= near[1:]
    odd = sign & beside & ~_punctuation(points, space)
    same = np.flatnonzero(letter[:-1] & (points[:-1] == points[1:]))
    if len(same):
        before = kind[np.maximum(same - 1, 0)] * (same > 0)
        after = kind[np.minimum(same + 2, n - 1)] * (same + 2 < n)
        c = kind[same]
        once = model[before, c, after] + DOUBLE_COST > model[before, c, c] + model[c, c, after]
        odd[same[once]] = True
        thrice = same[:-1][np.diff(same) == 1]
        odd[thrice] = True
    found: list[tuple[np.ndarray, np.ndarray]] = []
    plain = np.concatenate(([0], np.cumsum(letter)))
    at = np.flatnonzero(odd)
    if len(at):
        gaps = np.flatnonzero(space)  # a line end closes the last text, so every token has one
        after = np.searchsorted(gaps, at)
        ends, first = np.unique(gaps[after], return_index=True)
        before = after[first] - 1
        starts = np.where(before >= 0, gaps[np.maximum(before, 0)] + 1, 0)
        worded = plain[ends] > plain[starts]
        found.append((starts[worded], ends[worded]))
    run_start, run_end = _edges(near)
    single = np.flatnonzero(run_end - run_start == 1)
    if len(single) >= 3:
        ours, next_ = run_start[single[:-1]], run_start[single[1:]]
        lines = np.concatenate(([0], np.cumsum(points == 10)))
        close = (np.diff(single) == 1) & (next_ - ours <= 4) & (lines[next_] == lines[ours])
        low, high = _edges(close)
        starts, ends = run_start[single[low]], run_end[single[high]]
        long = (high - low >= 2) & (plain[ends] - plain[starts] >= 2)
        found.append((starts[long], ends[long]))
    if not sum(len(s) for s, _ in found):
        return none, none
    starts, ends = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    fresh = np.concatenate(([True], starts[1:] >= ends[:-1]))
    firsts = np.flatnonzero(fresh)
    return starts[firsts], ends[np.append(firsts[1:], len(starts)) - 1]


class Restorer:
    """Texts with their suspicious spans replaced by what they most likely say, all in lower case."""

    MEMO = 200_000  # spans remembered; no effect on results

    def __init__(self, model: np.ndarray) -> None:
        self.model = model
        self.memo: dict[str, str] = {}

    def __call__(self, texts: list[str | None]) -> list[str]:
        texts = [unveiled(t) for t in texts]
        points, first = _points(texts)
        starts, ends = suspicious_spans(points, self.model)
        if not len(starts):
            return texts
        if len(self.memo) > self.MEMO:
            self.memo.clear()
        pieces: dict[int, list[str]] = {}
        done: dict[int, int] = {}
        owner = np.searchsorted(first, starts, side="right") - 1
        for doc, start, end in zip(owner.tolist(), (starts - first[owner]).tolist(), (ends - first[owner]).tolist(), strict=True):
            span = texts[doc][start:end]
            plain = self.memo.get(span)
            if plain is None:
                plain = self.memo[span] = decode_span(span, self.model)
            pieces.setdefault(doc, []).extend((texts[doc][done.get(doc, 0) : start], plain))
            done[doc] = end
        for doc, parts in pieces.items():
            texts[doc] = "".join(parts) + texts[doc][done[doc] :]
        return texts


# -- grams --------------------------------------------------------------------------------------------------


def _grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each gram size: positions, codes, and the document of each position.

    Letters only, save that the first character may be a border. Codes of the two sizes differ.
    """
    points, first = _points(texts)
    c = _CLASS[points].astype(np.int64)
    c[c == _DIGIT] = 0
    solid = c > 0
    for size in (4, 5):
        n = len(c) - size + 1
        if n <= 0:
            continue
        code = np.zeros(n, dtype=np.int64)
        whole = np.ones(n, dtype=bool)
        for i in range(size):
            code = (code << 6) | c[i : i + n]
            if i:
                whole &= solid[i : i + n]
        at = np.flatnonzero(whole)
        yield at, code[at] | (size << 32), np.searchsorted(first, at, side="right") - 1


def _contexts(texts: list[str], at: np.ndarray) -> np.ndarray:
    """One of 64 bits for what stands in the eight characters before each position."""
    points, _ = _points(texts)
    c = np.concatenate((np.zeros(8, dtype=np.uint64), _CLASS[points].astype(np.uint64)))
    hashed = np.zeros(len(at), dtype=np.uint64)
    for i in range(8):
        hashed = hashed * np.uint64(0x9E3779B97F4A7C15) + c[at + i]
    return np.uint64(1) << ((hashed * np.uint64(0xD1B54A32D192ED03)) >> np.uint64(58))


def _counted(texts: list[str], wanted: np.ndarray, sieve: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place in wanted, count) of the wanted grams."""
    pairs = []
    for _, codes, owner in _grams(texts):
        maybe = np.flatnonzero(sieve[_slot(codes)])
        place = np.searchsorted(wanted, codes[maybe])
        place[place == len(wanted)] = 0
        hit = wanted[place] == codes[maybe] if len(wanted) else np.zeros(0, dtype=bool)
        pairs.append(owner[maybe][hit] * len(wanted) + place[hit])
    if not pairs or not len(wanted):
        return (np.zeros(0, dtype=np.int64),) * 3
    found, counts = np.unique(np.concatenate(pairs), return_counts=True)
    return found // len(wanted), found % len(wanted), counts


def _slot(codes: np.ndarray) -> np.ndarray:
    return ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)).astype(np.int64)


def _sieve(codes: np.ndarray) -> np.ndarray:
    table = np.zeros(1 << 22, dtype=bool)
    table[_slot(codes)] = True
    return table


def _weight_of(counts: np.ndarray) -> np.ndarray:
    return np.log2(1.0 + counts)


def _length(texts: list[str]) -> np.ndarray:
    return np.log2(1.0 + np.fromiter(map(len, texts), dtype=np.float64, count=len(texts))) / 10


def _logit(x: np.ndarray, y: np.ndarray, ridge: float, steps: int) -> np.ndarray:
    """Ridge logistic regression by accelerated gradient steps; the last column of x is the constant."""
    penalty = np.full(x.shape[1], ridge, dtype=x.dtype)
    penalty[-1] = 1e-3
    probe = np.ones(x.shape[1], dtype=x.dtype)
    for _ in range(20):  # the largest eigenvalue bounds the step
        probe = x.T @ (x @ (probe / np.linalg.norm(probe)))
    step = 1.0 / (0.3 * np.linalg.norm(probe) + ridge)
    w = ahead = np.zeros(x.shape[1], dtype=x.dtype)
    for i in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ ahead, -30, 30)))
        new = ahead - step * (x.T @ (p - y) + penalty * ahead)
        ahead = new + (i / (i + 3.0)) * (new - w)
        w = new
    return w


@dataclass(frozen=True)
class ToxicityModel:
    """What scoring needs: the language model, and grams with their weights."""

    language: np.ndarray
    codes: np.ndarray  # sorted
    weights: np.ndarray  # one for each code, then for the length and the constant

    def score(self, docs: DataFrame, text: str = "text", out: str = "score") -> DataFrame:
        """Adds ``out``, 0 to 1, to each row; other columns stay, one of that name is replaced.

        A null text counts as empty; an empty text, or one of signs only, is scored by its length. Equal texts
        score alike.
        """
        kept = docs.drop(out)
        place = kept.columns.index(text)
        schema = T.StructType([*kept.schema.fields, T.StructField(out, T.DoubleType())])
        shared = kept.sparkSession.sparkContext.broadcast(self)  # bounded: 64^3 floats and MAX_GRAMS weights

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = shared.value
            restore, sieve = Restorer(model.language), _sieve(model.codes)
            for batch in batches:
                for part in slices(batch, place):
                    scores = model.scores(restore(part.column(place).to_pylist()), sieve)
                    columns = [*part.columns, pa.array(scores)]
                    yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names, out])

        return kept.mapInArrow(run, schema)

    def scores(self, restored: list[str], sieve: np.ndarray) -> np.ndarray:
        logit = self.weights[-1] + self.weights[-2] * _length(restored)
        text, place, counts = _counted(restored, self.codes, sieve)
        np.add.at(logit, text, self.weights[place] * _weight_of(counts))
        return 1.0 / (1.0 + np.exp(-np.clip(logit, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> ToxicityModel:
    """A model for ``docs(doc_id, text)`` from ``labels(doc_id, toxic)``; other columns are ignored.

    The language model is counted over all documents. Weights are fitted on at most ``train_rows`` labelled rows, those
    of smallest hashed id. A document labelled more than once is toxic if one label says so; null labels and ids
    are left out. Without labelled rows every text scores 0.5, without toxic ones near 0.
    """
    language = log_model(trigram_counts(docs))
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("_toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    train = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "_toxic")
    train = written(train.repartition(8), "labelled-texts")
    codes = _telling_grams(train, language)
    shared = docs.sparkSession.sparkContext.broadcast((language, codes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, wanted = shared.value
        restore, sieve = Restorer(model), _sieve(wanted)
        for batch in batches:
            for part in slices(batch, 0):
                texts = restore(part.column(0).to_pylist())
                owner, place, counts = _counted(texts, wanted, sieve)
                cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
                columns = [
                    part.column(1),
                    pa.array(_length(texts)),
                    pa.array([place[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], type=pa.list_(pa.int64())),
                    pa.array([counts[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], type=pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["toxic", "length", "place", "count"])

    schema = "toxic int, length double, place array<long>, count array<long>"
    rows = train.mapInArrow(run, schema).collect()  # at most train_rows, each with at most MAX_GRAMS pairs
    rows.sort(key=lambda r: (r["length"], r["toxic"], r["place"], r["count"]))  # sums must not depend on the order
    x = np.zeros((len(rows), len(codes) + 2), dtype=np.float32)
    for i, row in enumerate(rows):
        x[i, row["place"]] = _weight_of(np.array(row["count"]))
        x[i, -2], x[i, -1] = row["length"], 1.0
    y = np.array([r["toxic"] for r in rows], dtype=np.float32)
    weights = _logit(x, y, RIDGE, STEPS) if len(rows) else np.zeros(len(codes) + 2)
    return ToxicityModel(language, codes, weights.astype(np.float64))


def _telling_grams(train: DataFrame, language: np.ndarray) -> np.ndarray:
    """Grams that are much more frequent in toxic rows, in several contexts."""
    shared = train.sparkSession.sparkContext.broadcast(language)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore = Restorer(shared.value)
        for batch in batches:
            for part in slices(batch, 0):
                texts = restore(part.column(0).to_pylist())
                toxic = np.array(part.column(1).to_pylist(), dtype=bool)
                for at, codes, owner in _grams(texts):
                    order = np.argsort(codes, kind="stable")
                    at, codes, owner = at[order], codes[order], owner[order]
                    distinct, begin = np.unique(codes, return_index=True)
                    if not len(distinct):
                        continue
                    fresh = np.ones(len(codes), dtype=bool)  # first of its document: positions ascend within a code
                    fresh[1:] = (codes[1:] != codes[:-1]) | (owner[1:] != owner[:-1])
                    bad = toxic[owner]
                    seen = np.where(bad, _contexts(texts, at), np.uint64(0))
                    columns = [
                        pa.array(distinct),
                        pa.array(np.add.reduceat((fresh & bad).astype(np.int64), begin)),
                        pa.array(np.add.reduceat((fresh & ~bad).astype(np.int64), begin)),
                        pa.array(np.bitwise_or.reduceat(seen, begin).view(np.int64)),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["code", "toxic", "clean", "contexts"])

    schema = "code long, toxic long, clean long, contexts long"
    sums = train.mapInArrow(run, schema).groupBy("code")
    sums = sums.agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"), F.bit_or("contexts").alias("contexts"))
    share = train.agg(F.coalesce(F.avg("_toxic"), F.lit(0.0)).alias("p")).first()["p"]
    filled = F.bit_count("contexts")
    contexts = F.when(filled == 64, F.lit(1e9)).otherwise(-64 * F.log(1 - filled / 64.0))
    seen = F.least(F.col("a").cast("double"), contexts)
    lift = (F.col("a") / (F.col("a") + F.col("b"))) / F.lit(max(share, 1e-9))
    telling = sums.where((seen >= LEAST_SEEN) & (lift >= LEAST_LIFT)).select("code", (seen * F.log(lift)).alias("gain"))
    kept = telling.orderBy(F.desc(F.round("gain", 6)), "code").limit(MAX_GRAMS).collect()
    return np.array(sorted(r["code"] for r in kept), dtype=np.int64)
