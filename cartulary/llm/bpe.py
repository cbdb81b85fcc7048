"""Byte-level BPE: texts to token ids and back.

Each Arrow batch is cut into words by the tokenizer's pattern, every distinct word is folded by ranked merges
once, and a document's ids are the ids of its words in a row. Decoding joins the byte pieces of the ids.
Nothing is shuffled; a task holds one batch and a bounded memo of words.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cartulary.llm.shingles import slices

SHORT = 48  # bytes up to which words are folded many at a time; longer ones go one by one
MEMO_WORDS = 300_000  # distinct words a worker remembers before it starts afresh; no effect on results
SLICE_BYTES = 4 << 20  # text worked on at once

_NONE = np.iinfo(np.int32).max


@dataclass(frozen=True)
class Tokenizer:
    """Ranks (piece -> id) and the pattern that cuts text into words. Bounded: one vocabulary file."""

    ranks: dict[bytes, int]
    pattern: str

    @classmethod
    def read(cls, path: str, pattern: str) -> Tokenizer:
        """Reads a rank file: one ``base64(piece) rank`` a line. The driver reads it; tasks get the ranks."""
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        missing = [i for i in range(256) if bytes([i]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")
        return cls(ranks, pattern)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of pieces that together are a piece: sorted codes of the pair, and the rank of the whole."""
        codes, ranks = [], []
        for whole, rank in self.ranks.items():
            for cut in range(1, len(whole)):
                left, right = self.ranks.get(whole[:cut]), self.ranks.get(whole[cut:])
                if left is not None and right is not None:
                    codes.append(left << 32 | right)
                    ranks.append(rank)
        order = np.argsort(codes)
        return np.array(codes, dtype=np.int64)[order], np.array(ranks, dtype=np.int32)[order]


class Folder:
    """Merges the neighbours of lowest rank, leftmost first, until no pair of a word is in the vocabulary."""

    def __init__(self, tokenizer: Tokenizer) -> None:
        self.ranks = tokenizer.ranks
        self.codes, self.merged = tokenizer.pairs()
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.int32)

    def __call__(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word."""
        out: list[list[int]] = [[]] * len(words)
        by_length: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            rank = self.ranks.get(word)
            if rank is not None:
                out[i] = [rank]
            elif len(word) > SHORT:
                out[i] = [self.ranks[piece] for piece in _fold_long(word, self.ranks)]
            elif word:
                by_length.setdefault(len(word), []).append(i)
        for length, places in by_length.items():
            data = np.frombuffer(b"".join(words[i] for i in places), dtype=np.uint8).reshape(-1, length)
            self._fold(self.single[data], np.array(places), out)
        return out

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if not len(self.codes):
            return np.full(left.shape, _NONE, dtype=np.int32)
        code = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.codes, code)
        at[at == len(self.codes)] = 0
        return np.where(self.codes[at] == code, self.merged[at], _NONE)

    def _fold(self, ids: np.ndarray, places: np.ndarray, out: list[list[int]]) -> None:
        """Words of one length, a row each; every round merges one pair of every row that has one left."""
        ranks = self._rank(ids[:, :-1], ids[:, 1:])
        while True:
            best = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(ids), dtype=np.int64)
            lowest = np.take_along_axis(ranks, best[:, None], 1)[:, 0] if ranks.shape[1] else np.full(len(ids), _NONE)
            live = lowest != _NONE
            for place, done in zip(places[~live].tolist(), ids[~live].tolist(), strict=True):
                out[place] = done
            if not live.any():
                return
            ids, ranks, places, best, lowest = ids[live], ranks[live], places[live], best[live], lowest[live]
            row, width = np.arange(len(ids)), ids.shape[1]
            ids[row, best] = lowest  # a piece's id is its rank
            keep = np.arange(width - 1)[None, :]
            ids = np.take_along_axis(ids, keep + (keep > best[:, None]), 1)
            keep = np.arange(width - 2)[None, :]
            ranks = np.take_along_axis(ranks, keep + (keep >= best[:, None]), 1)
            has_right, has_left = best < width - 2, best > 0
            r, b = row[has_right], best[has_right]
            ranks[r, b] = self._rank(ids[r, b], ids[r, b + 1])
            r, b = row[has_left], best[has_left] - 1
            ranks[r, b] = self._rank(ids[r, b], ids[r, b + 1])


def _fold_long(word: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The same fold with a heap over a linked list, n log n for words of any length."""
    n = len(word)
    end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[int, int, int]] = []  # rank, where the pair starts, where it ends

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (rank := ranks.get(word[i : end[j]])) is not None:
            heapq.heappush(heap, (rank, i, end[j]))

    for i in range(n):
        offer(i)
    gone = bytearray(n)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if gone[i] or (j := after[i]) >= n or end[j] != stop:
            continue
        end[i], after[i], gone[j] = stop, after[j], 1
        if after[i] < n:
            before[after[i]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [word[i : end[i]] for i in range(n) if not gone[i]]


def encode(docs: DataFrame, tokenizer: Tokenizer, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """Adds ``ids``, the token ids of ``text``, to each row; all other columns stay as they are.

    A null or empty text has no tokens. Equal rows get equal ids; no rows give no rows. A column that
    already has the name ``ids`` is replaced.
    """
    kept = docs.drop(ids)
    place = kept.columns.index(text)
    shared = kept.sparkSession.sparkContext.broadcast(tokenizer)  # one vocabulary file, a few MB
    schema = T.StructType([*kept.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = shared.value
        find = regex.compile(tok.pattern).findall
        fold = Folder(tok)
        memo: dict[str, list[int]] = {}
        for batch in batches:
            for part in slices(batch, place, SLICE_BYTES):
                found = [find(t) if t else [] for t in part.column(place).to_pylist()]
                if len(memo) > MEMO_WORDS:
                    memo.clear()
                fresh = list(set(chain.from_iterable(found)).difference(memo))
                memo.update(zip(fresh, fold([word.encode("utf-8") for word in fresh]), strict=True))
                flat, offsets = array("i"), array("i", [0])
                for words in found:
                    flat.extend(chain.from_iterable(map(memo.__getitem__, words)))
                    offsets.append(len(flat))
                ids_ = np.frombuffer(flat, dtype=np.int32) if flat else np.zeros(0, dtype=np.int32)
                tokens = pa.ListArray.from_arrays(pa.array(np.frombuffer(offsets, dtype=np.int32)), pa.array(ids_))
                yield pa.RecordBatch.from_arrays([*part.columns, tokens], names=[*part.schema.names, ids])

    return kept.mapInArrow(run, schema)


def decode(coded: DataFrame, tokenizer: Tokenizer, ids: str = "token_ids", decoded: str = "decoded") -> DataFrame:
    """Adds ``decoded``, the bytes the ids stand for, as binary; null ids give empty bytes.

    An id outside the vocabulary ends the job: nothing can be said about its bytes.
    """
    kept = coded.drop(decoded)
    place = kept.columns.index(ids)
    shared = kept.sparkSession.sparkContext.broadcast(tokenizer)
    schema = T.StructType([*kept.schema.fields, T.StructField(decoded, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = {rank: piece for piece, rank in shared.value.ranks.items()}
        for batch in batches:
            column = batch.column(place)
            ends = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))
            flat, start, texts = column.flatten(), 0, []
            for end in ends.tolist():
                texts.append(b"".join(map(pieces.__getitem__, flat.slice(start, end - start).to_numpy().tolist())))
                start = end
            out = pa.array(texts, type=pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, out], names=[*batch.schema.names, decoded])

    return kept.mapInArrow(run, schema)
