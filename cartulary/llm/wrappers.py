"""Main texts by wrapper induction: what pages of a host have in common is template, what varies is content.

1. Each page is read once into a skeleton and its blocks of text (``domtree``).
2. The most frequent skeleton of a host is its wrapper. Every other skeleton of the host is aligned with it by simple
   tree matching: equal labels meet, children in order, as many nodes as possible. A skeleton that has too little in
   common with it is a wrapper of its own.
3. Blocks of all pages are counted at the wrapper's slots. A text that stands in one slot on nearly all pages of different
   titles is template. The rest varies, and the subtree with most of it is where the content is; an article or main
   element says so itself. Elements marked as boilerplate are content nowhere.
4. A page's text is what stands at or below the content nodes and is no template.

Counting, joining and cutting are column work; Python reads pages and aligns the distinct skeletons. No text leaves its
row, save as a hash.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartulary.llm.common import written
from cartulary.llm.domtree import read
from cartulary.llm.shingles import slices
from cartulary.operators.hotkeys import lookup

FITS = 0.5  # share of nodes two skeletons must have in common to be one wrapper
MOST = 0.7  # share of the varying text below a child that makes it the content rather than its parent
CONSTANT = 0.9  # share of the pages with a slot that must show a text there
TITLES, TITLES_INSIDE = 3, 10  # different titles such pages must have, outside and inside an article
ROWS_KNOWN = 64  # rows of weights held at once while two lists of children are aligned; others are looked up again
TEXT_TAGS = frozenset("h1 h2 h3 h4 h5 h6 p ul ol dl pre blockquote".split())
CONTAINERS = frozenset("div main section article center table tbody tr td span form body font fieldset details".split())


class Skeleton:
    """A decoded skeleton: nodes in preorder."""

    def __init__(self, said: str) -> None:
        self.labels: list[str] = []
        self.parents: list[int] = []
        self.children: list[list[int]] = []
        self.ends: list[int] = []  # behind the last node below
        path: list[int] = []
        for i, line in enumerate(said.split("\n")):
            depth, _, label = line.partition(" ")
            while len(path) > int(depth):
                self.ends[path.pop()] = i
            self.labels.append(label)
            self.parents.append(path[-1] if path else -1)
            self.children.append([])
            self.ends.append(i + 1)
            if path:
                self.children[path[-1]].append(i)
            path.append(i)
        for node in path:
            self.ends[node] = len(self.labels)
        self.marked: list[bool] = []
        self.inside: list[bool] = []  # of an article or main element
        for label, parent in zip(self.labels, self.parents, strict=True):
            self.marked.append(label.endswith("!") or (parent >= 0 and self.marked[parent]))
            own = self.tag_of(label) in ("article", "main") and not self.marked[-1]
            self.inside.append(own or (parent >= 0 and self.inside[parent]))

    @staticmethod
    def tag_of(label: str) -> str:
        return label.rstrip("!").partition(".")[0]

    def __len__(self) -> int:
        return len(self.labels)


def _best(weights: Callable[[int], np.ndarray], k: int, m: int, paired: bool) -> tuple[int, list[tuple[int, int]]]:
    """The heaviest pairing of k rows with m columns, both in order: its weight and, if asked for, its pairs.
    ``weights`` gives a row.

    Of the table of best weights only about sqrt(k) rows are kept. The way back works out those between once more, a
    stretch at a time, so lists of every length are paired alike and never need the whole table.
    """
    step = math.isqrt(k) + 1

    def below(row: np.ndarray, low: int, high: int) -> Iterator[np.ndarray]:
        for i in range(low, high):
            after = row.copy()
            np.maximum(row[1:], row[:-1] + weights(i)[: len(row) - 1], out=after[1:])
            row = np.maximum.accumulate(after, out=after)
            yield row

    last = np.zeros(m + 1, dtype=np.int64)
    kept = [last]  # rows 0, step, 2 step and so on
    for i, last in enumerate(below(last, 0, k), 1):
        if i % step == 0:
            kept.append(last)
    pairs, i, j = [], k if paired else 0, m
    while i and j:
        low = (i - 1) // step * step
        table = [kept[low // step][: j + 1]]
        table.extend(below(table[0], low, i))
        while i > low and j:
            here, above = table[i - low], table[i - low - 1]
            if here[j] == above[j]:
                i -= 1
            elif here[j] == here[j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                pairs.append((i, j))
    return int(last[m]), pairs[::-1]


class Matching:
    """Simple tree matching of two skeletons."""

    def __init__(self, a: Skeleton, b: Skeleton) -> None:
        self.a, self.b = a, b
        self.shapes: dict[tuple, int] = {}
        self.sizes: list[int] = []
        self.parts: list[tuple[int, ...]] = []
        self.names: list[str] = []
        self.of_a, self.of_b = self._shapes(a), self._shapes(b)
        self.weights: dict[tuple[int, int], int] = {}
        self.weight = self._weigh(self.of_a[0], self.of_b[0])
        self.score = 2 * self.weight / (len(a) + len(b))

    def _shapes(self, tree: Skeleton) -> list[int]:
        out = [0] * len(tree)
        for i in range(len(tree) - 1, -1, -1):
            parts = tuple(out[c] for c in tree.children[i])
            key = (tree.labels[i], *parts)
            if key not in self.shapes:
                self.shapes[key] = len(self.sizes)
                self.sizes.append(1 + sum(self.sizes[p] for p in parts))
                self.parts.append(parts)
                self.names.append(tree.labels[i])
            out[i] = self.shapes[key]
        return out

    def _pairing(self, x: Sequence[int], y: Sequence[int], paired: bool) -> tuple[int, list[tuple[int, int]]]:
        """The best pairing of two lists of shapes; equal beginnings and ends are paired at once."""
        low = 0
        while low < min(len(x), len(y)) and x[low] == y[low]:
            low += 1
        high = 0
        while high < min(len(x), len(y)) - low and x[-1 - high] == y[-1 - high]:
            high += 1
        ends = [(i, i) for i in range(low)] + [(len(x) - high + i, len(y) - high + i) for i in range(high)]
        total = sum(self.sizes[x[i]] for i, _ in ends)
        mx, my = x[low : len(x) - high], y[low : len(y) - high]
        if mx and my:
            weight, pairs = _best(self._rows(mx, my), len(mx), len(my), paired)
            total += weight
            ends += [(low + i, low + j) for i, j in pairs]
        return total, sorted(ends)

    def _rows(self, x: Sequence[int], y: Sequence[int]) -> Callable[[int], np.ndarray]:
        """The weights of one entry of the first list with all of the second, by its place; looked up once a shape."""
        shapes: dict[int, int] = {}
        places = np.array([shapes.setdefault(q, len(shapes)) for q in y])
        known: dict[int, np.ndarray] = {}

        def row(i: int) -> np.ndarray:
            if x[i] not in known:
                if len(known) == ROWS_KNOWN:
                    known.clear()
                known[x[i]] = np.array([self.weights.get((x[i], q), 0) for q in shapes], dtype=np.int64)
            return known[x[i]][places]

        return row

    def _weigh(self, p: int, q: int) -> int:
        """How many nodes two shapes share at most; all pairs of shapes that may meet below are weighed first."""
        todo = [(p, q)]
        while todo:
            x, y = todo[-1]
            if (x, y) in self.weights:
                todo.pop()
            elif x == y:
                self.weights[x, y] = self.sizes[x]
            elif self.names[x] != self.names[y]:
                self.weights[x, y] = 0
            else:
                named: dict[str, set[int]] = {}
                for c in self.parts[y]:
                    named.setdefault(self.names[c], set()).add(c)
                below = [(c, d) for c in set(self.parts[x]) for d in named.get(self.names[c], ()) if (c, d) not in self.weights]
                if below:
                    todo.extend(below)
                else:
                    self.weights[x, y] = 1 + self._pairing(self.parts[x], self.parts[y], paired=False)[0]
        return self.weights[p, q]

    def pairs(self) -> list[int]:
        """For each node of the first skeleton the node of the second it is matched with, or -1."""
        out = [-1] * len(self.a)
        if not self.weight:
            return out
        todo = [(0, 0)]
        while todo:
            i, j = todo.pop()
            out[i] = j
            x, y = self.a.children[i], self.b.children[j]
            found = self._pairing([self.of_a[c] for c in x], [self.of_b[d] for d in y], paired=True)[1]
            todo.extend((x[s], y[t]) for s, t in found if self.a.labels[x[s]] == self.b.labels[y[t]])
        return out


def content_nodes(tree: Skeleton, masses: dict[int, int]) -> list[tuple[int, int]]:
    """Where a wrapper has its content, as ranges of nodes; ``masses`` is the varying text at its slots."""
    mass = [0] * len(tree)
    for i in range(len(tree) - 1, -1, -1):
        if not tree.marked[i]:
            mass[i] += max(0, masses.get(i, 0))
            if i:
                mass[tree.parents[i]] += mass[i]
    tags = [tree.tag_of(label) for label in tree.labels]

    def outermost(tag: str) -> list[int]:
        found, end = [], 0
        for i in range(len(tree)):
            if i >= end and tags[i] == tag and not tree.marked[i] and mass[i]:
                found.append(i)
                end = tree.ends[i]
        return found

    chosen = outermost("article") or outermost("main")
    if not chosen:
        node = 0
        while True:
            below = max(tree.children[node], key=lambda c: mass[c], default=None)
            if below is None or tags[below] not in CONTAINERS or mass[below] < MOST * mass[node] or not mass[below]:
                break
            if any(mass[c] and tags[c] in TEXT_TAGS for c in tree.children[node]):
                break  # titles and paragraphs stand here beside what is below
            node = below
        chosen = [node]
    ranges = [(i, tree.ends[i]) for i in chosen]
    titles = [i for i in range(len(tree)) if tags[i] == "h1" and not tree.marked[i]]
    if not any(low <= t < high for t in titles for low, high in ranges):
        ranges += [(t, tree.ends[t]) for t in titles]
    return ranges


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


READ = (
    "site string, skel binary, skeleton string, vote long, nodes array<int>, texts array<string>, hashes array<long>, "
    "sizes array<int>, links array<int>"
)


def host(url: Column) -> Column:
    """The host of a URL, A-Z lower-cased; empty without ://."""
    named = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(named, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def read_pages(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, html)`` read into skeletons and blocks; a page without host is a site of its own."""
    site = F.when(host(F.col("url")) == "", F.concat_ws(" ", F.lit("page"), "page_id", F.hex(F.xxhash64("url", "html"))))
    named = pages.select("page_id", "url", F.coalesce(site, host(F.col("url"))).alias("site"), "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", *[c.split()[0] for c in READ.split(", ")]]
        for batch in batches:
            for part in slices(batch, 3):
                found = [read(h) for h in part.column(3).to_pylist()]
                columns = [
                    part.column(0),
                    part.column(1),
                    part.column(2),
                    pa.array([hashlib.blake2b(p.skeleton.encode("utf-8", "replace"), digest_size=16).digest() for p in found], pa.binary()),
                    pa.array([p.skeleton.encode("utf-8", "replace").decode() for p in found]),
                    pa.array([_hash(p.title) for p in found], pa.int64()),
                    pa.array([p.nodes for p in found], pa.list_(pa.int32())),
                    pa.array([[t.encode("utf-8", "replace").decode() for t in p.texts] for p in found], pa.list_(pa.string())),
                    pa.array([[_hash(t) for t in p.texts] for p in found], pa.list_(pa.int64())),
                    pa.array([[len(t) for t in p.texts] for p in found], pa.list_(pa.int32())),
                    pa.array([p.links for p in found], pa.list_(pa.int32())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = pages.schema["page_id"].dataType.simpleString()
    return named.mapInArrow(run, f"page_id {kind}, url string, {READ}")


MAP = "array<struct<slot:int,anchor:int,marked:boolean,inside:boolean>>"


def _aligned(skeletons: DataFrame) -> DataFrame:
    """(site, skel, wrapper, map) of ``skeletons(site, skel, skeleton, n)``: for each node its slot in the wrapper."""
    most = F.max(F.struct("n", "skel", "skeleton")).alias("m")
    pivots = skeletons.groupBy("site").agg(most).select("site", F.col("m.skel").alias("pivot"), F.col("m.skeleton").alias("pivot_skeleton"))
    pivots = written(pivots, "pivots")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for site, skel, said, pivot, pivot_said in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tree = Skeleton(said)
                slots, anchors, wrapper = list(range(len(tree))), list(range(len(tree))), skel
                if skel != pivot:
                    match = Matching(tree, Skeleton(pivot_said))
                    if match.score >= FITS:
                        slots, anchors, wrapper = match.pairs(), [], pivot
                        for i, slot in enumerate(slots):  # a node that has no partner stands where its parent does
                            anchors.append(slot if slot >= 0 else anchors[tree.parents[i]])
                cells = zip(slots, anchors, tree.marked, tree.inside, strict=True)
                out.append((site, skel, wrapper, [dict(zip(("slot", "anchor", "marked", "inside"), c, strict=True)) for c in cells]))
            if out:
                cell = pa.struct([("slot", pa.int32()), ("anchor", pa.int32()), ("marked", pa.bool_()), ("inside", pa.bool_())])
                kinds = [pa.string(), pa.binary(), pa.binary(), pa.list_(cell)]
                columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["site", "skel", "wrapper", "map"])

    met = lookup(skeletons.select("site", "skel", "skeleton"), pivots, ["site"], "inner")
    return met.select("site", "skel", "skeleton", "pivot", "pivot_skeleton").mapInArrow(run, f"site string, skel binary, wrapper binary, map {MAP}")


def _slots(read_: DataFrame, aligned: DataFrame) -> DataFrame:
    """(site, wrapper, slot, h, inside, titles, votes, size): each text of each slot, on how many different titles of how many."""
    rows = read_.where(F.size("nodes") > 0).select("site", "skel", "vote", F.arrays_zip("nodes", "hashes", "sizes", "links").alias("blocks"))
    each = lookup(rows, aligned, ["site", "skel"], "inner", read_.select("site", "skel"))
    each = each.select("site", "wrapper", "vote", "map", F.explode("blocks").alias("b")).withColumn("m", F.get("map", F.col("b.nodes")))
    each = each.where("not m.marked and m.slot >= 0")
    size = F.col("b.sizes") - F.col("b.links")
    here = each.groupBy("site", "wrapper", F.col("m.slot").alias("slot"), F.col("b.hashes").alias("h"), "vote")
    seen = written(here.agg(F.sum(size).alias("size"), F.max("m.inside").alias("inside")), "seen")
    texts = seen.groupBy("site", "wrapper", "slot", "h").agg(F.count(F.lit(1)).alias("titles"), F.sum("size").alias("size"), F.max("inside").alias("inside"))
    votes = seen.select("site", "wrapper", "slot", "vote").distinct().groupBy("site", "wrapper", "slot").agg(F.count(F.lit(1)).alias("votes"))
    return lookup(texts, votes, ["site", "wrapper", "slot"], "inner", seen.select("site", "wrapper", "slot"))


def _regions(wrappers: DataFrame, masses: DataFrame, skeletons: DataFrame) -> DataFrame:
    """(site, wrapper, region) of ``wrappers(site, wrapper)``, which are ``skeletons``, by ``masses(site, wrapper, slot, mass)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())]))
        for batch in batches:
            found = []
            for said, slots in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                tree = Skeleton(said)
                ranges = content_nodes(tree, {s["slot"]: s["mass"] for s in slots or []})
                found.append([{"low": low, "high": high} for low, high in ranges])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, kind)], names=["site", "wrapper", "region"])

    # As many rows a wrapper as it has slots.
    listed = masses.groupBy("site", "wrapper").agg(F.collect_list(F.struct("slot", "mass")).alias("slots"))
    trees = skeletons.select("site", F.col("skel").alias("wrapper"), "skeleton")
    met = wrappers.join(trees, ["site", "wrapper"]).join(listed, ["site", "wrapper"], "left").select("site", "wrapper", "skeleton", "slots")
    return met.mapInArrow(run, "site string, wrapper binary, region array<struct<low:int,high:int>>")


def main_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars): the main text of each row of ``pages(page_id, url, html)``; other columns are ignored.

    Blocks are joined by one line end, white space inside a block is one blank, character references are decoded. A page
    without text, or null, has an empty text. Null and repeated ids and URLs are kept as rows; pages of equal id are read
    apart. Copies of a page vote once for a template, as they have one title. An empty table gives no rows.
    """
    pages_read = written(read_pages(pages), "pages-read", "zstd")
    skeletons = pages_read.groupBy("site", "skel").agg(F.count(F.lit(1)).alias("n"), F.min("skeleton").alias("skeleton"))
    skeletons = written(skeletons, "skeletons", "zstd")
    aligned = written(_aligned(skeletons), "aligned", "zstd")
    enough = F.when(F.col("inside"), TITLES_INSIDE).otherwise(TITLES)
    constant = (F.col("titles") >= enough) & (F.col("titles") >= CONSTANT * F.col("votes"))
    slots = written(_slots(pages_read, aligned).withColumn("constant", constant), "slots")
    masses = slots.where("not constant").groupBy("site", "wrapper", "slot").agg(F.sum("size").alias("mass"))
    # A slot's template texts are at most as many as stand on one page.
    fixed = slots.where("constant").groupBy("site", "wrapper").agg(F.collect_set(F.xxhash64("slot", "h")).alias("fixed"))
    rules = written(_regions(aligned.select("site", "wrapper").distinct(), masses, skeletons).join(fixed, ["site", "wrapper"], "left"), "rules")

    kept = F.transform("map", lambda m: ~m.marked & F.exists("region", lambda r: (m.anchor >= r.low) & (m.anchor < r.high)))
    beside = F.transform("map", lambda m: ~m.marked & (m.slot < 0))  # of a page that has nothing there: what its host's wrapper lacks
    kept = F.when(F.exists(kept, lambda k: k), kept).otherwise(beside)
    decided = lookup(aligned, rules, ["site", "wrapper"], "left", aligned.select("site", "wrapper"))
    decided = decided.select("site", "skel", kept.alias("kept"), F.transform("map", lambda m: m.slot).alias("slots"), "fixed")
    decided = written(decided, "decisions", "zstd")

    rows = pages_read.select("page_id", "url", "site", "skel", F.arrays_zip("nodes", "texts", "hashes").alias("blocks"))
    met = lookup(rows, decided, ["site", "skel"], "left", pages_read.select("site", "skel"))
    none = F.array().cast("array<bigint>")
    stays = F.filter(
        "blocks",
        lambda b: F.coalesce(F.get("kept", b.nodes), F.lit(False))
        & ~F.array_contains(F.coalesce("fixed", none), F.xxhash64(F.get("slots", b.nodes), b.hashes)),
    )
    text = F.array_join(F.transform(stays, lambda b: b.texts), "\n")
    return met.select("page_id", "url", F.coalesce(text, F.lit("")).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
