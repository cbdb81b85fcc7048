"""Pairs of longer lines that may be alike: windows of the longer one that one edit at most can have touched.

A line of a pair is cut into windows, each short enough that some window has fewer than two edits. A window is three
pieces, and an edit spoils one: either two neighbours are whole and stand together in the other line, or the outer two
are, and the one between them is a character longer, shorter or as long. So a key is made of two pieces, some twelve
characters, where a piece that no edit may touch could not have more than nine. The shorter line has two keys at each
place, whatever was edited; where the outer pieces are shifted is asked for by the windows, which are fewer.

Lines that may be a pair by their lengths, and windows and places that may meet by their positions, share a cell: a
line is shipped in stretches, and to more than one group of a range of lengths only where two windows are the stretch. A cell is joined inside its task. Cells are
done in rounds, so that the lines under way on disk at a time do not grow with the table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulary.llm.common import written

SHORTEST = 15  # characters of a window; of shorter ones the pieces would stand everywhere
WAYS = 5  # in which a window is asked for: the first two pieces, the last two, and the outer two shifted by -1, 0, 1
CELL_KEYS = 1_600_000  # keys of the windows of a cell, which a task holds in memory: some 200 MB
ROUND_CHARS = 700_000_000  # characters shipped in one round
CHUNK = 256  # places of a line that are looked at together
READ = 1 << 16  # places of a line that are listed at a time
IN_CELLS = ("spark.sql.requireAllClusterKeysForCoPartition", "false")  # rows that lie by cell are joined by cell and key as they lie


@contextmanager
def held(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """The setting holds for the jobs inside, and is afterwards as it was."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def edits(length: Column, least: float) -> Column:
    """How many edits a pair may have whose longer line has that length."""
    return F.floor(length * (1 - least) + 1e-9).cast("int")


def about(length: Column, least: float) -> Column:
    """The range of lengths a line is in: of the longer line of a pair the same or one more."""
    return F.floor(F.log(length) / -math.log(least)).cast("int")


def widths(least: float) -> list[tuple[int, int]]:
    """(from, width), longest first: lines of that length or more have a window of that width with one edit at most."""
    found = []
    for width in range(math.ceil(2 / (1 - least) - 1e-9) - 1, SHORTEST - 1, -1):
        sure = math.ceil(2 * (width - 1) / width / (2 / width - (1 - least))) + 1
        short = [n for n in range(sure) if 2 * (n // width) <= math.floor(n * (1 - least) + 1e-9)]
        found.append((max([width - 1, *short]) + 1, width))
    return found


def lengths(at: int, least: float) -> int:
    """A length that no line in that range is shorter than."""
    return max(1, math.ceil(least**-at) - 1)


def first_range(least: float) -> int | None:
    """The least range of lengths whose lines are cut into windows; null if none are."""
    found = widths(least)
    return math.ceil(math.log(min(n for n, _ in found) + 1) / -math.log(least)) if found else None


@dataclass(frozen=True)
class _Range:
    """The cells of the pairs whose shorter line is in one range of lengths.

    One for each stretch of ``reach`` characters, whole twos of windows, and each of the ``groups`` that the longer lines
    are dealt to where the shortest stretch of all of them has too many keys.
    """

    width: int
    first: int
    stretches: int
    groups: int
    reach: int
    chars: int

    @property
    def cells(self) -> int:
        return self.stretches * self.groups


def _ranges(sized: DataFrame, least: float) -> dict[int, _Range]:
    """The only rows that reach the driver are one for each tenth by which the length of a line grows."""
    sums = sized.groupBy(about(F.col("size"), least).alias("about"))
    sums = sums.agg(F.sum("size").alias("chars"), F.max("size").alias("top"), F.count(F.lit(1)).alias("n"))
    found = {r["about"]: (r["chars"], r["top"], r["n"]) for r in sums.collect()}
    start, first, out = first_range(least), 0, {}
    for at in sorted(found):
        if start is None or at < start:
            continue
        width = next(w for n, w in widths(least) if n <= lengths(at, least))
        (own, top, n), (more, further, m) = found[at], found.get(at + 1, (0, 0, 0))
        top, two = max(top, further), 2 * width
        keys = 2 * WAYS * (n + m)  # of two windows of each line
        reach = two * max(1, min(CELL_KEYS // keys, -(-min(READ, top) // two)))
        stretches, groups = -(-top // reach), -(-keys * (reach // two) // CELL_KEYS)
        out[at] = _Range(width, first, stretches, groups, reach, own + more + own * groups * (6 + stretches) // 6)
        first += out[at].cells
    return out


def _pieces(width: Column) -> tuple[Column, Column, Column]:
    middle = F.shiftright(width + 1, 2)
    last = F.shiftright(width - middle + 1, 1)
    return width - middle - last, middle, last


def _part(at: Column, length: Column, of: str = "_text") -> Column:
    """Characters of a text that has two bytes for each."""
    return F.substring(of, at * 2 + 1, length * 2)


def _wide(text: Column) -> Column:
    """The text with two bytes for each character; those beyond the first 65,536 count as one and the same."""
    read = F.encode(text, "UTF-16BE")
    plain = F.encode(F.regexp_replace(text, r"[^\x{0}-\x{FFFF}]", "\ufffd"), "UTF-16BE")
    return F.when(F.octet_length(read) == F.length(text) * 2, read).otherwise(plain)


def _keys_of_windows(stretches: DataFrame) -> DataFrame:
    """(cell, key, b, cb, spot) of ``stretches(cell, width, id, class, size, at, text)`` that begin and end with a window."""
    read = stretches.withColumn("_text", _wide(F.col("text")))
    count = F.floor(F.length("_text") / 2 / F.col("width")).cast("int")
    a, b, c = _pieces(F.col("width"))
    read = read.withColumn("_a", a).withColumn("_b", b).withColumn("_c", c)
    each = read.withColumn("_n", F.explode(F.sequence(F.lit(0), count * WAYS - 1)))
    each = each.withColumn("way", F.pmod("_n", F.lit(WAYS))).withColumn("_at", F.expr(f"_n div {WAYS}").cast("int") * F.col("width"))
    at, way, a, b, c = (F.col(x) for x in ("_at", "way", "_a", "_b", "_c"))
    together = F.hash(_part(at + way * a, a + b))
    outer = F.hash(_part(at, a), _part(at + a + b + 4 - way, c - 2))
    key = F.when(way < 2, together).otherwise(outer)
    place = F.col("at") + at + F.when(way == 1, a).otherwise(0)
    spot = F.shiftleft(F.col("size").cast("long"), 34) + F.shiftleft(place.cast("long"), 6) + F.when(way == 1, a).otherwise(0)
    return each.select("cell", key.alias("key"), F.col("id").alias("b"), F.col("class").alias("cb"), spot.alias("spot"))


def _keys_of_places(stretches: DataFrame) -> DataFrame:
    """(cell, key, a, ca, at) of ``stretches(cell, width, id, class, size, at, lead, count, text)``.

    Two keys for each of the ``count`` places that begin ``lead`` characters after ``at``, where the text begins.
    """
    read = stretches.withColumn("_text", _wide(F.col("text")))
    a, b, c = _pieces(F.col("width"))
    read = read.withColumn("_a", a).withColumn("_b", b).withColumn("_c", c)
    each = read.withColumn("_n", F.explode(F.sequence(F.lit(0), F.col("count") * 2 - 1)))
    each = each.withColumn("_at", F.col("lead") + F.shiftright("_n", 1))
    at, a, b, c = (F.col(x) for x in ("_at", "_a", "_b", "_c"))
    together, outer = F.hash(_part(at, a + b)), F.hash(_part(at, a), _part(at + a + b + 1, c - 2))
    key = F.when(F.col("_n").bitwiseAND(F.lit(1)) == 0, together).otherwise(outer)
    place = F.shiftleft(F.col("size").cast("long"), 32) + F.col("at") + at
    return each.select("cell", key.alias("key"), F.col("id").alias("a"), F.col("class").alias("ca"), place.alias("place"))


def _of_spot() -> tuple[Column, Column, Column]:
    """The length of the line, where in it the key is, and how far before that its window begins; lines have 2^28 characters at most."""
    place = F.shiftright("spot", 6).bitwiseAND(F.lit((1 << 28) - 1)).cast("int")
    return F.shiftright("spot", 34).cast("int"), place, F.col("spot").bitwiseAND(F.lit(63)).cast("int")


def _of_place() -> tuple[Column, Column]:
    return F.shiftright("place", 32).cast("int"), F.shiftright(F.shiftleft("place", 32), 32).cast("int")


def _may_be(least: float) -> Column:
    """Whether lines of different classes stand to each other as the edits allow, the longer one being b."""
    (la, pa), (lb, pb, _) = _of_place(), _of_spot()
    longer = (lb > la) | ((lb == la) & (F.col("b") > F.col("a")))
    return (F.col("ca") != F.col("cb")) & longer & (F.abs(pb - pa) + F.abs(lb - la - (pb - pa)) <= edits(lb, least))


def _met(short: DataFrame, long: DataFrame, least: float) -> DataFrame:
    """(cell, a, ca, la, b, cb, lb, pa, pb), once each: the window of b from ``pb`` on has a key where it would begin in a at ``pa``."""
    met = _keys_of_places(short).join(_keys_of_windows(long).hint("shuffle_hash"), ["cell", "key"]).where(_may_be(least))
    (la, pa), (lb, pb, back) = _of_place(), _of_spot()
    met = met.select("cell", "a", "ca", la.alias("la"), "b", "cb", lb.alias("lb"), (pa - back).alias("pa"), (pb - back).alias("pb"))
    return met.groupBy(*met.columns).agg(F.count(F.lit(1)).alias("_n")).drop("_n")


def _chunks(rows: DataFrame, name: str) -> DataFrame:
    """The text in chunks of places, with three windows around, for a text is walked from its start to each place."""
    ends = [F.expr(f"({x}) div {CHUNK}").cast("int") for x in ("at", "at + length(text) - 1")]
    cut = rows.withColumn(f"_{name}", F.explode(F.sequence(*ends)))
    begin = F.greatest(F.col("at"), F.col(f"_{name}") * CHUNK - F.col("width") * 3)
    cut = cut.withColumn(f"_text_{name}", F.substring("text", begin - F.col("at") + 1, F.col("width") * 6 + CHUNK))
    cut = cut.withColumn(f"_at_{name}", begin).drop("at", "text")
    return cut.withColumnsRenamed({"id": name, "class": f"c{name}", "size": f"l{name}"})


def _beside(met: DataFrame, short: DataFrame, long: DataFrame) -> DataFrame:
    """The rows of ``met`` whose window's neighbour stands beside them as well.

    Windows are taken in twos. Some two have fewer than four edits, and one of them fewer than two, so the other has three
    at most, or two if what was met has one and may be off by one. Its end is where its edits have put it: twice as many.
    """
    asked = met.withColumn("_a", F.greatest(F.lit(0), F.expr(f"pa div {CHUNK}")).cast("int")).withColumn("_b", F.expr(f"pb div {CHUNK}").cast("int"))
    both = asked.join(_chunks(long, "b").hint("shuffle_hash"), ["cell", "b", "cb", "lb", "_b"])
    places = short.withColumn("_from", F.col("at") + F.col("lead")).drop("lead")
    both = both.join(_chunks(places, "a").withColumnRenamed("width", "_w").hint("shuffle_hash"), ["cell", "a", "ca", "la", "_a"])
    width = F.col("width")
    both = both.where((F.col("_w") == width) & F.col("pa").between(F.col("_from") - width, F.col("_from") + F.col("count")))
    at, pa, pb = F.expr("pb div width").cast("int"), F.col("pa"), F.col("pb")
    other = F.when(at % 2 == 0, width).otherwise(-width)
    alone = (at % 2 == 0) & (at + 1 == F.expr("lb div width"))
    begin = F.greatest(F.lit(0), pa + other)
    theirs = F.substring("_text_b", pb + other - F.col("_at_b") + 1, width)
    here = F.substring("_text_a", begin - F.col("_at_a") + 1, pa + other + width - begin)
    stands = F.call_function("levenshtein", theirs, here, F.lit(6)) >= 0
    return both.where(alone | stands).select("a", "b", "la", "lb", "width", "pb")


def _shipped(rows: DataFrame, cells: int) -> DataFrame:
    """The rows in the partition of their cell; no null is left, so that all that read them share one exchange."""
    return rows.where(reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in rows.columns])).repartitionById(cells, F.col("cell"))


def _rounds(ranges: dict[int, _Range]) -> list[tuple[int, int]]:
    """(first, last) cell of each round."""
    out, begun, chars = [], 0, 0
    for r in ranges.values():
        for cell in range(r.first, r.first + r.cells):
            chars += r.chars // r.cells
            if chars >= ROUND_CHARS:
                out.append((begun, cell))
                begun, chars = cell + 1, 0
    last = max((r.first + r.cells for r in ranges.values()), default=0) - 1
    return [*out, (begun, last)] if begun <= last else out


def window_pairs(table: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of ids of ``table(id, norm, class)``, of different classes, that may be alike.

    None is left out whose shorter line is in a range of lengths from ``first_range`` on.
    """
    sized = table.withColumn("size", F.length("norm")).where("size > 0")
    ranges = _ranges(sized, least)
    if not ranges:
        return sized.select(F.col("id").alias("a"), F.col("id").alias("b")).where("false")
    top = max(ranges) + 1

    def of(name: str) -> Column:
        known = [getattr(ranges[i], name) if i in ranges else None for i in range(top)]
        return F.get(F.array(*[F.lit(x).cast("int") for x in known]), F.col("_about"))

    size = F.col("size")
    parts = []
    for begin, end in _rounds(ranges):
        asked = [i for i, r in ranges.items() if r.first <= end and r.first + r.cells > begin]
        lines = sized.where(size.between(lengths(min(asked), least), lengths(max(asked) + 2, least) + 1))

        def placed(rows: DataFrame, stretches: Column, groups: Column, begin: int = begin, end: int = end) -> DataFrame:
            """The rows once for each of their cells that this round is about."""
            known = rows.withColumn("width", of("width")).where("width is not null")
            known = known.withColumn("_reach", of("reach")).withColumn("_groups", of("groups"))
            known = known.withColumn("_stretch", F.explode(F.sequence(F.lit(0), stretches - 1))).withColumn("_group", groups)
            known = known.withColumn("cell", of("first") + F.col("_stretch") * F.col("_groups") + F.col("_group") - begin)
            return known.where(F.col("cell").between(0, end - begin))

        reach, stretch, width = (F.col(x) for x in ("_reach", "_stretch", "width"))
        low, high = about(F.ceil(size * least - 1e-9), least), about(size, least)
        long = placed(lines.withColumn("_about", F.explode(F.sequence(low, high))), F.ceil(size / reach).cast("int"), F.pmod(F.hash("id"), F.col("_groups")))
        start, stop = ((stretch + i) * F.expr("_reach div width").cast("int") for i in (0, 1))
        stop = F.least(stop, F.floor(size / width).cast("int"))
        long = long.withColumn("_start", start).withColumn("_stop", stop).where("_stop > _start").withColumn("at", F.col("_start") * width)
        long = long.withColumn("text", F.substring("norm", F.col("at") + 1, (F.col("_stop") - F.col("_start")) * width))
        long = long.select("cell", "width", "id", "class", "size", "at", "text")
        long = _shipped(long, end - begin + 1)
        # Of two lines within the edits e, places are at most e behind and e / 2 ahead of the window that they stand for.
        most = edits(F.floor(size / least + 1e-9), least)
        short = placed(lines.withColumn("_about", high), of("stretches"), F.explode(F.sequence(F.lit(0), F.col("_groups") - 1)))
        short = short.withColumn("_from", F.greatest(F.lit(0), stretch * reach - most - 1))
        short = short.withColumn("_to", F.least(size, (stretch + 1) * reach + F.floor(most / 2).cast("int"))).where("_to > _from")
        short = short.withColumn("_from", F.explode(F.sequence(F.col("_from"), F.col("_to") - 1, F.lit(READ))))
        short = short.withColumn("_to", F.least("_to", F.col("_from") + READ))
        short = short.withColumn("count", F.col("_to") - F.col("_from")).withColumn("lead", F.least(F.col("_from"), width * 2))
        short = short.withColumn("at", F.col("_from") - F.col("lead"))
        short = short.withColumn("text", F.substring("norm", F.col("at") + 1, F.col("lead") + F.col("count") + width * 3))
        short = _shipped(short.select("cell", "width", "id", "class", "size", "at", "lead", "count", "text"), end - begin + 1)
        with held(table.sparkSession, *IN_CELLS):
            near = _beside(_met(short, long, least), short, long).groupBy("a", "b", "la", "lb", "width").agg(F.count(F.lit(1)).alias("n"))
            parts.append(written(near, "window-pairs"))
    found = reduce(DataFrame.unionByName, parts).groupBy("a", "b", "la", "lb", "width").agg(F.sum("n").alias("n"))
    # So many twos have fewer than four edits. A window is counted more than once where more of it is whole.
    whole = F.floor(F.col("lb") / F.col("width")) * 2 - edits(F.col("lb"), least)
    return found.where(F.col("n") * 4 >= whole).select("a", "b")
