"""Fuzzy line dedup: of lines that say nearly the same, one occurrence stays in the corpus.

1. Lines are normalised; equal ones are one distinct line.
2. Each distinct line gets a 60-bit SimHash of its words, longer words weighing more. All 60 votes of a word are added
   as twenty longs of three 20-bit counters each, in one aggregate.
3. The SimHash is cut into five blocks. Two values that differ in at most three bits share two blocks, so each pair of
   blocks is a bucket. A bucket ties its values to two representatives, never to each other, and a pair goes on only if
   few bits differ.
4. Pairs are checked by edit similarity; connected lines are one class.
5. SimHash alone loses pairs. So the longer line of a pair is cut into windows, of which one has fewer than two edits and
   stands but for them in the other line (``windows``). Lines too short for windows are cut into pieces: the shorter line
   of a pair into more than the pair may have edits; an edit spoils one piece at most, and the others stand in the longer
   line, shifted by no more than the edits. Lines of different classes that share that many are checked as well, which
   leaves out no pair within the bound. Lines that may be a pair by their lengths meet in a cell, and only inside the task
   of a cell are they cut up.
6. The first occurrence of a group (smallest doc_id, then line number) stays, all others go.

Column work only. Lines are normalised once and written. Texts are shuffled as distinct lines and with their class; after
that only lines with a candidate and documents with a repeated line move. Step 5 ships a line twice as the longer one of a
pair, and as the shorter one once and what the stretches of two cells have in common. Neither keys nor pieces are shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartulary.llm.common import beside, connected, sieved, written
from cartulary.llm.windows import IN_CELLS, about, first_range, window_pairs
from cartulary.llm.windows import edits as _edits
from cartulary.llm.windows import held as _held

SIMILAR = 0.9  # 1 - edits / length of the longer line
BLOCKS, BLOCK_BITS = 5, 12
BITS = BLOCKS * BLOCK_BITS
FAR = 12  # bits of the SimHash that may differ before the text is looked at
LANE = 20  # bits of a counter: up to a million, so 80,000 different words in a line
MOST_WEIGHT = 12
PIECES = (16, 12, 8, 6, 5, 4, 3, 2, 1)  # lengths of a piece, the longest that gives enough pieces is taken
PIECES_READ = (512, 64, 8)  # in stretches of so many pieces a line is cut, so that it is not walked from its start for each
CLEANED = ("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")  # what was shuffled goes once its rows are written
CELL_PIECES = 1_500_000  # pieces of the shorter lines of a cell, which a task holds in memory: some 200 MB
CELL_CHARS = 32_000_000  # characters of its longer lines, which stream by


def normalised(line: Column) -> Column:
    """Lower case, with runs of white space and ASCII punctuation as one blank."""
    # A blank alone between words is left as it is, which spares most of the matches.
    runs = r"[\s\p{Punct}&&[^ ]][\s\p{Punct}]*| [\s\p{Punct}]+"
    return F.trim(F.regexp_replace(F.lower(line), runs, " "))


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, line, id, norm) for each line that says something; lines are equal if their ids are."""
    hashed = docs.select("doc_id", "text", _hash().alias("text_hash"))  # once a document, not once a line
    each = hashed.select("doc_id", "text_hash", F.posexplode(F.split("text", "\n", -1)).alias("line", "said"))
    # The test looks at the line as it is: on ``norm`` it would work that out twice.
    spoken = each.where(F.col("said").rlike(r"[^\s\p{Punct}]"))
    normal = spoken.select("doc_id", "text_hash", "line", normalised(F.col("said")).alias("norm"))
    return normal.select("doc_id", "text_hash", "line", F.xxhash64("norm").alias("id"), "norm")


def _hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def simhashes(lines: DataFrame) -> DataFrame:
    """(id, sim) of distinct lines (id, norm); words carry the id alone, so that a long line is not copied for each."""
    words = lines.select("id", F.explode(F.array_distinct(F.split("norm", " "))).alias("_w"))
    hashed = words.select(
        "id", F.xxhash64("_w").alias("_h"), F.least(F.length("_w"), F.lit(MOST_WEIGHT)).cast("long").alias("_v")
    )
    votes = []
    for lane in range(BITS // 3):
        three = F.shiftright("_h", 3 * lane)
        spread = three.bitwiseAND(F.expr("1L"))
        for i in (1, 2):
            spread = spread.bitwiseOR(F.shiftleft(F.shiftright(three, i).bitwiseAND(F.expr("1L")), LANE * i))
        votes.append(F.sum(F.col("_v") * spread).alias(f"_s{lane}"))
    added = hashed.groupBy("id").agg(F.sum("_v").alias("_all"), *votes)
    sim = F.expr("0L")
    for bit in range(BITS):
        count = F.shiftright(f"_s{bit // 3}", LANE * (bit % 3)).bitwiseAND(F.lit((1 << LANE) - 1))
        sim = sim + F.when(count * 2 > F.col("_all"), F.lit(1 << bit)).otherwise(F.expr("0L"))
    return added.select("id", sim.alias("sim"))


def _buckets(sims: DataFrame) -> DataFrame:
    """(key, sim): each SimHash value under every pair of its blocks."""
    mask = (1 << BLOCK_BITS) - 1
    block = [F.shiftright("sim", BLOCK_BITS * i).bitwiseAND(F.lit(mask).cast("long")) for i in range(BLOCKS)]
    pairs = [(i, j) for i in range(BLOCKS) for j in range(i + 1, BLOCKS)]
    keys = [
        F.shiftleft(block[i], BLOCK_BITS).bitwiseOR(block[j]).bitwiseOR(F.lit(n << (2 * BLOCK_BITS)).cast("long"))
        for n, (i, j) in enumerate(pairs)
    ]
    return sims.select(F.explode(F.array(*keys)).alias("key"), "sim")


def candidate_pairs(table: DataFrame) -> DataFrame:
    """Pairs (a, b) of line ids, of ``table(id, sim)``, whose SimHash values are near."""
    sims = table.groupBy("sim").agg(F.min("id").alias("id"))
    sims = written(sims, "simhashes")
    keys = _buckets(sims.select("sim"))
    ends = keys.groupBy("key").agg(F.min("sim").alias("low"), F.max("sim").alias("high")).where("low < high")
    ends = written(ends, "buckets")
    few = sieved(keys, F.col("key"), ends, F.col("key"))
    tied = few.join(ends, "key").select("sim", F.explode(F.array("low", "high")).alias("other")).where("sim <> other")
    near = tied.where(F.bit_count(F.col("sim").bitwiseXOR(F.col("other"))) <= FAR).distinct()
    heads = sims.select(F.col("sim").alias("other"), F.col("id").alias("b"))
    across = table.select("sim", F.col("id").alias("a")).join(near.join(heads, "other"), "sim").select("a", "b")
    same = table.join(sims.withColumnRenamed("id", "b"), "sim").select(F.col("id").alias("a"), "b")
    both = across.unionByName(same).where("a <> b")
    return both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _piece(length: Column, least: float) -> Column:
    """The length of the pieces a line is cut into as the shorter one of a pair; null if it is near to no other."""
    edits = _edits(F.floor(length / least + 1e-9), least)
    fits = [F.when((edits > 0) & (F.floor(length / q) > edits), F.lit(q)) for q in PIECES]
    return F.coalesce(*fits)


def _cut_up(lines: DataFrame, step: Column) -> DataFrame:
    """``lines(cell, id, class, norm, size, q)`` as (cell, gram, id, class, size, q, at): strings of q characters, each ``step``."""
    read = lines.select("cell", "id", "class", "size", "q", F.lit(0).alias("at"), F.col("norm").alias("_part"))
    for pieces in PIECES_READ:
        width = F.col("q") * pieces
        parts = read.where(F.length("_part") >= F.col("q"))
        parts = parts.withColumn("_from", F.explode(F.sequence(F.lit(0), F.length("_part") - F.col("q"), width)))
        part = F.substring("_part", F.col("_from") + 1, width + F.col("q") - 1)
        read = parts.select("cell", "id", "class", "size", "q", (F.col("at") + F.col("_from")).alias("at"), part.alias("_part"))
    each = read.withColumn("_at", F.explode(F.sequence(F.lit(0), F.least(width - 1, F.length("_part") - F.col("q")), step)))
    gram = F.substring("_part", F.col("_at") + 1, F.col("q"))
    return each.select("cell", gram.alias("gram"), "id", "class", "size", "q", (F.col("at") + F.col("_at")).alias("at"))


def _parts(sized: DataFrame, about: Callable[[Column], Column], least: float) -> list[tuple[int, int]]:
    """For each value of ``about`` from 0: in how many groups its longer and its shorter lines are dealt, (0, 0) for none.

    The only rows that reach the driver, one for each tenth by which the length of a line grows.
    """
    pieces = F.floor(F.col("size") / _piece(F.col("size"), least))
    sums = sized.groupBy(about(F.col("size")).alias("about")).agg(F.sum("size").alias("chars"), F.sum(pieces).alias("pieces"))
    found = {r["about"]: (r["chars"], r["pieces"] or 0) for r in sums.collect()}
    parts = []
    for at in range(max(found, default=-1) + 1):
        short = found.get(at, (0, 0))[1] + found.get(at - 1, (0, 0))[1]
        parts.append((-(-found[at][0] // CELL_CHARS), max(1, -(-short // CELL_PIECES))) if at in found else (0, 0))
    return parts


def piece_pairs(table: DataFrame, least: float = SIMILAR) -> DataFrame:
    """Pairs (a, b) of ids of ``table(id, norm, class)``, of different classes, that may be alike: no alike pair is left out.

    ``least`` is above 0.5. Lines are shuffled, not their pieces: lines of about one length share cells, any two of
    them one, and are cut up, joined and counted inside the task that holds the cell, if it runs with ``IN_CELLS`` held.
    """
    sized = table.withColumn("size", F.length("norm")).where("size > 0")
    step = -math.log(least)

    def about(length: Column) -> Column:
        return F.floor(F.log(length) / step).cast("int")  # of the longer line the same or one more

    parts = _parts(sized, about, least)
    if not parts:
        return sized.select(F.col("id").alias("a"), F.col("id").alias("b")).where("false")

    def group(of: int) -> Column:
        return F.coalesce(F.get(F.array(*[F.lit(p[of]) for p in parts]), F.col("_about")), F.lit(0))

    def dealt(lines: DataFrame, own: int, salt: int) -> DataFrame:
        """Each line in its own group, once for each group of the other side."""
        here = lines.where(group(0) > 0).withColumn("_other", F.explode(F.sequence(F.lit(0), group(1 - own) - 1)))
        mine = F.pmod(F.xxhash64("id", F.lit(salt)), group(own)).cast("int")
        row, column = (mine, F.col("_other")) if own == 0 else (F.col("_other"), mine)
        cell = F.struct(F.col("_about").alias("about"), row.alias("long"), column.alias("short"))
        return here.withColumn("cell", F.xxhash64(cell)).drop("_about", "_other").repartition(cells, "cell")

    cells = 2 * sum(long * short for long, short in parts)
    able = sized.where(_edits(F.col("size"), least) > 0).withColumn("_about", about(F.col("size")))
    lengths = F.sequence(F.ceil(F.col("size") * least - 1e-9).cast("int"), F.col("size"))
    asked = F.array_distinct(F.array_compact(F.transform(lengths, lambda n: _piece(n, least))))
    long = _cut_up(dealt(able, 0, 0).withColumn("q", F.explode(asked)), F.lit(1))
    short = sized.withColumn("q", _piece(F.col("size"), least)).where("q is not null")
    short = short.withColumn("_about", F.explode(F.array(about(F.col("size")), about(F.col("size")) + 1)))
    short = _cut_up(dealt(short, 1, 1), F.col("q"))
    key = F.xxhash64("gram", "q").alias("key")
    left = long.select("cell", key, F.col("id").alias("a"), F.col("class").alias("ca"), F.col("size").alias("la"), F.col("at").alias("pa"))
    right = short.select("cell", key, F.col("id").alias("b"), F.col("class").alias("cb"), F.col("size").alias("lb"), F.col("at").alias("pb"))
    edits = _edits(F.col("la"), least)
    ahead = (F.col("la") > F.col("lb")) | ((F.col("la") == F.col("lb")) & (F.col("a") > F.col("b")))
    # A whole piece that stands shifted takes as many edits before it, and those that make up the lengths behind it.
    shift = F.col("pa") - F.col("pb")
    near = F.abs(shift) + F.abs(F.col("la") - F.col("lb") - shift) <= edits
    shared = left.join(right.hint("shuffle_hash"), ["cell", "key"]).where((F.col("ca") != F.col("cb")) & ahead & near)
    kept = F.floor(F.col("lb") / _piece(F.col("lb"), least)) - edits  # pieces that no edit reaches, at least
    counted = shared.groupBy("cell", "a", "b", "la", "lb").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= kept)
    return counted.select("a", "b")


def _same_ahead(a: Column, b: Column) -> Column:
    """With how many equal entries two arrays begin."""
    differs = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
    return F.when(differs > 0, differs - 1).otherwise(F.size(a)).cast("int")


def alike(pairs: DataFrame, least: float) -> DataFrame:
    """The rows of ``pairs(na, nb, ...)`` whose texts have an edit similarity of ``least``.

    Words that both begin or end with do not change the edit distance and are left out. If as many words are left
    on both sides, the distances of word to word bound it from above; where that says yes, the long one is not asked.
    """
    a, b = F.col("na"), F.col("nb")
    longer, shorter = F.greatest(F.length(a), F.length(b)), F.least(F.length(a), F.length(b))
    bounded = pairs.withColumn("_most", _edits(longer, least)).where(longer - shorter <= F.col("_most"))
    split = bounded.withColumn("_wa", F.split(a, " ")).withColumn("_wb", F.split(b, " "))
    ahead = split.withColumn("_ahead", _same_ahead(F.col("_wa"), F.col("_wb")))
    left = F.least(F.size("_wa"), F.size("_wb")) - F.col("_ahead")
    ends = ahead.withColumn("_behind", F.least(left, _same_ahead(F.reverse("_wa"), F.reverse("_wb"))))
    middle = [F.slice(w, F.col("_ahead") + 1, F.size(w) - F.col("_ahead") - F.col("_behind")) for w in ("_wa", "_wb")]
    cut = ends.withColumn("_ma", middle[0]).withColumn("_mb", middle[1])

    def apart(x: Column, y: Column) -> Column:
        return F.when(x == y, 0).otherwise(F.levenshtein(x, y))

    def text(words: str) -> Column:
        return F.array_join(F.transform(words, lambda w: F.concat(w, F.lit(" "))), "")

    word_by_word = F.aggregate(F.zip_with("_ma", "_mb", apart), F.lit(0), lambda n, x: n + x)
    aligned = (F.size("_ma") == F.size("_mb")) & (word_by_word <= F.col("_most"))
    within = F.call_function("levenshtein", text("_ma"), text("_mb"), F.col("_most")) >= 0  # -1 beyond the bound
    return cut.where(F.when(aligned, True).otherwise(within)).select(*pairs.columns)


def _checked(pairs: DataFrame, table: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of ids of ``table(id, norm)`` that are alike."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = written(sieved(table.select("id", "norm"), F.col("id"), asked, F.col("id")).join(asked, "id", "left_semi"), "texts", "zstd")
    left = texts.select(F.col("id").alias("a"), F.col("norm").alias("na"))
    right = texts.select(F.col("id").alias("b"), F.col("norm").alias("nb"))
    return alike(pairs.join(left, "a").join(right, "b"), least).select("a", "b")


def line_groups(lines: DataFrame, least: float = SIMILAR) -> DataFrame:
    """(id, class) of the distinct lines of ``lines(id, norm)`` that occur more than once or have a near line."""
    table = written(lines.groupBy("id").agg(F.min("norm").alias("norm"), F.count(F.lit(1)).alias("n")), "lines", "zstd")
    sims = written(simhashes(table), "line-simhashes")
    first = connected(_checked(written(candidate_pairs(sims), "candidates"), table, least))
    first = written(first, "line-classes")
    texts, labels = table.select("id", "norm"), first.select(F.col("node").alias("id"), F.col("label").alias("class"))
    alone = sieved(texts, F.col("id"), labels, F.col("id"), inside=False).withColumn("class", F.col("id"))
    tied = sieved(texts, F.col("id"), labels, F.col("id")).join(labels, "id", "left")
    classed = alone.unionByName(tied.withColumn("class", F.coalesce("class", "id")))
    start = first_range(least)
    short = classed if start is None else classed.where(about(F.length("norm"), least) <= start)
    with _held(table.sparkSession, *IN_CELLS):
        found = written(piece_pairs(short, least), "piece-pairs")
    found = found.unionByName(window_pairs(classed, least)) if start is not None else found
    more = _checked(written(found.distinct(), "near-pairs"), table, least)
    edges = first.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(more)
    labels = connected(edges).select(F.col("node").alias("id"), F.col("label").alias("class"))
    repeated = table.where("n > 1").select("id", F.col("id").alias("class"))
    return written(labels.unionByName(repeated).groupBy("id").agg(F.min("class").alias("class")), "line-groups")


def repeated_lines(docs: DataFrame, least: float = SIMILAR) -> DataFrame:
    """(doc_id, text_hash, repeated): for each document with lines that have partners, those lines.

    ``repeated`` is an array of (line, class, kept), by line number from 0.
    """
    lines = written(_lines(docs), "said", "zstd")
    groups = line_groups(lines.select("id", "norm"), least)
    rows = sieved(lines.drop("norm"), F.col("id"), groups, F.col("id"))
    found = written(rows.join(groups, "id").select("doc_id", "text_hash", "line", "class"), "occurrences")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "line")
    firsts = found.groupBy("class").agg(F.min(place).alias("first"))
    marked = found.join(firsts, "class").select(
        "doc_id",
        "text_hash",
        F.struct("line", "class", (place.eqNullSafe(F.col("first"))).alias("kept")).alias("one"),
    )
    return marked.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("one")).alias("repeated"))


def dedup_lines(docs: DataFrame, least: float = SIMILAR) -> DataFrame:
    """``docs(doc_id, text, ...)`` with repeated lines taken out of the text, and ``repeated`` beside it.

    ``repeated`` names the lines that have partners, as in ``repeated_lines``; null where there are none. All other
    columns pass through. Defined cases: a line without letters, digits or signs outside ASCII is never removed; a text
    whose lines all go becomes empty; null texts stay null; rows equal in doc_id and text lose the same lines, so that
    repeated rows stay equal; a null doc_id comes last when the first occurrence is chosen.
    """
    return beside(docs.drop("repeated"), ["doc_id", "text"], lambda d: _cut(d, least))


def _cut(docs: DataFrame, least: float) -> DataFrame:
    with _held(docs.sparkSession, *CLEANED):
        found = written(repeated_lines(docs, least), "repeated-lines")
    keyed = docs.withColumn("_hash", _hash())
    at, found_at = F.xxhash64("doc_id", "_hash"), F.xxhash64("doc_id", "text_hash")
    rest = sieved(keyed, at, found, found_at, inside=False).withColumn("repeated", F.lit(None).cast(found.schema["repeated"].dataType))
    looked = sieved(keyed, at, found, found_at)
    lists = found.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_h"), "repeated")
    met = looked.join(lists, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_h")), "left")
    said = F.split("text", "\n", -1)
    gone = F.transform(F.filter("repeated", lambda r: ~r.kept), lambda r: r.line)
    stays = F.array_except(F.sequence(F.lit(0), F.size(said) - 1), gone)
    text = F.array_join(F.transform(stays, lambda i: F.get(said, i)), "\n")
    cut = met.withColumn("text", F.when(F.exists("repeated", lambda r: ~r.kept), text).otherwise(F.col("text")))
    return rest.select(*docs.columns, "repeated").unionByName(cut.select(*docs.columns, "repeated"))
