"""Weekly time expressions such as ``[[(t2h9){d5h8}]-[(t2h12){h1}]]``.

Splitting a text into atoms and a postfix operator list needs a grammar, so one Arrow function
does that and nothing else. What an atom says is column work inside the row; a second Arrow function joins
the minutes of an expression's atoms as bits. No step needs a shuffle.
"""

from __future__ import annotations

import re
from functools import lru_cache
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartulary.functions.markup import ALL, let
from cartulary.functions.text import squeeze, strip_edges

# Qualifier, duration, snippet and closure patterns.
QUALIFIER = r"(?:y\d{4}|M(?:1[0-2]|0?[1-9])|d(?:3[01]|[12]?\d)|t[1-7]|h(?:2[0-3]|[01]?\d)|m(?:[1-5]?\d))"
DURATION = r"(?:y\d+|M\d+|d\d+|h\d+|m\d+)"
SNIPPET = r"\[\([^)\]]+\)(?:\{[^}]+\})?\]"
CLOSURE = r"\b(PERM_CLOSED|TEMP_CLOSED)\s*:\s*\[(.*?)\]"
WEEKDAYS = ["Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday"]
MONTHS = [
    "January", "February", "March", "April", "May", "June",
    "July", "August", "September", "October", "November", "December",
]
DAY_MINUTES = 1440
MOST_COUNTED = 999_999_999
DECIMAL_DIGITS = 30  # sums of as many amounts of so many digits as a text can hold still fit 38 digits
LIMB_DIGITS = 18

PARSED = T.StructType(
    [
        T.StructField("atoms", T.ArrayType(T.StringType())),
        T.StructField("ops", T.ArrayType(T.StringType())),
        T.StructField("error", T.StringType()),
    ]
)
BINDS = {"+": 1, "*": 2, "-": 2}
_ATOM = re.compile(r"\[\(([^)]*)\)(?:\{([^}]*)\})?\]")


# ---------------------------------------------------------------- text to postfix


def to_postfix(text: str) -> tuple[list[str], list[str]]:
    """Atoms in reading order and the operators in postfix order, atoms by number.

    ``*`` and ``-`` bind tighter than ``+``; all go left to right. Reading stops at the first
    character that cannot go on, and inside a group it goes on behind the group's bracket. Open
    groups end with the text.
    """
    atoms: list[str] = []
    out: list[str] = []
    waiting: list[str] = []
    groups: list[int] = []
    i, want_operand = 0, True

    def flush(limit: int) -> None:
        while waiting and waiting[-1] != "[" and BINDS[waiting[-1]] >= limit:
            out.append(waiting.pop())

    while True:
        while i < len(text) and text[i].isspace():
            i += 1
        if want_operand:
            atom = _ATOM.match(text, i)
            if atom:
                out.append(str(len(atoms)))
                atoms.append(f"({atom[1]}){{{atom[2] or ''}}}")
                i, want_operand = atom.end(), False
            elif text[i : i + 2] != "[(" and text[i : i + 1] == "[":
                waiting.append("[")
                groups.append(_group_end(text, i))
                i += 1
            else:
                raise ValueError(f"no term at {i}: {text[i : i + 10]!r}")
        elif i < len(text) and text[i] in BINDS and not (groups and i >= groups[-1]):
            flush(BINDS[text[i]])
            waiting.append(text[i])
            i, want_operand = i + 1, True
        elif groups:
            flush(0)
            waiting.pop()
            i = groups.pop() + 1
        else:
            flush(0)
            return atoms, out


def _group_end(text: str, start: int) -> int:
    """Index of the bracket that closes the one at ``start``, or the length of the text."""
    depth = 0
    for j in range(start, len(text)):
        depth += (text[j] == "[") - (text[j] == "]")
        if depth == 0:
            return j
    return len(text)


def first_expression(cell: str) -> str | None:
    """First bracket that opens a group or an atom, up to its match; none when unbalanced."""
    start = re.search(r"\[(?=[(\[])", cell)
    if not start:
        return None
    end = _group_end(cell, start.start())
    return cell[start.start() : end + 1] if end < len(cell) else None


def _parse_text(text: str | None) -> tuple[list[str], list[str], str | None]:
    try:
        atoms, ops = to_postfix((text or "").strip())
        return atoms, ops, None
    except ValueError as problem:
        return [], [], str(problem)


def _parse_cell(cell: str | None) -> tuple[list[str], list[str], str | None]:
    """The first expression of a cell, else the union of all its snippets."""
    cell = (cell or "").strip()
    expression = first_expression(cell)
    if expression:
        atoms, ops, error = _parse_text(expression)
        if error is None:
            return atoms, ops, None
    atoms, ops = [], []
    for snippet in re.findall(SNIPPET, cell):
        more, _, error = _parse_text(snippet)
        if error is None:
            ops += [str(len(atoms)), *(["+"] if atoms else [])]
            atoms += more
    return atoms, ops, None


_PARSED = pa.struct([("atoms", pa.list_(pa.string())), ("ops", pa.list_(pa.string())), ("error", pa.string())])


@F.arrow_udf(PARSED)
def parse_expression(texts: pa.Array) -> pa.Array:
    """Whole text as one expression."""
    return pa.array([dict(zip(_PARSED.names, _parse_text(t), strict=True)) for t in texts.to_pylist()], _PARSED)


@F.arrow_udf(PARSED)
def parse_cell(cells: pa.Array) -> pa.Array:
    """What a sheet cell means: first expression, else its snippets."""
    return pa.array([dict(zip(_PARSED.names, _parse_cell(c), strict=True)) for c in cells.to_pylist()], _PARSED)


@F.arrow_udf(T.StringType())
def extract_expression(cells: pa.Array) -> pa.Array:
    return pa.array([first_expression(c) if c else None for c in cells.to_pylist()], pa.string())


def snippets(cell: Column) -> Column:
    return F.regexp_extract_all(cell, F.lit(f"({SNIPPET})"), F.lit(1))


# ---------------------------------------------------------------- atoms


def qualifiers(atom: Column) -> Column:
    inner = F.regexp_extract(atom, r"^\(([^)]*)\)", 1)
    return F.regexp_extract_all(inner, F.lit(f"({QUALIFIER})"), F.lit(1))


def durations(atom: Column) -> Column:
    inner = F.regexp_extract(atom, r"\{([^}]*)\}$", 1)
    return F.regexp_extract_all(inner, F.lit(f"({DURATION})"), F.lit(1))


def _amounts(tokens: Column, unit: str) -> Column:
    """Amounts of all tokens of one unit, in order, as their digits without leading zeros."""
    return F.transform(
        F.filter(tokens, lambda t: F.left(t, F.lit(1)) == unit),
        lambda t: F.regexp_replace(F.substring(t, 2, ALL), r"\A0+(?=\d)", ""),
    )


def _limbs(digits: Column, n: Column) -> Column:
    """A number in decimal digits as n numbers below 10^18, the lowest first."""
    wide = F.lpad(digits, n * LIMB_DIGITS, "0")
    return F.transform(F.sequence(n - 1, F.lit(0)), lambda i: F.substring(wide, i * LIMB_DIGITS + 1, F.lit(LIMB_DIGITS)).cast("bigint"))


def _plus(a: Column, b: Column) -> Column:
    """The sum of two numbers of any length, as digits."""
    base = F.lit(10**LIMB_DIGITS)
    n = F.ceil((F.greatest(F.length(a), F.length(b)) + 1) / LIMB_DIGITS).cast("int")
    pairs = let(n, lambda k: F.zip_with(_limbs(a, k), _limbs(b, k), lambda x, y: x + y))
    start = F.struct(F.lit(0).cast("bigint").alias("carry"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        return let(
            x + acc["carry"],
            lambda s: F.struct(
                F.when(s >= base, 1).otherwise(0).cast("bigint").alias("carry"),
                F.concat(F.lpad((s % base).cast("string"), LIMB_DIGITS, "0"), acc["out"]).alias("out"),
            ),
        )

    return F.regexp_replace(F.reduce(pairs, start, step, lambda acc: acc["out"]), r"\A0+(?=\d)", "")


def _total(amounts: Column) -> Column:
    """The sum of amounts, to the last digit, as digits; 0 without any."""
    zero = F.lit(0).cast("decimal(38,0)")
    short = F.reduce(amounts, zero, lambda a, x: (a + x.try_cast("decimal(38,0)")).cast("decimal(38,0)")).cast("string")
    long = F.reduce(amounts, F.lit("0"), _plus)
    return F.when(F.exists(amounts, lambda x: F.length(x) > DECIMAL_DIGITS), long).otherwise(short)


def _modulo(digits: Column, by: int) -> Column:
    """The rest of a number of any length, as an integer."""
    limbs = let(F.ceil(F.length(digits) / LIMB_DIGITS).cast("int"), lambda n: F.reverse(_limbs(digits, n)))
    return F.reduce(limbs, F.lit(0).cast("bigint"), lambda a, x: (a * (10**LIMB_DIGITS % by) + x % by) % by).cast("int")


def numbers(tokens: Column, unit: str) -> Column:
    """Numbers of all tokens of one unit, in order, as integers.

    Larger ones become MOST_COUNTED, which is past any day or week they could reach.
    """
    return F.transform(
        F.filter(tokens, lambda t: F.left(t, F.lit(1)) == unit),
        lambda t: F.least(
            F.coalesce(F.substring(t, 2, ALL).try_cast("decimal(38,0)"), F.lit(MOST_COUNTED)), F.lit(MOST_COUNTED)
        ).cast("int"),
    )


def _first(values: Column) -> Column:
    return F.try_element_at(values, F.lit(1))


def _minutes(values: Column, each: int) -> Column:
    """Minutes of a list of hours or minutes; a day is as long as the sum can get."""
    most = DAY_MINUTES // each
    day = F.lit(DAY_MINUTES)
    return F.reduce(values, F.lit(0), lambda a, x: F.least(a + F.least(x, F.lit(most)) * each, day))


def atom_days(quals: Column, durs: Column) -> Column:
    """Weekdays of an atom: a run of days, those named, or all seven."""
    named = numbers(quals, "t")
    span = F.coalesce(_first(numbers(durs, "d")), F.lit(0))
    run = F.transform(
        F.sequence(F.lit(0), F.least(span, F.lit(7)) - 1), lambda i: (_first(named) + i - 1) % 7 + 1
    )
    return F.array_distinct(
        F.when((F.size(named) > 0) & (span > 0), run)
        .when(F.size(named) > 0, named)
        .otherwise(F.sequence(F.lit(1), F.lit(7)))
    )


def _tokens(atom: Column) -> Column:
    return F.struct(qualifiers(atom).alias("quals"), durations(atom).alias("durs"))


def atom_intervals(atom: Column) -> Column:
    """``array<struct<weekday, start_min, end_min>>`` of one atom.

    No hour and no minute other than 0 means no start, hence no interval. An interval is cut at
    midnight; day durations only span weekdays.
    """
    return let(_tokens(atom), lambda t: _token_intervals(t["quals"], t["durs"]))


def _token_intervals(quals: Column, durs: Column) -> Column:
    hour, minute = _first(numbers(quals, "h")), F.coalesce(_first(numbers(quals, "m")), F.lit(0))
    start = F.when(
        hour.isNotNull() | (minute != 0), F.coalesce(hour, F.lit(0)) * 60 + minute
    )
    length = _minutes(numbers(durs, "h"), 60) + _minutes(numbers(durs, "m"), 1)
    days = F.when(start.isNotNull() & (length > 0), atom_days(quals, durs)).otherwise(
        F.array().cast("array<int>")
    )
    return F.transform(
        days,
        lambda d: F.struct(
            d.cast("int").alias("weekday"),
            start.alias("start_min"),
            F.least(start + length, F.lit(DAY_MINUTES)).alias("end_min"),
        ),
    )


def explode_atoms(parsed: DataFrame, key: str = "key") -> DataFrame:
    """``(key, atom_no, atom, quals, durs)``"""
    atoms = parsed.select(key, F.posexplode_outer("parsed.atoms").alias("atom_no", "atom")).filter("atom_no is not null")
    return atoms.select(
        key,
        "atom_no",
        "atom",
        qualifiers(F.col("atom")).alias("quals"),
        durations(F.col("atom")).alias("durs"),
    )


def atom_interval_table(atoms: DataFrame, key: str = "key") -> DataFrame:
    """``(key, atom_no, weekday, start_min, end_min)``"""
    return atoms.select(key, "atom_no", F.inline_outer(atom_intervals(F.col("atom")))).filter("weekday is not null")


# ---------------------------------------------------------------- evaluation


# Operators as numbers below zero, so that a postfix list is an array of integers.
OP_CODES = {"+": -1, "*": -2, "-": -3}


def _codes(ops: Column) -> Column:
    codes = F.create_map(*(F.lit(x) for pair in OP_CODES.items() for x in pair))
    return F.transform(ops, lambda op: F.coalesce(F.element_at(codes, op), op.try_cast("int")))


def _fold(codes: Column, empty: Column, operand, combine) -> Column:
    """Run a postfix list over a stack kept as an array; the result is its last entry."""

    def step(stack: Column, code: Column) -> Column:
        left, right = F.try_element_at(stack, F.lit(-2)), F.try_element_at(stack, F.lit(-1))
        rest = F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 2, F.lit(0)))
        return F.when(code >= 0, F.array_append(stack, operand(code))).otherwise(
            F.array_append(rest, combine(code, left, right))
        )

    return F.try_element_at(F.reduce(codes, empty, step), F.lit(-1))


INTERVALS = "array<struct<weekday:int,start_min:int,end_min:int>>"
_DAY = (1 << DAY_MINUTES) - 1


def _runs(bits: int) -> list[tuple[int, int]]:
    """Where the runs of ones of a day begin and end."""
    edges = bits ^ (bits << 1)
    places = []
    while edges:
        low = edges & -edges
        places.append(low.bit_length() - 1)
        edges ^= low
    return list(zip(places[::2], places[1::2], strict=True))


@lru_cache(maxsize=1 << 14)
def atom_bits(atom: str) -> int:
    """The minutes of the week of one atom, a bit each; the same as ``atom_intervals`` says."""
    quals = re.findall(QUALIFIER, m[1]) if (m := re.match(r"\(([^)]*)\)", atom)) else []
    durs = re.findall(DURATION, m[1]) if (m := re.search(r"\{([^}]*)\}\Z", atom)) else []

    def all_of(tokens: list[str], unit: str) -> list[int]:
        return [min(int(t[1:]), MOST_COUNTED) if len(t) < 20 else MOST_COUNTED for t in tokens if t[0] == unit]

    hours, minutes = all_of(quals, "h"), all_of(quals, "m")
    if not hours and not any(minutes[:1]):
        return 0
    start = (hours[0] if hours else 0) * 60 + (minutes[0] if minutes else 0)
    length = min(DAY_MINUTES, sum(all_of(durs, "h")) * 60 + sum(all_of(durs, "m")))
    end = min(start + length, DAY_MINUTES)
    if end <= start:
        return 0
    named, span = all_of(quals, "t"), (all_of(durs, "d") or [0])[0]
    days = named or range(1, 8)
    if named and span:
        days = [(named[0] + i - 1) % 7 + 1 for i in range(min(span, 7))]
    bits = 0
    for day in days:
        bits |= ((1 << end - start) - 1) << (day - 1) * DAY_MINUTES + start
    return bits


def week_runs(ops: list[str], atoms: list[int]) -> list[tuple[int, int, int]]:
    """``(weekday, start_min, end_min)`` of a postfix list over sets of minutes, each set one integer of a bit a minute.

    An operator without both operands keeps what it has; ``*`` and ``-`` have nothing then.
    """
    stack: list[int] = []
    for op in ops:
        if op not in OP_CODES:
            stack.append(atoms[int(op)])
            continue
        right = stack.pop() if stack else 0
        left = stack.pop() if stack else 0
        stack.append(left | right if op == "+" else left & right if op == "*" else left & ~right)
    week = stack[-1] if stack else 0
    out = []
    for day in range(1, 8):
        bits = (week >> DAY_MINUTES * (day - 1)) & _DAY
        if bits:
            out += [(day, start, end) for start, end in _runs(bits)]
    return out


def _weeks(ops: pa.Array, atoms: pa.Array) -> pa.Array:
    """``week_runs`` of many expressions."""
    found = [
        week_runs(o or [], [atom_bits(x) for x in a or []]) for o, a in zip(ops.to_pylist(), atoms.to_pylist(), strict=True)
    ]
    flat = [r for rows in found for r in rows]
    columns = [pa.array([r[i] for r in flat], pa.int32()) for i in range(3)]
    rows = pa.StructArray.from_arrays(columns, names=["weekday", "start_min", "end_min"])
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in found], dtype=np.int64)))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows)


def weekly_intervals(parsed: Column) -> Column:
    """``array<struct<weekday, start_min, end_min>>`` of a parsed expression, merged and in order.

    An atom's minutes of the week are the bits of one integer, so an operator is one bit operation whatever it joins.
    """
    return F.arrow_udf(_weeks, INTERVALS)(parsed["ops"], parsed["atoms"])


def with_parsed(cells: DataFrame, text: str = "cell", whole: bool = False) -> DataFrame:
    """Add column ``parsed``. ``whole`` reads the entire text, else the cell rules hold."""
    parse = parse_expression if whole else parse_cell
    return cells.withColumn("parsed", parse(F.col(text)))


def weekly(cells: DataFrame, text: str = "cell", key: str = "key", whole: bool = True) -> DataFrame:
    """``(key, weekday, start_min, end_min)`` of every expression."""
    evaluated = with_parsed(cells, text, whole).select(key, weekly_intervals(F.col("parsed")).alias("_week"))
    # Outer: else the optimizer asks ahead, in another run of the function, which weeks are empty.
    return evaluated.select(key, F.inline_outer("_week")).filter("weekday is not null")


# ---------------------------------------------------------------- text forms


def _clock(minutes: Column, am: str, pm: str) -> Column:
    hour = F.floor(minutes / 60).cast("int")
    twelve = F.when(hour % 12 == 0, 12).otherwise(hour % 12)
    return F.format_string(
        "%d:%02d %s", twelve.cast("int"), (minutes % 60).cast("int"), F.when(hour < 12, am).otherwise(pm)
    )


def fmt_range(start: Column, end: Column) -> Column:
    """``9:00 am–5:30 pm``; the end of the day prints as 12:00 pm."""
    inside = lambda m: F.greatest(F.lit(0), F.least(m, F.lit(DAY_MINUTES)))
    return F.concat(_clock(inside(start), "am", "pm"), F.lit("–"), _clock(inside(end), "am", "pm"))


def _name(names: list[str], number: Column) -> Column:
    return F.try_element_at(F.array(*map(F.lit, names)), number)


def week_lines(intervals: Column) -> Column:
    """Seven pairs of day and hours, in one text."""
    return let(intervals, _week_lines)


def _week_lines(intervals: Column) -> Column:
    def lines(day: Column) -> Column:
        ranges = F.transform(
            F.filter(intervals, lambda x: x["weekday"] == day),
            lambda x: fmt_range(x["start_min"], x["end_min"]),
        )
        hours = F.coalesce(F.nullif(F.array_join(ranges, ", "), F.lit("")), F.lit("Closed"))
        return F.concat(_name(WEEKDAYS, day), F.lit("\n"), hours)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.lit(7)), lines), "\n")


def _closure_dates(cell: Column) -> Column:
    """Qualifier lists of the parentheses inside a closure mark."""
    inside = F.regexp_extract(cell, CLOSURE, 2)
    groups = F.regexp_extract_all(inside, F.lit(r"\(([^)]+)\)"), F.lit(1))
    return F.transform(
        groups, lambda g: F.regexp_extract_all(g, F.lit(f"({QUALIFIER})"), F.lit(1))
    )


def _ymd(quals: Column) -> tuple[Column, Column, Column]:
    return tuple(_first(numbers(quals, unit)) for unit in "yMd")


def perm_closed(cell: Column) -> Column:
    """Closure line of a permanently closed place, null for any other cell."""
    kind = F.regexp_extract(cell, CLOSURE, 1)
    year, month, day = _ymd(_first(_closure_dates(cell)))
    dated = (year != 0) & (month != 0) & (day != 0)
    line = F.when(
        dated, F.format_string("No (Closed permanently on %04d-%02d-%02d)", year, month, day)
    ).otherwise("No (Closed permanently)")
    return F.when(kind == "PERM_CLOSED", line)


def _long_date(quals: Column) -> Column:
    """``January 1, 2025`` with whatever parts are there."""
    year, month, day = _ymd(quals)
    month_name = _name(MONTHS, month)
    front = (
        F.when(month.isNotNull() & day.isNotNull(), F.concat(month_name, F.lit(" "), day.cast("string")))
        .when(month.isNotNull(), month_name)
        .when(day.isNotNull(), F.concat(F.lit("day "), day.cast("string")))
    )
    return F.concat_ws(", ", front, year.cast("string"))


def specials_text(cell: Column) -> Column:
    """Sentence for a closure mark, null without one or without enough dates."""
    kind = F.regexp_extract(cell, CLOSURE, 1)
    dates = F.transform(_closure_dates(cell), _long_date)
    return F.when(
        (kind == "PERM_CLOSED") & (F.size(dates) > 0),
        F.concat(F.lit("Permanently closed on "), _first(dates)),
    ).when(
        (kind == "TEMP_CLOSED") & (F.size(dates) > 1),
        F.concat(
            F.lit("Temporarily closed from "),
            _first(dates),
            F.lit(" to "),
            F.try_element_at(dates, F.lit(2)),
        ),
    )


# Units in the order they are spoken.
UNITS = [("y", "year"), ("M", "month"), ("d", "day"), ("h", "hour"), ("m", "minute")]


def _counted(word: str):
    return lambda n: F.when(n != "0", F.concat(n, F.lit(f" {word}"), F.when(n != "1", "s").otherwise("")))


def duration_text(durs: Column) -> Column:
    parts = []
    for unit, word in UNITS:
        parts.append(let(_total(_amounts(durs, unit)), _counted(word)))
    return F.coalesce(F.nullif(F.concat_ws(" and ", *parts), F.lit("")), F.lit("0 minutes"))


def _when_text(quals: Column, durs: Column) -> Column:
    """Days and dates an atom names; the parts with ``in`` come last."""
    year, month, day = _ymd(quals)
    named = numbers(quals, "t")
    span = F.coalesce(_first(numbers(durs, "d")), F.lit(0))
    days_run = _modulo(_first(_amounts(durs, "d")), 7)
    last_day = ((_first(named) + days_run + 5) % 7 + 1).cast("int")
    names = F.transform(named, lambda d: _name(WEEKDAYS, d))
    listed = F.when(
        F.size(names) > 1,
        F.concat(
            F.array_join(F.slice(names, F.lit(1), F.size(names) - 1), ", "),
            F.lit(" and "),
            F.try_element_at(names, F.lit(-1)),
        ),
    ).otherwise(_first(names))
    days = (
        F.when(
            (F.size(named) > 0) & (span > 1),
            F.concat(_name(WEEKDAYS, _first(named)), F.lit(" through "), _name(WEEKDAYS, last_day)),
        )
        .when((F.size(named) > 0) & (span == 1), _name(WEEKDAYS, _first(named)))
        .when(F.size(named) > 0, listed)
    )
    date = F.when(
        day.isNotNull() & month.isNotNull(),
        F.concat(_name(MONTHS, month), F.lit(" "), day.cast("string")),
    ).when(day.isNotNull(), F.concat(F.lit("day "), day.cast("string")))
    in_month = F.when(
        month.isNotNull() & day.isNull(), F.concat(F.lit("in "), F.concat_ws(" ", _name(MONTHS, month), year.cast("string")))
    ).when(year.isNotNull(), F.concat(F.lit("in "), year.cast("string")))
    return F.concat_ws(", ", days, date, in_month)


def describe_atom(atom: Column) -> Column:
    return let(_tokens(atom), lambda t: _describe_tokens(t["quals"], t["durs"]))


def _describe_tokens(quals: Column, durs: Column) -> Column:
    hour, minute = _first(numbers(quals, "h")), _first(numbers(quals, "m"))
    start = F.when(
        hour.isNotNull() | minute.isNotNull(),
        _clock(F.coalesce(hour, F.lit(0)) * 60 + F.coalesce(minute, F.lit(0)), "AM", "PM"),
    )
    phrase = let(
        _when_text(quals, durs),
        lambda w: F.when(w.startswith("in "), w).when(w != "", F.concat(F.lit("on "), w)),
    )
    return F.concat_ws(" ", F.concat(start, F.lit(" for")), duration_text(durs), phrase)


JOINING = {"+": " and ", "*": " limited to ", "-": " except "}


def describe(parsed: Column) -> Column:
    """The expression in words, null when it did not parse."""
    words = F.create_map(*(F.lit(x) for op, word in JOINING.items() for x in (OP_CODES[op], word)))
    text = _fold(
        _codes(parsed["ops"]),
        F.array().cast("array<string>"),
        lambda no: describe_atom(F.element_at(parsed["atoms"], no + 1)),
        lambda op, a, b: F.concat(a, F.element_at(words, op), b),
    )
    return F.replace(squeeze(text), F.lit("12:00 AM"), F.lit("midnight"))


def translated(cell: Column, parsed: Column) -> Column:
    """What a cell says: blank, a closure line, or the week's hours."""
    return (
        F.when(strip_edges(F.coalesce(cell, F.lit(""))) == "", "")
        .when(parsed["error"].isNotNull(), F.concat(F.lit("[parse error] "), parsed["error"]))
        .otherwise(F.coalesce(perm_closed(cell), week_lines(weekly_intervals(parsed))))
    )


def translate_column(df: DataFrame, column: str, out: str = "translated") -> DataFrame:
    """Add the translated text of a column of cells."""
    return (
        with_parsed(df, column)
        .withColumn(out, translated(F.col(column), F.col("parsed")))
        .drop("parsed")
    )
