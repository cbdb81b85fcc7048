"""Column names: tidy them, find them, pick them by spreadsheet letter."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame


def _trim(name: str) -> str:
    return name.strip("\ufeff \t\r\n")


HEADER_STYLES = {
    "trim": _trim,
    "lower": lambda n: _trim(n).lower(),
    "snake": lambda n: _trim(n).lower().replace(" ", "_"),
    "unquote": lambda n: n.strip().replace('"', ""),
}


def normalize_headers(df: DataFrame, style: str = "trim") -> DataFrame:
    return df.toDF(*map(HEADER_STYLES[style], df.columns))


def resolve_column(df: DataFrame, wanted: str) -> str:
    """Exact name, then blind to case and spacing, then a 1-based number."""
    loose = lambda n: re.sub(r"\s+", " ", n.strip()).lower()
    if wanted in df.columns:
        return wanted
    alike = [c for c in df.columns if loose(c) == loose(wanted)]
    if alike:
        return alike[-1]
    if wanted.isdigit() and 1 <= int(wanted) <= len(df.columns):
        return df.columns[int(wanted) - 1]
    raise ValueError(f"no column {wanted!r}; the table has: {', '.join(df.columns)}")


def _ordinal(letters: str) -> int:
    """A -> 0, Z -> 25, AA -> 26, ZZ -> 701."""
    if not re.fullmatch("[A-Z]{1,2}", letters):
        raise ValueError(f"not a spreadsheet column: {letters!r}")
    number = 0
    for char in letters:
        number = number * 26 + ord(char) - ord("A") + 1
    return number - 1


def _letters(ordinal: int) -> str:
    high, low = divmod(ordinal, 26)
    return (chr(ord("A") + high - 1) if high else "") + chr(ord("A") + low)


def expand_letters(specs: Sequence[str]) -> list[str]:
    """``["ab-ad, C"]`` becomes ``[AB, AC, AD, C]``."""
    names = []
    for part in ",".join(specs).upper().split(","):
        first, dash, last = (p.strip() for p in part.partition("-"))
        stop = _ordinal(last) if dash else _ordinal(first)
        names += [_letters(i) for i in range(_ordinal(first), stop + 1)]
    return names


def select_letters(df: DataFrame, specs: Sequence[str]) -> DataFrame:
    """Keep the columns that stand under the given spreadsheet letters."""
    picked = [_ordinal(name) for name in expand_letters(specs)]
    return df.select(*(df.columns[i] for i in picked))
