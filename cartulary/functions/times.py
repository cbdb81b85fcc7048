"""Naive date-times: the zone word is dropped, nothing is converted."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from cartulary.functions.markup import let
from cartulary.functions.text import squeeze

# Accepted spellings, tried in this order.
VERSION_FORMATS = ["yyyy-M-d h:m a"]
EDIT_FORMATS = [
    "yyyy-M-d h:m a",
    "yyyy-M-d H:m",
    "MMM d, yyyy h:m a",
    "MMM d, yyyy H:m",
    "yyyy-M-d",
]
CLOSURE_FORMATS = [
    "yyyy-M-d",
    "M/d/yyyy",
    "yyyy-M-d H:m",
    "M/d/yyyy h:m a",
    "MMM d, yyyy",
]


def _may_fit(text: Column, fmt: str) -> Column:
    """Whether the text has the signs of a format and the M of its AM or PM. A try that fails is an exception, so it is costly."""
    signs = [c for c in dict.fromkeys(fmt) if not c.isalpha() and c != " "]
    tests = [text.contains(c) for c in signs] + ([F.upper(text).contains("M")] if "a" in fmt else [])
    return reduce(lambda x, y: x & y, tests)


def parse_any(text: Column, formats: Sequence[str]) -> Column:
    """First format that fits, else null."""

    def first(t: Column) -> Column:
        return F.coalesce(
            *(F.when(_may_fit(t, f), F.try_to_timestamp(t, F.lit(f)).cast("timestamp_ntz")) for f in formats)
        )

    return let(text, first)


def parse_version_ts(text: Column) -> Column:
    """``2025-06-01 01:23 PM CDT``: the last word goes, the rest must fit."""
    return parse_any(F.regexp_replace(text, r" [^ ]*$", ""), VERSION_FORMATS)


def parse_edit_ts(text: Column) -> Column:
    """Lenient edit date; a trailing upper-case word of 2-4 characters is a zone.

    Such a word may hold digits as long as its letters are upper case. AM/PM is not kept out:
    "01:00 PM" without a zone loses its PM and is read on the 24-hour clock.
    """

    def without_zone(text: Column, last: Column) -> Column:
        zone = (
            F.length(last).between(2, 4) & (last == F.upper(last)) & (last != F.lower(last))
        )
        return F.when(zone, F.regexp_replace(text, r" ?[^ ]+$", "")).otherwise(text)

    cut = let(squeeze(text), lambda t: let(F.regexp_extract(t, r"([^ ]+)$", 1), lambda last: without_zone(t, last)))
    return parse_any(cut, EDIT_FORMATS)


def parse_closure_date(text: Column) -> Column:
    return parse_any(F.trim(text), CLOSURE_FORMATS)


def fmt_mdy(ts: Column) -> Column:
    """``7/4/2025``"""
    return F.date_format(ts, "M/d/yyyy")


def fmt_iso(ts: Column) -> Column:
    """ISO text to the second, with microseconds when there are any; blank when missing."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    return F.coalesce(
        F.when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), micros)), F.lit("")
    )
