"""Page markup as text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from cartulary.functions.text import squeeze, unescape_html

TAG = "<[^>]*>"
# Longer than any array; small enough that adding an offset does not overflow.
ALL = 1_000_000_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times."""
    return F.transform(F.array(value), body)[0]


def until_last(text: Column, end: str) -> Column:
    """The text up to its last match of ``end``, blank without one.

    What opens behind that point closes nowhere. A search that stays before it finds an end for
    each opening, so its time does not grow with the square of the openings left open.
    """
    return F.regexp_extract(text, rf"(?is)\A.*{end}", 0)


def _without(text: Column, start: str, end: str) -> Column:
    """The text without all from each ``start`` to the next ``end``."""
    closed = until_last(text, end)
    return F.concat(
        F.regexp_replace(closed, rf"(?is){start}.*?{end}", ""), F.substring(text, F.length(closed) + 1, F.lit(ALL))
    )


def live_markup(html: Column, drop: tuple[str, ...] = ("script", "style")) -> Column:
    """Markup without comments and without the named elements and their content."""

    def cut(text: Column, start: str, end: str) -> Column:
        return let(text, lambda t: F.when(t.rlike(rf"(?i){end}"), _without(t, start, end)).otherwise(t))

    text = cut(html, "<!--", "-->")
    for tag in drop:
        text = cut(text, rf"<{tag}\b", rf"</{tag}\s*>")
    return text


def behind_first(parts: Column) -> Column:
    """All entries of an array but the first."""
    return F.slice(parts, 2, ALL)


def all_matches(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def contents(markup: Column, opening: str, tag: str) -> Column:
    """What stands in each element of that tag, from an open tag that fits to the next end tag.

    The markup is cut at its end tags once. Each cut holds at most one such element, from its first open tag on; what is
    behind the last end tag is in none. So tags that never end cost no search for an end.
    """
    cut = F.split(markup, rf"(?i)</{tag}\s*+>", -1)

    def content(part: Column) -> Column:
        # An open tag ends at a >, so none begins behind the last one.
        ahead = F.regexp_extract(part, r"(?s)\A.*>", 0)
        return let(
            ahead,
            lambda h: F.when(
                h.rlike(rf"(?is){opening}"),
                F.concat(F.regexp_extract(h, rf"(?is){opening}(.*)\z", 1), F.substring(part, F.length(h) + 1, F.lit(ALL))),
            ),
        )

    closed = F.slice(cut, 1, F.greatest(F.size(cut) - 1, F.lit(0)))
    return F.filter(F.transform(closed, content), lambda c: c.isNotNull())


def first_match(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null when nothing matches."""
    return F.try_element_at(all_matches(text, pattern, group), F.lit(1))


def first_of(items: Column) -> Column:
    return F.try_element_at(items, F.lit(1))


def decoded(text: Column) -> Column:
    """Entities decoded; text without any is left alone."""
    return let(text, lambda t: F.when(t.contains("&"), unescape_html(t)).otherwise(t))


def visible(markup: Column) -> Column:
    """Text of a piece of markup, blanks squeezed."""
    return squeeze(decoded(F.regexp_replace(markup, TAG, " ")))
