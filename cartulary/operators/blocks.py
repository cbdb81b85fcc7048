"""Page markup to an ordered list of blocks: headings, paragraphs, lists, images.

All of it happens inside the page's row. The page is cut at block tags; an automaton over the tags alone, for many pages
at once, says where each block, list item and section begins and ends; the pieces of text between are put together by
column work. No text is shuffled and none reaches Python, and pages of equal or no id stay apart.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartulary.functions.markup import ALL, TAG, decoded, let, live_markup
from cartulary.functions.text import strip_edges, unescape_html

PAGE = "page_id"
PAGE_ROW = "page_row"
HEADINGS = ["h1", "h2", "h3"]
LISTS = ["ul", "ol"]
# Other block tags; they end an open paragraph but carry no meaning of their own.
CONTAINERS = (
    "address|article|aside|blockquote|center|dd|div|dl|dt|fieldset|footer|form|h4|h5|h6|header|hr|"
    "main|nav|pre|section|table|tbody|td|tfoot|th|thead|tr"
)
_NAMES = rf"/?(?:h1|h2|h3|p|ul|ol|li|img|br|{CONTAINERS})"
# A place right before a block tag.
BLOCK_TAG = rf"(?i)(?=<{_NAMES}\b[^>]*>)"
# A page that opens with bare text, before any body tag, has it in an implied paragraph.
LEADING_TEXT = r"(?is)^(\s*(?:<!doctype[^>]*>\s*|<html\b[^>]*>\s*)*)([^<\s])"

TITLE_SECTION = -1


def tokens(html: Column) -> Column:
    """A page as an array of ``(tag, attrs, pieces)``: each block tag with the pieces of text that follow it.

    Inline tags stand between trimmed pieces of text; blank ones are left out.
    """
    body = live_markup(html, ("script", "style", "head"))
    body = F.regexp_replace(body, LEADING_TEXT, "$1<p>$2")

    def cut(part: Column, tag: Column) -> Column:
        none = tag == ""
        attrs = F.when(none, "").otherwise(F.regexp_extract(part, r"^<[^\s>]*([^>]*)>", 1))
        said = F.when(none, part).otherwise(F.substring(part, F.instr(part, F.lit(">")) + 1, F.lit(ALL)))
        # Most pieces hold no inline tag and need no cutting.
        pieces = F.when(said.contains("<"), F.split(said, TAG, -1)).otherwise(F.array(said))
        pieces = F.transform(pieces, lambda x: strip_edges(decoded(x)))
        return F.struct(tag.alias("tag"), attrs.alias("attrs"), F.filter(pieces, lambda x: x != "").alias("pieces"))

    def token(part: Column) -> Column:
        named = F.when(part.startswith("<"), F.lower(F.regexp_extract(part, rf"(?i)^<({_NAMES})\b[^>]*>", 1)))
        return let(F.coalesce(named, F.lit("")), lambda tag: cut(part, tag))

    # The blank ahead keeps a part without tag in front, also where the page opens with a tag.
    return F.transform(F.split(F.concat(F.lit(" "), body), BLOCK_TAG, -1), token)


def _sums(values: np.ndarray, starts: np.ndarray, page: np.ndarray) -> np.ndarray:
    """Running sums that begin anew on each page."""
    added = np.cumsum(values)
    before = np.concatenate(([0], added))[starts]
    return added - before[page]


def _latest(marked: np.ndarray, starts: np.ndarray, page: np.ndarray) -> np.ndarray:
    """For each token the last marked one of its page up to it, or -1."""
    last = np.maximum.accumulate(np.where(marked, np.arange(len(marked)), -1)) if len(marked) else marked.astype(np.int64)
    return np.where(last >= starts[page], last, -1)


_ORDER = [*HEADINGS, "p", *LISTS, "li", "img", "br", *CONTAINERS.split("|")]
_TAGS = pa.array(_ORDER + [f"/{t}" for t in _ORDER])
_CODE = {t.as_py(): i for i, t in enumerate(_TAGS)}
_LOOSE, _LIST, _PARAGRAPH = 0, 1, 2  # modes; a heading is 3 and more


def _codes(*names: str) -> np.ndarray:
    return np.array([_CODE[n] for n in names])


_SPAN = "struct<start:int,n:int>"
SPANS = (
    f"array<struct<block_no:int,mode:int,ordered:boolean,section_no:int,start:int,n:int,items:array<{_SPAN}>,images:array<int>>>"
)


def block_spans(tags: pa.Array) -> pa.Array:
    """The blocks of pages, given the tags of their tokens: number, kind, section, and where tokens, items and images stand.

    The page title, its first heading of level 1 or 2, is section -1 on its own. Any other heading opens a section, and
    what stands before the first one is section 0.
    """
    lengths = pc.fill_null(pc.list_value_length(tags), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(lengths) else lengths
    page = np.repeat(np.arange(len(lengths)), lengths)
    n = len(page)
    code = pc.fill_null(pc.index_in(tags.flatten(), value_set=_TAGS), -1).to_numpy(zero_copy_only=False)

    opens, closes = np.isin(code, _codes(*LISTS)), np.isin(code, _codes(*[f"/{t}" for t in LISTS]))
    total = _sums(opens.astype(np.int64) - closes, starts, page)
    # A stray closing tag must not push the depth below zero: what the lowest sum of the page so far lacks is added.
    apart = 2 * n + 2
    lowest = np.minimum.accumulate(total - page * apart) + page * apart if n else total
    depth = total - np.minimum(0, lowest)
    outside = depth == 0

    begins = np.isin(code, _codes(*HEADINGS, "p"))
    ends = np.isin(code, _codes(*[f"/{t}" for t in (*HEADINGS, "p", *LISTS)]))
    neutral = np.isin(code, _codes(*CONTAINERS.split("|"), *[f"/{t}" for t in CONTAINERS.split("|")]))
    mode = np.full(n, -1)
    mode[opens & (depth == 1)] = _LIST
    mode[outside & (ends | neutral)] = _LOOSE
    kinds = np.array([3, 4, 5, _PARAGRAPH])
    mode[outside & begins] = kinds[code[outside & begins]] if n else mode[:0]
    at = _latest(mode >= 0, starts, page)
    mode = np.where(at >= 0, mode[at], _LOOSE) if n else mode
    first = np.zeros(n, dtype=bool)
    first[starts[lengths > 0]] = True
    before = np.where(first, _LOOSE, np.roll(mode, 1))
    loose = mode == _LOOSE
    new = (outside & begins) | (opens & (depth == 1)) | (loose & (np.isin(code, _codes("br", "img")) | (before != _LOOSE)))
    block_no = _sums(new.astype(np.int64), starts, page)

    top = depth == 1
    item = top & (code == _CODE["li"])
    state = _latest(item | (top & (opens | (code == _CODE["/li"]))), starts, page)
    in_item = (state >= 0) & item[state]
    item_no = _sums(item.astype(np.int64), starts, page)

    # Blocks are runs of tokens.
    head = np.flatnonzero(first | new)
    size = np.diff(np.append(head, n))
    owner, kind = page[head], mode[head]
    heading = kind >= 3
    able = heading & (kind <= 4)
    seen = np.concatenate(([0], np.cumsum(able)))
    per_page = np.searchsorted(owner, np.arange(len(lengths) + 1))
    title = able & (seen[1:] - seen[per_page[owner]] == 1)
    opened = np.cumsum(heading & ~title)
    section = opened - np.concatenate(([0], opened))[per_page[owner]]
    section = np.where(title, TITLE_SECTION, section)

    # Items are runs of tokens of a list block that are in one item.
    listed = in_item & (mode == _LIST)
    start_item = listed & (first | new | ~np.roll(listed, 1) | (np.roll(item_no, 1) != item_no))
    item_head = np.flatnonzero(start_item)
    nth = np.cumsum(start_item) - 1
    item_size = np.bincount(nth[listed], minlength=len(item_head)) if len(item_head) else np.zeros(0, dtype=np.int64)
    images = np.flatnonzero((code == _CODE["img"]) & (mode < 3) & ((mode != _LIST) | in_item))

    def lists(places: np.ndarray, values: pa.Array, bounds: np.ndarray) -> pa.ListArray:
        """Values at sorted places, one list for each stretch between bounds."""
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(places, bounds), pa.int32()), values)

    int32 = pa.int32()
    item_spans = pa.StructArray.from_arrays(
        [pa.array(item_head - starts[page[item_head]], int32), pa.array(item_size, int32)], names=["start", "n"]
    )
    bounds = np.append(head, n)
    blocks = pa.StructArray.from_arrays(
        [
            pa.array(block_no[head], int32),
            pa.array(kind, int32),
            pa.array(code[head] == _CODE["ol"]),
            pa.array(section, int32),
            pa.array(head - starts[owner], int32),
            pa.array(size, int32),
            lists(item_head, item_spans, bounds),
            lists(images, pa.array(images - starts[page[images]], int32), bounds),
        ],
        names=["block_no", "mode", "ordered", "section_no", "start", "n", "items", "images"],
    )
    return pa.ListArray.from_arrays(pa.array(per_page, int32), blocks)


BLOCK_FIELDS = ["sub", "type", "level", "ordered", "text", "items", "src", "alt"]
_TYPES = {
    "sub": "int", "type": "string", "level": "int", "ordered": "boolean", "text": "string",
    "items": "array<string>", "src": "string", "alt": "string",
}


def _row(block: Column, **fields: Column) -> Column:
    return F.struct(
        block["block_no"].cast("bigint").alias("block_no"),
        block["section_no"].cast("bigint").alias("section_no"),
        *(fields.get(n, F.lit(None)).cast(_TYPES[n]).alias(n) for n in BLOCK_FIELDS),
    )


def _attr(attrs: Column, name: str) -> Column:
    return unescape_html(F.regexp_extract(attrs, rf"""(?i)\b{name}\s*=\s*["']([^"']*)["']""", 1))


def extract_blocks(pages: DataFrame) -> DataFrame:
    """``(page_id, page_row, block_no, section_no, sub, type, level, ordered, text, items, src, alt)``.

    Blocks are ordered by ``(block_no, sub)``. An image inside a paragraph or list item comes
    right after its block, a loose one stands where it is. ``page_row`` is a number of the page's row: pages of equal or
    null id stay apart by it. ``section_no`` as in ``block_spans``.
    """
    spans = F.arrow_udf(block_spans, SPANS)
    cut = pages.select(PAGE, F.monotonically_increasing_id().alias(PAGE_ROW), tokens(F.col("html")).alias("_tokens"))
    found = cut.withColumn("_blocks", spans(F.transform("_tokens", lambda t: t["tag"])))

    def said(start: Column, n: Column, glue: str) -> Column:
        return F.array_join(F.flatten(F.transform(F.slice("_tokens", start + 1, n), lambda t: t["pieces"])), glue)

    def rows(b: Column) -> Column:
        heading, listed = b["mode"] >= 3, b["mode"] == _LIST
        text = F.when(heading, said(b["start"], b["n"], "")).when(~listed, said(b["start"], b["n"], " "))
        block = _row(
            b,
            sub=F.lit(0),
            type=F.when(heading, "heading").when(listed, "list").otherwise("paragraph"),
            level=F.when(heading, b["mode"] - 2),
            ordered=F.when(listed, b["ordered"]),
            text=text,
            items=F.when(listed, F.transform(b["items"], lambda i: said(i["start"], i["n"], " "))),
        )

        def picture(at: Column) -> Column:
            attrs = F.get("_tokens", at)["attrs"]
            return _row(
                b,
                sub=F.when(b["mode"] == _LOOSE, F.lit(-1)).otherwise(at),
                type=F.lit("image"),
                src=_attr(attrs, "src"),
                alt=F.nullif(_attr(attrs, "alt"), F.lit("")),
            )

        return F.concat(F.array(block), F.transform(b["images"], picture))

    shown = F.filter(F.flatten(F.transform("_blocks", rows)), lambda r: (r["type"] != "paragraph") | (r["text"] != ""))
    # Outer: else the optimizer asks ahead, in another run of all this, which pages have no block.
    return found.select(PAGE, PAGE_ROW, F.inline_outer(shown)).filter("type is not null")


def image_blocks(pages: DataFrame) -> DataFrame:
    return extract_blocks(pages).filter(F.col("type") == "image")
