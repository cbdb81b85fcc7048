"""A page as a small tree of blocks: tolerant reading of markup, marks of boilerplate, equal neighbours folded.

``read`` gives a page's title, its skeleton (element labels in preorder, without texts) and its blocks of text, each with
the skeleton node it stands at. Neighbours of the same structure are one skeleton node, so that a list of any length has one
shape. All passes are linear in the page and use no recursion, so depth and open tags do no harm.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

# Elements that stand in a line of text; all others begin a block.
INLINE = frozenset(
    "a abbr acronym audio b bdi bdo big br canvas cite code data del dfn em embed font i img ins kbd label map mark math "
    "meter object output picture progress q rp rt ruby s samp small span strike strong sub sup td th time tt u var video wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe xmp noembed noframes".split())  # up to their own end tag, whatever stands inside
TRANSPARENT = frozenset("html body".split())
# Elements that are never part of an article.
BOILERPLATE_TAGS = frozenset(
    "nav footer aside form button select input textarea script style noscript template iframe object svg canvas audio video "
    "dialog menu head datalist fieldset search xmp noembed noframes".split()
)
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form status".split())
# A class or id says boilerplate if its words are of these two lists, at least one of the first.
BOILERPLATE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsors sponsored promo promos promoted "
    "promotion banner cookie cookies consent gdpr notice notices notification notifications announcement alert alerts popup modal "
    "overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments "
    "commentlist disqus respond reply replies discussion nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager "
    "sidebar sidebars footer header masthead topbar toolbar widget widgets search form paywall disclaimer hidden".split()
)
FILLER_WORDS = frozenset(
    "area bar block body bottom box button buttons by container content footer form global header holder icon icons inner item items "
    "left link links list main message module outer page pane panel posts articles stories primary reader readers region right row "
    "secondary section site slot social story text thread title top unit user users view visitor wrap wrapper js the to with no jump "
    "js-only sticky fixed mobile desktop policy warning ol ul li div".split()
)
CLOSES = {  # an opening tag ends these, where they are the innermost open block
    "li": ("li", "p"),
    "dt": ("dt", "dd", "p"),
    "dd": ("dt", "dd", "p"),
    "tr": ("tr", "p"),
    "tbody": ("tr", "thead", "tbody", "p"),
    "thead": ("p",),
    "tfoot": ("tr", "tbody", "p"),
    "option": ("option",),
    "optgroup": ("option", "optgroup"),
}

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_QUOTE = re.compile(r"=\s*([\"'])")
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_OF_INTEREST = re.compile(r"class|id|role|hidden|style", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass
class Page:
    title: str
    skeleton: str  # a line for each node in preorder: depth, label; a label that ends in ! is boilerplate
    nodes: list[int]  # of each block, its place in the skeleton
    texts: list[str]
    links: list[int]  # of each block, how many of its characters are links


class _Element:
    __slots__ = ("article", "children", "label", "mark", "parent", "soft", "tag")

    def __init__(self, tag: str, label: str, parent: int, mark: bool, soft: bool, article: bool) -> None:
        self.tag, self.label, self.parent, self.mark, self.soft, self.article = tag, label, parent, mark, soft, article
        self.children: list[int] = []


class _Text:
    __slots__ = ("links", "parent", "pieces")

    def __init__(self, parent: int) -> None:
        self.parent = parent
        self.pieces: list[str] = []
        self.links: list[str] = []


def _tag_end(html: str, at: int) -> int:
    """Where the tag ends that goes on at ``at``: behind its >, one inside a quoted value not counted."""
    last = None
    while True:
        end = html.find(">", at)
        if end < 0:
            return len(html)
        quote = _QUOTE.search(html, at, end)
        if quote is None:
            return end + 1
        if last is None:
            last = {q: html.rfind(q) for q in "\"'"}
        if last[quote.group(1)] < quote.end():  # never closed: the quote is no quote
            return end + 1
        at = html.find(quote.group(1), quote.end()) + 1


def says_boilerplate(name: str) -> bool:
    """Whether a class or id is one of boilerplate."""
    words = [w.lower() for w in _WORDS.findall(name)]
    return any(w in BOILERPLATE_WORDS for w in words) and all(w in BOILERPLATE_WORDS or w in FILLER_WORDS for w in words)


def _attributes(said: str) -> dict[str, str]:
    if not _OF_INTEREST.search(said):
        return {}
    return {m.group(1).lower(): m.group(2) or m.group(3) or m.group(4) or "" for m in _ATTRIBUTE.finditer(said)}


@lru_cache(maxsize=4_096)
def _described(tag: str, said: str) -> tuple[str, bool, bool]:
    """What a tag says: its label, whether its names and whether anything else about it speak of boilerplate."""
    attributes = _attributes(said)
    names = attributes.get("class", "").split()
    named = any(says_boilerplate(n) for n in (*names, attributes.get("id", "")))
    unseen = "hidden" in attributes or attributes.get("aria-hidden") == "true" or _UNSEEN.search(attributes.get("style", "")) is not None
    hard = unseen or (tag in BOILERPLATE_TAGS and tag != "form") or attributes.get("role", "").lower() in BOILERPLATE_ROLES
    label = ".".join([tag, *(re.sub(r"\d+", "", n).lower() for n in names)])
    return label.replace("\n", ""), named, hard


class _Reader:
    def __init__(self, html: str) -> None:
        self.html = html
        self.items: list[_Element | _Text] = [_Element("", "", -1, False, False, False)]
        self.open = [0]  # elements, outermost first
        self.at: dict[str, list[int]] = {}  # tag -> places in ``open``
        self.inline: list[str] = []  # open links only: other inline elements change nothing
        self.leaf: _Text | None = None
        self.broken = False  # the last thing was a line break
        self.title = ""
        self.run()

    def push(self, tag: str, label: str, named: bool, hard: bool) -> None:
        parent = self.open[-1]
        above = self.items[parent]
        inside = above.article or (tag in ("article", "main") and not named)
        soft = (named and tag != "main") or tag == "form" or (tag == "header" and not inside)
        self.items.append(_Element(tag, label, parent, hard, soft and not hard, inside))
        above.children.append(len(self.items) - 1)
        self.at.setdefault(tag, []).append(len(self.open))
        self.open.append(len(self.items) - 1)
        self.leaf = None

    def pop_to(self, depth: int) -> None:
        while len(self.open) > depth:
            self.at[self.items[self.open.pop()].tag].pop()
        self.leaf = None
        self.inline.clear()

    def say(self, text: str) -> None:
        if self.leaf is None:
            if not text.strip():
                return
            self.leaf = _Text(self.open[-1])
            self.items.append(self.leaf)
            self.items[self.open[-1]].children.append(len(self.items) - 1)
        said = unescape(text) if "&" in text else text
        self.leaf.pieces.append(said)
        if self.inline:
            self.leaf.links.append(said)
        if said.strip():
            self.broken = False

    def start(self, tag: str, said: str) -> None:
        if tag == "br":
            if self.broken:  # the second of two ends the block
                self.leaf = None
            elif self.leaf is not None:
                self.leaf.pieces.append(" ")
                self.broken = True
            return
        if tag in TRANSPARENT:
            return
        if said:
            label, named, hard = _described(tag, said) if len(said) < 500 else _described.__wrapped__(tag, said)
        else:
            label, named, hard = tag, False, tag in BOILERPLATE_TAGS and tag != "form"
        plain = tag in INLINE
        if plain and not named and not hard:
            if tag == "a":
                self.inline.append(tag)
            elif tag in ("td", "th") and self.leaf is not None:
                self.leaf.pieces.append(" ")
            return
        if tag in VOID:
            if tag == "hr":
                self.leaf = None
            return
        if not plain:  # a block ends the paragraph it would stand in
            if tag in CLOSES:
                closing = CLOSES[tag]
                while len(self.open) > 1 and self.items[self.open[-1]].tag in closing:
                    self.pop_to(len(self.open) - 1)
            elif self.at.get("p") and self.items[self.open[-1]].tag == "p":
                self.pop_to(len(self.open) - 1)
        self.push(tag, label, named, hard)
        if said.endswith("/") and "-" in tag:
            self.pop_to(len(self.open) - 1)

    def end(self, tag: str) -> None:
        if tag == "a" and self.inline:
            self.inline.pop()
        places = self.at.get(tag)
        if places:
            self.pop_to(places[-1])

    def run(self) -> None:
        html, at = self.html, 0
        ends: dict[str, re.Pattern[str]] = {}
        while at < len(html):
            mark = html.find("<", at)
            if mark < 0:
                self.say(html[at:])
                return
            if mark > at:
                self.say(html[at:mark])
            name = _NAME.match(html, mark)
            if name is None:
                if html.startswith("<!--", mark):
                    end = html.find("-->", mark + 2)
                    at = len(html) if end < 0 else end + 3
                elif html.startswith(("<!", "<?", "</"), mark):
                    end = html.find(">", mark)
                    at = len(html) if end < 0 else end + 1
                else:
                    self.say("<")
                    at = mark + 1
                continue
            at = _tag_end(html, name.end())
            tag = name.group(2).lower()
            if name.group(1):
                self.end(tag)
                continue
            said = html[name.end() : at - 1]
            if tag in RAW:
                ends.setdefault(tag, re.compile(f"</{tag}(?=[\\s/>])", re.I))
                found = ends[tag].search(html, at)
                if tag == "title" and not self.title:
                    self.title = " ".join(unescape(html[at : found.start() if found else len(html)]).split())
                at = _tag_end(html, found.end()) if found else len(html)
                self.leaf = self.leaf if tag in ("script", "style") else None
                continue
            self.start(tag, said)


def _marks(items: list[_Element | _Text]) -> None:
    """Settles the softer marks: an element that holds the article is no boilerplate, whatever its class or a form round it."""
    articles, said = [0] * len(items), [0] * len(items)  # below each element; a title says as much as four paragraphs
    for i in range(len(items) - 1, 0, -1):
        item = items[i]
        if isinstance(item, _Element):
            if item.soft:
                item.mark = not articles[i] and (item.tag != "form" or said[i] < 4)
            if item.mark:
                continue
            articles[item.parent] += articles[i] + (item.tag in ("article", "main") and not item.soft)
            said[item.parent] += said[i] + {"h1": 4, "p": 1}.get(item.tag, 0)


def read(html: str | None) -> Page:
    reader = _Reader(html or "")
    items = reader.items
    _marks(items)
    # From the leaves up: the shape of each item, nothing for those without text; equal shapes have one number.
    shapes: dict[tuple, int] = {}
    sizes = [0]
    shape = [0] * len(items)
    folded: list[list[int]] = [[] for _ in items]
    texts: dict[int, str] = {}
    for i in range(len(items) - 1, -1, -1):
        item = items[i]
        if isinstance(item, _Text):
            said = " ".join("".join(item.pieces).split())
            if not said:
                continue
            texts[i] = said
            key: tuple = ("#",)
            size = 1
        else:
            kept = [c for c in item.children if shape[c]]
            if not kept and i:
                continue
            folded[i] = kept
            parts = [shape[c] for n, c in enumerate(kept) if not n or shape[c] != shape[kept[n - 1]]]
            key = (item.label + ("!" if item.mark else ""), *parts)
            size = 1 + sum(sizes[p] for p in parts)
        if key not in shapes:
            shapes[key] = len(sizes)
            sizes.append(size)
        shape[i] = shapes[key]
    lines: list[str] = [""] * sizes[shape[0]]
    page = Page(reader.title, "", [], [], [])
    todo = [(0, 0, 0)]
    while todo:
        i, node, depth = todo.pop()
        item = items[i]
        if isinstance(item, _Text):
            lines[node] = f"{depth} #"
            page.nodes.append(node)
            page.texts.append(texts[i])
            page.links.append(min(len(texts[i]), sum(len("".join(p.split())) for p in item.links)))
            continue
        lines[node] = f"{depth} {item.label}{'!' if item.mark else ''}"
        ahead, below = node + 1, []
        for n, c in enumerate(folded[i]):
            if n and shape[c] != shape[folded[i][n - 1]]:
                ahead += sizes[shape[folded[i][n - 1]]]
            below.append((c, ahead, depth + 1))
        todo.extend(reversed(below))
    page.skeleton = "\n".join(lines)
    if not page.title:
        page.title = page.texts[0] if page.texts else ""
    return page
