"""Main text of HTML pages by two passes over blocks.

A page is cut into blocks at block-level tags. The first pass takes each block by itself: blocks of a region that is not the article (by
tag, role or class) and link lists are boilerplate; long blocks with stop words are text; short blocks stay open. The
second pass lets an open block follow the nearest decided blocks on both sides. Where a page marks its article, only blocks inside
it can be text. Classes and forms that wrap the article or most of a page's text are no regions.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

# Common function words of the languages that are told apart from lists of names and links.
STOP_WORDS = frozenset("""
the of and to in a is that for it was on with as be by at this are from or an have not but had his they her she which you one we all
were there been has when who will more no if out so said what up its about than into them can only other new some could time these
der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei
einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei
de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec son mais comme on ou si leur
el los del las y por con para su al lo como más pero sus este ya entre cuando muy sin sobre también me hasta hay donde quien
""".split())

# Elements that end a block, that never hold the article's text, and that mark it.
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer
form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead
title tr ul""".split())
APART = frozenset("aside button dialog footer form head iframe menu nav noscript object select svg template textarea title video audio canvas".split())
RAW = frozenset("script style noscript textarea title iframe template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MARKED = frozenset("article main".split())
# Words in class, id and role names of regions that are not the article.
REGIONS = frozenset("""ad ads adv advert advertisement advertising advertorial banner banners bio breadcrumb breadcrumbs byline comment comments commentlist
complementary consent contentinfo cookie cookies copyright disqus footer footers form header headers login masthead menu menus modal nav navbar
navigation newsletter notice notices notification outbrain overlay pager pagination paywall popup promo promos promotion recommended register related
reply respond search share sharing sidebar sidebars signup skip social sponsor sponsored subscribe subscription taboola tags teaser toolbar
tracking warning widget widgets""".split())

# Region words of what stands beside an article, however long; and words before which (or beside which) a
# region word tells something of the page or of a position instead of naming a region.
FIRM = frozenset("""ad ads adv advert advertisement advertising advertorial comment comments commentlist consent cookie cookies copyright disqus footer
footers outbrain paywall promo promos promotion recommended related reply respond sponsor sponsored taboola teaser""".split())
STATES = frozenset("has have hide hides no not show shows with without".split())
PLACES = frozenset("fixed sticky".split())

#: A wrapper holds more than this share of the page's stop words.
WRAPS = 0.5

#: First pass: the share of a block's characters in links from which it is a link list, the length from which a
#: block decides for itself, and the least share of stop words of a text block (of a marked article, and without one).
MOST_LINKS = 0.5
LONG = 70
STOPS_MARKED, STOPS = 0.02, 0.12
#: On a page without a long block of this share the language is unknown: long blocks with at most this share in links are text.
STOPS_KNOWN, FEW_LINKS = 0.2, 0.2

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)(?:((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|([^>]*)(?:>|\Z))", re.S)
_NAMES = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_WORD = re.compile(r"\w+")


@dataclass
class Region:
    """An element that is not the article by its names, or a form, unless it turns out to wrap the article."""

    around: Region | None
    kind: str  # 'firm', 'whole' (a region word as a whole name), 'part' (of a name) or 'form'
    marked: bool  # inside a marked article
    holds: set[str] = field(default_factory=set)  # marked elements in it
    weight: int = 0
    apart: bool = True


@dataclass
class Block:
    text: str
    linked: int  # characters inside links
    apart: bool
    marked: bool
    heading: bool
    region: Region | None = None


@dataclass
class _Open:
    """An element that is not closed yet."""

    name: str
    apart: bool  # for good
    marked: bool
    region: Region | None = None


@dataclass
class _Page:
    stack: list[_Open] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    links: int = 0
    breaks: int = 0
    heading: bool = False
    regions: list[Region] = field(default_factory=list)

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            top = self.stack[-1] if self.stack else _Open("", False, False)
            self.blocks.append(Block(text, self.linked, top.apart, top.marked, self.heading, top.region))
        self.parts, self.linked, self.breaks = [], 0, 0

    def text(self, raw: str) -> None:
        if raw:
            text = html.unescape(raw)
            if text.strip():
                self.breaks = 0
                if self.links:
                    self.linked += len(" ".join(text.split()))
            self.parts.append(text)

    def open(self, name: str, attributes: str) -> None:
        if name in BLOCKS:
            self.flush()
            self.heading = len(name) == 2 and name[0] == "h" and name[1].isdigit()
        if name == "br":
            self.breaks += 1
            self.parts.append(" ")
            if self.breaks == 2:
                self.flush()
        elif name == "a":
            self.links += 1
        if name in VOID:
            return
        if name == "p" or name == "li":  # they end an open one of their kind
            self._close_open(name)
        top = self.stack[-1] if self.stack else _Open("", False, False)
        kind = _region_kind(attributes, name, top.marked)
        apart = top.apart or kind == "hidden" or name in APART and name not in ("form", "header") or (name == "header" and not top.marked)
        kind, region = kind or ("form" if name == "form" else None), top.region
        if kind and not apart:
            region = Region(top.region, kind, top.marked)
            self.regions.append(region)
        if name in MARKED and region and not apart:
            region.holds.add(name)
        self.stack.append(_Open(name, apart, top.marked or name in MARKED, region))

    def _close_open(self, name: str) -> None:
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k].name == name:
                del self.stack[k:]
                return
            if self.stack[k].name in BLOCKS:
                return

    def close(self, name: str) -> None:
        if name in BLOCKS:
            self.flush()
            self.heading = False
        if name == "a":
            self.links = max(0, self.links - 1)
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k].name == name:
                del self.stack[k:]
                return
            if name not in BLOCKS and self.stack[k].name in BLOCKS:
                return  # a stray inline end tag closes nothing outside its block


def _region_kind(attributes: str, name: str, marked: bool) -> str | None:
    """How class, id or role name a region that is not the article, or 'hidden'. An article has headers of its own."""
    regions = REGIONS - {"header", "headers"} if marked else REGIONS
    if not attributes.strip() or name in ("html", "body"):
        return None
    found = set()
    for m in _NAMES.finditer(attributes):
        kind, value = m[1].lower(), (m[2] or "").strip("\"'")
        if kind == "hidden" or kind == "aria-hidden" and value == "true":
            return "hidden"
        if kind == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return "hidden"
        elif name not in MARKED:
            for one in value.split():
                parts = [p.lower() for p in _PARTS.findall(one)]
                named = regions.intersection(parts)
                if not named or parts[0] in STATES:
                    continue
                placed = not PLACES.isdisjoint(parts)
                found.add("part" if placed else "firm" if named & FIRM else "whole" if regions.issuperset(parts) else "part")
    return next((k for k in ("firm", "whole", "part") if k in found), None)


def _stop_words(text: str) -> int:
    return sum(w in STOP_WORDS for w in _WORD.findall(text.lower()))


def _settle(page: _Page) -> None:
    """Decides which regions are apart, and with them their blocks.

    A region that holds a main element wraps the page. Of the others, those beside an article by their names (``FIRM``) stay apart. One that holds most
    stop words of the rest of the page is a wrapper if it also holds an article element, or if it is a form or has a region word only as a part of a name.
    """
    for region in reversed(page.regions):
        if region.around:
            region.around.holds |= region.holds
    firm: set[int] = set()
    for region in page.regions:
        if region.around and id(region.around) in firm or region.kind == "firm" and "main" not in region.holds:
            firm.add(id(region))
    open_to_weight = [r for r in page.regions if id(r) not in firm and "main" not in r.holds and _may_wrap(r)]
    total = 0
    if open_to_weight:
        counted = [b for b in page.blocks if not b.apart and (b.region is None or id(b.region) not in firm)]
        weights = [_stop_words(b.text) for b in counted]
        if not any(weights):
            weights = [len(b.text) for b in counted]
        total = sum(weights)
        for block, weight in zip(counted, weights):
            if block.region:
                block.region.weight += weight
        for region in reversed(page.regions):
            if region.around:
                region.around.weight += region.weight
    wrappers = {id(r) for r in open_to_weight if r.weight > WRAPS * total}
    for region in page.regions:
        region.apart = "main" not in region.holds and id(region) not in wrappers or region.around is not None and region.around.apart
    for block in page.blocks:
        block.apart = block.apart or block.region is not None and block.region.apart


def _may_wrap(region: Region) -> bool:
    return "article" in region.holds or region.kind in ("part", "form") and not region.marked


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page in order, with decoded text and single spaces."""
    state, at = _Page(), 0
    while True:
        m = _TOKEN.search(page, at)
        if not m:
            break
        state.text(page[at:m.start()])
        at = m.end()
        if m[2]:
            name = m[2].lower()
            if m[1]:
                state.close(name)
            elif name in RAW:  # its text is no markup, up to its own end tag
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(page, at)
                if name in BLOCKS:
                    state.flush()
                at = end.end() if end else len(page)
            else:
                state.open(name, m[3] or m[4] or "")
        if at >= len(page):
            break
    state.text(page[at:])
    state.flush()
    _settle(state)
    return state.blocks


def _stop_share(text: str) -> float:
    found = _WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in found) / len(found) if found else 0.0


def _first_pass(block: Block, only_marked: bool, unknown: bool = False) -> bool | None:
    """True: text; False: boilerplate; None: open. ``unknown``: the stop words are not those of the page's language."""
    if block.apart or only_marked and not block.marked:
        return False
    size = len(block.text)
    if block.linked > MOST_LINKS * size:
        return False
    if block.heading or size < LONG:
        return None
    if _stop_share(block.text) >= (STOPS_MARKED if block.marked else STOPS):
        return True
    if unknown and block.linked <= FEW_LINKS * size:
        return True
    return None if block.marked or unknown else False


def _unknown_language(blocks: list[Block], first: list[bool | None]) -> bool:
    """Whether a page without a marked article has long, link-poor blocks that lack stop words, and none that has many."""
    own = [b for b in blocks if not b.apart and not b.heading and len(b.text) >= LONG and b.linked <= MOST_LINKS * len(b.text)]
    return any(state is False and not b.apart and not b.heading for b, state in zip(blocks, first)) and all(_stop_share(b.text) < STOPS_KNOWN for b in own)


def main_text(page: str | None) -> str:
    """The text blocks of a page, joined by line ends; '' for null, empty and pages without text."""
    blocks = blocks_of(page or "")
    only_marked = any(b.marked and not b.apart for b in blocks)
    first = [_first_pass(b, only_marked) for b in blocks]
    if not only_marked and _unknown_language(blocks, first):
        first = [_first_pass(b, only_marked, unknown=True) for b in blocks]
    # in a marked article, other regions inside it say nothing about the blocks beside them
    decided = [None if only_marked and (b.apart or not b.marked) else state for b, state in zip(blocks, first)]
    before: list[bool | None] = []
    last = None
    for state in decided:
        last = last if state is None else state
        before.append(last)
    kept, last = [False] * len(blocks), None
    for k in range(len(blocks) - 1, -1, -1):
        last = last if decided[k] is None else decided[k]
        if first[k] is not None:
            kept[k] = first[k]
        elif only_marked:  # what is inside the article and not boilerplate by itself follows its nearest text, or stands alone
            kept[k] = True in (before[k], last) or True not in first
        else:  # a heading follows the block after it; others follow both sides, and need the side that is there
            sides = [last] if blocks[k].heading and last is not None else [s for s in (before[k], last) if s is not None]
            kept[k] = bool(sides) and all(sides)
    return "\n".join(b.text for b, keep in zip(blocks, kept) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html).

    Null and empty pages have an empty text. Pages are read whole, however long; repeated rows stay, and other columns are not used.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(p) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.string()), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())],
                schema=schema)

    return pages.select("page_id", "url", "html").mapInArrow(texts, "page_id long, url string, text string, n_chars long")
