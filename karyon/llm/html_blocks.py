"""Leaf text blocks of a web page, with what surrounds them.

One pass over the page: a tag that does not end is looked for once, and afterwards a tag ends with its first `>`; open elements are kept
by name as well as in a stack, so an end tag costs what it closes. Each open element points to the set of features of
its ancestors and itself and makes a set of its own only if it adds one, so time and memory grow with the page, whatever its depth.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

#: HTML element names by their role in the text flow.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes noscript script style template textarea title xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav object ol option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
#: What a start tag closes if it stands open, up to the elements that hold it.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select",)),
    "tr": (("tr", "td", "th"), ("table", "tbody", "thead", "tfoot")),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)),
    "thead": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)),
}

_MARK = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
_LOOSE = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_NAMES = re.compile(r"\b(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PART = re.compile(r"[a-z]+")


@dataclass
class Block:
    text: str
    around: frozenset[str]  # features of the ancestors: in:TAG and name:WORD
    parent: str
    linked: int  # characters inside links


def _words(attributes: str) -> frozenset[str]:
    if "=" not in attributes:
        return frozenset()
    return frozenset(w for m in _NAMES.finditer(attributes) for w in _PART.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", m[1] or m[2] or m[3] or "").lower()))


class _Reader:
    """known says which features of ancestors are of use; None: all."""

    def __init__(self, known: Callable[[str], bool] | None = None) -> None:
        self.known = known
        self.stack: list[tuple[str, frozenset[str]]] = []
        self.open: dict[str, list[int]] = {}  # places in the stack by tag
        self.open_blocks: list[int] = []
        self.pieces: list[str] = []
        self.linked = 0
        self.blocks: list[Block] = []

    def text(self, piece: str) -> None:
        if "&" in piece:
            piece = unescape(piece)
        self.pieces.append(piece)
        if self.open.get("a"):
            self.linked += len(piece)

    def flush(self) -> None:
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            if text:
                parent, around = self.stack[-1] if self.stack else ("", frozenset())
                self.blocks.append(Block(text, around, parent, self.linked))
            self.pieces = []
        self.linked = 0

    def push(self, tag: str, attributes: str) -> None:
        around = self.stack[-1][1] if self.stack else frozenset()
        own = {f"in:{tag}", *(f"name:{w}" for w in _words(attributes))} if attributes else {f"in:{tag}"}
        new = {f for f in own if f not in around and (self.known is None or self.known(f))}
        self.open.setdefault(tag, []).append(len(self.stack))
        if tag in BLOCK:
            self.open_blocks.append(len(self.stack))
        self.stack.append((tag, around | new if new else around))

    def cut(self, depth: int) -> None:
        for tag, _ in reversed(self.stack[depth:]):
            self.open[tag].pop()
            if tag in BLOCK:
                self.open_blocks.pop()
        del self.stack[depth:]

    def close(self, names: tuple[str, ...], within: tuple[str, ...]) -> None:
        """Closes the outermost of these elements inside the innermost of those that hold them."""
        barrier = max((places[-1] for t in within if (places := self.open.get(t))), default=-1)
        lowest = None
        for t in names:
            places = self.open.get(t)
            if places and places[-1] > barrier:
                at = places[bisect_right(places, barrier)]
                lowest = at if lowest is None else min(at, lowest)
        if lowest is not None:
            self.cut(lowest)

    def start(self, tag: str, attributes: str) -> None:
        if tag in BLOCK:
            self.flush()
            if tag in CLOSES:
                self.close(*CLOSES[tag])
            self.close(("p",), ("table", "td", "th", "button", "object", "blockquote", "li", "div", "section", "article"))
        if tag in VOID:
            if tag == "br" or tag == "hr":
                self.pieces.append(" ")
            return
        if not attributes.endswith("/") or tag in BLOCK:
            self.push(tag, attributes)

    def end(self, tag: str) -> None:
        if tag in BLOCK:
            self.flush()
        places = self.open.get(tag)
        if places and (tag in BLOCK or not self.open_blocks or self.open_blocks[-1] < places[-1]):
            self.cut(places[-1])


@lru_cache(maxsize=32)
def _closing(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\b[^>]*>", re.I)


def page_blocks(html: str | None, known: Callable[[str], bool] | None = None) -> list[Block]:
    """The page's blocks in order; scripts, styles, comments and other raw elements are left out."""
    html = html or ""
    reader, at, n = _Reader(known), 0, len(html)
    last, mark = html.rfind(">"), _MARK
    while at < n:
        open_ = html.find("<", at)
        if open_ < 0:
            reader.text(html[at:])
            break
        if open_ > at:
            reader.text(html[at:open_])
        m = mark.match(html, open_) if open_ < last or html.startswith("<!--", open_) else None
        if not m and mark is _MARK and open_ < last and html[open_ + 1 : open_ + 2].strip("/").isalpha():
            mark = _LOOSE  # a quote that does not end; once is enough to look for its end
            m = mark.match(html, open_)
        if not m and open_ < last and html.startswith("</", open_):
            mark, m = (_LOOSE, _LOOSE.match(html, open_)) if mark is _MARK else (mark, None)
        if not m:
            reader.text("<")
            at = open_ + 1
            continue
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:
            reader.end(tag)
        elif tag in RAW:
            if tag != "title" and tag not in ("script", "style", "template"):
                reader.flush()
            close = _closing(tag).search(html, at) if at <= last else None
            at = close.end() if close else n
        else:
            reader.start(tag, m[3] or "")
    reader.flush()
    return reader.blocks
