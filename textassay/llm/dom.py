"""A small HTML parser: block elements in page order, with their text and statistics."""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)(?:>|\Z)|</[^>]*(?:>|\Z)", re.S)
NAMED = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
WORD = re.compile("[A-Z]?[a-z]+|[A-Z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg select button".split())
#: Without an end tag these take the rest of the page; of other raw elements the tag alone is skipped.
TEXT_ONLY = frozenset("script style textarea title".split())
FOREIGN = frozenset({"svg"})
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
CLOSES_P = BLOCK - frozenset("html body li dt dd td th tr tbody thead tfoot caption legend".split()) | {"hr"}
#: Elements that end an open one of the same sort, and what bounds the search.
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"tr", "td", "th", "thead", "tbody"}, {"table"})}


@dataclass
class Page:
    """Block elements in page order (parents first); node 0 is the page itself."""

    tags: list[str] = field(default_factory=lambda: ["html"])
    parents: list[int] = field(default_factory=lambda: [-1])
    depths: list[int] = field(default_factory=lambda: [0])
    ends: list[int] = field(default_factory=lambda: [1])
    names: list[list[str]] = field(default_factory=lambda: [[]])
    inner: list[int] = field(default_factory=lambda: [0])  # tags that are no blocks
    chars: list[int] = field(default_factory=lambda: [0])
    linked: list[int] = field(default_factory=lambda: [0])
    marks: list[int] = field(default_factory=lambda: [0])
    blocks: list[tuple[int, str]] = field(default_factory=list)


def attribute_words(attributes: str) -> list[str]:
    return [w.lower() for _, value in NAMED.findall(attributes) for w in WORD.findall(value)]


def parse(source: str) -> Page:
    page = Page()
    stack: list[tuple[str, int]] = [("html", 0)]  # open elements, with their block
    node, links = 0, 0
    parts: list[str] = []
    opened: Counter[str] = Counter()  # open elements by name: most searches of the stack find none and are not begun
    endless: set[str] = set()  # raw elements that have no end tag from here on

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                page.blocks.append((node, text))
                n = len(text)
                page.chars[node] += n
                page.marks[node] += text.count(".") + text.count(",")

    def close(at: int) -> None:
        """End the open elements from ``at`` of the stack on."""
        nonlocal node, links
        flush()
        for name, block in stack[at:]:
            opened[name] -= 1
            if name in BLOCK:
                page.ends[block] = len(page.tags)
            elif name == "a":
                links -= 1
        del stack[at:]
        node = stack[-1][1]

    def last_open(names: set[str] | frozenset[str], bounds: set[str] | frozenset[str]) -> int:
        if not any(opened[n] for n in names):
            return 0
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in names:
                return k
            if stack[k][0] in bounds:
                return 0
        return 0

    def text(piece: str) -> None:
        if piece:
            parts.append(piece)
            if links:
                page.linked[node] += len(piece.strip())

    at, n = 0, len(source)
    while at < n:
        m = TOKEN.search(source, at)
        if not m:
            text(source[at:])
            break
        text(source[at : m.start()])
        at = m.end()
        name = m[2]
        if not name:
            continue
        name = name.lower()
        if m[1]:
            if name in BLOCK:
                k = last_open({name}, frozenset()) if name not in ("html", "body") else 0
                if k:
                    close(k)
                else:
                    flush()
            elif name == "a":
                if k := last_open({"a"}, BLOCK):
                    del stack[k]
                    opened["a"] -= 1
                    links -= 1
            continue
        if name in RAW:
            parts.append(" ")
            page.inner[node] += 1
            if name in FOREIGN and m[3].endswith("/"):
                continue
            end = None if name in endless else re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(source, at)
            if end is None:
                endless.add(name)
            at = end.end() if end else n if name in TEXT_ONLY else at
        elif name in BLOCK:
            if name in ("html", "body"):
                if words := attribute_words(m[3]):
                    page.names[0] += words
                continue
            flush()
            if name in CLOSES_P and (k := last_open({"p"}, {"table", "button"})):
                close(k)
            if own := SIBLINGS.get(name):
                while k := last_open(own[0], own[1]):
                    close(k)
            page.tags.append(name)
            page.parents.append(node)
            page.depths.append(page.depths[node] + 1)
            page.ends.append(0)
            page.names.append(attribute_words(m[3]) if len(m[3]) > 4 else [])
            page.inner.append(0)
            page.chars.append(0)
            page.linked.append(0)
            page.marks.append(0)
            node = len(page.tags) - 1
            stack.append((name, node))
            opened[name] += 1
        else:
            page.inner[node] += 1
            if name in VOID:
                if name in ("br", "hr"):
                    parts.append(" ")
                    if name == "hr":
                        flush()
            elif name == "a":
                if not links:
                    stack.append((name, node))
                    opened[name] += 1
                    links += 1
    close(1)
    page.ends[0] = len(page.tags)
    return page

