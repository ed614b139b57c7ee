"""Web pages as trees of block elements and text blocks."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(class|id|role|data-main)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
NAME = re.compile(r"[a-z]+")
WHITE = re.compile(r"\s+")

VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split())
# What stands inside is never text of the page.
HIDDEN = frozenset(
    "head title script style noscript template iframe object svg math canvas audio video "
    "select button textarea datalist".split())
RAW = frozenset("script style textarea title noscript iframe".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu "
    "nav ol p pre search section summary table tbody tfoot thead tr caption ul".split())
# An opening tag ends the open elements named here, up to the nearest element that holds them.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}), "body": ({"head"}, {"html"}),
}
NOT_IN_P = BLOCK - {"html", "body"}


@dataclass
class Page:
    """Nodes in page order; a parent comes before its children. ``text`` is None for elements."""

    parent: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    names: list[tuple[str, ...]] = field(default_factory=list)
    text: list[str | None] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)
    marked: list[bool | None] = field(default_factory=list)

    def add(self, parent: int, tag: str, names: tuple[str, ...], text: str | None, linked: int,
            marked: bool | None) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.names.append(names)
        self.text.append(text)
        self.linked.append(linked)
        self.marked.append(marked)
        return len(self.parent) - 1


def _read_attributes(source: str) -> tuple[tuple[str, ...], bool | None]:
    names: list[str] = []
    marked = None
    for key, a, b, c in ATTRIBUTE.findall(source):
        value = a or b or c
        if key.lower() == "data-main":
            marked = value == "1"
        else:
            names += NAME.findall(CAMEL.sub(" ", value).lower())
    return tuple(dict.fromkeys(names)), marked


def parse(source: str) -> Page:
    """The tree of a page; unclosed, stray and cut-off tags are taken as browsers take them."""
    page = Page()
    page.add(-1, "root", (), None, 0, None)
    open_tags: list[tuple[str, int, bool | None]] = [("root", 0, None)]
    # Depths of the open tags by name, and of those that are blocks, the deepest last.
    depths: dict[str, list[int]] = {}
    blocks: list[int] = []
    parts: list[str] = []
    hidden = links = linked = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = WHITE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                page.add(open_tags[-1][1], "#text", (), text, min(linked, len(text)),
                         open_tags[-1][2])
            parts.clear()
        linked = 0

    def close_from(depth: int) -> None:
        nonlocal hidden, links
        if blocks and blocks[-1] >= depth:
            flush()
        for tag, _, _ in open_tags[depth:]:
            hidden -= tag in HIDDEN
            links -= tag == "a"
            depths[tag].pop()
        del open_tags[depth:]
        while blocks and blocks[-1] >= depth:
            blocks.pop()

    def deepest(tags: set[str]) -> int:
        return max((depths[tag][-1] for tag in tags if depths.get(tag)), default=0)

    def find(wanted: set[str], until: set[str]) -> int:
        depth = deepest(wanted)
        if until is BLOCK:
            held = blocks[-1] if blocks else 0
        else:
            held = deepest(until)
        return depth if depth >= held else 0

    at, end = 0, len(source)
    while at < end:
        found = TAG.search(source, at)
        stop = found.start() if found else end
        if stop > at and not hidden:
            piece = source[at:stop]
            parts.append(piece)
            if links:
                linked += len(piece)
        if not found:
            break
        at = found.end()
        closing = found.group(1) or found.group(4)
        tag = found.group(2) or found.group(5)
        if tag is None:
            continue
        if at == end and not found.group().endswith(">"):
            break  # a tag cut off by the end of the page
        tag = tag.lower()
        attributes = found.group(3) or found.group(6) or ""
        if closing:
            depth = find({tag}, set() if tag in BLOCK or tag in HIDDEN else BLOCK)
            if depth:
                close_from(depth)
            elif tag == "br" and not hidden:
                parts.append(" ")
            continue
        if tag in ("br", "td", "th") and not hidden:
            parts.append(" ")
        if tag in NOT_IN_P:
            depth = find({"p"}, {"button", "table", "object"})
            if depth:
                close_from(depth)
        if tag in ENDS:
            depth = find(*ENDS[tag])
            if depth:
                close_from(depth)
        if tag in BLOCK:
            flush()
        if tag in VOID or attributes.endswith("/") and tag in ("svg", "path"):
            continue
        node, marked = open_tags[-1][1:]
        if tag in BLOCK:
            names, own = _read_attributes(attributes) if attributes else ((), None)
            marked = marked if own is None else own
            if not hidden:
                node = page.add(node, tag, names, None, 0, marked)
        depths.setdefault(tag, []).append(len(open_tags))
        if tag in BLOCK:
            blocks.append(len(open_tags))
        open_tags.append((tag, node, marked))
        hidden += tag in HIDDEN
        links += tag == "a"
        if tag in RAW:
            last = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(source, at)
            at = last.start() if last else end
    flush()
    return page
