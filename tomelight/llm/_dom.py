"""A small, forgiving HTML reader: text pieces with the path of open elements above them.

It reads a page once, whatever the page: a tag ends at the next ``>`` outside of quotes, found from left to right; a quote that is never
closed is met once, and from then on tags end at the next ``>``; where no ``>`` follows, the rest is text. The open elements are
kept by tag, so an end tag finds its element without a search. A path is a running hash, so depth costs nothing.
"""

from __future__ import annotations

import html
import re

import xxhash

_OPEN = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*))")
_STOP = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")

#: Fixed values of HTML: elements without content, with raw text, that end an open paragraph, and inline ones.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li legend main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}


class Element:
    __slots__ = ("tag", "attributes", "parent", "path", "number")

    def __init__(self, tag: str, attributes: dict[str, str], parent: Element | None, path: int, number: int):
        self.tag, self.attributes, self.parent, self.path, self.number = tag, attributes, parent, path, number


def _signature(tag: str, attributes: dict[str, str]) -> str:
    """An element's look: its tag, classes and id without digits."""
    names = attributes.get("class", "") + " " + attributes.get("id", "")
    return tag if names == " " else tag + "." + ".".join(sorted(re.sub(r"\d+", "0", names).split()))


def _below(path: int, signature: str) -> int:
    """The path of an element: a hash of its parent's and its look."""
    return xxhash.xxh64_intdigest(path.to_bytes(8, "little", signed=True) + signature.encode("utf-8", "surrogatepass")) - (1 << 63)


class _Stack:
    """The open elements, with the depths of each tag and of block elements."""

    def __init__(self, root: Element):
        self.elements, self.depths, self.blocks = [root], {}, []

    def push(self, element: Element) -> None:
        depth = len(self.elements)
        self.elements.append(element)
        self.depths.setdefault(element.tag, []).append(depth)
        if element.tag in BLOCK:
            self.blocks.append(depth)

    def cut(self, depth: int) -> None:
        while len(self.elements) > depth:
            tag = self.elements.pop().tag
            self.depths[tag].pop()
            if tag in BLOCK:
                self.blocks.pop()

    def last(self, tags) -> int:
        """Depth of the innermost of these tags, 0 if none is open."""
        return max((self.depths[t][-1] for t in tags if self.depths.get(t)), default=0)


class _Tags:
    """Where tags end."""

    def __init__(self, page: str):
        self.page, self.quotes, self.last = page, True, page.rfind(">")

    def end(self, at: int) -> int:
        """The place of the ``>`` that ends the tag whose name ends at ``at``; -1 if there is none."""
        if at > self.last:
            return -1
        place = at
        while self.quotes:
            found = _STOP.search(self.page, place)
            if found and found[0] == ">":
                return found.start()
            closing = self.page.find(found[0], found.end()) if found else -1
            if closing < 0:
                self.quotes = False
            place = closing + 1
        return self.page.find(">", at)


def read(page: str) -> tuple[list[Element], list[tuple[int, str]]]:
    """(elements in page order, pieces): a piece is (number of its element, decoded text); ("\\n" pieces end blocks).

    Elements keep their place in the tree; the path is the chain of signatures from the root. Pieces of text come in page
    order, and a piece with None ends the current block.
    """
    root = Element("", {}, None, 0, 0)
    elements, stack, pieces, at, n, tags = [root], _Stack(root), [], 0, len(page), _Tags(page)
    text_from = 0

    def text(upto: int) -> None:
        if upto > text_from:
            piece = page[text_from:upto]
            pieces.append((stack.elements[-1].number, html.unescape(piece) if "&" in piece else piece))

    while at < n:
        found = _OPEN.search(page, at)
        if not found:
            break
        start, tag = found.start(), found[2]
        if tag is None:
            comment = found[0] == "<!--"
            end = page.find("-->", found.end()) if comment else page.find(">", found.end()) if found.end() <= tags.last else -1
            if end < 0 and not comment:
                break
            text(start)
            text_from = at = n if end < 0 else end + (3 if comment else 1)
            continue
        end = tags.end(found.end())
        if end < 0:
            break
        text(start)
        text_from = at = end + 1
        tag = tag.lower()
        if found[1]:
            if tag in BLOCK:
                pieces.append((stack.elements[-1].number, None))
            depth = stack.last((tag,))
            # an inline element's end does not close the blocks that opened inside it
            if depth and (tag in BLOCK or not stack.blocks or stack.blocks[-1] < depth):
                stack.cut(depth)
            continue
        raw = page[found.end() : end]
        attributes = {}
        if raw and not raw.isspace():
            for a in _ATTRIBUTE.finditer(raw):
                attributes.setdefault(a[1].lower(), html.unescape(a[2] or a[3] or a[4] or ""))
        if tag in BLOCK:
            pieces.append((stack.elements[-1].number, None))
            if stack.blocks and stack.elements[stack.blocks[-1]].tag == "p":
                stack.cut(stack.blocks[-1])
        if tag in _ENDS:
            ends, stops = _ENDS[tag]
            depth = stack.last(stops)
            # the innermost open one above the nearest stop
            inner = max((stack.depths[t][-1] for t in ends if stack.depths.get(t)), default=0)
            if inner > depth:
                stack.cut(inner)
        parent = stack.elements[-1]
        if tag in ("br", "hr"):
            pieces.append((parent.number, " " if tag == "br" else None))
        element = Element(tag, attributes, parent, _below(parent.path, _signature(tag, attributes)), len(elements))
        elements.append(element)
        if tag in VOID or (raw and raw.endswith("/") and tag not in BLOCK):
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            stop = close.start() if close else n
            after = page.find(">", close.end()) + 1 if close and close.end() <= tags.last else 0
            pieces.append((element.number, page[at:stop]))
            text_from = at = after or n
            continue
        stack.push(element)
    text(n)
    return elements, pieces
