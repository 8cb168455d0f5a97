"""A small tolerant HTML parser: block nodes, and the text pieces in page order."""

import re
from bisect import bisect_left
from dataclasses import dataclass, field
from html import unescape

#: Where a comment, a declaration, an end tag or a start tag begins; ``Ends`` finds where it ends.
HEAD = re.compile(r"<!--|<[!?]|</([a-zA-Z][^\s/>]*+)|<([a-zA-Z][^\s/>]*+)")
TAG_END = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no markup, and no text of the page: scripts, styles, form fields, what a browser never shows.
RAW = frozenset("script style template textarea title iframe noembed noframes select".split())
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for t in RAW}
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math mi mn mo q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: A start tag closes these if they are open inside the nearest of the second set.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead"}, {"table"}), "option": ({"option"}, {"select"}),
}


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    attributes: str = ""
    label: str = ""
    own: int = 0
    links: int = 0
    inputs: int = 0
    children: list[int] = field(default_factory=list)


@dataclass
class Page:
    """``pieces``: (node, text) in page order; text between block edges, and a blank at each edge."""

    nodes: list[Node]
    pieces: list[tuple[int, str]]


class Ends:
    """Places of the ``>`` that end start tags, in time linear in the page.

    A ``>`` in quotes ends no tag, but a quote that never closes, or after whose closing no tag would
    end, is a sign like any other.
    """

    def __init__(self, html: str) -> None:
        self.html = html
        self.marks: list[int] | None = None
        self.after: list[int] = []

    def of(self, at: int) -> int:
        """Place behind the tag whose attributes begin at ``at``; -1 if it never ends."""
        if self.marks is None:
            if m := TAG_END.match(self.html, at):
                return m.end()
            self._settle()
        k = bisect_left(self.marks, at)
        return self.after[k] if k < len(self.marks) else -1

    def _settle(self) -> None:
        """For each quote and ``>``, from the last one back: where a tag ends that is outside quotes there."""
        found = [(m.start(), m[0]) for m in re.finditer("[\"'>]", self.html)]
        self.marks, self.after = [at for at, _ in found], [-1] * len(found)
        outside, inside = -1, {'"': -1, "'": -1}  # where a tag ends that is outside, or inside such a quote
        for k in range(len(found) - 1, -1, -1):
            at, sign = found[k]
            if sign == ">":
                outside = at + 1
            else:
                open_ = inside[sign]
                inside[sign] = outside  # this quote closes what is open before it
                outside = open_ if open_ >= 0 else outside
            self.after[k] = outside


class Stack:
    """Open elements with the block node that holds their text, and where each kind of them stands."""

    def __init__(self) -> None:
        self.open: list[tuple[str, int]] = [("#page", 0)]
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = [0]

    def __len__(self) -> int:
        return len(self.open)

    @property
    def node(self) -> int:
        return self.open[-1][1]

    def push(self, tag: str, node: int) -> None:
        self.places.setdefault(tag, []).append(len(self.open))
        if tag not in INLINE:
            self.blocks.append(len(self.open))
        self.open.append((tag, node))

    def pop(self) -> tuple[str, int]:
        tag, node = self.open.pop()
        self.places[tag].pop()
        if tag not in INLINE:
            self.blocks.pop()
        return tag, node

    def last(self, *tags: str) -> int:
        """Place of the innermost open element of these tags, -1 if there is none."""
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=-1)

    @property
    def block(self) -> tuple[int, str]:
        return self.blocks[-1], self.open[self.blocks[-1]][0]


def parse(html: str) -> Page:
    nodes, pieces = [Node("#page", -1, 0)], []
    stack, ends = Stack(), Ends(html)
    anchors = 0  # open links

    def close_to(k: int) -> None:
        nonlocal anchors
        while len(stack) > k:
            tag, node = stack.pop()
            anchors -= tag == "a"
            if tag not in INLINE:
                pieces.append((nodes[node].parent if nodes[node].parent >= 0 else 0, " "))

    def put(text: str) -> None:
        if text:
            node = stack.node
            text = unescape(text) if "&" in text else text
            pieces.append((node, text))
            size = len(text) - text.count(" ") if text.strip() else 0
            nodes[node].own += size
            if anchors:
                nodes[node].links += size

    at, head = 0, False
    while m := HEAD.search(html, at):
        end, start = m[1], m[2]
        if m[0] == "<!--":
            behind = html.find("-->", m.end()) + 3
            behind = behind if behind > 2 else len(html)
        else:
            behind = ends.of(m.end()) if start else html.find(">", m.end()) + 1 or -1
        if behind < 0:  # no more tag ends: all is text but for a comment that goes to the end
            cut = html.find("<!--", m.start())
            html = html[:cut] if cut >= 0 else html
            break
        if not head:
            put(html[at : m.start()])
        at = behind
        written = html[m.end() : behind - 1]
        if start:
            tag = start.lower()
            if tag == "head":
                head = True
                continue
            if head and tag not in VOID | RAW:
                head = tag == "html"
            attributes = label = ""
            if written and tag not in INLINE:
                found = [(a[0].lower(), a[1] or a[2] or a[3]) for a in ATTRIBUTE.findall(written)]
                attributes = " ".join(v for k, v in found if k in ("class", "id", "role", "aria-label", "itemprop")).lower()
                label = next((v for k, v in found if k == "data-y"), "")
                if any(k == "hidden" or k == "style" and "display:none" in v.replace(" ", "").lower() for k, v in found):
                    attributes += " hidden"
            if tag in RAW:
                done = RAW_END[tag].search(html, at)
                at = done.end() if done else len(html)
                if tag in ("select", "textarea"):
                    nodes[stack.node].inputs += 1
                continue
            if tag in VOID:
                if tag == "input":
                    nodes[stack.node].inputs += 1
                if tag in ("br", "hr"):
                    pieces.append((stack.node, " "))
                continue
            if tag in ("html", "body"):
                continue
            if tag not in INLINE:
                if tag in CLOSES:
                    which, scope = CLOSES[tag]
                    k = stack.last(*which)
                    if k > 0 and k > stack.last(*scope - which):
                        close_to(k)
                k, block = stack.block
                if block == "p":  # a block ends an open paragraph
                    close_to(k)
                parent = stack.node
                pieces.append((parent, " "))
                nodes[parent].children.append(len(nodes))
                nodes.append(Node(tag, parent, nodes[parent].depth + 1, attributes, label))
                stack.push(tag, len(nodes) - 1)
            elif not written.endswith("/"):
                anchors += tag == "a"
                stack.push(tag, stack.node)
        elif end:
            tag = end.lower()
            if tag == "head":
                head = False
            k = stack.last(tag)
            if k > 0 and (tag not in INLINE or k > stack.block[0]):
                close_to(k)
    if not head:
        put(html[at:])
    close_to(1)
    return Page(nodes, pieces)
