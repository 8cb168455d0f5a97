"""Blocks of HTML sources."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

#: Elements whose edges end a run of text.
CONTAINERS = frozenset("html body div section article main header footer aside address blockquote ul ol dl li dt dd p h1 h2 h3 h4 h5 h6 table pre figure figcaption".split())
HEADINGS = frozenset(f"h{i}" for i in range(1, 7))
DROPPED = frozenset(("script", "style", "nav"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class Element:
    __slots__ = ("children", "holds", "name", "parent", "table_below")

    def __init__(self, name: str, parent: Element | None) -> None:
        self.name, self.parent, self.children = name, parent, []
        self.holds = self.table_below = False  # a container, a table, anywhere below


class Tree(HTMLParser):
    """Elements nest as their tags say; nothing is closed implicitly (H12)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.top = self.at = Element("#document", None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        e = Element(tag, self.at)
        self.at.children.append(e)
        if tag in CONTAINERS:
            up = self.at
            while up is not None and not (up.holds and (up.table_below or tag != "table")):
                up.holds = True
                up.table_below |= tag == "table"
                up = up.parent
        if tag not in VOID:
            self.at = e

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.at = self.at.parent

    def handle_endtag(self, tag: str) -> None:
        e = self.at
        while e is not None and e.name != tag:
            e = e.parent
        if e is not None and e.parent is not None:
            self.at = e.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)

    def handle_decl(self, decl: str) -> None:
        self.at.children.append(("decl", decl))


def _texts(e: Element) -> Iterator[str]:
    stack = [iter(e.children)]
    while stack:
        for c in stack[-1]:
            if isinstance(c, str):
                if t := c.strip():
                    yield t
            elif isinstance(c, Element) and c.name not in DROPPED:
                stack.append(iter(c.children))
                break
        else:
            stack.pop()


def _table_text(table: Element) -> str:
    lines, stack = [], [table]
    while stack:
        e = stack.pop()
        if e.name == "tr":
            lines.append(" | ".join(" ".join(_texts(c)) for c in e.children if isinstance(c, Element) and c.name in ("th", "td")))
        stack += [c for c in reversed(e.children) if isinstance(c, Element) and c.name not in DROPPED]
    return "\n".join(lines)


def blocks(html: str | None) -> list[tuple[str, str]]:
    """``(kind, text)`` of a page's blocks in order (SC3). Without a body the walk starts at the document, whose
    declaration then counts as text (H25)."""
    tree = Tree()
    tree.feed(html or "")
    tree.close()
    root = _find(tree.top, "body") or tree.top
    out: list[tuple[str, str]] = []
    run: list[str] = []

    def flush(e: Element) -> None:
        if text := " ".join(run).strip():
            out.append(("heading" if e.name in HEADINGS else "paragraph", text))
        run.clear()

    stack = [(root, iter(root.children))]
    if root.name == "table" and not root.table_below:
        return [("table", _table_text(root))]
    while stack:
        e, children = stack[-1]
        for c in children:
            if isinstance(c, tuple):
                if c[1].strip():
                    run.append(c[1].split(None, 1)[-1] if c[1].lower().startswith("doctype") else c[1])
            elif isinstance(c, str):
                if t := c.strip():
                    run.append(t)
            elif c.name in DROPPED:
                continue
            elif c.name in CONTAINERS or c.holds:
                flush(e)
                if c.name == "table" and not c.table_below:
                    out.append(("table", _table_text(c)))
                    continue
                stack.append((c, iter(c.children)))
                break
            elif t := " ".join(_texts(c)):
                run.append(t)
        else:
            flush(e)
            stack.pop()
    return out


def _find(e: Element, name: str) -> Element | None:
    stack = [e]
    while stack:
        x = stack.pop()
        if x.name == name:
            return x
        stack += [c for c in reversed(x.children) if isinstance(c, Element)]
    return None


def html_blocks(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """``key``, ``block_no``, ``kind``, ``block_text`` of every page; parsed in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, i, kind, text) for k, h in zip(batch[key], batch[html], strict=True) for i, (kind, text) in enumerate(blocks(h))]
            yield pd.DataFrame(rows, columns=[key, "block_no", "kind", "block_text"])

    return pages.select(key, html).mapInPandas(run, f"{key} bigint, block_no int, kind string, block_text string")
