"""Embedding units: blocks packed to a token limit without loss.

Blocks of equal identity that follow each other are a run. A run's text is first laid out as
entries, spans that fit the limit; entries that may share a unit are then filled up in order.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

#: Where a sentence ends (PR10): fixed values.
ENDS = re.compile(r"[。！？!?；;\n]|\.(?=\s|$)")
ROWS = re.compile(r"[^\n]+")


class Entry(NamedTuple):
    """A span of a block's text under a table's first row, if there is one."""

    block: dict
    span: tuple[int, int]
    head: tuple[int, int] | None = None
    hard: bool = False  # cut inside a sentence
    alone: bool = True

    def spans(self) -> list[tuple[int, int]]:
        at = self.block["start_at"]
        return [(at + a, at + z) for a, z in ([self.head] if self.head else []) + [self.span]]

    def text(self) -> str:
        return "\n".join(self.block["text"][a:z] for a, z in ([self.head] if self.head else []) + [self.span])


def pieces(text: str, first: int, last: int, fits: Callable[[str], bool]) -> Iterator[tuple[int, int, bool]]:
    """``text[first:last]`` as (start, end, hard): as many sentences as fit, or of a sentence too long as many characters."""
    ends = sorted({first + m.end() for m in ENDS.finditer(text[first:last])} | {last})
    while first < last:
        ends = ends[bisect_right(ends, first) :]
        whole = bisect_left(ends, True, key=lambda e: not fits(text[first:e]))
        if whole:
            to = ends[whole - 1]
        else:
            to = first + bisect_left(range(first + 1, ends[0] + 1), True, key=lambda e: not fits(text[first:e]))
        if to == first:
            raise ValueError("no room for a unit under its header")
        yield first, to, not whole
        first = to


def entries(block: dict, limit: int, count: Callable[[str], int]) -> Iterator[Entry]:
    """A paragraph's pieces may share units unless cut hard; headings and rows of a table stand alone."""
    text, kind = block["text"], block["kind"]
    if kind != "table":
        for a, z, hard in pieces(text, 0, len(text), lambda t: count(t) <= limit):
            yield Entry(block, (a, z), None, hard, hard or kind == "heading")
        return
    rows = [m.span() for m in ROWS.finditer(text)]
    head = rows[0] if rows and count(text[slice(*rows[0])]) < limit else None
    if head:
        yield Entry(block, rows.pop(0))
    lead = text[slice(*head)] + "\n" if head else ""
    for row in rows:
        for a, z, hard in pieces(text, *row, lambda t: count(lead + t) <= limit):
            yield Entry(block, (a, z), head, hard)


def filled(run: Iterable[Entry], limit: int, count: Callable[[str], int]) -> Iterator[list[Entry]]:
    """Consecutive entries in groups whose joined text fits."""
    group: list[Entry] = []
    for entry in run:
        if group and count("\n".join(x.text() for x in [*group, entry])) > limit:
            yield group
            group = []
        group.append(entry)
    if group:
        yield group


def pack(blocks: Iterable[dict], limit: int, count: Callable[[str], int] = len) -> Iterator[dict]:
    """Units of one source (UD1). ``blocks``: kind, section, page, text, start_at, in reading order."""
    for (_, _, kind), run in groupby(blocks, key=lambda b: (b.get("section"), b.get("page"), b["kind"])):
        laid = (e for block in run for e in entries(block, limit, count))
        for alone, some in groupby(laid, key=lambda e: e.alone):
            for group in ([e] for e in some) if alone else filled(some, limit, count):
                text = "\n".join(e.text() for e in group)
                if count(text) > limit:
                    raise ValueError("unit exceeds its limit")
                yield {"kind": kind, "spans": [s for e in group for s in e.spans()], "text": text, "fallback_split": any(e.hard for e in group)}


def embedding_units(blocks: DataFrame, key: str, order: str, limit: int = 512, count: Callable[[str], int] = len) -> DataFrame:
    """Units of every source. Sources stream through tasks in Arrow batches, sorted; of one source a task holds
    the run of blocks that it works on."""
    spans = "array<struct<start_at:int,end_at:int>>"
    schema = f"{key} bigint, unit_no int, kind string, fallback_split boolean, spans {spans}, unit_text string"
    arrow = pa.schema([(key, pa.int64()), ("unit_no", pa.int32()), ("kind", pa.string()), ("fallback_split", pa.bool_()), ("spans", pa.list_(pa.struct([("start_at", pa.int32()), ("end_at", pa.int32())]))), ("unit_text", pa.string())])

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                yield from batch.slice(i, 1024).to_pylist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        for source, held in groupby(rows(batches), key=lambda r: r[key]):
            for i, u in enumerate(pack(held, limit, count)):
                out.append({key: source, "unit_no": i, "kind": u["kind"], "fallback_split": u["fallback_split"], "spans": [{"start_at": a, "end_at": z} for a, z in u["spans"]], "unit_text": u["text"]})
                if len(out) >= 1024:
                    yield pa.RecordBatch.from_pylist(out, arrow)
                    out.clear()
        yield pa.RecordBatch.from_pylist(out, arrow)

    return blocks.select(key, order, "kind", "section", "page", "text", "start_at").repartition(key).sortWithinPartitions(key, order).mapInArrow(run, schema)
