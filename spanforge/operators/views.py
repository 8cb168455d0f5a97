"""Views of a candidate for a scorer, bounded in tokens (UD4).

A view is the whole text under its identity if that fits with the query. Else the focal unit, its neighbours
and what is required stay, and the other units are tried by nearness, once the earlier of two at one distance
first and once the later: two views at most. Units are sentences and whole table passages; none is ever cut.

Tokens are counted by an injected counter of (query, text), which is made once a task: a tokenizer is
loaded there, not sent along. A view is counted whole whenever a unit is tried: tokens of parts do not add up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

#: Tokens of a query and a view together.
Counter = Callable[[str, str], int]
#: Whether the view is whole, some of it, or does not fit.
STATUSES = ("ready", "context_incomplete", "context_too_large")


def characters(query: str, text: str) -> int:
    """The counter without a tokenizer."""
    return len(query) + len(text)


def word_pieces(path: str) -> Callable[[], Counter]:
    """Maker of a counter by the vocabulary file of a tokenizer at ``path``, as its library loads it."""

    def make() -> Counter:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        return lambda query, text: len(tokenizer.encode(query, text).ids)

    return make


def bounded(query: str, identity: str, whole: str, units: list[tuple[str, bool, bool]], count: Counter, limit: int) -> tuple[list[str], str]:
    """The views of one candidate and their status. ``units``: (text, focal, required)."""
    full = f"{identity}\n{whole}"
    if whole and count(query, full) <= limit:
        return [full], STATUSES[0]
    centre = next((i for i, u in enumerate(units) if u[1]), None)
    if centre is None:
        return [], STATUSES[2]
    must = {i for i, u in enumerate(units) if u[2] or abs(i - centre) <= 1}
    told = lambda chosen: identity + "\n" + "\n".join(units[i][0] for i in sorted(chosen))
    if count(query, told(must)) > limit:
        return [], STATUSES[2]
    views: list[str] = []
    for direction in (-1, 1):
        chosen = set(must)
        for i in sorted(set(range(len(units))) - must, key=lambda i: (abs(i - centre), direction * i)):
            if count(query, told(chosen | {i})) <= limit:
                chosen.add(i)
        if (text := told(chosen)) not in views:
            views.append(text)
    return views, STATUSES[1]


def with_views(candidates: DataFrame, limit: int, make: Callable[[], Counter] = lambda: characters, keep: tuple[str, ...] = ("query_id", "place", "query")) -> DataFrame:
    """``keep``, ``views`` and ``view_status`` of each candidate.

    ``candidates``: ``query``, ``identity``, ``whole``, and ``sentences`` with ``text``, ``focal`` and ``required`` (``reading.view_units``).
    """
    fields = {f.name: f for f in candidates.schema}
    schema = StructType([*(fields[c] for c in keep), StructField("views", ArrayType(StringType())), StructField("view_status", StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = make()
        for batch in batches:
            found = []
            for query, identity, whole, units in zip(*(batch.column(c).to_pylist() for c in ("query", "identity", "whole", "sentences"))):
                found.append(bounded(query or "", identity or "", whole or "", [(u["text"], bool(u["focal"]), bool(u["required"])) for u in units or ()], count, limit))
            arrays = [pa.array([f[0] for f in found], arrow.field("views").type), pa.array([f[1] for f in found])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *arrays], schema=arrow)

    return candidates.select(*dict.fromkeys((*keep, "query", "identity", "whole", "sentences"))).mapInArrow(run, schema)
