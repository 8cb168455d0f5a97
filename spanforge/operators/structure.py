"""Blocks, chunks, offsets, sections and reading groups."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.functions import text as T

#: Line ends of Python's splitlines; only a line feed is taken off a row's end.
ROW = r"[^\n\x0b\x0c\r\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]*(?:\r\n|[\n\x0b\x0c\r\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}])|[^\n\x0b\x0c\r\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]+"
#: Rows of a text without the other line ends: a sign is compared with one, not with a union of classes.
LINE = r"[^\n]*\n|[^\n]+"
OTHER_ENDS = "\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029"


def _parts(text: Column) -> Column:
    """Rows of a text with their line ends."""
    other = reduce(or_, (F.contains(text, F.lit(c)) for c in OTHER_ENDS))
    cut = lambda pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(other, cut(ROW)).otherwise(cut(LINE))


def paragraph_chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = 1600) -> DataFrame:
    """Fixed slices of each text (UD9): ``key``, ``chunk_no``, ``chunk_id``, ``start_at``, ``end_at``, ``chunk_text``.

    Null and empty texts give no chunk.
    """
    n = F.length(text)
    cut = F.transform(F.sequence(F.lit(0), n - 1, F.lit(limit)), lambda a, i: F.struct(i.alias("chunk_no"), a.alias("start_at"), F.least(a + limit, n).alias("end_at"), F.substr(F.col(text), a + 1, F.lit(limit)).alias("chunk_text")))
    one = docs.select(key, F.explode(F.when(n > 0, cut)).alias("c")).select(key, "c.*")
    return one.select(key, "chunk_no", F.concat(F.lit("c"), F.col("chunk_no").cast("string")).alias("chunk_id"), "start_at", "end_at", "chunk_text")


def table_chunks(tables: DataFrame, key: str, text: str, limit: int) -> DataFrame:
    """Row pieces of each table under its repeated header (UD9).

    A header of ``limit`` characters or more is an error; a table of one row gives its header alone.
    """
    lines = T.spans_of_parts(_parts(F.col(text)))
    rows = F.transform(lines, lambda r: F.struct(r["start"].alias("s"), F.rtrim(r["part"], F.lit("\n")).alias("row")))
    df = tables.where(F.length(text) > 0).select(key, rows.alias("rows"))
    head = F.element_at("rows", 1)["row"]
    df = df.withColumn("header", F.when(F.length(head) < limit, head).otherwise(F.raise_error(F.lit("table header reaches the chunk limit"))))
    room = F.greatest(F.lit(1), limit - F.length("header") - 1)
    body = F.filter(F.slice("rows", 2, F.greatest(F.size("rows") - 1, F.lit(1))), lambda r: r["row"] != "")
    piece = lambda r, n, p, room: F.struct((r["s"] + p).alias("s"), (r["s"] + F.least(p + room, n)).alias("e"), F.substr(r["row"], p + 1, room).alias("row"))
    cut = lambda r, room: T.bound(F.length(r["row"]), lambda n: F.transform(F.sequence(F.lit(0), n - 1, room), lambda p: piece(r, n, p, room)))
    pieces = T.bound(room, lambda room: F.flatten(F.transform(body, lambda r: cut(r, room))))
    df = df.withColumn("pieces", F.when(F.size("rows") > 1, pieces))
    df = df.select(key, "header", F.posexplode(F.when(F.coalesce(F.size("pieces"), F.lit(0)) > 0, F.col("pieces")).otherwise(F.array(F.lit(None).cast("struct<s:int,e:int,row:string>")))).alias("chunk_no", "piece"))
    return df.select(key, "chunk_no", F.concat(F.lit("c"), F.col("chunk_no").cast("string")).alias("chunk_id"), F.col("piece")["s"].alias("start_at"), F.col("piece")["e"].alias("end_at"), F.concat_ws("\n", "header", F.col("piece")["row"]).alias("chunk_text"))


def text_blocks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Blocks of plain text and Markdown (SC2), split at blank lines; the kind is read before stripping."""
    part = F.posexplode(F.split(F.col(text), rf"\n{T.BLANK}*\n")).alias("part", "raw")
    kind = F.when(F.col("raw").startswith("#"), "heading").when(F.col("raw").startswith("|"), "table").otherwise("paragraph")
    return docs.select(key, part).select(key, "part", kind.alias("kind"), T.strip("raw").alias("block_text")).where("block_text <> ''")


def with_offsets(blocks: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """Place of each block in the canonical text, whose blocks are two characters apart (WN2)."""
    w = Window.partitionBy(key).orderBy(order)
    before = F.coalesce(F.sum(F.length(text) + 2).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return blocks.withColumn("start_at", before).withColumn("end_at", F.col("start_at") + F.length(text))


def with_section(blocks: DataFrame, key: str, order: str, text: str, heading: Column) -> DataFrame:
    """The last heading at or before each block, itself included (WN3)."""
    w = Window.partitionBy(key).orderBy(order)
    return blocks.withColumn("section", F.coalesce(F.last(F.when(heading, F.col(text)), ignorenulls=True).over(w), F.lit("")))


def numbered(blocks: DataFrame, key: str, order: str, prefix: str = "b") -> DataFrame:
    """``b0``, ``b1``, … in document order (WN4)."""
    w = Window.partitionBy(key).orderBy(order)
    return blocks.withColumn("block_id", F.concat(F.lit(prefix), (F.row_number().over(w) - 1).cast("string")))


def reading_order(blocks: DataFrame, key: str) -> DataFrame:
    """Place by page, top edge or offset, left edge, offset (WN6). ``bbox``: x0, y0, x1, y1."""
    w = Window.partitionBy(key).orderBy(F.coalesce("page", F.lit(0)), F.coalesce(F.get("bbox", 1), F.col("start_at").cast("double")), F.coalesce(F.get("bbox", 0), F.lit(0.0)), "start_at")
    return blocks.withColumn("place", F.row_number().over(w) - 1)


def same_paragraph(a: Column, b: Column) -> Column:
    """Whether two neighbouring lines of a page are of one visual paragraph (WN5)."""
    x0, y0, x1, y1 = range(4)
    p, q = a["bbox"], b["bbox"]
    of = lambda c: c[y1] - c[y0]
    height = F.greatest(of(p), of(q))
    gap = q[y0] - p[y1]
    short = (p[x1] - p[x0]) < 0.7 * (q[x1] - q[x0])
    ends = F.regexp_replace(a["text"], rf"{T.BLANK}+\z", "").rlike(r"[。.！？]\z")
    ok = (
        (a["kind"] == "paragraph") & (b["kind"] == "paragraph") & p.isNotNull() & q.isNotNull() & a["page"].eqNullSafe(b["page"])
        & (height > 0) & (gap >= 0) & (gap <= 1.5 * height)
        & (q[x0] <= p[x0] + 0.5 * height) & (F.abs(of(q) - of(p)) <= 0.2 * height)
        & (F.abs(q[x1] - p[x1]) <= F.greatest(3 * height, 0.2 * (p[x1] - p[x0]))) & ~(short & ends)
    )
    return F.coalesce(ok, F.lit(False))


def with_groups(lines: DataFrame, key: str, order: str, joins: Column) -> DataFrame:
    """``group_no``: islands of rows that join their predecessor. ``joins`` sees ``previous`` and ``this`` structs."""
    w = Window.partitionBy(key).orderBy(order)
    row = F.struct(*lines.columns)
    df = lines.withColumn("this", row).withColumn("previous", F.lag(row).over(w))
    df = df.withColumn("fresh", F.when(F.col("previous").isNotNull() & joins, 0).otherwise(1))
    return df.withColumn("group_no", F.sum("fresh").over(w) - 1).drop("this", "previous", "fresh")


def surrounding(groups: DataFrame, key: str, group: str, reach: int) -> DataFrame:
    """Rows of the groups within ``reach`` of each focus row (WN7): columns of the focus (``focus_``) and of the neighbour."""
    focus = groups.select(F.col(key), *(F.col(c).alias(f"focus_{c}") for c in groups.columns if c != key))
    near = focus.select("*", F.explode(F.sequence(F.col(f"focus_{group}") - reach, F.col(f"focus_{group}") + reach)).alias(group))
    return near.join(groups, [key, group])
