"""Exact removal of repeated passages by column-wise sorting of anchored contexts.

A byte goes if a ``LENGTH``-byte string over it also starts earlier (smaller id, or the same text
further left). Inserting one symbol of every whole document a round into a collection-wide
Burrows-Wheeler transform takes as many rounds, each rewriting the transform, as the longest text
has bytes; so the construction runs on short contexts instead:

1. Each window of ``LENGTH`` bytes has an anchor, its leftmost ``GRAM``-byte string of least hash.
   Windows of one anchor form a context. Equal windows have equal anchors at equal offsets.
2. Contexts (one row of four numbers each) meet by anchor hash. A context that is equal to an earlier
   one goes as a whole; copies within a task are settled there, before the shuffle. An anchor of
   several distinct contexts leaves one request per distinct context.
3. The requested contexts, aligned on their anchors, are the collection: column by column from the
   right, one symbol of each is inserted, the order follows by the stable (LF) step and the common
   prefixes by range minima of the last round's. Neighbours with LENGTH common symbols are equal
   windows; all but the first go. Tables between the steps are written and read sequentially.

An anchor with more than ``HOT`` distinct contexts is not gathered in one task: its windows become
rows of a hash, and the first of each is found by a pre-aggregated minimum.
"""

import gc
import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_of

LENGTH, GRAM = 100, 32
SPAN = LENGTH - GRAM  # anchor offsets in a window: 0 .. SPAN
HOT = 20_000
#: Contexts that a task sorts, about.
PER_TASK = 40_000

B = 0x9E3779B97F4A7C15
POSITION = np.uint64((1 << 36) - 1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class Powers:
    """B^i and B^-i modulo 2^64, as far as asked for."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def until(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up, self.down = (np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size, b, np.uint64)))) for b in (B, pow(B, -1, 2**64)))
        return self.up, self.down


def contexts(raw: np.ndarray, powers: Powers) -> tuple[np.ndarray, ...]:
    """Anchor hash, context hash, anchor place, places before and after of its windows (as one number each)."""
    h = raw.astype(np.uint64) + np.uint64(1)
    width = 1
    while width < GRAM:
        h = h[:-width] * np.uint64(pow(B, width, 2**64)) + h[width:]
        width *= 2
    h = _mix(h)
    key = (h >> np.uint64(36) << np.uint64(36)) | np.arange(len(h), dtype=np.uint64)
    low, size = key, 1
    while 2 * size <= SPAN + 1:
        low, size = np.minimum(low[:-size], low[size:]), 2 * size
    rest = SPAN + 1 - size
    if rest:
        low = np.minimum(low[:-rest], low[rest:])
    at = (low & POSITION).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    last = np.append(first[1:], len(at)) - 1
    p = at[first]
    up, down = powers.until(len(h) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * up[: len(h)], dtype=np.uint64)))
    whole = (total[last + SPAN + 1] - total[first]) * down[first]
    before, after = p - first, last - first
    packed = (before << 7) | after
    ctx = _mix(whole + packed.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return (h[p] >> np.uint64(2)).view(np.int64), ctx.view(np.int64), p, packed


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of intervals per document; touching ones are joined."""
    if not len(doc):
        return doc, start, end
    o = np.lexsort((start, doc))
    doc, start, end = doc[o], start[o], end[o]
    new = np.concatenate(([True], doc[1:] != doc[:-1]))
    group = np.cumsum(new) - 1
    big = int(end.max()) + 1
    reach = np.maximum.accumulate(end + group * big) - group * big
    cut = new | np.concatenate(([True], start[1:] > reach[:-1]))
    at = np.flatnonzero(cut)
    return doc[at], start[at], reach[np.append(at[1:], len(doc)) - 1]


FOUND = "gram bigint, ctx bigint, doc bigint, place bigint, packed bigint"
NAMES = ["gram", "ctx", "doc", "place", "packed"]


def _batch(*columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], NAMES)


def _anchors(batches):
    """Contexts of each text; of equal ones in a batch the first, and an interval row (ctx null) for the others."""
    powers = Powers()
    for batch in batches:
        parts = []
        for doc, text in zip(batch.column(0), batch.column(1), strict=True):
            raw = np.frombuffer(text.as_py().encode("utf-8", "surrogatepass"), np.uint8)
            if len(raw) >= LENGTH:
                gram, ctx, p, packed = contexts(raw, powers)
                parts.append((gram, ctx, np.full(len(p), doc.as_py()), p, packed))
        if not parts:
            continue
        gram, ctx, doc, p, packed = (np.concatenate(c) for c in zip(*parts, strict=True))
        o = np.lexsort((p, doc, ctx, gram))
        gram, ctx, doc, p, packed = gram[o], ctx[o], doc[o], p[o], packed[o]
        first = np.concatenate(([True], (gram[1:] != gram[:-1]) | (ctx[1:] != ctx[:-1])))
        yield _batch(gram[first], ctx[first], doc[first], p[first], packed[first])
        start = (p - (packed >> 7))[~first]
        d, s, e = merged(doc[~first], start, start + (packed & 127)[~first] + LENGTH)
        if len(d):
            yield pa.RecordBatch.from_arrays([pa.array(d * 31 + s), pa.nulls(len(d), pa.int64()), pa.array(d), pa.array(s), pa.array(e)], NAMES)


def _requests(batches):
    """Of rows sorted by (gram, ctx, doc, place): intervals (ctx null) and requests (ctx kept)."""
    gram0 = ctx0 = None
    held = None  # the gram's first row, until a second context shows
    for batch in batches:
        ctx_all = batch.column(1)
        settled = np.asarray(ctx_all.is_null())
        if settled.any():
            yield batch.filter(pa.array(settled))
        open_ = batch.filter(pa.array(~settled))
        if not open_.num_rows:
            continue
        gram, ctx, doc, p, packed = (c.to_numpy() for c in open_.columns)
        same_gram = np.concatenate(([gram0 is not None and gram[0] == gram0], gram[1:] == gram[:-1]))
        same = same_gram & np.concatenate(([ctx0 is not None and ctx[0] == ctx0], ctx[1:] == ctx[:-1]))
        start = (p - (packed >> 7))[same]
        d, s, e = merged(doc[same], start, start + (packed & 127)[same] + LENGTH)
        yield pa.RecordBatch.from_arrays([pa.array(d), pa.nulls(len(d), pa.int64()), pa.array(d), pa.array(s), pa.array(e)], NAMES)
        second = same_gram & ~same
        opener = np.flatnonzero(~same_gram)
        group = np.cumsum(~same_gram)  # 0: goes on from the batch before
        seconds = np.bincount(group[second], minlength=len(opener) + 1)
        ask = second.copy()
        ask[opener[seconds[1:] > 0]] = True
        if seconds[0] and held is not None:
            yield _batch(*([x] for x in held))
            held = None
        if ask.any():
            yield _batch(gram[ask], ctx[ask], doc[ask], p[ask], packed[ask])
        if len(opener):
            held = None if seconds[-1] else tuple(int(c[opener[-1]]) for c in (gram, ctx, doc, p, packed))
        gram0, ctx0 = gram[-1], ctx[-1]


CONTEXT = "gram bigint, doc bigint, place bigint, packed bigint, bytes binary"


def _cut(batches):
    """The bytes of the requested contexts of each text."""
    for batch in batches:
        for k in range(0, batch.num_rows, 64):
            out = [[], [], [], [], []]
            for doc, text, asked in zip(*(c[k : k + 64] for c in batch.columns), strict=True):
                raw = text.as_py().encode("utf-8", "surrogatepass")
                for a in asked.as_py():
                    p, before, after = a["place"], a["packed"] >> 7, a["packed"] & 127
                    for column, v in zip(out, (a["gram"], doc.as_py(), p, a["packed"], raw[p - before : p - before + after + LENGTH]), strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, [pa.int64()] * 4 + [pa.binary()], strict=True)], ["gram", "doc", "place", "packed", "bytes"])


def columnwise(matrix: np.ndarray, valid: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which valid windows of aligned contexts are equal to a valid window of smaller rank in their column.

    ``matrix``: contexts x (SPAN + LENGTH) symbols; ``valid``: contexts x (SPAN + 1) window starts.
    """
    n, columns = matrix.shape
    order, common = np.arange(n), np.zeros(n + 1, np.uint8)
    common[1:n] = LENGTH  # before any symbol is in, all contexts are equal
    flags = np.zeros_like(valid)
    by_column = np.ascontiguousarray(matrix.T)
    for column in range(columns - 1, -1, -1):
        symbol = by_column[column][order]
        step = np.argsort(symbol, kind="stable")
        together = symbol[step[1:]] == symbol[step[:-1]]
        ranges = np.stack((step[:-1][together] + 1, step[1:][together] + 1), 1).ravel()
        new = np.zeros(n + 1, np.uint8)
        if len(ranges):
            new[1:n][together] = np.minimum(np.minimum.reduceat(common, ranges)[::2], LENGTH - 1) + 1
        order, common = order[step], new
        if column <= SPAN:
            starts = np.flatnonzero(common[:n] < LENGTH)
            here = np.where(valid[order, column], rank[order], n)
            first = np.repeat(np.minimum.reduceat(here, starts), np.diff(np.append(starts, n)))
            flags[order, column] = (here < n) & (here > first)
    return flags


def _sort(batches):
    """Intervals of the windows that an earlier equal window makes redundant; all contexts of a partition at once."""
    doc, place, packed, cells = [], [], [], []
    for batch in batches:
        doc += batch.column(1).to_pylist()
        place += batch.column(2).to_pylist()
        packed += batch.column(3).to_pylist()
        cells += batch.column(4).to_pylist()
    if not doc:
        return
    doc, place, packed = (np.array(x, np.int64) for x in (doc, place, packed))
    before, after = packed >> 7, packed & 127
    n = len(doc)
    matrix = np.zeros((n, SPAN + LENGTH), np.uint8)
    for row, b, cell in zip(matrix, before.tolist(), cells, strict=True):
        row[SPAN - b : SPAN - b + len(cell)] = np.frombuffer(cell, np.uint8)
    at = np.arange(SPAN + 1)
    low = (SPAN - before)[:, None]
    valid = (at >= low) & (at <= low + after[:, None])
    # copies of one row (the same id read twice) have one rank, so none is before the other
    o = np.lexsort((place, doc))
    fresh = np.concatenate(([False], (doc[o][1:] != doc[o][:-1]) | (place[o][1:] != place[o][:-1])))
    rank = np.empty(n, np.int64)
    rank[o] = np.cumsum(fresh)
    row, column = np.nonzero(columnwise(matrix, valid, rank))
    start = place[row] - SPAN + column
    d, s, e = merged(doc[row], start, start + LENGTH)
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (d, s, e)], ["doc", "start", "end"])


def _window_rows(batches):
    for batch in batches:
        doc, start, digest = [], [], []
        for d, p, packed, cell in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
            for i in range((packed & 127) + 1):
                doc.append(d)
                start.append(p - (packed >> 7) + i)
                digest.append(xxhash.xxh3_128_digest(cell[i : i + LENGTH]))
        yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(digest, pa.binary())], ["doc", "start", "digest"])


def _spans(raw: bytes, cuts: list) -> tuple[int, int, str]:
    if not cuts:
        return 0, 0, hashlib.sha256(raw).hexdigest()
    s, e = np.array([c["start"] for c in cuts], np.int64), np.array([c["end"] for c in cuts], np.int64)
    _, s, e = merged(np.zeros(len(s), np.int64), s, e)
    kept, at = hashlib.sha256(), 0
    for a, b in zip(s.tolist(), e.tolist(), strict=True):
        kept.update(raw[at:a])
        at = b
    kept.update(raw[at:])
    return int((e - s).sum()), len(s), kept.hexdigest()


def _results(batches):
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            out = []
            for doc, text, cuts in zip(*(c[k : k + 256] for c in batch.columns), strict=True):
                raw = text.as_py().encode("utf-8", "surrogatepass")
                out.append((doc.as_py(), len(raw), *_spans(raw, cuts.as_py() or [])))
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 4 + [pa.string()], strict=True)], ["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _free(spark) -> None:
    """Lets Spark drop the shuffle files of finished steps, whose tables are written."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def repeated(texts: DataFrame) -> DataFrame:
    """Intervals ``doc``, ``start``, ``end`` (bytes, end exclusive, may overlap) to remove from ``texts`` (``doc``, ``text``)."""
    spark = texts.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = texts.mapInArrow(_anchors, FOUND)
    met = rows.repartition(n, "gram").sortWithinPartitions("gram", "ctx", "doc", "place").mapInArrow(_requests, FOUND)
    met = materialize(met, "met")
    _free(spark)
    direct = met.where("ctx is null").select("doc", F.col("place").alias("start"), F.col("packed").alias("end"))
    asked = met.where("ctx is not null").select("gram", "doc", "place", "packed")
    by_doc = asked.groupBy("doc").agg(F.collect_list(F.struct("gram", "place", "packed")).alias("asked"))
    cells = materialize(texts.join(by_doc, "doc").select("doc", "text", "asked").mapInArrow(_cut, CONTEXT), "cells")
    _free(spark)
    hot = materialize(cells.groupBy("gram").count().where(F.col("count") > HOT).select("gram"), "hot")
    tasks = max(n, -(-cells.count() // PER_TASK))
    cold = cells.join(hot, "gram", "left_anti").repartition(tasks, "gram").mapInArrow(_sort, "doc bigint, start bigint, end bigint")
    windows = cells.join(hot, "gram", "left_semi").mapInArrow(_window_rows, "doc bigint, start bigint, digest binary")
    first = windows.groupBy("digest").agg(F.min(F.struct("doc", "start")).alias("first"))
    later = windows.join(first, "digest").where(F.struct("doc", "start") > F.col("first")).select("doc", "start", (F.col("start") + LENGTH).alias("end"))
    out = materialize(direct.unionByName(cold).unionByName(later), "repeats")
    _free(spark)
    return out


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` of each row.

    Null and empty texts have 0 bytes and nothing removed. Rows of one id and one text are one
    document read several times and are treated alike; where ids repeat with different texts, or
    are null, documents are ordered by (id, nulls last, SHA-256 of the text). An empty table gives no rows.
    """
    plain = docs.select(F.col(key).cast("bigint").alias("doc"), text_of(text).alias("text"))
    odd = plain.groupBy("doc").count().where("count > 1 or doc is null")
    if odd.isEmpty():
        texts, ids = plain, None
    else:
        hashed = plain.withColumn("digest", F.sha2("text", 256))
        ordered = hashed.select("doc", "digest").distinct().orderBy(F.asc_nulls_last("doc"), "digest")
        # numbers with gaps that rise in that order: by partition of the sort, then by row
        ids = materialize(ordered.select(F.col("doc").alias("id"), "digest", F.monotonically_increasing_id().alias("doc")), "ids")
        joined = hashed.join(ids.withColumnRenamed("doc", "place"), hashed["doc"].eqNullSafe(ids["id"]) & (hashed["digest"] == ids["digest"]))
        texts = materialize(joined.select(F.col("place").alias("doc"), "text"), "texts")
    once = texts if ids is None else texts.dropDuplicates(["doc"])
    cuts = repeated(once).groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("cuts"))
    out = texts.join(cuts, "doc", "left").select("doc", "text", "cuts").mapInArrow(_results, "doc bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
    if ids is not None:
        out = out.join(ids.select("doc", "id"), "doc").withColumn("doc", F.col("id")).drop("id")
    return out.withColumnRenamed("doc", key)
