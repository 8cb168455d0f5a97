"""Lexical ranks by sparse products, and a posting store with block maxima.

A block of queries is a sparse matrix of tokens by queries. It goes to every task, which multiplies it
with the tokens of its passages and hands on the best ``k`` of each query only, so that the shuffle
grows with tasks, queries and ``k``, not with the pairs that share a word.

The store keeps the other side on disk: passages are cut by size into segments of ``ROWS`` rows, and a
posting row holds, for a token and a segment, the rows that have it and the least size among them. Such a
row bounds what the token can add to a score there. A search first reads the bounds, scores the most
promising segments of each query, and then only those whose bound reaches the k-th score found.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from spanforge.functions import text as T
from spanforge.sources.tables import shared, written

#: Queries, and (query, token) pairs, of a block; a larger set is worked through in blocks.
BLOCK_QUERIES, BLOCK_TOKENS = 20_000, 2_000_000
#: Products that are worked out at a time.
CELLS = 8_000_000
#: Passages that are worked on at a time: token codes of whole texts are some 100 bytes a token.
PART = 1024
#: Passages of a segment of the store, and segments that a query scores before any is left out.
ROWS, FIRST = 4096, 2
#: Bounds are widened by this part, far above the rounding of their sums.
SLACK = 1e-9
PLACE = ["source_id", "start_at", "chunk_id"]


@dataclass
class QueryBlock:
    """Tokens of a block of queries: ``queries[since[v] : since[v + 1]]`` are those with token ``v``."""

    ids: pa.Array
    scopes: list | None
    vocabulary: pa.Array
    since: np.ndarray
    queries: np.ndarray

    @classmethod
    def of(cls, asked: pa.Table, scope: str | None) -> QueryBlock:
        """From ``query_id``, ``tokens`` and the scope; rows of one query are one."""
        found: dict[tuple, set[str]] = {}
        columns = [asked.column(c).to_pylist() for c in ("query_id", "tokens", *([scope] if scope else []))]
        for q, tokens, *s in zip(*columns):
            found.setdefault((q, *s), set()).update(tokens or ())
        words = sorted(set().union(*found.values()))
        code = {w: i for i, w in enumerate(words)}
        pairs = np.array([(code[w], q) for q, ws in enumerate(found.values()) for w in ws], np.int64).reshape(-1, 2)
        pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
        since = np.searchsorted(pairs[:, 0], np.arange(len(words) + 1))
        ids = pa.array([k[0] for k in found], asked.schema.field("query_id").type)
        return cls(ids, [k[1] for k in found] if scope else None, pa.array(words, pa.string()), since, pairs[:, 1])

    def codes(self, tokens: pa.Array) -> np.ndarray:
        """Number of each token, -1 for those that no query has."""
        return pc.fill_null(pc.index_in(tokens.cast(pa.string()), value_set=self.vocabulary), -1).to_numpy(zero_copy_only=False)

    def pairs(self, v: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, passage) once for each token that they share, of tokens ``v`` in passages ``p``."""
        n = self.since[v + 1] - self.since[v]
        upto = np.cumsum(n)
        at = np.arange(upto[-1] if len(n) else 0) - np.repeat(upto - n, n) + np.repeat(self.since[v], n)
        return self.queries[at], np.repeat(p, n)


def best(q: np.ndarray, score: np.ndarray, tie: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest scores of each query; equal ones by ``tie``."""
    order = np.lexsort((tie, -score, q))
    first = np.flatnonzero(np.r_[True, np.diff(q[order]) != 0]) if len(order) else np.zeros(0, int)
    rank = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
    return order[rank < k]


def product(block: QueryBlock, v: np.ndarray, p: np.ndarray, size: np.ndarray, tie: np.ndarray, k: int, allowed: Callable | None = None, floor: np.ndarray | None = None):  # noqa: ANN201
    """Best ``k`` passages of each query, from tokens ``v`` in passages ``p`` (ascending): queries, passages, scores.

    Scores below a query's ``floor`` are left out. ``allowed(q, p)`` tells pairs that are in scope.
    """
    n_q = len(block.ids)
    root = np.sqrt(np.maximum(1, size).astype(float))
    step = max(1, CELLS // max(1, n_q))
    parts = []
    for low in range(0, len(size), step):
        a, z = np.searchsorted(p, [low, low + step])
        if a == z:
            continue
        rows = min(step, len(size) - low)
        q, at = block.pairs(v[a:z], p[a:z])
        counts = np.bincount((at - low) * n_q + q, minlength=rows * n_q).reshape(rows, n_q)
        scores = counts / root[low : low + rows, None]
        least = np.partition(scores, -k, axis=0)[-k] if rows > k else np.zeros(n_q)
        if floor is not None:
            least = np.maximum(least, floor)
        at, q = np.nonzero((scores >= least) & (counts > 0))
        if allowed is not None:
            # scopes are few of many pairs: what is in scope is ranked by itself
            at, q = np.nonzero(counts)
            inside = allowed(q, at + low)
            at, q = at[inside], q[inside]
        parts.append((q, at + low, scores[at, q]))
    q, at, score = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    top = best(q, score, tie[at], k)
    return q[top], at[top], score[top]


def tokenized(passages: DataFrame) -> DataFrame:
    """``source_id``, ``chunk_id``, ``start_at``, ``size`` (own tokens) and ``tokens`` (with those of the ``context``); a null text is empty."""
    own = T.tokens(F.coalesce("chunk_text", F.lit("")))
    every = F.array_union(own, T.tokens(F.coalesce("context", F.lit("")))) if "context" in passages.columns else own
    return passages.select("source_id", "chunk_id", "start_at", F.size(own).alias("size"), every.alias("tokens"))


def query_blocks(queries: DataFrame, scope: str | None) -> Iterator[QueryBlock]:
    """The queries in blocks of a bounded size."""
    asked = queries.select("query_id", T.tokens("query").alias("tokens"), *([scope] if scope else []))
    n = asked.agg(F.count("*").alias("q"), F.sum(F.size("tokens")).alias("t")).first()
    blocks = max(1, -(-n["q"] // BLOCK_QUERIES), -(-(n["t"] or 0) // BLOCK_TOKENS))
    for b in range(blocks):
        part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        block = QueryBlock.of(part.toArrow(), scope)
        if len(block.vocabulary):
            yield block


def _ties(batch: pa.RecordBatch) -> np.ndarray:
    """Place of each row in the order of source, start and chunk id."""
    order = pc.sort_indices(pa.table({str(i): batch.column(c) for i, c in enumerate(PLACE)}), sort_keys=[(str(i), "ascending") for i in range(len(PLACE))]).to_numpy()
    ties = np.empty(len(order), np.int64)
    ties[order] = np.arange(len(order))
    return ties


def _in_scope(block: QueryBlock, sources: pa.Array) -> Callable | None:
    if block.scopes is None:
        return None
    code = {s: i for i, s in enumerate(dict.fromkeys(block.scopes)) if s is not None}
    asked = np.array([code.get(s, -2) for s in block.scopes])
    held = np.array([code.get(s, -1) for s in sources.to_pylist()])
    return lambda q, p: asked[q] == held[p]


def _ranked(block: QueryBlock, k: int, schema: pa.Schema):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((len(block.ids), k))  # the best scores of this task so far
        for batch in (b.slice(i, PART) for b in batches for i in range(0, b.num_rows, PART)):
            tokens = batch.column("tokens")
            n = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
            v, p = block.codes(tokens.flatten()), np.repeat(np.arange(batch.num_rows), n)
            v, p = v[v >= 0], p[v >= 0]
            size = pc.fill_null(batch.column("size"), 0).to_numpy(zero_copy_only=False)
            q, at, score = product(block, v, p, size, _ties(batch), k, _in_scope(block, batch.column("source_id")), held[:, 0])
            new = score >= held[q, 0]
            q, at, score = q[new], at[new], score[new]
            for i in np.unique(q):
                held[i] = np.sort(np.r_[held[i], score[q == i]])[-k:]
            took = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([block.ids.take(pa.array(q)), *(took.column(c) for c in ("source_id", "chunk_id", "start_at")), pa.array(score)], schema=schema)

    return run


def ranked(passages: DataFrame, queries: DataFrame, k: int, scope: str | None = None) -> DataFrame:
    """Candidates ``query_id``, ``source_id``, ``chunk_id``, ``start_at``, ``score``: of each task at least the ``k`` best of each query."""
    fields = passages.schema
    schema = StructType([queries.schema["query_id"], *(fields[c] for c in ("source_id", "chunk_id", "start_at")), StructField("score", DoubleType())])
    own, out = tokenized(passages), None
    for block in query_blocks(queries, scope):
        found = own.mapInArrow(_ranked(block, k, to_arrow_schema(schema)), schema)
        out = found if out is None else out.unionByName(found)
    return passages.sparkSession.createDataFrame([], schema) if out is None else out


def _numbered(rows: int, schema: pa.Schema):  # noqa: ANN202
    """Sorted passages to segments: ``segment``, ``row`` in the order of places, then the passage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = TaskContext.get().partitionId() << 32
        for table in _cut(batches, rows):
            batch = table.combine_chunks().to_batches()[0]
            batch = batch.take(pa.array(np.argsort(_ties(batch))))
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, segment)), pa.array(np.arange(n, dtype=np.int32)), *batch.columns], schema=schema)
            segment += 1

    return run


def _cut(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        while sum(b.num_rows for b in held) >= rows:
            table = pa.Table.from_batches(held)
            yield table.slice(0, rows)
            held = table.slice(rows).to_batches()
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held)


POSTING = "token string, segment bigint, least int, rows array<int>"


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of ``segment``, ``row``, ``size``, ``tokens`` in order of segments; one that two splits share has two rows of a token, whose bounds add up."""
    schema = pa.schema([("token", pa.string()), ("segment", pa.int64()), ("least", pa.int32()), ("rows", pa.list_(pa.int32()))])
    waiting: list[pa.RecordBatch] = []
    for batch in (b for part in (batches, [None]) for b in part):
        held = pa.Table.from_batches(waiting + ([batch] if batch is not None else [])).combine_chunks() if waiting or batch is not None else None
        if held is None or not held.num_rows:
            continue
        held = held.to_batches()[0]
        segment = held.column("segment").to_numpy()
        runs = _runs(segment)
        if batch is not None:  # the last segment may go on
            waiting = [held.slice(runs.pop()[0])]
        for a, z in runs:
            part = held.slice(a, z - a)
            row, size = (part.column(c).to_numpy() for c in ("row", "size"))
            words = part.column("tokens").flatten().dictionary_encode()
            at = np.repeat(np.arange(z - a), pc.fill_null(pc.list_value_length(part.column("tokens")), 0).to_numpy(zero_copy_only=False))
            code = words.indices.to_numpy()
            order = np.lexsort((row[at], code))
            code, at = code[order], at[order]
            first = np.flatnonzero(np.r_[True, np.diff(code) != 0]) if len(code) else np.zeros(0, int)
            if not len(first):
                continue
            rows = pa.ListArray.from_arrays(pa.array(np.r_[first, len(code)], pa.int32()), pa.array(row[at], pa.int32()))
            yield pa.RecordBatch.from_arrays([words.dictionary.take(pa.array(code[first])), pa.array(np.full(len(first), segment[a])), pa.array(np.minimum.reduceat(size[at], first), pa.int32()), rows], schema=schema)


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of each run of equal values."""
    cuts = np.flatnonzero(np.diff(values)) + 1
    return list(zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(values)].tolist(), strict=True)) if len(values) else []


def write_store(passages: DataFrame, path: str, rows: int = ROWS) -> None:
    """Writes the posting store of ``passages`` to the new folder ``path``.

    ``passages``: ``segment``, ``row``, place and size; ``segments``: the sizes of each segment;
    ``postings``: ``token``, ``segment``, ``least`` size, ``rows``, sorted by token, so that a scan for some
    tokens passes over most of the files. A common word is one row a segment, dealt to many tasks.
    """
    own = tokenized(passages).where("size > 0 or size(tokens) > 0")
    schema = StructType([StructField("segment", LongType()), StructField("row", IntegerType()), *own.schema])
    by_size = own.repartitionByRange("size", *PLACE).sortWithinPartitions("size", *PLACE)
    numbered = written(by_size.mapInArrow(_numbered(rows, to_arrow_schema(schema)), schema), f"{path}/numbered")
    written(numbered.drop("tokens"), f"{path}/passages")
    sizes = numbered.groupBy("segment").agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "size"))), lambda x: x["size"]).alias("sizes"))
    written(sizes, f"{path}/segments")
    # rows of a segment lie in one task, which writes its postings without a shuffle of tokens
    posted = written(numbered.select("segment", "row", "size", "tokens").mapInArrow(_posted, POSTING), f"{path}/posted")
    written(posted.repartitionByRange("token", "segment").sortWithinPartitions("token", "segment"), f"{path}/postings")
    posted.limit(0).write.mode("overwrite").parquet(f"{path}/posted")
    numbered.limit(0).write.mode("overwrite").parquet(f"{path}/numbered")  # frees the tokens


def bounds(postings: DataFrame, asked: DataFrame) -> DataFrame:
    """Most that a passage of a segment can score for a query: ``q``, ``segment``, ``bound``."""
    most = (F.lit(1.0) / F.sqrt(F.greatest(F.lit(1), "least").cast("double"))).alias("most")
    hits = postings.select("token", "segment", most).join(asked, "token")
    return hits.groupBy("q", "segment").agg((F.sum("most") * (1 + SLACK)).alias("bound"))


def _scored(block: QueryBlock, k: int, schema: pa.Schema) -> Callable:
    def run(postings: pa.Table, work: pa.Table) -> pa.Table:
        if not postings.num_rows or not work.num_rows:
            return schema.empty_table()
        segment = work.column("segment")[0].as_py()
        size = np.array(work.column("sizes")[0].as_py())
        wanted = np.zeros(len(block.ids), bool)
        wanted[work.column("queries")[0].as_py()] = True
        lists = postings.column("rows").combine_chunks()
        v = np.repeat(block.codes(postings.column("token").combine_chunks()), pc.list_value_length(lists).to_numpy())
        p = lists.flatten().to_numpy(zero_copy_only=False)
        order = np.argsort(p, kind="stable")
        floor = np.where(wanted, 0.0, np.inf)
        q, at, score = product(block, v[order], p[order], size, np.arange(len(size)), k, floor=floor)
        return pa.table([pa.array(q.astype(np.int32)), pa.array(np.full(len(q), segment)), pa.array(at.astype(np.int32)), pa.array(score)], schema=schema)

    return run


def search_store(spark: SparkSession, path: str, queries: DataFrame, k: int = 64, first: int = FIRST) -> tuple[DataFrame, dict[str, int]]:
    """Best ``k`` passages of each query from a store: ``query_id``, ``source_id``, ``chunk_id``, ``score``, ``rank``.

    Also the number of (query, segment) pairs that share a word, and of those that were scored.
    """
    postings, segments, passages = (spark.read.parquet(f"{path}/{t}") for t in ("postings", "segments", "passages"))
    schema = StructType([StructField("q", IntegerType()), StructField("segment", LongType()), StructField("row", IntegerType()), StructField("score", DoubleType())])
    seen, out = {"pairs": 0, "scored": 0}, None
    for block in query_blocks(queries, None):
        counts = np.diff(block.since)
        rows = pa.table({"token": block.vocabulary.take(pa.array(np.repeat(np.arange(len(counts)), counts))), "q": pa.array(block.queries.astype(np.int32))})
        asked = spark.createDataFrame(rows)
        held = postings.join(asked.select("token").distinct(), "token", "left_semi")
        bound = written(bounds(postings, asked), shared(spark))
        order = Window.partitionBy("q").orderBy(F.desc("bound"), "segment")
        # (query, segment) pairs: a few thousandths of the (query, passage) pairs
        wave = written(bound.withColumn("n", F.row_number().over(order)), shared(spark))

        def scores(work: DataFrame) -> DataFrame:
            grouped = work.groupBy("segment").agg(F.collect_set("q").alias("queries")).join(segments, "segment")
            run = _scored(block, k, to_arrow_schema(schema))
            return held.select("token", "segment", "rows").groupBy("segment").cogroup(grouped.groupBy("segment")).applyInArrow(run, schema)

        one = written(scores(wave.where(F.col("n") <= first)), shared(spark))
        nth = one.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))).where(F.col("n") == k).select("q", F.col("score").alias("reached"))
        rest = wave.where(F.col("n") > first).join(nth, "q", "left").where(F.col("reached").isNull() | (F.col("bound") >= F.col("reached")))
        rest = written(rest.select("q", "segment"), shared(spark))
        seen["pairs"] += wave.count()
        seen["scored"] += wave.where(F.col("n") <= first).count() + rest.count()
        every = one.unionByName(scores(rest))
        some = every.withColumn("n", F.rank().over(Window.partitionBy("q").orderBy(F.desc("score")))).where(F.col("n") <= k).drop("n")
        placed = some.join(passages, ["segment", "row"])
        line = Window.partitionBy("q").orderBy(F.desc("score"), *PLACE)
        top = placed.withColumn("rank", F.row_number().over(line)).where(F.col("rank") <= k)
        ids = spark.createDataFrame(pa.table({"q": pa.array(np.arange(len(block.ids), dtype=np.int32)), "query_id": block.ids}))
        found = top.join(ids, "q").select("query_id", "source_id", "chunk_id", "score", "rank")
        out = found if out is None else out.unionByName(found)
    if out is None:
        empty = StructType([queries.schema["query_id"], passages.schema["source_id"], passages.schema["chunk_id"], StructField("score", DoubleType()), StructField("rank", IntegerType())])
        return spark.createDataFrame([], empty), seen
    return out, seen
