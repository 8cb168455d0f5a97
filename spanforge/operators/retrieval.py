"""Lexical and dense candidates, their fusion, and selection."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from spanforge.functions import text as T
from spanforge.operators import postings


def lexical(passages: DataFrame, queries: DataFrame, k: int = 64, scope: str | None = None) -> DataFrame:
    """Top ``k`` passages of each query by |q ∩ p| / sqrt(|p|) (JN1, AG1, WN1, TK1, FI1, FI2).

    ``passages``: ``source_id``, ``chunk_id``, ``start_at``, ``chunk_text``, optionally ``context`` (its
    tokens count for matches, not for length); ``queries``: ``query_id``, ``query``. With ``scope``
    only passages whose ``source_id`` equals that column of the query are ranked. Ties by source,
    first span start, chunk id as text. Blocks of queries are multiplied with the passages in place.
    """
    scored = postings.ranked(passages, queries, k, scope)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "source_id", "start_at", "chunk_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "source_id", "chunk_id", "score", "rank")


def _nearest(ids: pa.Array, matrix: np.ndarray, scopes: list | None, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Distances of a block of queries to batches of ``unit_id``, ``embedding``, ``scope``; of a batch at least the ``k`` nearest."""
    lengths = np.sqrt((matrix * matrix).sum(1))
    code = {s: i for i, s in enumerate(dict.fromkeys(scopes or ()))}
    asked = np.array([code[s] for s in scopes or ()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            v = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1)
            own = np.sqrt((v * v).sum(1))
            held = np.array([code.get(s, -1) for s in batch.column("scope").to_pylist()]) if scopes is not None else None
            for q in range(0, len(matrix), 256):
                d = 1 - (v @ matrix[q : q + 256].T) / (own[:, None] * lengths[None, q : q + 256])
                if held is not None:
                    d[held[:, None] != asked[None, q : q + 256]] = np.inf
                # ranks go by rounded distances: what may round to the k-th stays
                last = np.partition(d, k - 1, axis=0)[k - 1] + 2e-9 if n > k else np.full(d.shape[1], np.inf)
                i, j = np.nonzero((d <= last) & np.isfinite(d))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(j + q)), batch.column("unit_id").take(pa.array(i)), pa.array(d[i, j])], ["query_id", "unit_id", "distance"])

    return run


def dense(vectors: DataFrame, queries: DataFrame, k: int = 64, scoped: bool = False, dimension: int = 64, block: int = 20_000) -> DataFrame:
    """Exact k nearest vectors by cosine distance (JN3, FI3, PR20, TK1).

    ``vectors``: ``unit_id``, ``embedding``, ``scope``; ``queries``: ``query_id``, ``query_embedding``, ``query_scope``.
    The stated query set is compared with all rows. A set of at most ``block`` queries is sent to
    every task, which multiplies it with its vectors and keeps the best of each Arrow batch; a
    larger one is joined in blocks, and each task keeps its best before the shuffle (the window's
    group limit).
    """
    ok = vectors.where(T.valid_vector("embedding", dimension))
    blocks = max(1, -(-queries.count() // block))
    if blocks == 1:
        rows = queries.select("query_id", "query_embedding", "query_scope").toArrow()
        matrix = np.array(rows.column("query_embedding").to_pylist(), float).reshape(rows.num_rows, dimension)
        run = _nearest(rows.column("query_id").combine_chunks(), matrix, rows.column("query_scope").to_pylist() if scoped else None, k)
        schema = StructType([queries.schema["query_id"], vectors.schema["unit_id"], StructField("distance", DoubleType())])
        found = ok.select("unit_id", "embedding", "scope").mapInArrow(run, schema)
    else:
        asked = queries.withColumn("query_block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))).withColumn("query_length", F.sqrt(T.dot("query_embedding", "query_embedding")))
        every = ok.withColumn("length", F.sqrt(T.dot("embedding", "embedding"))).withColumn("query_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))
        pairs = every.join(asked, (every["query_block"] == asked["query_block"]) & ((F.col("scope") == F.col("query_scope")) if scoped else F.lit(True)))
        found = pairs.select("query_id", "unit_id", (1 - T.dot("embedding", "query_embedding") / (F.col("length") * F.col("query_length"))).alias("distance"))
    found = found.withColumn("distance", F.round("distance", 9))
    w = Window.partitionBy("query_id").orderBy("distance", "unit_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hydrated(hits: DataFrame, units: DataFrame, passages: DataFrame) -> DataFrame:
    """Dense hits as passages (JN4): ``query_id``, ``source_id``, ``chunk_id``, ``rank``.

    ``units``: ``unit_id``, ``source_id``, ``chunk_id``, ``text_hash``. A unit without a passage, or whose
    passage has another text than was embedded, is an error.
    """
    there = passages.select("source_id", "chunk_id", F.sha2("chunk_text", 256).alias("found_hash"))
    both = hits.join(units.select("unit_id", "source_id", "chunk_id", "text_hash"), "unit_id", "left").join(there, ["source_id", "chunk_id"], "left")
    same = F.col("text_hash") == F.col("found_hash")
    checked = F.when(F.coalesce(same, F.lit(False)), F.col("chunk_id")).otherwise(F.raise_error(F.lit("vector index does not match the corpus")))
    return both.select("query_id", "source_id", checked.alias("chunk_id"), "rank")


def fuse(branches: dict[str, DataFrame], keys: list[str], k: int = 64, constant: int = 60) -> DataFrame:
    """Reciprocal-rank fusion (JN2, WN8, TK2): a branch counts once per key, at its first rank.

    Each branch has ``query_id``, ``keys`` and ``rank``; branches are added in the order given, so that
    the sum does not depend on the order of rows. They are joined, not united: a union of rankings, each
    dealt by query, may take its parts for dealt alike after their partitions were coalesced apart.
    """
    out = None
    for name, df in branches.items():
        first = df.groupBy("query_id", *keys).agg(F.min("rank").alias(f"rank_{name}"))
        out = first if out is None else out.join(first, ["query_id", *keys], "full_outer")
    rrf = F.lit(0.0)
    for n in branches:
        rrf = rrf + F.coalesce(F.lit(1.0) / (constant + F.col(f"rank_{n}")), F.lit(0.0))
    w = Window.partitionBy("query_id").orderBy(F.desc("rrf"), *keys)
    return out.withColumn("rrf", rrf).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def rerank(candidates: DataFrame, score: Callable[[Column, Column], Column], query: str = "query", view: str = "view") -> DataFrame:
    """Scores each distinct (query, view) once, and ranks by (-best score, place) (UF1, ST9, AG6, FI4, FI5, TK3).

    ``candidates``: ``query_id``, ``place``, ``query``, ``views`` (array). Null scores drop a candidate; a
    score that is not finite is an error.
    """
    windows = candidates.select("query_id", "place", query, F.explode("views").alias(view)).withColumn("pair", F.sha2(F.concat_ws("\u001f", F.sha2(query, 256), view), 256))
    # texts go through one shuffle; what follows joins on their digest
    once = windows.groupBy("pair").agg(F.first(F.struct(query, view)).alias("t")).select("pair", score(F.col(f"t.{query}"), F.col(f"t.{view}")).alias("score"))
    finite = F.col("score").isNull() | (~F.isnan("score") & (F.abs("score") < float("inf")))
    once = once.withColumn("score", F.when(finite, F.col("score")).otherwise(F.raise_error(F.lit("score is not finite"))))
    best = windows.select("query_id", "place", "pair").join(once, "pair").groupBy("query_id", "place").agg(F.max("score").alias("score"), F.count("*").alias("pairs")).where("score is not null")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "place")
    return best.withColumn("rank", F.row_number().over(w))


def overlap_score(query: Column, view: Column) -> Column:
    """A stated, deterministic scorer: token overlap over the root of the view's size. No model."""
    q, v = T.tokens(query), T.tokens(view)
    return F.size(F.array_intersect(q, v)) / F.sqrt(F.greatest(F.lit(1), F.size(v)).cast("double"))


def select_uncovered(ranked: DataFrame, limit: int = 6, order: str = "rank", refs: str = "refs") -> DataFrame:
    """Walks a query's blocks in order and skips those whose refs were all seen; stops at ``limit`` (WN12, UD3, TK4).

    ``ranked``: ``query_id``, ``order``, ``refs``. The state holds the refs of at most ``limit`` blocks.
    """
    blocks = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(refs).alias("refs"))))
    start = F.struct(F.expr("cast(array() as array<string>)").alias("seen"), F.expr("cast(array() as array<int>)").alias("kept"))

    def step(a: Column, b: Column) -> Column:
        take = (F.size(a["kept"]) < limit) & (F.size(F.array_except(b["refs"], a["seen"])) > 0)
        return F.when(take, F.struct(F.array_union(a["seen"], b["refs"]).alias("seen"), F.array_append(a["kept"], b["o"]).alias("kept"))).otherwise(a)

    return ranked.groupBy("query_id").agg(F.aggregate(blocks, start, step, lambda a: a["kept"]).alias("kept"))
