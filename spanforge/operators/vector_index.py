"""A stored index of vectors in inverted lists: built once, probed by many searches.

Vectors go to the list of the nearest of some centers, which are fitted on a bounded sample; every vector is
indexed. A search ranks the centers for each query and reads the first ``probes`` lists only. How many are
needed is measured when the index is built: for a bounded set of calibration queries the exact
neighbours over all rows are found, and the least number of lists that holds the wanted share of them is
kept in the manifest. With ``exact`` all lists are read, and the result is that of an exact search.

Lists are folders, so a search opens those it probes; a list's rows lie in many files and batches, so a
list that holds a third of all rows is many tasks. The manifest has a digest over the lists' contents.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from spanforge.functions import text as T
from spanforge.operators import retrieval
from spanforge.sources import publishing

#: Vectors that the centers are fitted on, queries that the number of probes is fitted on, and queries of a block.
SAMPLE, CALIBRATION, BLOCK = 20_000, 256, 20_000
#: Share of the exact neighbours that the probed lists of the calibration queries hold.
TARGET = 0.95
MOST_LISTS = 4096


@dataclass
class Index:
    """An index opened for searches."""

    path: str
    rows: DataFrame  # unit_id, embedding, scope, list
    centers: np.ndarray
    probes: int


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1e-300)


def fit(v: np.ndarray, lists: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Centers of unit vectors by cosine: each starts at a vector, moves to the direction of its own."""
    v = _unit(v)
    centers = v[np.random.default_rng(seed).permutation(len(v))[:lists]]
    for _ in range(rounds):
        near = (v @ centers.T).argmax(1)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, v)
        some = (sums != 0).any(1)
        centers[some] = _unit(sums[some])
    return centers


def _assigned(centers: np.ndarray, schema: pa.Schema):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = _matrix(batch.column("embedding"), batch.num_rows)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((v @ centers.T).argmax(1).astype(np.int32))], schema=schema)

    return run


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1)


def _sample(df: DataFrame, n: int, salt: int) -> DataFrame:
    """``n`` rows that the hash of their id chooses; alike in every run."""
    return df.orderBy(F.xxhash64("unit_id", F.lit(salt)), "unit_id").limit(n)


def build(vectors: DataFrame, path: str, dimension: int, lists: int | None = None, k: int = 64, target: float = TARGET) -> dict:
    """Writes an index of ``vectors`` (``unit_id``, ``embedding``, ``scope``) to the new folder ``path``; its manifest.

    Vectors of another dimension, or that are not finite or all zero, are an error.
    """
    spark = vectors.sparkSession
    fine = F.coalesce(T.valid_vector("embedding", dimension), F.lit(False))
    checked = vectors.select("unit_id", F.when(fine, F.col("embedding")).otherwise(F.raise_error(F.lit("a vector is not valid"))).alias("embedding"), "scope")
    n = checked.count()
    lists = lists or int(min(MOST_LISTS, max(1, round(np.sqrt(n)))))
    some = np.array([r[0] for r in _sample(checked, SAMPLE, 1).select("embedding").collect()], float).reshape(-1, dimension)
    centers = fit(some, lists) if len(some) else np.zeros((1, dimension))
    schema = StructType([*checked.schema, StructField("list", IntegerType())])
    dealt = checked.mapInArrow(_assigned(centers, to_arrow_schema(schema)), schema)
    # a range of (list, id) a task: a long list is many files
    dealt.repartitionByRange("list", F.xxhash64("unit_id")).sortWithinPartitions("list", "unit_id").write.mode("errorifexists").partitionBy("list").parquet(f"{path}/lists")
    spark.createDataFrame(enumerate(centers.tolist()), "list int, center array<double>").write.parquet(f"{path}/centers")
    index = Index(path, spark.read.schema(schema).parquet(f"{path}/lists"), centers, len(centers))
    digests = publishing.digest_tree(index.rows.select("list", publishing.row_digest(index.rows.drop("list")).alias("leaf")), "list")
    digests = digests.withColumnRenamed("list", "batch")
    digests.write.parquet(f"{path}/digests")
    manifest = {"schema_version": 1, "rows": n, "lists": len(centers), "dimension": dimension, "k": k, "target": target, "probes": calibrated(index, k, target) if n else 1}
    manifest |= {"digest": publishing.root(spark.read.parquet(f"{path}/digests")), "schema": schema.json()}
    spark.createDataFrame([(json.dumps(manifest),)], "value string").write.text(f"{path}/manifest")
    return manifest


def calibrated(index: Index, k: int, target: float) -> int:
    """The least number of lists that hold ``target`` of the ``k`` exact neighbours of the calibration queries."""
    asked = _sample(index.rows, CALIBRATION, 2).select(F.col("unit_id").alias("query_id"), F.col("embedding").alias("query_embedding"), F.lit(None).alias("query_scope"))
    exact = retrieval.dense(index.rows, asked, k, dimension=index.centers.shape[1]).select("query_id", "unit_id")
    held = exact.join(index.rows.select("unit_id", "list"), "unit_id").groupBy("query_id", "list").count().collect()  # at most CALIBRATION x k
    vectors = {r["query_id"]: np.array(r["query_embedding"], float) for r in asked.collect()}
    place = {q: np.argsort(np.argsort(-(index.centers @ v), kind="stable")) for q, v in vectors.items()}
    ranks = np.repeat([place[r["query_id"]][r["list"]] for r in held], [r["count"] for r in held])
    return int(np.quantile(ranks, target, method="higher")) + 1


def open_index(spark: SparkSession, path: str, verify: bool = True) -> Index:
    """The index at ``path``; with ``verify`` the rows of all its lists are checked against the manifest."""
    manifest = publishing.manifest_of(spark, path)
    if not manifest:
        raise publishing.NotPublished(f"no manifest: {path}")
    rows = spark.read.schema(StructType.fromJson(json.loads(manifest["schema"]))).parquet(f"{path}/lists")
    if verify:
        found = publishing.digest_tree(rows.select("list", publishing.row_digest(rows.drop("list")).alias("leaf")), "list")
        if publishing.root(found.withColumnRenamed("list", "batch")) != manifest["digest"]:
            raise publishing.NotPublished(f"rows and manifest differ: {path}")
    # as many rows as lists
    centers = [r["center"] for r in spark.read.parquet(f"{path}/centers").orderBy("list").collect()]
    return Index(path, rows, np.array(centers, float), manifest["probes"])


def _probed(matrix: np.ndarray, ids: pa.Array, scopes: list | None, ask: dict[int, np.ndarray], k: int, schema: pa.Schema):  # noqa: ANN202
    """Distances of the queries that probe a list to its vectors; of a batch and list at least the ``k`` nearest."""
    length = np.sqrt((matrix * matrix).sum(1))
    code = {s: i for i, s in enumerate(dict.fromkeys(scopes or ()))}
    wanted = np.array([code[s] for s in scopes or ()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("list").to_numpy()
            for number in np.unique(lists):
                q, rows = ask[int(number)], np.flatnonzero(lists == number)
                part = batch.take(pa.array(rows))
                v = _matrix(part.column("embedding"), len(rows))
                own = np.sqrt((v * v).sum(1))
                held = np.array([code.get(s, -1) for s in part.column("scope").to_pylist()]) if scopes is not None else None
                for a in range(0, len(q), 256):
                    some = q[a : a + 256]
                    d = 1 - (v @ matrix[some].T) / (own[:, None] * length[None, some])
                    if held is not None:
                        d[held[:, None] != wanted[None, some]] = np.inf
                    # ranks go by rounded distances: what may round to the k-th stays
                    last = np.partition(d, k - 1, axis=0)[k - 1] + 2e-9 if len(rows) > k else np.full(len(some), np.inf)
                    i, j = np.nonzero((d <= last) & np.isfinite(d))
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(some[j])), part.column("unit_id").take(pa.array(i)), pa.array(d[i, j])], schema=schema)

    return run


def search(index: Index, queries: DataFrame, k: int = 64, scoped: bool = False, probes: int | None = None, exact: bool = False) -> DataFrame:
    """Nearest vectors of each query by cosine distance: ``query_id``, ``unit_id``, ``distance``, ``rank``.

    ``queries``: ``query_id``, ``query_embedding``, ``query_scope``. Reads ``probes`` lists a query, by default as many as
    the calibration found, or all of them with ``exact``.
    """
    probes = len(index.centers) if exact else min(len(index.centers), probes or index.probes)
    schema = StructType([queries.schema["query_id"], index.rows.schema["unit_id"], StructField("distance", DoubleType())])
    blocks = max(1, -(-queries.count() // BLOCK))
    found = None
    for b in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        table = part.select("query_id", "query_embedding", "query_scope").toArrow()
        matrix = np.array(table.column("query_embedding").to_pylist(), float).reshape(table.num_rows, -1)
        if not len(matrix):
            continue
        near = np.argsort(-(matrix @ index.centers.T), axis=1, kind="stable")[:, :probes]
        ask = {int(n): np.flatnonzero((near == n).any(1)) for n in np.unique(near)}
        rows = index.rows if exact else index.rows.where(F.col("list").isin(list(ask)))
        run = _probed(matrix, table.column("query_id").combine_chunks(), table.column("query_scope").to_pylist() if scoped else None, ask, k, to_arrow_schema(schema))
        hits = rows.select("unit_id", "embedding", "scope", "list").mapInArrow(run, schema)
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return queries.sparkSession.createDataFrame([], StructType([*schema, StructField("rank", IntegerType())]))
    w = Window.partitionBy("query_id").orderBy("distance", "unit_id")
    return found.withColumn("distance", F.round("distance", 9)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
