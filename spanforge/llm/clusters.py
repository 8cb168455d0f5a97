"""Centroid clustering with Hamerly bounds, exact in integers.

A vector's components become integers. Each round assigns every vector to its nearest centroid and moves
the centroids to the componentwise floor of their vectors' means. A written table holds for each vector
its cluster, one upper bound on the distance to it and one lower bound on that to any other centroid.
A round loosens both by the drift of the centroids; a vector whose upper bound stays below the lower
bound, or below half the distance from its centroid to the next, keeps its cluster without a distance.
The others are scanned in full: exact integer squared distances to all centroids, ties to the smaller
number. Bounds are rounded outwards and compared strictly, so no rounding can decide an assignment.

The sums of the centroids are carried on by the vectors that changed cluster: 64 exact decimal sums a
cluster, pre-aggregated in each task. To the driver come the centroids and their sums, whose number is a
parameter; to the tasks go the centroids. No step gathers the vectors of a cluster.

Defined results: a vector with another number of components, or with a null or non-finite one, is left out;
rows that share an id are vectors of their own, and a null id hashes as the empty string; first centroids
with one hash go by their components; fewer vectors than centroids give as many centroids as vectors; an
empty table gives none; other columns are not read. Components saturate at the ends of a long, and so
does a distance; comparisons stay exact.
"""

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from .common import discard, materialize

LONG = 2**63 - 1
#: Bounds are widened by this part, far above the rounding of the operations between two scans.
SLACK = 1e-9


@dataclass(frozen=True)
class Clustering:
    """``centroids`` many, ``rounds`` of moves, vectors of ``dimension`` scaled by ``scale``."""

    centroids: int = 40
    rounds: int = 5
    dimension: int = 64
    scale: int = 256
    salt: str = "2:"


def integers(vectors: DataFrame, c: Clustering, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Kept vectors: ``key`` and ``v``, array of longs."""
    x = F.col(embedding).cast("array<double>")
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    v = F.transform(x, lambda e: F.floor(e * float(c.scale)).cast("bigint"))
    # one test after the other: the second must not see a null array
    return vectors.select(key, embedding).where(F.coalesce(F.size(embedding) == c.dimension, F.lit(False))).where(finite).select(key, v.alias("v"))


def _objects(a: np.ndarray) -> np.ndarray:
    return a.astype(object)


def squared(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row of ``v`` to each centroid, as longs or, where they may not fit, as objects."""
    most = max(_most(v), _most(centroids))
    n = v.shape[1]
    if 4 * n * most * most < 2**53:  # every sum of products is an exact double
        a, b = v.astype(float), centroids.astype(float)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)
    if 4 * n * most * most >= 2**63:
        v, centroids = _objects(v), _objects(centroids)
    return np.stack([((v - c) ** 2).sum(1) for c in centroids], 1)


def own(v: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Exact squared distance of each row to the centroid beside it."""
    most = max(_most(v), _most(centers))
    if 4 * v.shape[1] * most * most >= 2**63:
        v, centers = _objects(v), _objects(centers)
    return ((v - centers) ** 2).sum(1)


def _most(a: np.ndarray) -> int:
    return max(abs(int(a.min())), abs(int(a.max()))) if a.size else 0


def _root(d: np.ndarray, widen: float) -> np.ndarray:
    return np.sqrt(d.astype(float)) * (1 + widen)


def _matrix(column: pa.Array, n: int, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, width)


def gaps(centroids: np.ndarray) -> np.ndarray:
    """Half of the distance of each centroid to the nearest other one, rounded down."""
    d = _root(squared(centroids, centroids), -SLACK)
    np.fill_diagonal(d, np.inf)
    return d.min(1) / 2


def scan(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid of each row, upper bound on its distance and lower bound on the next one's."""
    d = squared(v, centroids)
    rows = np.arange(len(v))
    near = d.argmin(1)  # the first of equal ones
    upper = _root(d[rows, near], SLACK)
    roots = _root(d, -SLACK)
    roots[rows, near] = np.inf
    return near, upper, roots.min(1)


def assigner(centroids: np.ndarray, before: np.ndarray | None, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A round over (key, v[, cluster, upper, lower]): adds the cluster before, and whether the row was scanned."""
    half = gaps(centroids)
    drift = None if before is None else _root(own(centroids, before), SLACK)
    width = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            v = _matrix(batch.column(1), n, width)
            if drift is None:
                last = np.full(n, -1)
                cluster, upper, lower = scan(v, centroids)
                far = np.ones(n, bool)
            else:
                last = batch.column("cluster").to_numpy()
                cluster = last.copy()
                upper = (batch.column("upper").to_numpy() + drift[cluster]) * (1 + SLACK)
                lower = (batch.column("lower").to_numpy() - drift.max()) * (1 - SLACK)
                bound = np.maximum(lower, half[cluster])
                near = np.flatnonzero(~(upper < bound))
                if len(near):  # one distance makes the upper bound tight again
                    upper[near] = _root(own(v[near], centroids[cluster[near]]), SLACK)
                far = ~(upper < bound)
                if far.any():
                    cluster[far], upper[far], lower[far] = scan(v[far], centroids)
            arrays = [batch.column(0), batch.column(1), cluster.astype(np.int32), upper, lower, last.astype(np.int32), far]
            yield pa.RecordBatch.from_arrays([a if isinstance(a, pa.Array) else pa.array(a) for a in arrays], schema=schema)

    return run


def _sums(state: DataFrame, c: Clustering) -> dict[int, tuple[int, list[int]]]:
    """What the moved vectors add to each cluster: number of vectors and exact sums of components."""
    moved = state.where("cluster <> last").select(
        F.explode(F.array(F.struct(F.col("cluster").alias("k"), F.lit(1).alias("sign")), F.struct(F.col("last").alias("k"), F.lit(-1).alias("sign")))).alias("e"), "v"
    ).where("e.k >= 0")
    signed = [F.sum(F.col("v")[i].cast("decimal(20,0)") * F.col("e.sign").cast("decimal(1,0)")).alias(f"s{i}") for i in range(c.dimension)]
    rows = moved.groupBy("e.k").agg(F.sum("e.sign").alias("n"), *signed).collect()  # a row per centroid
    return {r["k"]: (r["n"], [int(r[f"s{i}"]) for i in range(c.dimension)]) for r in rows}


def first_centroids(kept: DataFrame, c: Clustering, key: str = "vec_id") -> np.ndarray:
    """The vectors with the smallest hashes of their ids; at most ``c.centroids`` rows come to the driver."""
    digest = F.sha2(F.concat(F.lit(c.salt), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"), 256)
    rows = kept.select(digest.alias("digest"), "v").orderBy("digest", "v").limit(c.centroids).collect()
    return np.array([r["v"] for r in rows], np.int64).reshape(len(rows), c.dimension)


def clustered(vectors: DataFrame, c: Clustering = Clustering(), key: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """Written rows ``key``, ``v``, ``cluster``, ``upper``, ``lower``, ``last``, ``scanned`` of the last assignment, and the final centroids."""
    kept = integers(vectors, c, key, embedding)
    centroids, before = first_centroids(kept, c, key), None
    schema = StructType(
        [
            kept.schema[key], StructField("v", ArrayType(LongType(), False)), StructField("cluster", IntegerType()), StructField("upper", DoubleType()),
            StructField("lower", DoubleType()), StructField("last", IntegerType()), StructField("scanned", kept.select(F.lit(True).alias("b")).schema["b"].dataType),
        ]
    )
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    if not len(centroids):
        return kept.sparkSession.createDataFrame([], schema), centroids
    totals = [[0, [0] * c.dimension] for _ in centroids]
    state = kept
    for done in range(c.rounds + 1):
        inputs = state.select(key, "v") if before is None else state.select(key, "v", "cluster", "upper", "lower")
        new = materialize(inputs.mapInArrow(assigner(centroids, before, arrow), schema), f"round{done}")
        if before is not None:
            discard(state)
        state, before = new, centroids
        if done < c.rounds:
            for k, (n, sums) in _sums(state, c).items():
                totals[k][0] += n
                totals[k][1] = [a + b for a, b in zip(totals[k][1], sums)]
            moved = [[s // n for s in sums] if n else list(map(int, old)) for (n, sums), old in zip(totals, centroids)]
            centroids = np.array(moved, np.int64)
    return state, centroids


def distances(state: DataFrame, centroids: np.ndarray, key: str = "vec_id") -> DataFrame:
    """``key``, ``cluster``, ``distance``: exact squared distance to the own centroid, at most the largest long."""
    schema = StructType([state.schema[key], StructField("cluster", IntegerType()), StructField("distance", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cluster = batch.column("cluster").to_numpy()
                d = own(_matrix(batch.column("v"), batch.num_rows, centroids.shape[1]), centroids[cluster])
                d = np.minimum(d, LONG).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("cluster"), pa.array(d)], [key, "cluster", "distance"])

    return state.select(key, "cluster", "v").mapInArrow(run, schema)


def inertia(vectors: DataFrame, c: Clustering = Clustering(), key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Each kept vector with its cluster, squared distance, the sums of these, and the digest of its centroid."""
    state, centroids = clustered(vectors, c, key, embedding)
    found = materialize(distances(state, centroids, key), "distances")
    discard(state)
    exact = F.sum(F.col("distance").cast("decimal(38,0)"))
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(exact.alias("s")).collect()}  # a row per centroid
    as_long = lambda x: F.lit(min(x, LONG)).cast("bigint")
    by_cluster = F.array(*(as_long(sums.get(k, 0)) for k in range(max(1, len(centroids)))))
    texts = F.array(*(F.lit(",".join(map(str, row))) for row in centroids.tolist() or [[]]))
    return found.select(
        key, "cluster", "distance", by_cluster[F.col("cluster")].alias("cluster_inertia"), as_long(sum(sums.values())).alias("inertia"),
        F.sha2(texts[F.col("cluster")].cast("binary"), 256).alias("centroid_sha256"),
    )
