"""Evidence and bundles settled into durable state (ST2): each run adds to what the runs before it left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.operators import evidence
from spanforge.sources.durable import Durable


def settle(state: Durable, rows: DataFrame, order: str = "seq") -> int:
    """Unites evidence with the state by reference: the first place stays, the last row's fields win; the buckets written.

    One reference with two texts is an error, and leaves the state as it was. Rows settled again change nothing.
    """
    return state.upsert(rows.select(state.key), lambda old: evidence.union_by_ref(old, rows, ref=state.key, order=order))


def settle_bundles(state: Durable, bundles: DataFrame, known: DataFrame, ref: str = "ref") -> int:
    """Adds bundles that the state does not hold; one that it holds stays as it is.

    A bundle that names a reference outside ``known`` is an error.
    """
    fields = [c for c in state.schema.names if c != state.key]
    unknown = bundles.select(F.explode("refs").alias(ref)).join(known.select(ref), ref, "left_anti")
    if not unknown.isEmpty():
        raise ValueError("a bundle references unavailable originals")

    def merge(old: DataFrame) -> DataFrame:
        both = old.withColumn("__new", F.lit(0)).unionByName(bundles.select(*state.schema.names).withColumn("__new", F.lit(1)))
        row = F.struct(*fields)
        return both.groupBy(state.key).agg(F.min_by(row, F.struct("__new", F.to_json(row))).alias("row")).select(state.key, "row.*")

    return state.upsert(bundles.select(state.key), merge)
