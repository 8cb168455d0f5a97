"""A keyed table in versions: an upsert writes the buckets that it touches, and a new list of buckets.

Rows lie in ``buckets`` folders by the hash of their key. A version is a manifest that names, for each bucket,
the folder that holds it; folders of buckets that did not change are named again. Data are written first
and the manifest last, so a run that fails leaves the version before, and a run that is repeated finds it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKET = "__bucket"


class Durable:
    """The table at ``path`` with the key column ``key``; created by the first upsert."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: StructType, buckets: int = 64) -> None:
        self.spark, self.path, self.key, self.schema, self.buckets = spark, path, key, schema, buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _manifest(self) -> dict[int, str]:
        """Folder of each bucket in the last version; as many rows as buckets."""
        try:
            every = self.spark.read.schema("bucket int, folder string, version int").parquet(f"{self.path}/manifest")
        except AnalysisException:  # no version yet
            return {}
        last = every.agg(F.max("version")).first()[0]
        return {r["bucket"]: r["folder"] for r in every.where(F.col("version") == F.lit(last)).collect()} if last is not None else {}

    @property
    def version(self) -> int:
        try:
            return self.spark.read.schema("version int").parquet(f"{self.path}/manifest").agg(F.max("version")).first()[0] or 0
        except AnalysisException:
            return 0

    def rows(self, buckets: list[int] | None = None) -> DataFrame:
        """Rows of the last version, or of some of its buckets."""
        found = [f for b, f in self._manifest().items() if f and (buckets is None or b in buckets)]
        return self.spark.read.schema(self.schema).parquet(*found) if found else self.spark.createDataFrame([], self.schema)

    def upsert(self, touched: DataFrame, merge: Callable[[DataFrame], DataFrame]) -> int:
        """Replaces the buckets of the keys in ``touched`` by ``merge`` of their rows; the number of buckets written.

        Another writer of the same version is an error: the manifest of a version is written once.
        """
        hit = sorted(r[0] for r in touched.select(self.bucket().alias(BUCKET)).distinct().collect())  # at most as many as buckets
        if not hit:
            return 0
        version, before = self.version + 1, self._manifest()
        new = merge(self.rows(hit)).select(*(F.col(f"`{c}`") for c in self.schema.names)).withColumn(BUCKET, self.bucket())
        folder = f"{self.path}/data/version={version}"
        # merged rows are written where they lie: dealing them by bucket would shuffle the table once more
        new.write.mode("overwrite").partitionBy(BUCKET).parquet(folder)
        full = {r[0] for r in self.spark.read.parquet(folder).select(BUCKET).distinct().collect()} if not _empty(self.spark, folder) else set()
        after = before | {b: f"{folder}/{BUCKET}={b}" if b in full else "" for b in hit}
        manifest = self.spark.createDataFrame(sorted(after.items()), "bucket int, folder string")
        manifest.coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/manifest/version={version}")
        return len(hit)


def _empty(spark: SparkSession, folder: str) -> bool:
    try:
        return BUCKET not in spark.read.parquet(folder).columns
    except AnalysisException:
        return True
