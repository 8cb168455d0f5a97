"""Tables bound to their content: batches that resume, a digest tree over all rows, checks on opening.

A row's digest covers the names, types and values of its columns. Rows belong to a batch by the hash of
their key, so a build that stopped goes on with the batches that are missing or differ, and an opening
that needs some batches checks those. A batch's digest is the root of a tree over its rows' digests: each
level hashes groups of about ``FAN`` digests, so no task gathers a batch. Equal rows count by number.
"""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from spanforge.sources.tables import shared, written

#: Digests that one node of the tree covers on average; rows of a batch by default.
FAN, BATCH_ROWS = 512, 1_000_000


class NotPublished(ValueError):
    """A table without a manifest, or whose content is not what its manifest says."""


def row_digest(df: DataFrame) -> Column:
    """SHA-256 of a row: each column by name, type and JSON value, in the order of names."""
    names = sorted(df.columns)
    head = json.dumps([[c, df.schema[c].dataType.simpleString()] for c in names])
    quoted = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]
    return F.sha2(F.concat(F.lit(head), F.to_json(F.struct(*quoted), {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd HH:mm:ss.SSSSSSxxx"})), 256)


def digest_tree(leaves: DataFrame, by: str) -> DataFrame:
    """``by``, ``rows``, ``digest``: root of the tree over the column ``leaf`` of each ``by``."""
    # equal rows are one leaf with their number, so none of the groups below is hot
    level = leaves.groupBy(by, "leaf").agg(F.count("*").alias("rows"))
    level = level.select(by, F.sha2(F.concat_ws(":", "leaf", F.col("rows").cast("string")), 256).alias("leaf"), "rows")
    level = written(level, shared(leaves.sparkSession))
    most = level.groupBy(by).count().agg(F.max("count")).first()[0] or 0
    while most > FAN:
        # nodes go by the head of the digest: about FAN a group, whatever the number of rows
        groups = -(-most // FAN)
        node = F.pmod(F.conv(F.substring("leaf", 1, 12), 16, 10).cast("bigint"), F.lit(groups))
        level = _node(level, by, node.alias("node")).drop("node")
        most = groups
    return _node(level, by).withColumnRenamed("leaf", "digest")


def _node(level: DataFrame, *by: str | Column) -> DataFrame:
    return level.groupBy(*by).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("leaf")), ","), 256).alias("leaf"), F.sum("rows").alias("rows"))


def _batches(rows: DataFrame) -> DataFrame:
    return digest_tree(rows.select("batch", row_digest(rows.drop("batch")).alias("leaf")), "batch")


def root(batches: DataFrame) -> str:
    """Digest of a table from those of its batches, as ``batch``, ``rows``, ``digest``."""
    leaves = batches.select(F.lit(0).alias("all"), F.sha2(F.concat_ws(":", "batch", "rows", "digest"), 256).alias("leaf"))
    found = digest_tree(leaves, "all").first()
    return found["digest"] if found else ""


def publish(df: DataFrame, path: str, key: list[str], batch_rows: int = BATCH_ROWS) -> dict:
    """Writes ``df`` to ``path`` and its manifest last (SK3); what has no manifest is not published.

    A build at ``path`` that did not end is taken up: only batches that are missing, or hold other rows than
    ``df`` has, are written. A published table is never written over. Returns the manifest, with ``written``,
    the number of batches that were.
    """
    spark = df.sparkSession
    if manifest_of(spark, path):
        raise FileExistsError(f"published already: {path}")
    started = _maybe(spark, f"{path}/building")
    count = started.first()["batches"] if started is not None else max(1, -(-df.count() // batch_rows))
    if started is None:
        spark.createDataFrame([(count,)], "batches long").write.json(f"{path}/building")
    batch = F.pmod(F.xxhash64(*(F.col(f"`{k}`") for k in key)), F.lit(count))
    staged = df.withColumn("batch", batch)
    wanted = written(_batches(staged), shared(spark))
    there = _maybe(spark, f"{path}/rows", df)
    missing = wanted if there is None else wanted.join(_batches(there), ["batch", "rows", "digest"], "left_anti")
    missing = written(missing.select("batch"), shared(spark))
    todo = missing.count()
    if todo:
        # batches are dealt by hash and split, so that a large one is not one task's
        part = staged.join(missing, "batch", "left_semi")
        part.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{path}/rows")
    if there is None and not todo:
        df.withColumn("batch", batch).limit(0).write.mode("append").partitionBy("batch").parquet(f"{path}/rows")
    back = _read(spark, path, df.schema)
    # a build that ended between these two writes is taken up here
    _batches(back).write.mode("overwrite").parquet(f"{path}/digests")
    found, all_of = spark.read.parquet(f"{path}/digests"), ["batch", "rows", "digest"]
    if not found.join(wanted, all_of, "left_anti").isEmpty() or not wanted.join(found, all_of, "left_anti").isEmpty():
        raise NotPublished(f"written rows differ from those given: {path}")
    manifest = {"schema_version": 1, "status": "ready", "rows": wanted.agg(F.sum("rows")).first()[0] or 0, "batches": count, "digest": root(found), "schema": df.schema.json()}
    spark.createDataFrame([(json.dumps(manifest),)], "value string").write.mode("errorifexists").text(f"{path}/manifest")
    return manifest | {"written": todo}


def published(spark: SparkSession, path: str, batches: list[int] | None = None) -> DataFrame:
    """A published table; an error if its rows are not those of the manifest.

    With ``batches`` only these are read and checked, each against its own digest, and these against the root.
    """
    manifest = manifest_of(spark, path)
    if not manifest or manifest["status"] != "ready":
        raise NotPublished(f"no manifest: {path}")
    known = spark.read.parquet(f"{path}/digests")
    if root(known) != manifest["digest"]:
        raise NotPublished(f"digests and manifest differ: {path}")
    rows = _read(spark, path, StructType.fromJson(json.loads(manifest["schema"])))
    if batches is not None:
        rows, known = rows.where(F.col("batch").isin(batches)), known.where(F.col("batch").isin(batches))
    found = _batches(rows)
    both = known.join(found.withColumnsRenamed({"rows": "rows_", "digest": "digest_"}), "batch", "full_outer")
    same = F.coalesce((F.col("rows") == F.col("rows_")) & (F.col("digest") == F.col("digest_")), F.lit(False))
    if not both.where(~same).isEmpty():
        raise NotPublished(f"rows and manifest differ: {path}")
    return rows.drop("batch")


def _read(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(StructType([*schema, StructField("batch", LongType())])).parquet(f"{path}/rows")


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        return bool(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).inputFiles())
    except AnalysisException:  # no such folder
        return False


def _maybe(spark: SparkSession, path: str, like: DataFrame | None = None) -> DataFrame | None:
    if not _exists(spark, path):
        return None
    return spark.read.json(path) if like is None else _read(spark, path.rpartition("/")[0], like.schema)


def manifest_of(spark: SparkSession, path: str) -> dict | None:
    return json.loads(spark.read.text(f"{path}/manifest").first()[0]) if _exists(spark, f"{path}/manifest") else None
