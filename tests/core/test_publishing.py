"""Content-bound tables, and the vector index that is opened through its digests."""

import random

import pytest
from pyspark.sql import functions as F

from spanforge.operators import retrieval, vector_index
from spanforge.sources import publishing
from spanforge.sources.tables import shared

SCHEMA = "id long, text string, tags array<string>, `a.b` double"


def table(spark, n=40, change=None):
    rows = [(i, f"text {i}", [str(i)] if i % 3 else None, i / 7) for i in range(n)]
    if change is not None:
        rows[change] = (change, "other", None, 0.0)
    return spark.createDataFrame([*rows, *rows[:5]], SCHEMA)


def test_rows_come_back_and_are_never_written_over(spark):
    path = shared(spark)
    manifest = publishing.publish(table(spark), path, ["id"], batch_rows=10)
    assert (manifest["rows"], manifest["batches"], manifest["written"]) == (45, 5, 5)
    back = publishing.published(spark, path)
    assert back.schema == table(spark).schema and sorted(map(str, back.collect())) == sorted(map(str, table(spark).collect()))
    with pytest.raises(FileExistsError):
        publishing.publish(table(spark), path, ["id"])
    assert publishing.publish(table(spark), shared(spark), ["id"], 10)["digest"] == manifest["digest"]
    assert publishing.publish(table(spark, change=7), shared(spark), ["id"], 10)["digest"] != manifest["digest"]


def test_a_changed_value_is_refused(spark):
    path = shared(spark)
    publishing.publish(table(spark), path, ["id"], batch_rows=10)
    rows = spark.read.parquet(f"{path}/rows")
    spoiled = rows.where("id = 7").select("batch").first()[0]
    changed = [tuple(r) for r in rows.where(F.col("batch") == spoiled).withColumn("text", F.when(F.col("id") == 7, "changed").otherwise(F.col("text"))).collect()]
    spark.createDataFrame(changed, rows.schema).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{path}/rows")
    with pytest.raises(publishing.NotPublished, match="rows and manifest"):
        publishing.published(spark, path)
    with pytest.raises(publishing.NotPublished):
        publishing.published(spark, path, batches=[spoiled])
    fine = [b for b in range(5) if b != spoiled]
    assert publishing.published(spark, path, batches=fine).where("text = 'changed'").count() == 0


def test_a_build_that_stopped_goes_on(spark, monkeypatch):
    path = shared(spark)
    # the build ends before its digests are written
    monkeypatch.setattr(publishing, "root", lambda _: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        publishing.publish(table(spark), path, ["id"], batch_rows=10)
    monkeypatch.undo()
    with pytest.raises(publishing.NotPublished, match="no manifest"):
        publishing.published(spark, path)
    # of what is there, the batch of the changed row alone is written again
    manifest = publishing.publish(table(spark, change=7), path, ["id"], batch_rows=10)
    assert manifest["written"] == 1 and publishing.published(spark, path).where("text = 'other'").count() == 1


def test_a_tree_of_several_levels_and_hot_rows(spark, monkeypatch):
    monkeypatch.setattr(publishing, "FAN", 4)
    leaves = spark.range(300).select(F.lit(0).alias("all"), F.sha2((F.col("id") % 200).cast("string"), 256).alias("leaf"))
    one, two = (publishing.digest_tree(leaves.repartition(n), "all").first() for n in (1, 7))
    assert one["rows"] == 300 and one == two
    assert publishing.digest_tree(leaves.limit(299), "all").first()["digest"] != one["digest"]
    assert publishing.digest_tree(leaves.limit(0), "all").count() == 0
    assert publishing.publish(table(spark).limit(0), shared(spark), ["id"])["rows"] == 0


def vectors(spark, n=1500, dimension=16):
    rng = random.Random(3)
    centers = [[rng.gauss(0, 1) for _ in range(dimension)] for _ in range(20)]
    # a third of all vectors is in one place
    rows = [(i, [x + rng.gauss(0, 0.3) for x in centers[0 if i % 3 == 0 else i % 20]], i % 4) for i in range(n)]
    v = spark.createDataFrame(rows, "unit_id long, embedding array<float>, scope int")
    return v, v.where("unit_id % 50 = 0").select(F.col("unit_id").alias("query_id"), F.col("embedding").alias("query_embedding"), F.col("scope").alias("query_scope"))


def rows_of(df):
    return sorted((r.query_id, r["rank"], r.unit_id, r.distance) for r in df.collect())


@pytest.mark.parametrize("block", [vector_index.BLOCK, 7])
def test_index_is_exact_with_all_lists_and_near_with_few(spark, monkeypatch, block):
    monkeypatch.setattr(vector_index, "BLOCK", block)
    v, q = vectors(spark)
    path = shared(spark)
    manifest = vector_index.build(v, path, 16, k=20)
    index = vector_index.open_index(spark, path)
    assert index.rows.count() == 1500 and manifest["lists"] == 39 and manifest["probes"] < 30
    exact = rows_of(retrieval.dense(v, q, 20, dimension=16))
    assert rows_of(vector_index.search(index, q, 20, exact=True)) == exact
    scoped = rows_of(retrieval.dense(v, q, 20, scoped=True, dimension=16))
    assert rows_of(vector_index.search(index, q, 20, scoped=True, exact=True)) == scoped
    found = {(r[0], r[2]) for r in rows_of(vector_index.search(index, q, 20))}
    assert len(found & {(r[0], r[2]) for r in exact}) >= 0.9 * len(exact)


def test_index_refuses_bad_vectors_and_changed_rows(spark):
    v, q = vectors(spark, 60)
    with pytest.raises(Exception, match="not valid"):
        vector_index.build(v.unionByName(spark.createDataFrame([(99, [0.0] * 16, 1)], v.schema)), shared(spark), 16)
    path = shared(spark)
    vector_index.build(v, path, 16, k=5)
    extra = spark.read.parquet(f"{path}/lists").limit(1).withColumn("unit_id", F.lit(777).cast("long"))
    extra.write.mode("append").partitionBy("list").parquet(f"{path}/lists")
    with pytest.raises(publishing.NotPublished, match="differ"):
        vector_index.open_index(spark, path)
    empty = shared(spark)
    vector_index.build(v.limit(0), empty, 16)
    assert vector_index.search(vector_index.open_index(spark, empty), q).count() == 0
