"""Each way that a supervised search can end, and that its jobs end with it."""

import threading
import time

from pyspark.sql import functions as F

from spanforge.operators import retrieval
from spanforge.plans import supervised as S


def slow(spark):
    def sleep(batches):
        for b in batches:
            time.sleep(30)
            yield b

    return lambda: spark.range(4, numPartitions=4).mapInArrow(sleep, "id long")


def running(spark):
    tracker = spark.sparkContext.statusTracker()
    return sum(len(tracker.getJobInfo(j).stageIds) > 0 and tracker.getJobInfo(j).status == "RUNNING" for j in tracker.getJobIdsForGroup(None))


def test_ready_late_cancelled_and_failed(spark):
    ready = S.supervised(spark, lambda: spark.range(5), 60)
    assert ready.status == "ready" and ready.rows.count() == 5
    late = S.supervised(spark, slow(spark), 2)
    assert late.status == "reranker_deadline" and late.rows is None and late.seconds < 20
    stop = threading.Event()
    threading.Timer(2, stop.set).start()
    assert S.supervised(spark, slow(spark), 60, stop).status == "reranker_cancelled"
    assert S.supervised(spark, lambda: spark.range(1), 60, stop).status == "reranker_cancelled"
    assert running(spark) == 0
    broken = S.supervised(spark, lambda: spark.range(1).select(F.raise_error(F.lit("no such index"))), 60)
    assert broken.status == "dense_retrieval_failed" and "no such index" in broken.detail
    assert S.supervised(spark, lambda: 1 / 0, 60).detail == "division by zero"


def test_statuses_are_rows(spark):
    passages = spark.createDataFrame([(1, 0, "c0", 0, 11, "river stone"), (2, 0, "c0", 0, 5, "light")], "source_id long, chunk_no int, chunk_id string, start_at int, end_at int, chunk_text string")
    queries = spark.createDataFrame([(1, "river"), (2, "nothing here")], "query_id long, query string")
    told = lambda rows: sorted((r.query_id, r.retrieval_status, r.n_blocks) for r in rows.collect())
    assert told(S.search(passages, queries, 60, score=retrieval.overlap_score)[1]) == [(1, "ready", 1), (2, "ready", 0)]
    assert told(S.search(passages, queries, 60)[1]) == [(1, "reranker_unavailable", 0), (2, "reranker_unavailable", 0)]
    manifest = spark.createDataFrame([("a", "x"), ("b", "2c26b46b68ffc68ff99b453c1d30413413422d706483bfa0f98a5e886266e7ae")], "path string, sha256 string")
    files = spark.createDataFrame([("b", bytearray(b"foo")), ("c", bytearray(b""))], "path string, content binary")
    changed = S.changed_files(files, manifest)
    assert [r.path for r in changed.collect()] == ["a"]
    assert told(S.search(passages, queries, 60, snapshot=changed, score=retrieval.overlap_score)[1])[0][1] == "reranker_snapshot_mismatch"
