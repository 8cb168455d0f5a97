"""Searches under supervision (CP4): a deadline, cancellation, and a status for each query as a row.

The search runs in a thread whose jobs carry a tag, and is written to a folder of its own. When its time is
up, or the caller cancels, the jobs of the tag are ended on the cluster; what was written of it is not
read. A failure of a branch is a status with the reason, never a thinner result: an index that does not
match, or a provider that fails, does not fall back to words alone.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.plans import search as api
from spanforge.sources.tables import shared

#: How a supervised search can end.
READY, DEADLINE, CANCELLED, UNAVAILABLE, MISMATCH, FAILED = "ready", "reranker_deadline", "reranker_cancelled", "reranker_unavailable", "reranker_snapshot_mismatch", "dense_retrieval_failed"
#: Seconds between looks at the clock.
POLL = 0.05


@dataclass
class Outcome:
    status: str
    detail: str = ""
    rows: DataFrame | None = None
    seconds: float = 0.0


def supervised(spark: SparkSession, work: Callable[[], DataFrame], seconds: float, cancelled: threading.Event | None = None) -> Outcome:
    """Runs ``work`` and writes its rows, within ``seconds`` and until ``cancelled`` is set."""
    context, began = spark.sparkContext, time.monotonic()
    tag, path, failed = f"search-{uuid.uuid4().hex}", shared(spark), []
    over = lambda: CANCELLED if cancelled is not None and cancelled.is_set() else DEADLINE if time.monotonic() - began >= seconds else None
    if ended := over():
        return Outcome(ended)

    def run() -> None:
        context.addJobTag(tag)
        try:
            work().write.parquet(path)
        except Exception as e:  # noqa: BLE001  told to the caller as a status
            failed.append(e)
        finally:
            context.removeJobTag(tag)

    thread = InheritableThread(target=run, daemon=True)
    thread.start()
    ended = None
    while thread.is_alive() and not ended:
        thread.join(POLL)
        ended = over() if thread.is_alive() else None
    while thread.is_alive():  # a plan that is still being made starts its jobs later
        context.cancelJobsWithTag(tag)
        thread.join(POLL)
    taken = time.monotonic() - began
    if ended:
        return Outcome(ended, seconds=taken)
    if failed:
        return Outcome(FAILED, str(failed[0]).strip().splitlines()[0][:200], seconds=taken)
    return Outcome(READY, rows=spark.read.parquet(path), seconds=taken)


def changed_files(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files of a snapshot that are missing, or have other bytes than its manifest says (CP12).

    ``files``: ``path``, ``content``; ``manifest``: ``path``, ``sha256``. Files beside the manifest do not count.
    """
    there = files.select("path", F.sha2("content", 256).alias("found"))
    return manifest.join(there, "path", "left").where(~F.col("sha256").eqNullSafe(F.col("found"))).select("path")


def search(passages: DataFrame, queries: DataFrame, seconds: float, cancelled: threading.Event | None = None, snapshot: DataFrame | None = None, **options) -> tuple[Outcome, DataFrame]:  # noqa: ANN003
    """``search`` of the API under supervision, and a status row for every query.

    ``snapshot``: changed files of the scorer; any is a refusal. The rows: ``query_id``, ``retrieval_status``, ``detail``, ``n_blocks``.
    """
    spark = passages.sparkSession
    if snapshot is not None and not snapshot.isEmpty():
        found = Outcome(MISMATCH)
    elif options.get("score") is None:
        found = Outcome(UNAVAILABLE)
    else:
        # candidates and scores are written once, and what follows reads them
        traced = {"trace": shared(spark)} | options
        found = supervised(spark, lambda: api.search(passages, queries, **traced), seconds, cancelled)
    status, detail = F.lit(found.status).alias("retrieval_status"), F.lit(found.detail).alias("detail")
    if found.rows is None:
        return found, queries.select("query_id", status, detail, F.lit(0).cast("bigint").alias("n_blocks"))
    counts = found.rows.groupBy("query_id").agg(F.count("*").alias("n"))
    rows = queries.join(counts, "query_id", "left")
    return found, rows.select("query_id", status, detail, F.coalesce("n", F.lit(0)).alias("n_blocks"))
