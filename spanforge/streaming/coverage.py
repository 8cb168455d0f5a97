"""Coverage of questions as a stream: each batch of updates is accepted or refused whole, in keyed state.

An event of a stage names a question, a bundle, or a list of updates that stand or fall together (UD7,
FI8). The stage's questions, its bundles and the number of refused lists are one typed value in RocksDB; a
query that stops goes on from its checkpoint with the state that it had. A stage is one model run, so its
questions and bundles are few; stages are spread over the tasks by key.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from spanforge.operators.coverage_state import Coverage, Question

UPDATE = "struct<seq:bigint,question_id:string,parent_id:string,question:string,state:string,bundle_ids:array<string>,exploration:string,next_gap:string>"
#: ``kind``: question, bundle or updates; ``name``: id of the question or bundle; ``question_id`` and ``adequacy`` of a bundle.
EVENT = f"stage_id bigint, seq bigint, kind string, name string, question_id string, adequacy string, updates array<{UPDATE}>"
#: One value for each stage: an entry for each question and bundle was a round trip to the state's server for each of them.
STATE = "refused int, version bigint, questions array<struct<id:string,state:string,exploration:string,bundles:array<string>,next_gap:string>>, bundles array<struct<id:string,question_id:string,adequacy:string>>"
OUT = "stage_id bigint, version bigint, question_id string, state string, n_bundles int, n_refused int"


class Stage(StatefulProcessor):
    """Keyed state of ``Coverage``."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("stage", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        refused, version, questions, bundles = self.state.get() if self.state.exists() else (0, 0, [], [])
        coverage = Coverage({q[0]: Question(q[1], q[2], tuple(q[3]), q[4]) for q in questions}, {b[0]: (b[1], b[2]) for b in bundles})
        for e in sorted(rows, key=lambda e: e["seq"]):
            if e["kind"] == "question":
                coverage.questions.setdefault(e["name"], Question())
            elif e["kind"] == "bundle":
                coverage.bundles[e["name"]] = (e["question_id"], e["adequacy"])
            else:
                refused += bool(coverage.apply([dict(u) for u in sorted(e["updates"], key=lambda u: u["seq"])]))
        kept = [(name, q.state, q.exploration, list(q.bundles), q.next_gap) for name, q in sorted(coverage.questions.items())]
        self.state.update((refused, version + 1, kept, [(name, *b) for name, b in sorted(coverage.bundles.items())]))
        for name, q in sorted(coverage.questions.items()):
            yield Row(stage_id=key[0], version=version + 1, question_id=name, state=q.state, n_bundles=len(q.bundles), n_refused=refused)

    def close(self) -> None:
        pass


def covered(events: DataFrame) -> DataFrame:
    """The stream of states, of all questions of a stage whenever an event comes in for it."""
    return events.groupBy("stage_id").transformWithState(Stage(), OUT, "Update", "None")


def run(events: DataFrame, folder: str) -> DataFrame:
    """Takes up what is available since the last run in ``folder``; the states after it."""

    def put(df: DataFrame, i: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/out/batch={i}")

    writer = covered(events).writeStream.trigger(availableNow=True).outputMode("update").option("checkpointLocation", f"{folder}/checkpoint")
    writer.foreachBatch(put).start().awaitTermination()
    rows = events.sparkSession.read.schema(OUT).parquet(f"{folder}/out")
    last = F.max_by(F.struct("state", "n_bundles", "n_refused"), "version").alias("s")
    return rows.groupBy("stage_id", "question_id").agg(last).select("stage_id", "question_id", "s.*")
