"""Coverage of questions as a state machine over ordered updates."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATES = ("unresolved", "partial", "supported", "conflicting")


@dataclass(frozen=True)
class Question:
    state: str = "unresolved"
    exploration: str = "active"
    bundles: tuple[str, ...] = ()
    next_gap: str = ""


def named(update: dict) -> list[str]:
    ids = update.get("bundle_ids")
    return [] if ids is None else list(ids)


@dataclass
class Coverage:
    """State of one stage. ``bundles``: id to (question id, adequacy)."""

    questions: dict[str, Question]
    bundles: dict[str, tuple[str, str]] = field(default_factory=dict)

    def problems(self, u: dict) -> list[str]:
        """Rules that an update breaks (FI8)."""
        q, ids = u["question_id"], named(u)
        out = []
        if q not in self.questions and not (u.get("parent_id") in self.questions and u.get("question")):
            out.append("unknown question")
        if u["state"] not in STATES:
            out.append("unknown state")
        if unknown := [b for b in ids if b not in self.bundles]:
            out.append(f"unknown bundles {unknown}")
        elif any(self.bundles[b][0] != q for b in ids):
            out.append("bundle of another question")
        if u["state"] == "conflicting" and len(set(ids)) < 2:
            out.append("a conflict needs two bundles")
        if u["state"] == "supported" and not any(self.bundles.get(b, ("", ""))[1] == "adequate" for b in ids):
            out.append("support needs an adequate bundle")
        if (u.get("exploration") or "active") not in ("active", "exhausted"):
            out.append("unknown exploration")
        return out

    def apply(self, updates: list[dict]) -> list[str]:
        """All updates of a batch, or none: the problems of a refused batch (UD7)."""
        found = [p for u in updates for p in self.problems(u)]
        if found:
            return found
        for u in updates:
            old = self.questions.get(u["question_id"], Question())
            self.questions[u["question_id"]] = replace(old, state=u["state"], exploration=u.get("exploration") or old.exploration, bundles=tuple(sorted({*old.bundles, *named(u)})), next_gap=u.get("next_gap") or "")
        return []


OUT = ("stage_id", "question_id", "state", "n_bundles", "n_refused")
QUESTION, BUNDLE, UPDATE = range(3)


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Final states from the facts and updates of stages, in order; held are one stage and one batch of its updates."""
    schema = pa.schema([("stage_id", pa.int64()), ("question_id", pa.string()), ("state", pa.string()), ("n_bundles", pa.int32()), ("n_refused", pa.int32())])
    stage, of, waiting, state, refused, done = None, None, [], None, 0, []

    def end() -> None:
        if state is not None:
            late = refused + bool(state.apply(waiting))
            done.extend((stage, q, s.state, len(s.bundles), late) for q, s in sorted(state.questions.items()))

    for batch in batches:
        for r in batch.to_pylist():
            if state is None or r["stage_id"] != stage:
                end()
                stage, of, waiting, state, refused = r["stage_id"], None, [], Coverage({}), 0
            if r["fact"] == QUESTION:
                state.questions[r["question_id"]] = Question()
            elif r["fact"] == BUNDLE:
                state.bundles[r["bundle_id"]] = (r["question_id"], r["adequacy"])
            else:
                if r["batch_no"] != of:
                    refused += bool(state.apply(waiting))
                    of, waiting = r["batch_no"], []
                waiting.append(r)
        if done:
            yield pa.RecordBatch.from_pylist([dict(zip(OUT, d)) for d in done], schema=schema)
            done.clear()
    end()
    if done:
        yield pa.RecordBatch.from_pylist([dict(zip(OUT, d)) for d in done], schema=schema)


def coverage_states(updates: DataFrame, bundles: DataFrame, questions: DataFrame) -> DataFrame:
    """Final state of each question of each stage.

    ``updates``: stage_id, batch_no, seq, question_id, state, bundle_ids; ``bundles``: stage_id, bundle_id,
    question_id, adequacy; ``questions``: stage_id, question_id. The three meet by stage, as rows in order
    that a task walks through; a stage is one model run and so bounded by nature.
    """
    facts = questions.select("stage_id", "question_id", F.lit(QUESTION).alias("fact"))
    facts = facts.unionByName(bundles.select("stage_id", "bundle_id", "question_id", "adequacy", F.lit(BUNDLE).alias("fact")), allowMissingColumns=True)
    every = facts.unionByName(updates.where("batch_no is not null").withColumn("fact", F.lit(UPDATE)), allowMissingColumns=True)
    rows = every.repartition("stage_id").sortWithinPartitions("stage_id", "fact", "batch_no", "seq")
    return rows.mapInArrow(_walked, "stage_id bigint, question_id string, state string, n_bundles int, n_refused int")
