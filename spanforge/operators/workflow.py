"""Stages of a run: seeding, validation of outputs, memo, handoff, judging, and a runner with an injected provider."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import PurePosixPath
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.functions import text as T
from spanforge.sources.tables import shared, written

#: Schema of a stage's output (CP11); a field that is not in it is an error in strict reading.
OUTPUT = "content string, tool string, arguments map<string,string>, issues array<struct<severity:string,kind:string,location:string,quote:string>>, figures array<struct<kind:string,title:string,values:array<double>>>"
TOOLS = ("search_evidence", "open_source", "search_web", "fetch_source", "calculate")


def seed_questions(briefs: DataFrame) -> DataFrame:
    """Questions of each brief (CP9): ``q-`` and the digest's first twelve digits; the priority defaults to essential."""
    q = briefs.select("brief_id", F.explode(F.when(F.size("questions") > 0, F.col("questions")).otherwise(F.array(F.struct(F.col("brief").alias("question"), F.lit(None).cast("string").alias("priority"))))).alias("q"))
    return q.select("brief_id", F.concat(F.lit("q-"), F.substr(F.sha2("q.question", 256), F.lit(1), F.lit(12))).alias("question_id"), F.col("q.question").alias("question"), F.coalesce("q.priority", F.lit("essential")).alias("priority"), F.lit("unresolved").alias("state"))


def add_context(stored: DataFrame, new: DataFrame, blocks: DataFrame) -> DataFrame:
    """Navigation text, appended once per key (CP7): unknown blocks or other content under a stored key are errors.

    ``stored``, ``new``: source_id, cache_key, generated, block_ids; ``blocks``: source_id, block_id.
    """
    known = blocks.groupBy("source_id").agg(F.collect_set("block_id").alias("known"))
    n = new.join(known, "source_id", "left").join(stored.select("source_id", "cache_key", F.col("generated").alias("was")), ["source_id", "cache_key"], "left")
    unknown = F.size(F.array_except("block_ids", F.coalesce("known", F.expr("cast(array() as array<string>)")))) > 0
    # the errors are in the predicate, which every row has to pass
    fresh = (
        F.when(unknown, F.raise_error(F.lit("unknown block")).cast("boolean"))
        .when(F.col("was") != F.col("generated"), F.raise_error(F.lit("context of this key exists with other content")).cast("boolean"))
        .otherwise(F.col("was").isNull())
    )
    return stored.unionByName(n.where(fresh).select(*stored.columns))


def output_problems(raw: Column, tools: tuple[str, ...] = TOOLS) -> Column:
    """Rules that a stage's JSON output breaks (FI7); empty if it is sound."""
    o = F.from_json(raw, OUTPUT)
    false = F.lit(False)
    wild = F.exists(o["figures"], lambda f: F.exists(f["values"], lambda v: v.isNotNull() & (F.isnan(v) | (F.abs(v) == float("inf")))))
    rules = {
        "no valid JSON": o.isNull() | (o["content"].isNull() & o["tool"].isNull()),
        "tool not allowed": o["tool"].isNotNull() & ~o["tool"].isin(*tools),
        "empty content": o["tool"].isNull() & (F.trim(F.coalesce(o["content"], F.lit(""))) == ""),
        "unknown figure": F.exists(o["figures"], lambda f: ~F.coalesce(f["kind"].isin("bar", "diagram"), false)),
        "value not finite": wild,
        "issue without a field": F.exists(o["issues"], lambda i: F.coalesce(F.trim(i["severity"]) == "", F.lit(True)) | F.coalesce(F.trim(i["location"]) == "", F.lit(True))),
        "material issue without a quote": F.exists(o["issues"], lambda i: (i["severity"] == "material") & F.coalesce(F.trim(i["quote"]) == "", F.lit(True))),
    }
    return F.array_compact(F.array(*(F.when(F.coalesce(r, false), F.lit(name)) for name, r in rules.items())))


def manifest_mismatch(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files whose digest is not the bound one, or that one side lacks (SC15, CP12, AG16, JN16)."""
    f, m = files.select("path", F.col("digest").alias("found")), manifest.select("path", F.col("digest").alias("bound"))
    return f.join(m, "path", "full_outer").where(~F.col("found").eqNullSafe(F.col("bound")))


def pending(stages: DataFrame, results: DataFrame, keys: tuple[str, ...] = ("stage", "input_hash")) -> DataFrame:
    """Stages without a result for their input (UD16)."""
    return stages.join(results.select(*keys).distinct(), list(keys), "left_anti")


def diagnostics(attempts: DataFrame, key: str = "campaign", order: str = "seq") -> DataFrame:
    """Attempts in order A, B, C, each once and only after an adequate one (UD11): ``allowed``."""
    w = Window.partitionBy(key).orderBy(order)
    nth = F.row_number().over(w)
    before = F.lag("outcome").over(w)
    want = F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), F.least(nth, F.lit(3)))
    return attempts.withColumn("allowed", (nth <= 3) & (F.col("kind") == want) & ((nth == 1) | F.coalesce(before == "adequate", F.lit(False))))


def judge_batches(pairs: DataFrame, key: str, order: str, body: str, capacity: int, first: int = 4) -> DataFrame:
    """Blind batches (CP20): the first ``first`` pairs and the rest, each halved until its bytes fit or it is one pair; A and B by a hash.

    Sizes are summed up once. Halving then works on ranges of pairs, a few rows a campaign, in rounds that
    end when every range fits; a round is a table, so that no plan grows with their number. (``key``, ``order``) is unique.
    """
    put = lambda df: written(df, shared(pairs.sparkSession))
    part = F.when(F.row_number().over(Window.partitionBy(key).orderBy(order)) <= first, 0).otherwise(1)
    line = Window.partitionBy("k", "part").orderBy("o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # a struct equals a struct with the same null
    sized = pairs.select(F.struct(key).alias("k"), F.col(order).alias("o"), part.alias("part"), F.coalesce(F.octet_length(body), F.lit(0)).alias("n"))
    sized = put(sized.select("*", F.count("*").over(line).alias("pos"), F.sum("n").over(line).alias("upto")))
    at = sized.select("k", "part", "pos", "upto", "n")
    ranges, done = put(at.groupBy("k", "part").agg(F.min("pos").alias("a"), F.max("pos").alias("z"))), None
    while True:
        ends = ranges.join(at.select("k", "part", F.col("pos").alias("z"), F.col("upto").alias("last")), ["k", "part", "z"])
        ends = ends.join(at.select("k", "part", F.col("pos").alias("a"), (F.col("upto") - F.col("n")).alias("before")), ["k", "part", "a"])
        ends = put(ends.select("k", "part", "a", "z", ((F.col("z") > F.col("a")) & (F.col("last") - F.col("before") > capacity)).alias("split")))
        fits = ends.where("not split").select("k", "part", "a")
        done = fits if done is None else done.unionByName(fits)
        if ends.where("split").isEmpty():
            break
        middle = F.col("a") + F.floor((F.col("z") - F.col("a") + 1) / 2)
        halves = F.explode(F.array(F.struct(F.col("a").alias("a"), (middle - 1).alias("z")), F.struct(middle.alias("a"), F.col("z").alias("z"))))
        ranges = put(ends.where("split").select("k", "part", halves.alias("h")).select("k", "part", "h.*"))
    starts = done.select("k", "part", F.col("a").alias("pos"), F.lit(1).alias("start"))
    batch = (F.sum(F.coalesce("start", F.lit(0))).over(line) - 1).alias("batch")
    numbered = sized.join(starts, ["k", "part", "pos"], "left").select("k", "o", "part", batch)
    found = pairs.withColumns({"k": F.struct(key), "o": F.col(order)}).join(numbered, ["k", "o"]).drop("k", "o")
    return found.withColumn("swapped", F.pmod(F.crc32(F.concat_ws(":", F.col(key).cast("string"), F.col(order).cast("string")).cast("binary")), F.lit(2)) == 1)


def contained(root: str, name: str) -> str:
    """A path under a root; one that leaves it is an error (PR25)."""
    parts: list[str] = []
    for p in PurePosixPath(name).parts:
        if p == "..":
            if not parts:
                raise ValueError("path leaves its root")
            parts.pop()
        elif p != ".":
            parts.append(p)
    if PurePosixPath(name).is_absolute():
        raise ValueError("path leaves its root")
    return str(PurePosixPath(root, *parts))


def choose_model(settings: dict[str, str], role: str, exhausted: frozenset[str] = frozenset(), fallback: str | None = None) -> str:
    """Model of a role, or the fallback once its quota is used up (CP16)."""
    model = settings.get(role) or settings["default"]
    if model in exhausted:
        if fallback is None:
            raise ValueError("quota exhausted and no fallback")
        return fallback
    return model


@dataclass(frozen=True)
class Request:
    stage: str
    role: str
    payload: str


@dataclass(frozen=True)
class Result:
    text: str
    seconds: float = 0.0
    tokens: int | None = None


class Provider(Protocol):
    """A model behind an interface (UF6)."""

    def run(self, request: Request) -> Result: ...


class Canned:
    """A provider with fixed outputs by stage, in order (SC14)."""

    def __init__(self, outputs: dict[str, list[dict]]) -> None:
        self.outputs = {k: list(v) for k, v in outputs.items()}

    def run(self, request: Request) -> Result:
        return Result(json.dumps(self.outputs[request.stage].pop(0)))


@dataclass
class Runner:
    """A stage in turns (UD17): the provider asks for tools until it gives content; equal inputs are answered from the memo."""

    provider: Provider
    tools: dict[str, Callable[[dict], object]]
    max_turns: int = 8
    max_bytes: int = 200_000
    memo: dict[str, str] = field(default_factory=dict)
    trace: list[dict] = field(default_factory=list)

    def run(self, stage: str, role: str, evidence: list[dict]) -> str:
        key = hashlib.sha256(json.dumps([stage, role, evidence], sort_keys=True, ensure_ascii=False).encode()).hexdigest()
        if key in self.memo:
            return self.memo[key]
        held = list(evidence)
        for turn in range(self.max_turns):
            payload = json.dumps(held, ensure_ascii=False)
            if len(payload.encode()) > self.max_bytes:
                raise ValueError("request exceeds its budget")
            out = json.loads(self.provider.run(Request(stage, role, payload)).text)
            name = out.get("tool")
            if not name:
                if not (out.get("content") or "").strip():
                    raise ValueError("empty content")
                self.memo[key] = out["content"]
                return out["content"]
            if name not in self.tools:
                raise ValueError(f"tool {name} is not allowed")
            result = self.tools[name](out.get("arguments") or {})
            self.trace.append({"stage": stage, "turn": turn, "tool": name, "arguments": out.get("arguments")})
            held.append({"tool": name, "result": result})
        raise ValueError("no content within the turns")


def workflow(runner: Runner, brief: str, research: int = 1) -> dict[str, str]:
    """plan, research, synthesis, review, revision where the review asks for it, recheck (UD18)."""
    out = {"plan": runner.run("plan", "planner", [{"brief": brief}])}
    for i in range(research):
        out[f"research-{i}"] = runner.run(f"research-{i}", "researcher", [{"plan": out["plan"]}])
    notes = [{"notes": out[f"research-{i}"]} for i in range(research)]
    out["synthesis"] = runner.run("synthesis", "writer", notes)
    out["review"] = runner.run("review", "reviewer", [{"report": out["synthesis"]}])
    if out["review"].strip() != "ready":
        out["revision"] = runner.run("revision", "writer", [{"report": out["synthesis"], "review": out["review"]}])
        out["recheck"] = runner.run("recheck", "reviewer", [{"report": out["revision"]}])
    return out


def recovered(stage_files: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Stages whose stored result still has the digest of its checkpoint (UD15)."""
    return stage_files.join(checkpoints.select("stage", F.col("digest").alias("bound")), "stage").where(T.digest("result") == F.col("bound")).drop("bound")
