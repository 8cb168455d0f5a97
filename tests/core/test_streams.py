"""Ledger and coverage as streams: rules, deadlines, crashes, restarts, and order of arrival."""

import random

import pytest
from pyspark.sql import functions as F

from spanforge.operators.coverage_state import Coverage, Question
from spanforge.sources.tables import shared
from spanforge.streaming import budget, coverage
from spanforge.streaming.budget import Account, Limits

SCHEMA = "campaign long, seq long, ts timestamp, action string, name string, attempt string, seconds double"


def told(account, *events):
    out = []
    for at, action, name, attempt, seconds in events:
        account.expired(at)
        found = account.apply(at, action, name, attempt, seconds)
        out.append(found["reason"] or found["decision"])
    return out


def test_rules_of_a_ledger():
    a = Account(Limits(attempts=2, calls=3, workers=1, session_seconds=1000, attempt_seconds=500, watchdog_seconds=90, invocation_seconds=200))
    assert told(
        a, (0, "reserve", "c0", "a", 5), (1, "admit", "a", None, None), (2, "admit", "a", None, None), (3, "start", "", None, None), (3, "reserve", "c1", "b", 5), (4, "reserve", "c1", "a", 950),
        (5, "reserve", "c2", "a", 5), (6, "settle", "c1", None, 30), (7, "settle", "c1", None, 30), (8, "settle", "c9", None, 1), (9, "reserve", "c1", "a", 5),
    ) == ["not started", "admitted", "attempt exists", "started already", "attempt is not active", "admitted", "call in flight", "settled", "settled already", "unknown call", "call exists"]
    assert a.charged == 30 and a.calls.get("c1") == (90, "settled")  # asked for 950, capped by the watchdog
    # a call that is never settled ends at its deadline and stays charged
    assert told(a, (10, "reserve", "c2", "a", 60), (71, "reserve", "c3", "a", 500)) == ["admitted", "admitted"]
    assert a.calls.get("c2") == (60, "lost") and a.charged == 30 + 60 + 90
    assert told(a, (72, "settle", "c2", None, 1), (73, "settle", "c3", None, 10), (74, "reserve", "c4", "a", 5)) == ["call was ended", "settled", "calls exhausted"]
    assert told(a, (75, "finish", "a", None, None), (76, "finish", "a", None, None), (77, "finish", "z", None, None), (78, "admit", "b", None, None), (79, "admit", "d", None, None)) == ["finished", "finished already", "unknown attempt", "admitted", "attempts exhausted"]
    assert told(a, (1001, "admit", "e", None, None), (1002, "fly", "", None, None)) == ["session exhausted", "unknown action"]


@pytest.mark.parametrize("given, wanted", [((50, 1000, 500, 90, 200), "requested_allowance"), ((950, 40, 500, 90, 200), "campaign_elapsed"), ((950, 1000, 30, 90, 200), "attempt_elapsed"), ((950, 1000, 500, 90, 200), "invocation_watchdog"), ((950, 1000, 500, 90, 20), "aggregate_invocation")])
def test_the_least_limit_is_named(given, wanted):
    asked, session, attempt, watchdog, every = given
    a = Account(Limits(session_seconds=session, attempt_seconds=attempt, watchdog_seconds=watchdog, invocation_seconds=every))
    a.apply(0, "admit", "a", None, None)
    found = a.apply(0, "reserve", "c", "a", asked)
    assert (found["resource"], found["granted"]) == (wanted, min(given))


def log(spark, n=400, campaigns=7, seed=2):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        action = rng.choice(["admit", "reserve", "reserve", "settle", "settle", "finish"])
        name = f"{'a' if action in ('admit', 'finish') else 'c'}{rng.randint(0, i // 60)}"
        # one campaign holds a third of the log
        rows.append((0 if i % 3 == 0 else rng.randrange(1, campaigns), i, 1_700_000_000 + 30 * i, action, name, f"a{rng.randint(0, i // 60)}", float(rng.randint(1, 400))))
    df = spark.createDataFrame(rows, "campaign long, seq long, s long, action string, name string, attempt string, seconds double")
    return df.select("campaign", "seq", F.timestamp_seconds("s").alias("ts"), "action", "name", "attempt", "seconds")


LIMITS = Limits(attempts=5, calls=30, workers=2, session_seconds=10_000, attempt_seconds=4_000, watchdog_seconds=300, invocation_seconds=3_000)


def stream(spark, path):
    return budget.decided(budget.stateful(spark).readStream.schema(SCHEMA).parquet(path), LIMITS)


def rows_of(df):
    return sorted((r.campaign, r.seq, r.decision, r.reason or "", r.granted or 0.0, r.resource or "", r.charged) for r in df.where("seq is not null").collect())


def in_order(events):
    out = []
    rows = events.withColumn("at", F.unix_micros("ts") / F.lit(1e6)).collect()
    for campaign in {r.campaign for r in rows}:
        out += [r for r in budget.decisions(Account(LIMITS), campaign, [r for r in rows if r.campaign == campaign]) if r.seq is not None]
    return sorted((r.campaign, r.seq, r.decision, r.reason or "", r.granted or 0.0, r.resource or "", r.charged) for r in out)


def test_stream_restarts_and_equals_the_walk(spark):
    events, folder = log(spark), shared(spark)
    for low, high in ((0, 120), (120, 121), (121, 400)):
        # rows of a micro-batch come in any order
        events.where((F.col("seq") >= low) & (F.col("seq") < high)).orderBy(F.desc("seq")).coalesce(1).write.mode("append").parquet(f"{folder}/log")
        found = budget.run(stream(spark, f"{folder}/log"), folder)
    assert rows_of(found) == in_order(events)
    assert budget.run(stream(spark, f"{folder}/log"), folder).where("seq is not null").count() == 400  # nothing new, nothing twice


def test_a_deadline_ends_the_call_of_a_silent_campaign(spark):
    folder = shared(spark)
    at = lambda s: F.timestamp_seconds(F.lit(1_700_000_000 + s))
    row = lambda campaign, seq, s, action, name: spark.range(1).select(F.lit(campaign).cast("long").alias("campaign"), F.lit(seq).cast("long").alias("seq"), at(s).alias("ts"), F.lit(action).alias("action"), F.lit(name).alias("name"), F.lit("a").alias("attempt"), F.lit(100.0).alias("seconds"))
    row(1, 1, 0, "admit", "a").unionByName(row(1, 2, 1, "reserve", "c")).coalesce(1).write.mode("append").parquet(f"{folder}/log")
    budget.run(stream(spark, f"{folder}/log"), folder)
    # another campaign's events move the clock: the silent one's call ends by its timer, charged as reserved
    for s in (9_000, 20_000):
        row(2, 3 + s, s, "admit", "a").write.mode("append").parquet(f"{folder}/log")
        found = budget.run(stream(spark, f"{folder}/log"), folder)
    ended = found.where("action = 'expire'").collect()
    assert [(r.campaign, r.name, r.at, r.charged) for r in ended] == [(1, "c", 1_700_000_101.0, 100.0)]
    row(1, 9, 20_001, "settle", "c").write.mode("append").parquet(f"{folder}/log")
    last = budget.run(stream(spark, f"{folder}/log"), folder).where("seq = 9").first()
    assert (last.decision, last.reason, last.charged) == ("error", "call was ended", 100.0)


def test_coverage_restarts_and_refuses_whole_lists(spark):
    folder = shared(spark)
    up = lambda seq, q, state, ids: (seq, q, None, None, state, ids, None, None)
    first = [(1, -2, "question", "q", None, None, None), (1, -1, "bundle", "b", "q", "adequate", None), (1, -1, "bundle", "c", "q", "unassessed", None), (1, 0, "updates", None, None, None, [up(0, "q", "partial", ["b"])])]
    second = [(1, 1, "updates", None, None, None, [up(1, "q", "supported", ["b", "c"]), up(2, "z", "partial", [])]), (1, 2, "updates", None, None, None, [up(4, "q", "unresolved", []), up(3, "q", "conflicting", ["b", "c"])]), (2, 0, "question", "x", None, None, None)]
    for rows in (first, second):
        spark.createDataFrame(rows, coverage.EVENT).write.mode("append").parquet(f"{folder}/log")
        found = coverage.run(budget.stateful(spark).readStream.schema(coverage.EVENT).parquet(f"{folder}/log"), folder)
    walk = Coverage({"q": Question()}, {"b": ("q", "adequate"), "c": ("q", "unassessed")})
    assert not walk.apply([{"question_id": "q", "state": "partial", "bundle_ids": ["b"]}])
    got = {(r.stage_id, r.question_id): (r.state, r.n_bundles, r.n_refused) for r in found.collect()}
    assert got == {(1, "q"): ("unresolved", 2, 1), (2, "x"): ("unresolved", 0, 0)}


def test_stages_are_walked_as_rows_across_batches(spark):
    """Groups of pandas frames took the time of a frame for each batch of updates; rows in order take that of their rows."""
    from spanforge.operators import coverage_state

    rng = random.Random(4)
    updates = [(s, b, b * 10 + k, f"q{rng.randint(0, 3)}", "partial", [f"b{rng.randint(0, 3)}"]) for s in (1, 2, 7) for b in range(9) for k in range(2)]
    facts = [(s, f"b{k}", f"q{k}", "adequate") for s in (1, 2, 7, 9) for k in range(3)]
    tables = (
        spark.createDataFrame(updates, "stage_id long, batch_no long, seq long, question_id string, state string, bundle_ids array<string>"),
        spark.createDataFrame(facts, "stage_id long, bundle_id string, question_id string, adequacy string"),
        spark.createDataFrame([(s, q) for s, _, q, _ in facts], "stage_id long, question_id string"),
    )
    want = []
    for s in (1, 2, 7, 9):
        state, refused = Coverage({f"q{k}": Question() for k in range(3)}, {b: (q, a) for t, b, q, a in facts if t == s}), 0
        for b in range(9) if s != 9 else ():
            refused += bool(state.apply([{"question_id": q, "state": x, "bundle_ids": i} for t, n, _, q, x, i in updates if (t, n) == (s, b)]))
        want += [(s, q, x.state, len(x.bundles), refused) for q, x in state.questions.items()]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        found = coverage_state.coverage_states(*tables)
        assert sorted(map(tuple, found.collect())) == sorted(want)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "CoGroups" not in found._jdf.queryExecution().toString()


class OneValue:
    """A handle whose state counts the calls that go to its server."""

    def __init__(self):
        self.value, self.calls = None, 0

    def getValueState(self, name, schema):  # noqa: N802
        return self

    def registerTimer(self, at):  # noqa: N802
        pass

    def exists(self):
        self.calls += 1
        return self.value is not None

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value


def test_a_micro_batch_of_a_campaign_takes_three_calls_to_the_state():
    """Each name of an attempt or a call took two or three."""
    handle, ledger = OneValue(), budget.Ledger(Limits(attempts=50, calls=50))
    ledger.init(handle)
    acts = [x for k in range(20) for x in (("admit", f"a{k}"), ("reserve", f"c{k}"), ("settle", f"c{k}"))]
    rows = [{"seq": i, "at": float(i), "action": a, "name": n, "attempt": f"a{i // 3}", "seconds": 2.0} for i, (a, n) in enumerate(acts)]
    got = [r for part in (rows[:31], rows[31:]) for r in ledger.handleInputRows((1,), part, None)]
    assert handle.calls <= 6
    assert [(r.seq, r.decision) for r in got] == [(i, {"admit": "admitted", "reserve": "admitted", "settle": "settled"}[a]) for i, (a, _) in enumerate(acts)]


def test_a_micro_batch_of_a_stage_takes_three_calls_to_the_state():
    """Each question and bundle took one, and both were listed."""
    handle, stage = OneValue(), coverage.Stage()
    stage.init(handle)
    first = [{"seq": -2, "kind": "question", "name": f"q{k}"} for k in range(9)] + [{"seq": -1, "kind": "bundle", "name": f"b{k}", "question_id": f"q{k}", "adequacy": "adequate"} for k in range(9)]
    update = lambda k: {"seq": k, "kind": "updates", "updates": [{"seq": k, "question_id": f"q{k}", "state": "partial", "bundle_ids": [f"b{k}"]}]}
    list(stage.handleInputRows((1,), first + [update(0)], None))
    got = list(stage.handleInputRows((1,), [update(1), update(9)], None))
    assert handle.calls <= 6
    assert [(r.question_id, r.state, r.n_refused) for r in got][:3] == [("q0", "partial", 1), ("q1", "partial", 1), ("q2", "unresolved", 1)]
