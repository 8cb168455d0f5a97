"""Queries over the event log as a stream with keyed state, each with the SQL of the same rows in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.plans.catalogue import query
from spanforge.plans.catalogue_more import COVERED, coverage_inputs
from spanforge.sources.tables import shared
from spanforge.streaming import budget, coverage, replay

DAY = 86_400
LIMITS = budget.Limits(attempts=4, calls=20, session_seconds=20 * DAY, attempt_seconds=3 * DAY, watchdog_seconds=40_000.0, invocation_seconds=400_000.0)


def ledger_events(log: DataFrame) -> DataFrame:
    """The event log as events of a ledger: a campaign for each user, attempts of some days, calls of some hours."""
    kind, number = F.col("event_type"), F.col("event_id").cast("bigint")
    action = F.when(kind == "signup", "admit").when(kind.isin("view", "purchase"), "reserve").when(kind == "click", "settle").otherwise("finish")
    part = lambda head, size: F.concat(F.lit(head), F.floor(number / size).cast("string"))
    name = F.when(kind.isin("signup", "error"), part("a", 2000)).otherwise(part("c", 250))
    seconds = F.when(kind == "click", F.col("value") * 300).otherwise(F.col("value") * 600)
    return log.select(F.col("user_id").alias("campaign"), number.alias("seq"), "ts", action.alias("action"), name.alias("name"), part("a", 2000).alias("attempt"), seconds.alias("seconds"))


LEDGER = f"""
WITH RECURSIVE e AS (
  SELECT user_id AS campaign, event_id AS seq, epoch_us(ts) / 1e6 AS moment, 'a' || (event_id // 2000) AS attempt,
    CASE event_type WHEN 'signup' THEN 'admit' WHEN 'view' THEN 'reserve' WHEN 'purchase' THEN 'reserve' WHEN 'click' THEN 'settle' ELSE 'finish' END AS action,
    CASE WHEN event_type IN ('signup', 'error') THEN 'a' || (event_id // 2000) ELSE 'c' || (event_id // 250) END AS name,
    value * CASE event_type WHEN 'click' THEN 300 ELSE 600 END AS seconds,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n
  FROM events),
s(campaign, n, started, charged, calls, tries, t_names, t_ends, t_done, c_names, c_done, c_lost, r_name, r_end, r_size,
  seq, moment, action, name, decision, reason, granted, resource) AS (
  SELECT DISTINCT campaign, 0::BIGINT, NULL::DOUBLE, 0::DOUBLE, 0, 0, []::VARCHAR[], []::DOUBLE[], []::VARCHAR[], []::VARCHAR[], []::VARCHAR[], []::VARCHAR[],
    NULL::VARCHAR, NULL::DOUBLE, NULL::DOUBLE, NULL::BIGINT, NULL::DOUBLE, NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR, NULL::DOUBLE, NULL::VARCHAR
  FROM e
  UNION ALL
  SELECT campaign, n, started, charged + CASE WHEN decision = 'admitted' AND action = 'reserve' THEN granted WHEN decision = 'settled' THEN seconds - r_size ELSE 0 END,
    calls + (decision = 'admitted' AND action = 'reserve')::INT, tries + (decision = 'admitted' AND action = 'admit')::INT,
    CASE WHEN decision = 'admitted' AND action = 'admit' THEN list_append(t_names, name) ELSE t_names END,
    CASE WHEN decision = 'admitted' AND action = 'admit' THEN list_append(t_ends, moment + granted) ELSE t_ends END,
    CASE WHEN decision = 'finished' THEN list_append(t_done, name) ELSE t_done END,
    CASE WHEN decision = 'admitted' AND action = 'reserve' THEN list_append(c_names, name) ELSE c_names END,
    CASE WHEN decision = 'settled' THEN list_append(c_done, name) ELSE c_done END, c_lost,
    CASE WHEN decision = 'admitted' AND action = 'reserve' THEN name WHEN decision = 'settled' THEN NULL ELSE r_name END,
    CASE WHEN decision = 'admitted' AND action = 'reserve' THEN moment + granted WHEN decision = 'settled' THEN NULL ELSE r_end END,
    CASE WHEN decision = 'admitted' AND action = 'reserve' THEN granted WHEN decision = 'settled' THEN NULL ELSE r_size END,
    seq, moment, action, name, decision, reason,
    CASE WHEN decision = 'admitted' THEN granted WHEN decision = 'settled' THEN seconds END,
    CASE WHEN action = 'reserve' AND (decision = 'admitted' OR reason = 'time exhausted') THEN resource END
  FROM (SELECT *, CASE WHEN reason IS NOT NULL THEN CASE WHEN action IN ('settle', 'finish') THEN 'error' ELSE 'refused' END
      WHEN action = 'settle' THEN 'settled' WHEN action = 'finish' THEN 'finished' ELSE 'admitted' END AS decision
    FROM (SELECT *, CASE action
        WHEN 'admit' THEN CASE WHEN left_s <= 0 THEN 'session exhausted' WHEN tries >= {LIMITS.attempts} THEN 'attempts exhausted' WHEN place > 0 THEN 'attempt exists' END
        WHEN 'reserve' THEN CASE WHEN started IS NULL THEN 'not started' WHEN left_s <= 0 THEN 'session exhausted' WHEN place = 0 OR list_contains(t_done, attempt) THEN 'attempt is not active'
          WHEN calls >= {LIMITS.calls} THEN 'calls exhausted' WHEN r_name IS NOT NULL THEN 'call in flight' WHEN list_contains(c_names, name) THEN 'call exists'
          WHEN granted <= 0 THEN 'time exhausted' END
        WHEN 'settle' THEN CASE WHEN NOT list_contains(c_names, name) THEN 'unknown call' WHEN list_contains(c_lost, name) THEN 'call was ended' WHEN list_contains(c_done, name) THEN 'settled already' END
        ELSE CASE WHEN place = 0 THEN 'unknown attempt' WHEN list_contains(t_done, attempt) THEN 'finished already' END END AS reason
      FROM (SELECT *, CASE WHEN action = 'admit' THEN least({LIMITS.attempt_seconds}, left_s) ELSE least(seconds, left_s, open_s, {LIMITS.watchdog_seconds}, rest_s) END AS granted,
          CASE least(seconds, left_s, open_s, {LIMITS.watchdog_seconds}, rest_s) WHEN seconds THEN 'requested_allowance' WHEN left_s THEN 'campaign_elapsed' WHEN open_s THEN 'attempt_elapsed'
            WHEN {LIMITS.watchdog_seconds} THEN 'invocation_watchdog' ELSE 'aggregate_invocation' END AS resource
        FROM (SELECT *, {LIMITS.session_seconds} - (moment - started) AS left_s, coalesce(list_position(t_names, attempt), 0) AS place,
            t_ends[list_position(t_names, attempt)] - moment AS open_s, {LIMITS.invocation_seconds} - charged AS rest_s
          FROM (SELECT e.campaign, e.n, CASE WHEN e.action = 'admit' THEN coalesce(started, e.moment) ELSE started END AS started, charged, calls, tries, t_names, t_ends, t_done, c_names, c_done,
              CASE WHEN r_end <= e.moment THEN list_append(c_lost, r_name) ELSE c_lost END AS c_lost, CASE WHEN r_end > e.moment THEN r_name END AS r_name,
              CASE WHEN r_end > e.moment THEN r_end END AS r_end, CASE WHEN r_end > e.moment THEN r_size END AS r_size, e.seq, e.moment, e.action, e.name, e.attempt, e.seconds
            FROM s JOIN e ON e.campaign = s.campaign AND e.n = s.n + 1)))))
)
SELECT campaign, seq, action, name, decision, reason, round(granted, 3) AS granted, resource, round(charged, 3) AS charged FROM s WHERE n > 0
"""


@query(LEDGER)
def stream_decisions(spark, d):
    """Decisions of every campaign's ledger, from typed state with timers (UD10, UD12, CP15)."""
    log = replay.events(budget.stateful(spark), f"{d}/events.parquet")
    found = budget.run(budget.decided(ledger_events(log), LIMITS), shared(spark)).where("seq is not null")
    return found.select("campaign", "seq", "action", "name", "decision", "reason", F.round("granted", 3).alias("granted"), "resource", F.round("charged", 3).alias("charged"))


def coverage_events(updates: DataFrame, bundles: DataFrame, questions: DataFrame) -> DataFrame:
    """Questions, bundles and lists of updates of each stage as the events of a stream, in order."""
    none = lambda *names: {n: F.lit(None).cast("string" if n != "updates" else f"array<{coverage.UPDATE}>") for n in names}
    q = questions.select("stage_id", F.lit(-2).cast("bigint").alias("seq"), F.lit("question").alias("kind"), F.col("question_id").alias("name"))
    b = bundles.select("stage_id", F.lit(-1).cast("bigint").alias("seq"), F.lit("bundle").alias("kind"), F.col("bundle_id").alias("name"), "question_id", "adequacy")
    text = lambda n: F.lit(None).cast("string").alias(n)
    one = F.struct("seq", "question_id", text("parent_id"), text("question"), "state", "bundle_ids", text("exploration"), text("next_gap"))
    u = updates.groupBy("stage_id", F.col("batch_no").cast("bigint").alias("seq")).agg(F.sort_array(F.collect_list(one)).alias("updates"))
    u = u.select("stage_id", "seq", F.lit("updates").alias("kind"), "updates")
    every = q.withColumns(none("question_id", "adequacy", "updates")).unionByName(b.withColumns(none("updates")))
    return every.unionByName(u.withColumns(none("name", "question_id", "adequacy")))


@query(COVERED)
def stream_coverage(spark, d):
    """Rows of ``coverage_machine`` from a stream that stops after half of the log, and goes on from its checkpoint (UD7, FI8)."""
    events = coverage_events(*coverage_inputs(spark, d))
    folder = shared(spark)
    half = events.where("seq >= 0").agg(F.percentile_approx("seq", 0.5)).first()[0]
    for part in (F.col("seq") <= F.lit(half), F.col("seq") > F.lit(half)):
        events.where(part).write.mode("append").parquet(f"{folder}/log")
        stream = budget.stateful(spark).readStream.schema(coverage.EVENT).parquet(f"{folder}/log")
        found = coverage.run(stream, folder)
    return found
