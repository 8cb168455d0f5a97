"""The call ledger as a stream: typed state per campaign, one decision for each event.

A campaign admits attempts; an attempt reserves calls, a bounded number of them in flight at a time; a call is
settled once, with the seconds that it took. Until then its reservation is charged, and one that is
never settled stays charged: the watchdog ends the call at its deadline and frees its place, not its
seconds. Deadlines are timers on event time, so that the call of a campaign that falls silent ends too; an
event that comes after a deadline ends the call first, whether or not the timer was due.

State is kept in RocksDB, one value for each campaign: totals, running calls, and its attempts and calls, which
the limits bound. A micro-batch reads and writes it once; an entry for each name was a round trip to the
state's server for each of them.
Events of a campaign are taken in the order of time and number within a micro-batch, and micro-batches in the
order of the log; ``files`` bounds a micro-batch. A restart goes on from the checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: What a campaign's events may be, and their decisions.
ACTIONS = ("start", "admit", "reserve", "settle", "finish")
DECISIONS = "campaign long, seq long, at double, action string, name string, decision string, reason string, granted double, resource string, charged double"
ACCOUNT = "started double, charged double, n_calls int, n_attempts int, attempts array<struct<name:string,deadline:double,status:string>>, calls array<struct<name:string,reserved:double,status:string>>, running array<struct<name:string,deadline:double,reserved:double>>"
FIELDS = ("campaign", "seq", "at", "action", "name", "decision", "reason", "granted", "resource", "charged")


@dataclass(frozen=True)
class Limits:
    """Ceilings of a campaign: attempts, calls, calls in flight; seconds of the session, an attempt, a call, and of all calls."""

    attempts: int = 10
    calls: int = 100
    workers: int = 1
    session_seconds: float = 28_800.0
    attempt_seconds: float = 7_200.0
    watchdog_seconds: float = 900.0
    invocation_seconds: float = 14_400.0
    #: Whether the first admission starts the clock; else an explicit start does.
    starts_itself: bool = True


class Store:
    """A map of the state, held in memory within a micro-batch."""

    def __init__(self, entries: Iterable[tuple] = ()) -> None:
        self.known: dict[str, tuple] = {e[0]: tuple(e[1:]) for e in entries}

    def get(self, key: str) -> tuple | None:
        return self.known.get(key)

    def put(self, key: str, value: tuple | None) -> None:
        if value is None:
            self.known.pop(key, None)
        else:
            self.known[key] = value

    def items(self) -> list[tuple[str, tuple]]:
        return sorted(self.known.items())

    def entries(self) -> list[tuple]:
        return [(k, *v) for k, v in self.items()]


class Account:
    """Rules of one campaign (UD10, UD12, AG13). ``started`` is None before the clock runs."""

    def __init__(self, limits: Limits, started: float | None = None, charged: float = 0.0, calls: int = 0, attempts: int = 0) -> None:
        self.limits, self.started, self.charged, self.n_calls, self.n_attempts = limits, started, charged, calls, attempts
        self.attempts, self.calls, self.running = Store(), Store(), Store()  # deadline, status; reserved, status; deadline, reserved

    def expired(self, now: float) -> list[tuple[float, str]]:
        """Ends calls whose deadline has come; their reservations stay charged."""
        out = sorted((deadline, call) for call, (deadline, _) in self.running.items() if deadline <= now)
        for _, call in out:
            self.calls.put(call, (self.calls.get(call)[0], "lost"))
            self.running.put(call, None)
        return out

    def apply(self, at: float, action: str, name: str, attempt: str | None, seconds: float | None) -> dict:
        """The decision on an event: ``decision``, ``reason``, ``granted``, ``resource``."""
        rule = getattr(self, f"_{action}", None) if action in ACTIONS else None
        found = rule(at, name, attempt, seconds or 0.0) if rule else ("error", "unknown action")
        return dict(zip(("decision", "reason", "granted", "resource"), (*found, None, None, None)[:4]))

    def _window(self, at: float) -> tuple[float, str | None]:
        if self.started is None:
            return 0.0, "not started"
        left = self.limits.session_seconds - (at - self.started)
        return left, None if left > 0 else "session exhausted"

    def _start(self, at: float, name: str, attempt: str | None, seconds: float) -> tuple:
        if self.started is not None:
            return "refused", "started already"
        self.started = at
        return ("started",)

    def _admit(self, at: float, name: str, attempt: str | None, seconds: float) -> tuple:
        if self.started is None and self.limits.starts_itself:
            self.started = at
        left, problem = self._window(at)
        if problem:
            return "refused", problem
        if self.n_attempts >= self.limits.attempts:
            return "refused", "attempts exhausted"
        if self.attempts.get(name):
            return "refused", "attempt exists"
        granted = min(self.limits.attempt_seconds, left)
        self.attempts.put(name, (at + granted, "running"))
        self.n_attempts += 1
        return "admitted", None, granted

    def _reserve(self, at: float, name: str, attempt: str | None, seconds: float) -> tuple:
        left, problem = self._window(at)
        if problem:
            return "refused", problem
        deadline, status = self.attempts.get(attempt) or (0.0, None)
        if status != "running":
            return "refused", "attempt is not active"
        if self.n_calls >= self.limits.calls:
            return "refused", "calls exhausted"
        if len(self.running.items()) >= self.limits.workers:
            return "refused", "call in flight"
        if self.calls.get(name):
            return "refused", "call exists"
        limits = (
            (seconds, "requested_allowance"), (left, "campaign_elapsed"), (deadline - at, "attempt_elapsed"),
            (self.limits.watchdog_seconds, "invocation_watchdog"), (self.limits.invocation_seconds - self.charged, "aggregate_invocation"),
        )
        granted, resource = min(limits, key=lambda x: x[0])
        if granted <= 0:
            return "refused", "time exhausted", None, resource
        self.calls.put(name, (granted, "running"))
        self.running.put(name, (at + granted, granted))
        self.charged += granted
        self.n_calls += 1
        return "admitted", None, granted, resource

    def _settle(self, at: float, name: str, attempt: str | None, seconds: float) -> tuple:
        reserved, status = self.calls.get(name) or (0.0, None)
        if status != "running":
            return "error", {None: "unknown call", "lost": "call was ended", "settled": "settled already"}[status]
        self.calls.put(name, (reserved, "settled"))
        self.running.put(name, None)
        self.charged += seconds - reserved
        return "settled", None, seconds

    def _finish(self, at: float, name: str, attempt: str | None, seconds: float) -> tuple:
        deadline, status = self.attempts.get(name) or (0.0, None)
        if status != "running":
            return "error", "unknown attempt" if status is None else "finished already"
        self.attempts.put(name, (deadline, "finished"))
        return ("finished",)


def decisions(account: Account, campaign: int, events: Iterable[Row]) -> Iterator[Row]:
    """Decisions on events in order, and the ends of calls that they find overdue."""
    for e in sorted(events, key=lambda e: (e["at"], e["seq"])):
        yield from ended(account, campaign, account.expired(e["at"]))
        found = account.apply(e["at"], e["action"], e["name"], e["attempt"], e["seconds"])
        yield Row(campaign=campaign, seq=e["seq"], at=e["at"], action=e["action"], name=e["name"], **found, charged=account.charged)


def ended(account: Account, campaign: int, calls: list[tuple[float, str]]) -> Iterator[Row]:
    for deadline, call in calls:
        yield Row(campaign=campaign, seq=None, at=deadline, action="expire", name=call, decision="ended", reason=None, granted=None, resource=None, charged=account.charged)


class Ledger(StatefulProcessor):
    """Keyed state of ``Account``."""

    def __init__(self, limits: Limits) -> None:
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("account", ACCOUNT)

    def _account(self) -> Account:
        if not self.state.exists():
            return Account(self.limits)
        started, charged, calls, attempts, *stores = self.state.get()
        account = Account(self.limits, started, charged, calls, attempts)
        account.attempts, account.calls, account.running = (Store(x) for x in stores)
        return account

    def _keep(self, account: Account) -> None:
        self.state.update((account.started, account.charged, account.n_calls, account.n_attempts, *(x.entries() for x in (account.attempts, account.calls, account.running))))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        account = self._account()
        before = {call for call, _ in account.running.items()}
        yield from decisions(account, key[0], rows)
        for call, (deadline, _) in account.running.items():
            if call not in before:
                self.handle.registerTimer(int(deadline * 1000) + 1)
        self._keep(account)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        account = self._account()
        yield from ended(account, key[0], account.expired(expiredTimerInfo.getExpiryTimeInMs() / 1000))
        self._keep(account)

    def close(self) -> None:
        pass


def stateful(spark: SparkSession) -> SparkSession:
    """A session of the same context whose streams keep typed state."""
    own = spark.newSession()
    for k in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(k, spark.conf.get(k))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return own


def decided(events: DataFrame, limits: Limits, horizon: str = "1 hour") -> DataFrame:
    """The stream of decisions. ``events``: ``campaign``, ``seq``, ``ts``, ``action``, ``name``, ``attempt``, ``seconds``.

    An event that comes more than ``horizon`` behind the newest of the micro-batches before is dropped as late.
    """
    timed = events.withColumn("at", F.unix_micros("ts") / F.lit(1e6)).withWatermark("ts", horizon)
    return timed.groupBy("campaign").transformWithState(Ledger(limits), DECISIONS, "Append", "EventTime")


def run(stream: DataFrame, folder: str) -> DataFrame:
    """Runs a stream over all that is available into ``folder``; a later run goes on from its checkpoint. All rows so far."""
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{folder}/checkpoint")
    writer.outputMode("append").format("parquet").option("path", f"{folder}/out").start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")
