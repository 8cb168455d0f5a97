"""Budgets over an ordered event log."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def usage(events: DataFrame, key: str, order: list[str], seconds: str = "seconds", reserved: str = "reserved") -> DataFrame:
    """Budget used before and after each invocation (AG12, WN11): actual seconds, or the reservation while unknown (H22)."""
    w = Window.partitionBy(key).orderBy(*order)
    charged = F.coalesce(seconds, reserved)
    out = events.withColumn("charged", charged)
    return out.withColumn("used_before", F.coalesce(F.sum("charged").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).withColumn("used_after", F.sum("charged").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def limiting(limits: DataFrame, key: list[str], order: str = "position") -> DataFrame:
    """The least of several named limits, ties by position (AG13)."""
    return limits.groupBy(*key).agg(F.min("allowance").alias("cap"), F.min_by("limit_name", F.struct("allowance", order)).alias("limiting_resource"))


def last_outcomes(events: DataFrame, key: str, order: list[str], n: int = 8) -> DataFrame:
    """The last ``n`` events of each key, newest first as 1 (WN9)."""
    w = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    return events.withColumn("back", F.row_number().over(w)).where(F.col("back") <= n)


def standing_failures(events: DataFrame, key: list[str], order: list[str], failed: str = "failed") -> DataFrame:
    """Latest outcome per key, kept if it failed: a later success clears it (UD8)."""
    latest = events.groupBy(*key).agg(F.max_by(F.struct(failed, *order), F.struct(*order)).alias("last"))
    return latest.where(F.col(f"last.{failed}")).select(*key, *(F.col(f"last.{c}").alias(c) for c in order))


def admissions(events: DataFrame, key: str, order: list[str], budget: float, per_call: float, calls: int) -> DataFrame:
    """Admits calls in order while budget and number last (UD10, UD12).

    Each row asks for ``wanted`` seconds and then used ``seconds`` (null: it never settled, its
    reservation stays charged). A reservation is the least of the request, the cap per call and
    what is left; a call is refused at the ceiling or with nothing left. A ledger is sequential
    by nature: its rows stream through one task per key, sorted, with three numbers of state.
    """
    columns = f"{key} bigint, " + ", ".join(f"{c} bigint" for c in order) + ", admitted boolean, reserved double, limiting_resource string, used_after double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, used, n = None, 0.0, 0
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                k = getattr(row, key)
                if k != now:
                    now, used, n = k, 0.0, 0
                place = [getattr(row, c) for c in order]
                limits = ((row.wanted, "requested_allowance"), (per_call, "call_cap"), (budget - used, "aggregate_invocation"))
                cap, name = min(limits, key=lambda x: x[0])
                if n >= calls or cap <= 0:
                    out.append((k, *place, False, None, "call_ceiling" if n >= calls else name, used))
                    continue
                n += 1
                used += cap if pd.isna(row.seconds) else row.seconds
                out.append((k, *place, True, float(cap), name, used))
            yield pd.DataFrame(out, columns=[key, *order, "admitted", "reserved", "limiting_resource", "used_after"])

    return events.select(key, *order, "wanted", "seconds").repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, columns)
