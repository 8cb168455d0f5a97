"""Interval joins within a source by bins over its offsets, wide or narrow as the intervals are.

An interval's level goes by its length: bins of a level are wider than its intervals, which so touch two of
them at most. Two intervals that share an offset share the bin of that offset at the higher of their
levels. So one side is dealt to the levels that the other side has, at and above its own, and an equality
join on (source, level, bin) meets every pair that overlaps; a pair that meets in two bins counts in the
one where its shared offsets begin. Pairs that are tested grow with the rows, not with the length of a
source, and a source that holds a third of all rows is split over as many tasks as it has bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Width of the lowest bins as a power of two; each level doubles it.
BASE = 6
LEVEL, BIN, LOW, HIGH = "__level", "__bin", "__low", "__high"


def _ranged(df: DataFrame, low: str, high: str) -> DataFrame:
    """Rows with the first and last offset that they touch, and their level; ``high`` is exclusive."""
    a, z = F.least(low, high).cast("bigint"), F.greatest(F.col(low), F.col(high) - 1).cast("bigint")
    level = F.greatest(F.lit(0), F.floor(F.log2((z - a + 1).cast("double"))) + 1 - BASE).cast("int")
    return df.withColumns({LOW: a, HIGH: z}).withColumn(LEVEL, F.when(F.col(LOW).isNotNull(), level))


def _levels(df: DataFrame) -> list[int]:
    """Levels that occur, some dozens at most."""
    return sorted(r[0] for r in df.select(LEVEL).where(F.col(LEVEL).isNotNull()).distinct().collect())


def _bin(offset: Column, level: Column) -> Column:
    return F.call_function("shiftright", offset, level + BASE)


def _dealt(df: DataFrame, levels: list[int] | None = None, strictly: bool = False) -> DataFrame:
    """A row for each bin that the interval touches at its own level, or at each of ``levels`` from its own (above it, if ``strictly``)."""
    if levels is not None:
        own = F.col(LEVEL)
        every = F.array(*map(F.lit, levels)) if levels else F.expr("cast(array() as array<int>)")
        df = df.withColumn("__at", F.explode(F.filter(every, lambda n: n > own if strictly else n >= own))).withColumn(LEVEL, F.col("__at")).drop("__at")
    return df.withColumn(BIN, F.explode(F.sequence(_bin(F.col(LOW), F.col(LEVEL)), _bin(F.col(HIGH), F.col(LEVEL)))))


def candidates(left: DataFrame, right: DataFrame, key: str, low: str, high: str, other_low: str, other_high: str) -> DataFrame:
    """Pairs of rows of one ``key`` that meet in a bin: all pairs that overlap, once or twice, and some beside."""
    a, b = _ranged(left, low, high), _ranged(right, other_low, other_high)
    of_a, of_b = _levels(a), _levels(b)
    named = {LOW: "__other", HIGH: "__other_high"}
    on = [key, LEVEL, BIN]
    up = _dealt(a, of_b).join(_dealt(b).withColumnsRenamed(named), on)
    return up.unionByName(_dealt(a).join(_dealt(b, of_a, strictly=True).withColumnsRenamed(named), on))


def overlaps(chunks: DataFrame, blocks: DataFrame, key: str) -> DataFrame:
    """Interval-overlap join on ``key`` (JN5): ``start_at < block_end`` and ``end_at > block_start``."""
    pairs = candidates(chunks, blocks, key, "start_at", "end_at", "block_start", "block_end")
    once = _bin(F.greatest(LOW, "__other"), F.col(LEVEL)) == F.col(BIN)
    found = pairs.where(once & (F.col("start_at") < F.col("block_end")) & (F.col("end_at") > F.col("block_start")))
    return found.drop(LEVEL, BIN, LOW, HIGH, "__other", "__other_high")


def containing(points: DataFrame, units: DataFrame, key: str, point: str = "point") -> DataFrame:
    """Units that hold a point (JN7): ``unit_start <= point < unit_end``."""
    held = _ranged(units, "unit_start", "unit_end")
    at = points.withColumns({LOW: F.col(point).cast("bigint"), HIGH: F.col(point).cast("bigint"), LEVEL: F.lit(0)})
    pairs = _dealt(at, _levels(held)).drop(LOW, HIGH).join(_dealt(held).drop(LOW, HIGH), [key, LEVEL, BIN]).drop(LEVEL, BIN)
    return pairs.where((F.col("unit_start") <= F.col(point)) & (F.col(point) < F.col("unit_end")))


def uncovered(units: DataFrame, passages: DataFrame, key: str) -> DataFrame:
    """Units that no passage of their source contains (JN6)."""
    held = _ranged(passages.select(key, "start_at", "end_at"), "start_at", "end_at")
    spans = _ranged(units.select(key, "unit_start", "unit_end").distinct(), "unit_start", "unit_end")
    # what contains a unit is as long or longer: it is enough to look for it where the unit begins
    first = spans.withColumn(HIGH, F.col(LOW))
    pairs = _dealt(first, _levels(held)).drop(LOW, HIGH).join(_dealt(held).drop(LOW, HIGH), [key, LEVEL, BIN])
    inside = pairs.where((F.col("unit_start") >= F.col("start_at")) & (F.col("unit_end") <= F.col("end_at")))
    return units.join(inside.select(key, "unit_start", "unit_end").distinct(), [key, "unit_start", "unit_end"], "left_anti")
