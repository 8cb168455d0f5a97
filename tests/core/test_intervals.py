"""Interval joins by nested bins against all pairs, and the number of pairs that they test."""

import random

import pytest
from pyspark.sql import functions as F

from spanforge.operators import intervals


def sides(spark, rng, n, far):
    def some(i):
        a = rng.choice([rng.randrange(far), rng.randrange(far) >> 8 << 8, -rng.randrange(50)])
        return (rng.choice([1, 2, None, 3]), i, a, a + rng.choice([0, 1, 700, 1024, rng.randrange(far), -3]))

    left, right = [some(i) for i in range(n)], [some(i) for i in range(n)]
    return left, right, spark.createDataFrame(left, "k int, a int, start_at int, end_at int"), spark.createDataFrame(right, "k int, b int, block_start int, block_end int")


@pytest.mark.parametrize("far", [900, 5_000, 3_000_000])
def test_joins_equal_all_pairs(spark, far):
    rng = random.Random(far)
    left, right, l, r = sides(spark, rng, 120, far)  # noqa: E741
    pairs = [(x, y) for x in left for y in right if x[0] is not None and x[0] == y[0]]
    got = sorted((p.a, p.b) for p in intervals.overlaps(l, r, "k").collect())
    assert got == sorted((x[1], y[1]) for x, y in pairs if x[2] < y[3] and x[3] > y[2])
    points = l.select("k", "a", F.col("start_at").alias("point"))
    units = r.withColumnsRenamed({"block_start": "unit_start", "block_end": "unit_end"})
    assert sorted((p.a, p.b) for p in intervals.containing(points, units, "k").collect()) == sorted((x[1], y[1]) for x, y in pairs if y[2] <= x[2] < y[3])
    inside = {y[1] for x, y in pairs if y[2] >= x[2] and y[3] <= x[3] and y[3] >= y[2] and x[3] >= x[2]}
    forward = units.where("unit_end >= unit_start"), l.where("end_at >= start_at")
    assert sorted(p.b for p in intervals.uncovered(*forward, "k").collect()) == sorted(y[1] for y in right if y[3] >= y[2] and y[1] not in inside)


def test_one_long_source_is_not_compared_with_itself(spark):
    def tested(n):
        chunks = spark.range(n).select(F.lit(1).alias("k"), (F.col("id") * 1600).alias("start_at"), (F.col("id") * 1600 + 1600).alias("end_at"))
        blocks = spark.range(n * 2).select(F.lit(1).alias("k"), (F.col("id") * 800 - 7).alias("block_start"), (F.col("id") * 800 + 793).alias("block_end"))
        pairs = intervals.candidates(chunks, blocks, "k", "start_at", "end_at", "block_start", "block_end")
        return pairs.count(), intervals.overlaps(chunks, blocks, "k").count()

    (few, _), (many, found) = tested(10_000), tested(100_000)
    assert found == 300_000 - 1 and many < 10.5 * few and many < 5 * found


def test_nothing_and_extra_columns(spark):
    l = spark.createDataFrame([(1, 0, 10, 5)], "k int, start_at int, end_at int, `x.y` int")  # noqa: E741
    r = spark.createDataFrame([(1, 5, 6)], "k int, block_start int, block_end int")
    assert intervals.overlaps(l, r, "k").first()["x.y"] == 5
    assert intervals.overlaps(l.limit(0), r, "k").count() == intervals.overlaps(l, r.limit(0), "k").count() == 0
