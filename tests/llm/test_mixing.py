"""Realised token shares against the target weights, limits and shapes."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spanforge.llm import mixing as mx


def corpus(spark, sizes, seed=3):
    rnd = random.Random(seed)
    rows, i = [], 0
    for s, n in sizes.items():
        for _ in range(n):
            rows.append((i, " ".join(["w"] * rnd.randint(1, 30)), s))
            i += 1
    return spark.createDataFrame(rows, "doc_id long, text string, source string"), {r[0]: len(r[1].split()) for r in rows}


def shares(rows, size):
    n, got, w = Counter(), Counter(), {}
    for r in rows:
        n[r.source] += size[r.doc_id]
        got[r.source] += size[r.doc_id] * r.copies
        w[r.source] = r.weight
    return n, got, w


@pytest.mark.parametrize(("entropy", "repeats"), [(0.97, 4.0), (0.999, 100.0), (0.0, 4.0), (1.0, 1.5)])
def test_budget_and_weights(spark, entropy, repeats):
    docs, size = corpus(spark, {"hot": 900, "a": 120, "b": 60, "c": 15})
    rows = mx.mixed(docs, mx.Mix(entropy=entropy, repeats=repeats, block_docs=50)).collect()
    n, got, w = shares(rows, size)
    total = sum(n.values())
    assert len(rows) == len(size) and abs(sum(w.values()) - 1) < 1e-6
    for s in n:
        assert 0 <= w[s] * total - got[s] <= 31, (s, w[s] * total, got[s])  # within one document
        assert w[s] * total / n[s] <= repeats + 1e-3
        c = {r.copies for r in rows if r.source == s}
        assert max(c) - min(c) <= 1
    h = -sum(x * math.log(x) for x in w.values()) / math.log(4)
    natural = -sum(x / total * math.log(x / total) for x in n.values()) / math.log(4)
    if repeats == 100.0:
        assert abs(h - max(entropy, natural)) < 1e-3


def test_no_source_is_cut_without_a_budget(spark):
    docs, size = corpus(spark, {"hot": 500, "a": 40, "b": 3})
    rows = mx.mixed(docs, mx.Mix(budget=None, repeats=3.0)).collect()
    n, got, _ = shares(rows, size)
    assert min(r.copies for r in rows) == 1 and got["hot"] == n["hot"] and 2 * n["b"] <= got["b"] <= 3 * n["b"] + 1


def test_shapes(spark):
    rows = [(1, "a b", None), (1, "a b", None), (None, "c", ""), (2, None, "x"), (3, "", "x"), (4, "d e f", "y")]
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, source string, weight int")
    got = mx.mixed(df).collect()
    assert len(got) == 6 and all(r.copies >= 0 for r in got) and len({r.copies for r in got if r.doc_id == 1}) == 1
    assert {r.copies for r in got if r.source == "x"} == {1}
    assert mx.mixed(df.limit(0)).count() == 0
    one = mx.mixed(df.where("doc_id = 4")).collect()
    assert [(r.copies, round(r.weight, 6)) for r in one] == [(1, 1.0)]


def test_block_permutations_equal_a_plain_walk(spark):
    """Copies of every document against loops over blocks and documents; hashes come from Spark."""
    rnd = random.Random(6)
    rows = [(i, rnd.choice(("hot", "hot", "hot", "a", "b", None)), " ".join("w" * rnd.randint(0, 12))) for i in range(400)] + [(None, "a", "x y z"), (5, "hot", "x y")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("__d_weight", F.lit(1)).withColumn("__name", F.lit("clash"))
    mix = mx.Mix(budget=0.9, entropy=0.95, repeats=3.0, block_docs=7)
    got = mx.mixed(docs, mix).withColumn("h", F.xxhash64("doc_id", F.lit(mix.seed))).withColumn("n", mx.tokens("text")).collect()
    assert len(got) == len(rows) and got[0]["__d_weight"] == 1 and got[0]["__name"] == "clash"
    total = sum(r.n for r in got)
    wanted = []
    for source in {r.source for r in got}:
        mine = [r for r in got if r.source == source]
        tokens = sum(r.n for r in mine)
        passes = mine[0].weight * mix.budget * total / tokens * (1 + 1e-9)
        full, rest, blocks = int(passes), (passes - int(passes)) * tokens, -(-len(mine) // mix.block_docs)
        keys = [(i, source or "", full) for i in range(blocks)]
        at = {r.b: r.o for r in spark.createDataFrame(keys, "b long, s string, f long").select("b", F.xxhash64("b", "f", "s", F.lit(mix.seed + 1)).alias("o")).collect()}
        turn = {r.h: r.t for r in spark.createDataFrame([(r.h, full) for r in mine], "h long, f long").select("h", F.xxhash64("h", "f", F.lit(mix.seed + 2)).alias("t")).collect()}
        used, cut = 0, False
        for block in sorted(range(blocks), key=lambda b: (at[b], b)):
            inside = [r for r in mine if r.h % blocks == block]
            size = sum(r.n for r in inside)
            if not cut and used + size <= rest:
                used += size
                wanted += [(r.doc_id, source, full + 1) for r in inside]
                continue
            left, done, taken = (0 if cut else rest - used), 0, set()
            for t in sorted({turn[r.h] for r in inside}):
                done += sum(r.n for r in inside if turn[r.h] == t)
                if not cut and done <= left:
                    taken.add(t)
            wanted += [(r.doc_id, source, full + (turn[r.h] in taken)) for r in inside]
            cut = True
    assert sorted(map(str, wanted)) == sorted(str((r.doc_id, r.source, r.copies)) for r in got)
    assert len({r[2] for r in wanted}) > 1


def test_dotted_names_and_a_very_long_text(spark):
    docs = spark.createDataFrame([(1, "a", "w " * 300_000, 7, 8), (2, "b", "x y", 7, 8)], "doc_id long, source string, text string, `x.y` int, `a``b` int")
    rows = mx.mixed(docs).collect()
    assert [(r["x.y"], r["a`b"]) for r in rows] == [(7, 8)] * 2
