"""Neighbours and edited texts against a plain loop; syncmers against their definition."""

import hashlib
import random

import numpy as np

from spanforge.llm import fingerprints as fp
from spanforge.llm import queries as q


def rows(spark, pairs):
    return spark.createDataFrame(pairs, "doc_id long, text string")


def some_texts(n, seed=5):
    rnd = random.Random(seed)
    words = ["alpha", "béta", "gamma😀", "delta", "of", "the", "river", "x"]
    return [" ".join(rnd.choices(words, k=rnd.choice((0, 1, 3, 40, 200)))) for _ in range(n)]


def brute(pairs):
    order = sorted(pairs, key=lambda r: (-(fp.LEAST if r[0] is None else r[0]), r[1] or ""))
    out = []
    for i, (d, t) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        a, b, c = (fp.sketch(fp.code_points(x)) for x in (t, edited, nxt))
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), fp.written(a), fp.written(b), fp.likeness(a, b), fp.likeness(a, c)))
    return sorted(out, key=str)


def test_equals_a_plain_loop(spark, tmp_path):
    ids = random.Random(1).sample(range(-1000, 1000), 60)
    pairs = [*zip(ids, some_texts(60), strict=True), (5000, None), (5000, "b"), (5000, "b"), (None, "last"), (None, None)]
    rows(spark, pairs).withColumn("key", fp.F.lit(1)).repartition(7).write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, q.op3_fingerprints(spark, str(tmp_path)).collect()), key=str) == brute(pairs)


def test_small_tables(spark):
    assert fp.fingerprints(rows(spark, [])).count() == 0
    assert [tuple(r) for r in fp.fingerprints(rows(spark, [(1, "only one text of all")])).collect()] == brute([(1, "only one text of all")])


def test_definition_of_closed_syncmers():
    cp = fp.code_points(" ".join(some_texts(20)))
    at, _ = fp.syncmers(cp)
    h = cp.astype(np.uint64) + np.uint64(1)
    w = 1
    while w < fp.S:
        h, w = h[:-w] * fp._power(w) + h[w:], 2 * w
    h = fp._mix(h).tolist()
    span = fp.K - fp.S
    want = [i for i in range(len(cp) - fp.K + 1) if min(h[i : i + span + 1]) in (h[i], h[i + span])]
    assert at.tolist() == want
    moved, _ = fp.syncmers(np.concatenate((fp.code_points("some prefix"), cp)))
    assert {i + 11 for i in want} <= set(moved.tolist())


def test_likeness():
    rnd = random.Random(2)
    a = "".join(rnd.choices("abcdefghij ", k=4000))
    b = "".join(rnd.choices("abcdefghij ", k=4000))
    sk = lambda t: fp.sketch(fp.code_points(t))
    assert fp.likeness(sk(a), sk(a)) == 1 and fp.likeness(sk(a), sk(b)) < 0.1
    assert abs(fp.likeness(sk(a), sk(a[:2000] + b[:2000])) - 0.5) < 0.2
    assert fp.likeness(sk(""), sk("")) == 1 and fp.likeness(sk(""), sk("a")) == 0


def test_estimates_are_near_the_likeness_of_all_anchors():
    rnd = random.Random(7)
    text = lambda n: fp.code_points("".join(rnd.choices("abcdefghij ", k=n)))
    off = []
    for _ in range(150):
        a, b = text(3000), text(3000)
        edited = np.concatenate((a[:1500], b[:1500]))
        few, all_ = (fp.likeness(fp.sketch(a, n), fp.sketch(edited, n), n) for n in (fp.SIZE, 10**6))
        off.append(abs(few - all_))
    assert np.mean(off) < 0.05 and np.quantile(off, 0.95) < 0.12
    a, b = text(500), text(500)
    assert fp.likeness(fp.sketch(a), fp.sketch(b)) == fp.likeness(fp.sketch(a, 10**6), fp.sketch(b, 10**6), 10**6)
