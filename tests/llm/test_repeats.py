"""Against a table of all windows."""

import hashlib
import random

import pytest

from spanforge.llm import queries as q
from spanforge.llm import repeats as rp


def brute(rows):
    """rows: (doc, bytes) in order."""
    seen, out = {}, []
    for d, t in rows:
        for i in range(len(t) - rp.LENGTH + 1):
            seen.setdefault(t[i : i + rp.LENGTH], (d, i))
    for d, t in rows:
        gone = bytearray(len(t))
        for i in range(len(t) - rp.LENGTH + 1):
            if seen[t[i : i + rp.LENGTH]] != (d, i):
                gone[i : i + rp.LENGTH] = b"\1" * rp.LENGTH
        spans = sum(1 for i in range(len(t)) if gone[i] and not (i and gone[i - 1]))
        out.append((d, len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return sorted(out)


def corpus(seed, n):
    rnd = random.Random(seed)
    words = ["the", "of", "wörld", "stone", "😀", "a", "river", "bright", "morning", "and", "x"]
    text = lambda k: " ".join(rnd.choices(words, k=k))
    passages = [text(k) for k in (10, 18, 22, 30, 60)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rnd.randint(0, 4)):
            parts.append(rnd.choice((text(rnd.randint(1, 60)), rnd.choice(passages), "ab " * rnd.randint(1, 120), rnd.choice(rows)[1] if rows else "")))
        rows.append((rnd.randint(-(10**6), 10**6) * 1000 + i, " ".join(parts)))
    return rows


@pytest.mark.parametrize("hot", [20_000, 3])
def test_equals_all_windows(spark, tmp_path, monkeypatch, hot):
    monkeypatch.setattr(rp, "HOT", hot)
    rows = corpus(hot, 120)
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("gram", rp.F.lit(1)).repartition(6).write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, q.op8_repeats(spark, str(tmp_path)).collect())) == brute(sorted((d, t.encode()) for d, t in rows))


def test_shapes(spark):
    long = "abcdefghij" * 15
    other = "".join(chr(33 + i % 90) for i in range(130))
    rows = [(1, other), (1, other), (2, None), (2, ""), (None, other), (5, other[:99]), (6, "z" + other + long[:50])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id if r.doc_id is not None else 99, r.n_bytes, r.n_removed, r.n_spans) for r in rp.remove_repeats(df).collect()))
    assert got == [(1, 130, 0, 0), (1, 130, 0, 0), (2, 0, 0, 0), (2, 0, 0, 0), (5, 99, 0, 0), (6, 181, 130, 1), (99, 130, 130, 1)]
    assert rp.remove_repeats(df.limit(0)).count() == 0
