"""Held-out accuracy, class prior, folds and shapes."""

import random
import zlib

import numpy as np

from spanforge.llm import quality as ql


def corpus(n, seed=7):
    rnd = random.Random(seed)
    words = ["river", "stone", "of", "the", "a", "winter", "garden", "walks", "slowly", "and", "bright", "morning"]
    docs, labels = [], []
    for i in range(n):
        good = rnd.random() < 0.7
        if good:
            text = " ".join(rnd.choices(words, k=rnd.randint(20, 120))).capitalize() + "."
        else:
            text = rnd.choice((" | ".join(rnd.choices(words, k=40)), "BUY!! NOW!! " * 20, " ".join([rnd.choice(words)] * 50)))
        docs.append((i, text))
        if rnd.random() < 0.5:
            labels.append((i, int(good), 0))
    return docs, labels


def frames(spark, docs, labels):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = corpus(1500)
    got = {r.doc_id: r for r in ql.quality(*frames(spark, docs, labels)).collect()}
    assert len(got) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d, r in got.items())
    out = [(q, got[d].predicted) for d, q, _ in labels if got[d].held_out]
    assert len(out) > 100 and np.mean([q == p for q, p in out]) > 0.97
    assert all(r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in got.values())


def test_held_out_and_negative_labels_do_not_matter(spark):
    docs, labels = corpus(400)
    turned = [(d, 1 - q if zlib.crc32(str(d).encode()) % 4 == 2 else q, 1 - t) for d, q, t in labels]
    a, b = (sorted(map(tuple, ql.quality(*frames(spark, docs, x)).collect())) for x in (labels, turned))
    assert a == b


def test_class_prior():
    rng = np.random.default_rng(0)
    for prior in (0.3, 0.6, 0.85):
        p = rng.normal(2, 1, 4000)
        u = np.concatenate((rng.normal(2, 1, int(4000 * prior)), rng.normal(-2, 1, int(4000 * (1 - prior)))))
        assert abs(ql.class_prior(p, u) - prior) < 0.06


def test_shapes(spark):
    docs, labels = corpus(200)
    odd = [(None, "text"), (1000, None), (1001, ""), (1002, "word " * 60000), (1003, "same"), (1003, "same")]
    d, lab = frames(spark, docs + odd, labels)
    rows = ql.quality(d.withColumn("score", ql.F.lit("x")), lab).where("doc_id is null or doc_id >= 1000").collect()
    assert len(rows) == 6 and len({r.score for r in rows if r.doc_id == 1003}) == 1 and all(0 <= r.score <= 1 for r in rows)
    assert ql.quality(d.limit(0), lab).count() == 0
    assert {r.score for r in ql.quality(d, lab.limit(0)).collect()} == {0.5}


def test_top_word_of_long_texts():
    for n in (10, 1999, 2000, 2001, 30_000):
        words = [f"w{i}" for i in range(n)]
        words[: n // 20 + 1] = ["the"] * (n // 20 + 1)
        assert ql.statistics(" ".join(words))[ql.NAMES.index("top_word")] == (n // 20 + 1) / n
