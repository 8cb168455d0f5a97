"""Lexical ranks against a plain walk: products in blocks, and the posting store that leaves segments out."""

import math
import random
import re

import pytest

from spanforge.operators import postings as P
from spanforge.operators import retrieval
from spanforge.sources.tables import shared

WORDS = [f"w{i}" for i in range(60)]


def corpus(n, seed=1):
    rng = random.Random(seed)
    rare = lambda: WORDS[min(59, int(rng.expovariate(0.15)))]
    return [(i // 3, f"c{i % 3}", (i % 3) * 10, " ".join(rare() for _ in range(rng.choice([1, 2, 3, 8, 30, 80])))) for i in range(n)]


def plain(rows, queries, k, context=None):
    tokens = lambda t: set(re.findall(r"[a-z0-9_]+", (t or "").lower()))
    out = {}
    for query_id, text, *scope in queries:
        asked, scored = tokens(text), []
        for i, (source, chunk, start, body) in enumerate(rows):
            every = tokens(body) | (tokens(context[i]) if context else set())
            n = len(asked & every)
            if n and (not scope or scope[0] == source):
                scored.append((-n / math.sqrt(max(1, len(tokens(body)))), source, start, chunk))
        for rank, (score, source, _, chunk) in enumerate(sorted(scored)[:k], 1):
            out[query_id, rank] = (source, chunk, round(-score, 12))
    return out


def got(df):
    return {(r.query_id, r["rank"]): (r.source_id, r.chunk_id, round(r.score, 12)) for r in df.collect()}


SCHEMA = "source_id long, chunk_id string, start_at int, chunk_text string"
ASKED = [(i, " ".join(random.Random(i).sample(WORDS, 1 + i % 9))) for i in range(25)] + [(90, "unheard"), (91, ""), (92, None)]


def frames(spark, rows, asked=ASKED, schema="query_id long, query string"):
    return spark.createDataFrame(rows, SCHEMA).repartition(5), spark.createDataFrame(asked, schema)


@pytest.mark.parametrize("block", [P.BLOCK_QUERIES, 4])
def test_products_equal_a_plain_walk(spark, monkeypatch, block):
    monkeypatch.setattr(P, "BLOCK_QUERIES", block)
    rows = corpus(900)
    assert got(retrieval.lexical(*frames(spark, rows), k=7)) == plain(rows, ASKED, 7)


def test_small_products_at_a_time_and_scopes(spark, monkeypatch):
    monkeypatch.setattr(P, "CELLS", 100)
    rows = corpus(300)
    asked = [(i, q, i % 110) for i, q in ASKED if q]
    passages, queries = frames(spark, rows, asked, "query_id long, query string, scope long")
    assert got(retrieval.lexical(passages, queries, k=2, scope="scope")) == plain(rows, asked, 2)
    assert got(retrieval.lexical(passages, queries.drop("scope"), k=3)) == plain(rows, [a[:2] for a in asked], 3)


def test_context_counts_for_matches_only(spark):
    rows = [(1, "c0", 0, "w1 w2"), (2, "c0", 0, "w1"), (3, "c0", 0, None), (4, "c0", 0, "")]
    context = ["w9 w8", None, "w9", "w1"]
    passages = spark.createDataFrame([(*r, c) for r, c in zip(rows, context)], SCHEMA + ", context string")
    asked = [(1, "w1 w9")]
    found = got(retrieval.lexical(passages, spark.createDataFrame(asked, "query_id long, query string"), k=9))
    assert found == plain([(a, b, c, d or "") for a, b, c, d in rows], asked, 9, context)


@pytest.mark.parametrize("k", [1, 5, 200])
def test_store_equals_a_plain_walk_and_leaves_segments_out(spark, k):
    rows = corpus(1500, seed=4)
    passages, queries = frames(spark, rows)
    path = shared(spark)
    P.write_store(passages, path, rows=16)
    found, seen = P.search_store(spark, path, queries, k=k)
    assert got(found) == plain(rows, ASKED, k)
    # short passages are in segments of their own: for the very best, those of long ones need not be scored
    assert seen["scored"] < {1: 0.5, 5: 0.9, 200: 1.01}[k] * seen["pairs"]


def test_store_of_nothing(spark):
    passages, queries = frames(spark, [])
    path = shared(spark)
    P.write_store(passages, path)
    assert P.search_store(spark, path, queries)[0].count() == 0
    assert P.search_store(spark, path, queries.limit(0))[0].count() == 0
    with pytest.raises(Exception, match="exists"):
        P.write_store(passages, path)


def test_fusion_takes_the_first_rank_of_a_key(spark):
    a = spark.createDataFrame([(1, "A", 1), (1, "B", 2)], "query_id int, key string, rank int")
    b = spark.createDataFrame([(1, "B", 1), (1, "B", 2), (1, "C", 3)], "query_id int, key string, rank int")
    rows = retrieval.fuse({"a": a, "b": b, "none": a.limit(0)}, ["key"]).orderBy("rank").collect()
    assert [(r.key, round(r.rrf, 12)) for r in rows] == [("B", round(1 / 62 + 1 / 61, 12)), ("A", round(1 / 61, 12)), ("C", round(1 / 63, 12))]


def test_postings_of_a_segment_are_gathered_in_its_task(spark, tmp_path):
    """A row for each token of each passage went through a shuffle; now a segment that batches cut is put together in place."""
    import pyarrow as pa

    rows = [(s, r, 2 + r, [f"w{r % 2}", "all"]) for s in (5, 9) for r in range(4)]
    table = pa.table({"segment": [r[0] for r in rows], "row": pa.array([r[1] for r in rows], pa.int32()), "size": pa.array([r[2] for r in rows], pa.int32()), "tokens": [r[3] for r in rows]})
    found = [tuple(r.values()) for b in P._posted(iter(table.to_batches(max_chunksize=3))) for r in b.to_pylist()]
    assert sorted(found) == sorted((t, s, least, held) for s in (5, 9) for t, least, held in (("w0", 2, [0, 2]), ("w1", 3, [1, 3]), ("all", 2, [0, 1, 2, 3])))
