"""Views bounded in tokens: rules, statuses, one counter a task, and the search that uses them."""

import os
import random

import pytest
from pyspark.sql import functions as F

from spanforge.operators import retrieval, views
from spanforge.plans import search as api

TOKENIZER = "/opt/tokenizers/word_bpe_49k.json"
UNIT = "struct<text:string,focal:boolean,required:boolean>"


def units(texts, focal, required=()):
    return [(t, i == focal, i in required) for i, t in enumerate(texts)]


def test_whole_bounded_and_too_large():
    texts = ["aaaa.", "bbbb.", "cccc.", "dddd.", "eeee."]
    whole = "".join(texts)
    call = lambda limit, focal=2, required=(): views.bounded("q", "id", whole, units(texts, focal, required), views.characters, limit)
    assert call(100) == (["id\n" + whole], "ready")
    # the later of two at one distance first, then the earlier
    assert call(27) == (["id\nbbbb.\ncccc.\ndddd.\neeee.", "id\naaaa.\nbbbb.\ncccc.\ndddd."], "context_incomplete")
    assert call(21) == (["id\nbbbb.\ncccc.\ndddd."], "context_incomplete")
    assert call(20) == ([], "context_too_large") and call(25, focal=None) == ([], "context_too_large")
    assert call(27, focal=1, required={4})[0] == ["id\naaaa.\nbbbb.\ncccc.\neeee."]
    assert views.bounded("", "", "", [], views.characters, 10) == ([], "context_too_large")


@pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="needs a vocabulary file")
def test_tokens_of_a_vocabulary(spark):
    rng = random.Random(1)
    rows = []
    for i in range(40):
        texts = [" ".join(rng.choices(["river", "stone", "unfathomable", "of", "the", "12345"], k=rng.randint(1, 12))) + "." for _ in range(rng.randint(1, 25))]
        rows.append((i, 1, "what stone", "Title", " ".join(texts), units(texts, rng.randrange(len(texts)))))
    df = spark.createDataFrame(rows, f"query_id long, place int, query string, identity string, whole string, sentences array<{UNIT}>")
    make = views.word_pieces(TOKENIZER)
    count = make()
    seen = set()
    for r in views.with_views(df, 60, make).collect():
        query, identity, whole, sentences = rows[r.query_id][2:]
        assert (r.views, r.view_status) == views.bounded(query, identity, whole, sentences, count, 60)
        assert all(count(query, v) <= 60 for v in r.views)
        seen.add(r.view_status)
    assert seen == set(views.STATUSES)


def test_nulls_and_nothing(spark):
    df = spark.createDataFrame([(None, None, None, None, None, None)], f"query_id long, place int, query string, identity string, whole string, sentences array<{UNIT}>")
    assert [(r.views, r.view_status) for r in views.with_views(df, 10).collect()] == [([], "context_too_large")]
    assert views.with_views(df.limit(0), 10).count() == 0


def test_a_search_bounds_its_views_by_the_counter(spark):
    rng = random.Random(3)
    text = lambda: " ".join(rng.choice(["river", "stone", "light", "over", "hill."]) for _ in range(60))
    rows = [(s, n, f"c{n}", 400 * n, 400 * n + 400, text()[:400]) for s in range(6) for n in range(4)]
    passages = spark.createDataFrame(rows, "source_id long, chunk_no int, chunk_id string, start_at int, end_at int, chunk_text string")
    queries = spark.createDataFrame([(1, "river stone"), (2, "hill light")], "query_id long, query string")
    found = lambda limit, **o: sorted((r.query_id, r.place, r.source_id, r.chunk_id, round(r.score, 12)) for r in api.search(passages, queries, api.Settings(window_characters=1500, view_characters=limit), score=retrieval.overlap_score, **o).collect())
    one, whole = found(500), found(10_000)
    assert len(one) == len(whole) == 12
    # a counter that counts nothing lets every view be whole, one that counts too much leaves none
    assert found(500, counter=lambda: lambda q, t: 0) == whole and found(500, counter=lambda: lambda q, t: 10**6) == []


def test_sentences_are_cut_once_for_their_windows(spark, tmp_path):
    """Four branches of the joins each cut all texts into sentences."""
    from spanforge.plans import catalogue

    spark.createDataFrame([(1, "A b. C d! E f? G."), (2, "Alone")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = catalogue.reading_window_greedy(spark, str(tmp_path))
    assert sorted(map(tuple, found.collect())) == [(1, 1, "0,1,2,3", "", 17, "complete_window"), (2, 0, "0", "", 5, "complete_window")]
    assert "regexp_extract_all" not in found._jdf.queryExecution().toString()
