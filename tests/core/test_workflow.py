"""The runner, paths and guards."""

import pytest
from pyspark.sql import functions as F

from spanforge.operators import workflow as wf
from spanforge.plans import search


def test_runner_calls_tools_and_remembers():
    outputs = {"plan": [{"tool": "calculate", "arguments": {"a": "1"}}, {"content": "the plan"}], "research-0": [{"content": "notes"}], "synthesis": [{"content": "report"}], "review": [{"content": "needs revision"}], "revision": [{"content": "better"}], "recheck": [{"content": "ready"}]}
    r = wf.Runner(wf.Canned(outputs), {"calculate": lambda a: "2"})
    out = wf.workflow(r, "brief")
    assert out["revision"] == "better" and out["recheck"] == "ready" and [t["tool"] for t in r.trace] == ["calculate"]
    assert r.run("plan", "planner", [{"brief": "brief"}]) == "the plan"
    with pytest.raises(ValueError, match="not allowed"):
        wf.Runner(wf.Canned({"plan": [{"tool": "rm"}]}), {}).run("plan", "p", [])
    with pytest.raises(ValueError, match="budget"):
        wf.Runner(wf.Canned({}), {}, max_bytes=5).run("plan", "p", [{"a": "long enough"}])


def test_paths_models_settings():
    assert wf.contained("/r", "a/../b/./c") == "/r/b/c"
    for bad in ("../x", "/etc", "a/../../x"):
        with pytest.raises(ValueError, match="leaves"):
            wf.contained("/r", bad)
    assert wf.choose_model({"default": "m"}, "writer", frozenset(["m"]), "n") == "n"
    with pytest.raises(ValueError, match="surrounding"):
        search.Settings(surrounding=3)


def test_context_guards(spark):
    stored = spark.createDataFrame([("s", "k", "x", ["b0"])], "source_id string, cache_key string, generated string, block_ids array<string>")
    blocks = spark.createDataFrame([("s", "b0")], "source_id string, block_id string")
    assert wf.add_context(stored, stored, blocks).count() == 1
    for other in ([("s", "k", "y", ["b0"])], [("s", "n", "y", ["b9"])]):
        with pytest.raises(Exception, match="other content|unknown block"):
            wf.add_context(stored, spark.createDataFrame(other, stored.schema), blocks).collect()


def test_search_never_falls_back_silently(spark):
    p = spark.createDataFrame([("s", 0, "c0", 0, 10, "alpha beta"), ("t", 0, "c0", 0, 10, "alpha beta"), ("t", 1, "c1", 10, 14, " end")], "source_id string, chunk_no int, chunk_id string, start_at int, end_at int, chunk_text string")
    q = spark.createDataFrame([(1, "alpha")], "query_id int, query string")
    from spanforge.operators import retrieval

    assert search.search(p, q).count() == 0
    got = {r.source_id: r for r in search.search(p, q, score=retrieval.overlap_score).collect()}
    assert set(got) == {"s", "t"} and got["s"].place == 1 and {r.retrieval_status for r in got.values()} == {"ready"}
    assert [u.text for u in got["t"].units] == ["alpha beta", " end"] and got["t"].status == "complete_window"
    plain = search.search(p, q, search.Settings(mode="degraded_lexical")).collect()
    assert len(plain) == 2 and plain[0].retrieval_status == "degraded_lexical" and plain[0].score is None
    found = search.originals(search.search(p, q, score=retrieval.overlap_score)).collect()
    assert sorted((r.source_id, len(r.passages)) for r in found) == [("s", 1), ("t", 2)]
    assert search.search_evidence(p, "beta", source_id="t").count() == 1
    with pytest.raises(ValueError, match="not supported"):
        search.search_evidence(p, "beta", embedding_model="m")


def test_context_finds_a_passage_and_is_never_scored(spark):
    from spanforge.operators import retrieval

    p = spark.createDataFrame([("s", 0, "c0", 0, 10, "alpha beta", "about gamma", "Title Issuer")], "source_id string, chunk_no int, chunk_id string, start_at int, end_at int, chunk_text string, context string, identity_text string")
    q = spark.createDataFrame([(1, "gamma")], "query_id int, query string")
    got = search.search(p, q, score=retrieval.overlap_score).collect()
    assert len(got) == 1 and got[0].score == 0.0 and got[0].units[0].text == "alpha beta"


def test_hybrid_candidates_need_the_texts_that_were_embedded(spark):
    p = spark.createDataFrame([("s", 0, "c0", 0, 5, "alpha"), ("t", 0, "c0", 0, 4, "beta")], "source_id string, chunk_no int, chunk_id string, start_at int, end_at int, chunk_text string")
    units = spark.createDataFrame([(1, "s", "c0", "alpha", [1.0, 0.0]), (2, "t", "c0", "beta", [0.0, 1.0])], "unit_id int, source_id string, chunk_id string, t string, embedding array<double>").withColumn("text_hash", F.sha2("t", 256))
    q = spark.createDataFrame([(1, "alpha", None), (2, "beta", "s")], "query_id int, query string, scope string")
    embed = lambda c: F.array(F.when(c == "alpha", 1.0).otherwise(0.1), F.lit(0.5))
    got = search.hybrid(units, embed, 2)(p, q, 10).collect()
    assert sorted((r.query_id, r.source_id, r.rank_lexical, r.rank_dense) for r in got) == [(1, "s", 1, 1), (1, "t", None, 2), (2, "s", None, 1)]
    with pytest.raises(Exception, match="does not match"):
        search.hybrid(units.withColumn("text_hash", F.lit("x")), embed, 2)(p, q, 10).collect()


def test_surrounding_passages(spark):
    p = spark.createDataFrame([("s", i, f"c{i}", i * 5, i * 5 + 5, f"text{i}") for i in range(4)], "source_id string, chunk_no int, chunk_id string, start_at int, end_at int, chunk_text string")
    f = spark.createDataFrame([("s", "c1")], "source_id string, chunk_id string")
    ids = lambda n, **k: sorted(r.passage_id for r in search.surrounding_passages(p, f, n, **k).collect())
    assert ids(0) == ["c1"] and ids(1) == ["c0", "c1", "c2"] and ids(2) == ["c0", "c1", "c2", "c3"]
    with pytest.raises(Exception, match="not complete"):
        ids(1, max_characters=7)
    with pytest.raises(ValueError, match="0..2"):
        ids(3)
