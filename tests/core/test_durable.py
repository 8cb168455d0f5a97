"""Durable tables: what a run leaves, what a failed run does not, and indexes that rebuild only what changed."""

import pytest
from pyspark.sql import functions as F

from spanforge.operators import reading_index, retrieval, settled
from spanforge.plans import search as api
from spanforge.sources.durable import Durable
from spanforge.sources.tables import shared

SCHEMA = "ref string, seq long, text string, origin string"


def state_of(table):
    return sorted(tuple(r) for r in table.rows().collect())


def test_settling_twice_leaves_one_state(spark):
    first = spark.createDataFrame([("a", 1, "A", "one"), ("b", 2, "B", "one"), ("c", 3, "C", "one")], SCHEMA)
    more = spark.createDataFrame([("b", 12, "B", "two"), ("d", 13, "D", "two")], SCHEMA)
    state = Durable(spark, shared(spark), "ref", first.schema, buckets=16)
    assert state.version == 0 and state_of(state) == []
    settled.settle(state, first)
    assert settled.settle(state, more) <= 2 and state.version == 2  # only the buckets of two references
    wanted = [("a", 1, "A", "one"), ("b", 2, "B", "two"), ("c", 3, "C", "one"), ("d", 13, "D", "two")]
    assert state_of(state) == wanted
    settled.settle(state, more)
    assert state_of(state) == wanted
    # another text at a locator is refused, and the state stays as it was
    with pytest.raises(Exception, match="two texts"):
        settled.settle(state, spark.createDataFrame([("a", 20, "other", "x"), ("e", 21, "E", "x")], SCHEMA))
    assert state_of(state) == wanted and settled.settle(state, more.limit(0)) == 0
    # the same table, opened again
    assert state_of(Durable(spark, state.path, "ref", first.schema, buckets=16)) == wanted


def test_a_version_has_one_writer(spark, monkeypatch):
    rows = spark.createDataFrame([("a", 1, "A", "one")], SCHEMA)
    state = Durable(spark, shared(spark), "ref", rows.schema)
    settled.settle(state, rows)
    monkeypatch.setattr(Durable, "version", property(lambda self: 0))
    with pytest.raises(Exception, match="exists"):
        settled.settle(state, rows)


def test_buckets_become_empty(spark):
    rows = spark.createDataFrame([("a", 1, "A", "one"), ("b", 2, "B", "one")], SCHEMA)
    state = Durable(spark, shared(spark), "ref", rows.schema, buckets=1)
    settled.settle(state, rows)
    state.upsert(rows.select("ref"), lambda old: old.limit(0))
    assert state_of(state) == [] and state.version == 2
    settled.settle(state, rows)
    assert len(state_of(state)) == 2


def test_bundles_are_set_once(spark):
    known = spark.createDataFrame([("a",), ("b",)], "ref string")
    schema = "bundle_id long, refs array<string>, adequacy string"
    state = Durable(spark, shared(spark), "bundle_id", spark.createDataFrame([], schema).schema)
    settled.settle_bundles(state, spark.createDataFrame([(1, ["a"], "unassessed")], schema), known)
    settled.settle_bundles(state, spark.createDataFrame([(1, ["a"], "adequate"), (2, ["a", "b"], "adequate")], schema), known)
    assert state_of(state) == [(1, ["a"], "unassessed"), (2, ["a", "b"], "adequate")]
    with pytest.raises(ValueError, match="unavailable"):
        settled.settle_bundles(state, spark.createDataFrame([(3, ["z"], "adequate")], schema), known)


def passages(spark, change=()):
    rows = [(s, n, f"c{n}", 50 * n, 50 * n + 50, f"source {s} part {n} {'new' if s in change else 'old'} word{s}x{n}") for s in range(8) for n in range(1 + s)]
    return spark.createDataFrame(rows, "source_id long, chunk_no int, chunk_id string, start_at int, end_at int, chunk_text string")


def test_a_refresh_builds_changed_sources_only_and_searches_read_it(spark):
    path = shared(spark)
    _, changed = reading_index.refresh(api.units_of(passages(spark)), path)
    assert changed.count() == 8
    now = passages(spark, change=(3, 5)).where("source_id <> 7")
    index, changed = reading_index.refresh(api.units_of(now), path)
    assert sorted((r.source_id, r.version is None) for r in changed.collect()) == [(3, False), (5, False), (7, True)]
    assert reading_index.refresh(api.units_of(now), path)[1].count() == 0 and index.version == 2
    whole, _ = reading_index.refresh(api.units_of(now), shared(spark))
    every = lambda i: sorted((r.source_id, r.focus_no, r.units, r.status, r.version) for r in i.rows().collect())
    assert every(index) == every(whole) and len(every(index)) == sum(range(1, 8))
    assert reading_index.refresh(api.units_of(now), path, reading_index.Window(reach=0))[1].count() == 7  # another window is another index

    queries = spark.createDataFrame([(1, "word3x2 new"), (2, "part old"), (3, "word6x6")], "query_id long, query string")
    settings = api.Settings(window_characters=8000, surrounding=1)
    seen = lambda i: sorted((r.query_id, r.place, r.source_id, r.chunk_id, r.refs, r.status) for r in api.search(now, queries, settings, score=retrieval.overlap_score, index=i).collect())
    assert seen(index.rows()) == seen(None) and len(seen(None)) > 5


def test_an_empty_index(spark):
    index, changed = reading_index.refresh(api.units_of(passages(spark).limit(0)), shared(spark))
    assert changed.count() == 0 and index.rows().count() == 0
    assert index.rows().select(F.size("units")).count() == 0


def test_texts_are_told_apart_by_digests_and_written_where_they_lie(spark, tmp_path):
    """A row in the shuffle held its text three times, and merged rows were dealt once more before they were written."""
    from spanforge.operators import evidence

    rows = spark.createDataFrame([(f"r{i}", i, f"text {i}") for i in range(40)], "ref string, seq long, text string")
    plan = evidence.union_by_ref(rows, rows)._jdf.queryExecution().toString()
    assert "min(text" not in plan and "max(text" not in plan
    state = Durable(spark, str(tmp_path / "t"), "ref", rows.schema, buckets=2)
    state.upsert(rows.select("ref"), lambda old: rows.coalesce(1))
    files = {f.rpartition("/")[0]: 0 for f in state.rows().inputFiles()}
    assert len(files) == 2 == len(state.rows().inputFiles()) and sorted(map(tuple, state.rows().collect())) == sorted(map(tuple, rows.collect()))
