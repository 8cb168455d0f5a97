"""The search API: candidates, reading windows, bounded views, scores, uncovered blocks, grouped originals."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.functions import text as T
from spanforge.operators import evidence, intervals, reading, retrieval
from spanforge.operators import views as token_views

Scorer = Callable[[Column, Column], Column]
#: Candidates of each query: (passages, queries, limit) to query_id, source_id, chunk_id, rank.
Provider = Callable[[DataFrame, DataFrame, int], DataFrame]


@dataclass(frozen=True)
class Settings:
    """Limits of a search, checked on construction (SC17)."""

    candidate_limit: int = 64
    retrieval_limit: int = 6
    window_characters: int = 8000
    surrounding: int = 1
    view_characters: int = 4000
    mode: str = "reranked"

    def __post_init__(self) -> None:
        for name, low, high in (("candidate_limit", 1, 512), ("retrieval_limit", 1, 64), ("window_characters", 200, 200_000), ("surrounding", 0, 2), ("view_characters", 100, 200_000)):
            if not low <= getattr(self, name) <= high:
                raise ValueError(f"{name} must be {low}..{high}")
        if self.mode not in ("reranked", "degraded_lexical"):
            raise ValueError("mode must be reranked or degraded_lexical")


def scoped(queries: DataFrame, sources: DataFrame) -> DataFrame:
    """Queries with the scope that they name inline (PR11, FI1): two scopes, or an unknown one, are an error."""
    q = queries.withColumn("s", T.inline_scope("query"))
    one = F.when(F.size("s.scopes") <= 1, F.get("s.scopes", 0)).otherwise(F.raise_error(F.lit("several scopes in one query")))
    q = q.select("query_id", F.col("s.query").alias("query"), one.alias("scope"))
    known = q.join(sources.select(F.col("source_id").alias("known")).distinct(), F.col("scope") == F.col("known"), "left")
    return known.select("query_id", "query", F.when(F.col("scope").isNull() | F.col("known").isNotNull(), F.col("scope")).otherwise(F.raise_error(F.lit("unknown source"))).alias("scope"))


def lexical(passages: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """The provider without vectors; a ``scope`` column of the queries restricts each to a source."""
    if "scope" not in queries.columns:
        return retrieval.lexical(passages, queries, limit)
    some = retrieval.lexical(passages, queries.where("scope is not null"), limit, scope="scope")
    return some.unionByName(retrieval.lexical(passages, queries.where("scope is null"), limit))


def hybrid(units: DataFrame, embed: Callable[[Column], Column], dimension: int) -> Provider:
    """Provider that fuses lexical ranks with those of vectors (UF3, UF4, CP3), both to the same depth.

    ``units``: unit_id, source_id, chunk_id, text_hash, embedding; ``embed`` turns the query text into a vector.
    """

    def provide(passages: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
        asked = queries.select("query_id", embed(F.col("query")).alias("query_embedding"), (F.col("scope") if "scope" in queries.columns else F.lit(None)).alias("query_scope"))
        asked = asked.where(T.valid_vector("query_embedding", dimension))
        vectors = units.select("unit_id", "embedding", F.col("source_id").alias("scope"))
        parts = [retrieval.dense(vectors, asked.where("query_scope is null"), limit, False, dimension)]
        if "scope" in queries.columns:
            parts.append(retrieval.dense(vectors, asked.where("query_scope is not null"), limit, True, dimension))
        hits = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        branches = {"lexical": lexical(passages, queries, limit), "dense": retrieval.hydrated(hits, units, passages)}
        return retrieval.fuse(branches, ["source_id", "chunk_id"], limit)

    return provide


def units_of(passages: DataFrame) -> DataFrame:
    """Passages as reading units, each a group of its own, for a corpus without finer structure."""
    return passages.select("source_id", F.col("chunk_no").cast("int").alias("unit_no"), F.col("chunk_no").cast("int").alias("group_no"), "start_at", "end_at", F.col("chunk_text").alias("unit_text"), F.lit("paragraph").alias("kind"))


def blocks(pool: DataFrame, passages: DataFrame, units: DataFrame, settings: Settings, index: DataFrame | None = None) -> DataFrame:
    """A reading window around each candidate (UD2, CP5): its units' texts and references, and the window's status.

    Windows are built once for each place, however many queries propose it, or taken from an ``index`` of
    the same window size (source_id, focus_no, units, status). Only passages and units of the sources of the pool are
    joined: of a pool that is a written table, they are told in place, and no text of another source is shuffled.
    """
    sources = pool.select("source_id").distinct()
    passages, units = (df.join(sources, "source_id", "left_semi") for df in (passages, units))
    wanted = pool.select("source_id", "chunk_id").distinct().join(passages.select("source_id", "chunk_id", F.col("start_at").alias("point")), ["source_id", "chunk_id"])
    bounds = units.select("source_id", F.col("unit_no").alias("focus_no"), F.col("start_at").alias("unit_start"), F.col("end_at").alias("unit_end"))
    focus = intervals.containing(wanted, bounds, "source_id").select(F.struct("source_id", "focus_no").alias("focus_id"), "source_id", "focus_no", "chunk_id", "point")
    places = focus.select("focus_id", "source_id", "focus_no").distinct()
    if index is None:
        around = reading.windows(units, places, "source_id", settings.window_characters, settings.surrounding)
    else:
        around = places.join(index.select("source_id", "focus_no", "units", "status"), ["source_id", "focus_no"])
    texts = units.select("source_id", "unit_no", F.struct("unit_no", F.col("unit_text").alias("text"), "start_at", "end_at", "kind").alias("unit"))
    held = around.select("focus_id", "source_id", "status", F.explode("units").alias("unit_no")).join(texts, ["source_id", "unit_no"])
    held = held.groupBy("focus_id", "status").agg(F.array_sort(F.collect_list("unit")).alias("units"))
    name = lambda u: F.sha2(F.concat_ws(":", F.col("source_id").cast("string"), u["start_at"].cast("string"), u["end_at"].cast("string")), 256)
    out = focus.join(held, "focus_id").withColumn("refs", F.transform("units", name))
    return out.select("source_id", "chunk_id", "point", "status", "units", "refs", T.digest(F.array_join("refs", ",")).alias("block_id"))


def sentenced(candidates: DataFrame) -> DataFrame:
    """Candidates with the ``whole`` text of their block and its ``sentences``, one of which holds the point."""
    marked = F.transform("units", lambda u: F.struct(u["text"].alias("text"), u["start_at"].alias("start_at"), u["kind"].alias("kind"), F.lit(False).alias("required")))
    whole = F.array_join(F.transform("units", lambda u: u["text"]), "\n")
    return candidates.withColumn("sentences", reading.view_units(marked, F.col("point"))).withColumn("whole", whole)


def search(passages: DataFrame, queries: DataFrame, settings: Settings = Settings(), units: DataFrame | None = None, provider: Provider = lexical, score: Scorer | None = None, trace: str | None = None, index: DataFrame | None = None, counter: Callable[[], token_views.Counter] | None = None) -> DataFrame:
    """Selected reading blocks of every query (CP1, CP3) with ``retrieval_status``.

    ``passages``: source_id, chunk_no, chunk_id, start_at, end_at, chunk_text, optionally ``context`` (finds, is never
    scored or returned) and ``identity_text``; ``units``: source_id, unit_no, group_no, start_at, end_at, unit_text, kind.
    Without a scorer nothing is selected and the status is ``reranker_unavailable``: lexical order
    stands in only where the mode is ``degraded_lexical``. With ``trace``, a new folder that all
    executors see, candidates and scores are written there (SK4), and read for what follows. With ``index``, the
    rows of a reading index of this window size, windows are looked up there and not built. ``counter`` makes the counter
    that views are bounded by (UD4), once a task; without one ``view_characters`` are code points.
    """

    def traced(df: DataFrame, name: str) -> DataFrame:
        if trace is None:
            return df
        df.write.parquet(f"{trace}/{name}")
        return df.sparkSession.read.schema(df.schema).parquet(f"{trace}/{name}")

    units = units_of(passages) if units is None else units
    pool = traced(provider(passages, queries, settings.candidate_limit).select("query_id", "source_id", "chunk_id", F.col("rank").alias("place")), "pool")
    identity = passages.select("source_id", "chunk_id", F.coalesce("identity_text", F.lit("")).alias("identity")) if "identity_text" in passages.columns else None
    windows = blocks(pool, passages, units, settings, index)
    c = pool.join(windows, ["source_id", "chunk_id"]).join(queries.select("query_id", "query"), "query_id")
    c = c.join(identity, ["source_id", "chunk_id"]) if identity is not None else c.withColumn("identity", F.lit(""))
    c = traced(c, "candidates")
    if settings.mode == "degraded_lexical":
        ranked = c.select("query_id", "place", F.lit(None).cast("double").alias("score"), F.col("place").alias("rank"))
        status = "degraded_lexical"
    elif score is None:
        ranked = c.limit(0).select("query_id", "place", F.lit(None).cast("double").alias("score"), F.col("place").alias("rank"))
        status = "reranker_unavailable"
    else:
        viewed = token_views.with_views(sentenced(c), settings.view_characters, counter or (lambda: token_views.characters))
        ranked = retrieval.rerank(viewed, score)
        status = "ready"
    ranked = traced(ranked, "scores")
    kept = retrieval.select_uncovered(ranked.join(c.select("query_id", "place", "refs"), ["query_id", "place"]), settings.retrieval_limit)
    chosen = kept.select("query_id", F.explode("kept").alias("rank")).join(ranked.select("query_id", "place", "score", "rank"), ["query_id", "rank"])
    out = chosen.join(c, ["query_id", "place"])
    return out.select("query_id", "source_id", "chunk_id", "score", F.col("rank").alias("place"), "block_id", "status", "refs", "units", F.lit(status).alias("retrieval_status"))


def originals(selected: DataFrame) -> DataFrame:
    """What a search returns of each source: every original once, in order of the text (AG2, ST7)."""
    each = selected.select("query_id", "source_id", F.explode(F.arrays_zip("refs", "units")).alias("x")).select("query_id", "source_id", "x.refs", "x.units.*")
    once = each.groupBy("query_id", "source_id", "refs").agg(F.first(F.struct("unit_no", "start_at", "end_at", "text")).alias("p"))
    return once.groupBy("query_id", "source_id").agg(F.array_sort(F.collect_list("p")).alias("passages"))


def surrounding_passages(passages: DataFrame, focus: DataFrame, surrounding: int = 0, max_characters: int = 8000) -> DataFrame:
    """Passages around each (source_id, chunk_id) of ``focus`` (CP5): none but itself for 0; for 1 or 2 those of a
    complete window in order, and an error if the window is not complete."""
    if surrounding not in (0, 1, 2):
        raise ValueError("surrounding must be 0..2")
    place = ["source_id", "chunk_id"]
    if surrounding == 0:
        return focus.select(*place).join(passages, place).select(*place, F.col("chunk_id").alias("passage_id"), "start_at", "chunk_text")
    units = units_of(passages)
    at = focus.select(*place).join(passages.select(*place, F.col("chunk_no").cast("int").alias("focus_no")), place).withColumn("focus_id", F.struct(*place))
    got = reading.windows(units, at.select("focus_id", "source_id", "focus_no"), "source_id", max_characters, surrounding)
    complete = F.when(F.col("status") == "complete_window", F.col("units")).otherwise(F.raise_error(F.lit("the window is not complete")))
    each = got.select("focus_id.source_id", "focus_id.chunk_id", F.explode(complete).alias("chunk_no"))
    return each.join(passages.select("source_id", F.col("chunk_no").cast("int").alias("chunk_no"), F.col("chunk_id").alias("passage_id"), "start_at", "chunk_text"), ["source_id", "chunk_no"]).select(*place, "passage_id", "start_at", "chunk_text")


def search_evidence(passages: DataFrame, query: str, limit: int = 6, source_id: str | None = None, embedding_model: str | None = None) -> DataFrame:
    """Plain lexical search (CP2)."""
    if embedding_model is not None:
        raise ValueError("adding embedding scores is not supported")
    scope = passages if source_id is None else passages.where(F.col("source_id") == source_id)
    q = passages.sparkSession.createDataFrame([(0, query)], "query_id long, query string")
    return retrieval.lexical(scope, q, limit).join(passages, ["source_id", "chunk_id"]).orderBy("rank")
