"""Small records around evidence: identities, bindings, omissions, requests, handoffs and lifecycles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.functions import text as T


def concise(passages: DataFrame, identity: tuple[str, ...] = ("source_id", "version")) -> DataFrame:
    """Identity, chunk, text and bare spans of a passage (PR6); other fields are left out."""
    spans = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["page"].alias("page")))
    return passages.select(*identity, "chunk_id", "text", spans.alias("spans"))


def identity_text(title: Column, issuer: Column) -> Column:
    """``title issuer`` with the blank kept where one is missing (PR8)."""
    return F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(issuer, F.lit("")))


def source_context(sources: DataFrame, annotations: DataFrame, chunks: DataFrame) -> DataFrame:
    """Sources with their annotations as a map (PR7). A value that does not occur in the chunk it names is an error.

    ``annotations``: source_id, name, value, chunk_id; ``chunks``: source_id, chunk_id, chunk_text.
    """
    held = annotations.join(chunks.select("source_id", "chunk_id", "chunk_text"), ["source_id", "chunk_id"], "left")
    there = F.coalesce(F.contains("chunk_text", "value"), F.lit(False))
    value = F.when(there, F.col("value")).otherwise(F.raise_error(F.concat(F.lit("annotation is not in its chunk: "), "name")))
    per = held.groupBy("source_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", value.alias("value"))))).alias("annotations"))
    return sources.join(per, "source_id", "left")


def with_context(passages: DataFrame, stored: DataFrame) -> DataFrame:
    """Passages with the generated navigation text of their source, null if there is none (CP8)."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("cache_key", "generated"))), lambda x: x["generated"])
    per = stored.groupBy("source_id").agg(F.array_join(texts, "\n").alias("context"))
    return passages.join(per, "source_id", "left")


def bindings(chunks: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Chunk metadata by the digest of its canonical form (JN17): ``binding``, ``meta``."""
    meta = F.to_json(F.struct(*sorted(fields)))
    return chunks.select(T.digest(meta).alias("binding"), meta.alias("meta")).distinct()


def anchor_problems(units: DataFrame, blocks: DataFrame, key: str = "source_id") -> DataFrame:
    """Units whose block is missing or does not hold them (JN8): ``problem``."""
    held = units.join(blocks.select(key, "block_id", F.col("start_at").alias("block_start"), F.col("end_at").alias("block_end")), [key, "block_id"], "left")
    problem = F.when(F.col("block_start").isNull(), "unknown block").when((F.col("unit_start") < F.col("block_start")) | (F.col("unit_end") > F.col("block_end")), "unit outside its block")
    return held.withColumn("problem", problem).where("problem is not null").drop("block_start", "block_end")


def omitted(every: DataFrame, selected: DataFrame, on: list[str]) -> DataFrame:
    """What there is and was not selected (ST4)."""
    return every.join(selected.select(*on).distinct(), on, "left_anti")


def required_refs(bundles: DataFrame, key: str = "stage_id") -> DataFrame:
    """Sorted union of the references that a stage must get (ST6)."""
    return bundles.groupBy(key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("refs")))).alias("refs"))


def same_sets(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Whether two sides hold the same set of values for each key (ST8)."""
    side = lambda df, name: df.select(key, value).distinct().withColumn(name, F.lit(True))
    both = side(left, "l").join(side(right, "r"), [key, value], "full_outer")
    return both.groupBy(key).agg(F.bool_and(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("same"))


def bounded_tasks(tasks: DataFrame, key: str, most: int = 12) -> DataFrame:
    """A plan's tasks; a plan of more than ``most`` is an error (TK7)."""
    n = F.count("*").over(Window.partitionBy(key))
    ok = F.when(n <= most, F.col(key)).otherwise(F.raise_error(F.lit("a plan has too many tasks")))
    return tasks.withColumn(key, ok)


def column_widths(cells: DataFrame, key: str, column: str, text: str) -> DataFrame:
    """Upper median of the cell lengths of each column, at least 1, and its share of the row (AG17)."""
    lengths = cells.groupBy(key, column, F.length(F.coalesce(text, F.lit(""))).alias("size")).agg(F.count("*").alias("n"))
    line = Window.partitionBy(key, column)
    # cells up to each length, of as many rows as there are lengths
    ranked = lengths.withColumn("upto", F.sum("n").over(line.orderBy("size"))).withColumn("half", F.floor(F.sum("n").over(line) / 2))
    per = ranked.where(F.col("upto") > F.col("half")).groupBy(key, column).agg(F.greatest(F.lit(1), F.min("size")).alias("width"))
    return per.withColumn("share", F.col("width") / F.sum("width").over(Window.partitionBy(key)))


def plans_within(tasks: DataFrame, key: str, limit: int = 12) -> DataFrame:
    """Plans with the number of their tasks, and whether that is within the limit (TK7): a row for each plan."""
    return tasks.groupBy(key).agg(F.count("*").alias("n_tasks")).withColumn("accepted", F.col("n_tasks") <= limit)


#: Fields of earlier stages that a stage does not read again.
UNREAD = {"review": ("trace", "usage", "searches"), "revision": ("trace", "usage", "searches", "evidence", "omitted")}


def pruned(inputs: DataFrame, stage: str) -> DataFrame:
    """Inputs of a stage without the fields it does not read (PR23); the scan below drops them as well."""
    return inputs.drop(*UNREAD.get(stage, ()))


def selection_manifest(packed: DataFrame, sizes: DataFrame, frame_bytes: int = 0) -> DataFrame:
    """What each stage was sent (SK5): counts, digest of the selected references, bytes of the request (CP10).

    ``packed``: stage_id, ref, selected; ``sizes``: ref, n_bytes.
    """
    held = packed.join(sizes.select("ref", "n_bytes"), "ref")
    refs = F.array_sort(F.collect_list(F.when(F.col("selected"), F.col("ref"))))
    return held.groupBy("stage_id").agg(
        F.count_if("selected").alias("n_selected"),
        F.count_if(~F.col("selected")).alias("n_omitted"),
        T.digest(F.array_join(refs, ",")).alias("selection_sha256"),
        (F.coalesce(F.sum(F.when(F.col("selected"), F.col("n_bytes"))), F.lit(0)) + frame_bytes).alias("request_bytes"),
    )


def framed(stage: Column, inputs: Column, evidence: Column, schema: str) -> Column:
    """A request as canonical JSON, and its bytes with those of the output schema (CP10): ``body``, ``n_bytes``."""
    body = F.concat(F.lit('{"evidence": '), evidence, F.lit(', "inputs": '), inputs, F.lit(', "stage": '), T.json_string(stage), F.lit("}"))
    return F.struct(body.alias("body"), (F.octet_length(body) + len(schema.encode())).alias("n_bytes"))


def collected(stages: DataFrame, evidence: DataFrame, selected: DataFrame, searches: DataFrame, bundles: DataFrame) -> DataFrame:
    """What a run hands on of each stage (UD14): lineage hash, evidence, omissions, prior searches and required references.

    ``stages``: stage_id, input_hash, result_hash; ``evidence``, ``selected``: stage_id, ref; ``searches``: stage_id, seq,
    query; ``bundles``: stage_id, refs. Every field is an array in a fixed order.
    """
    refs = lambda df, name: df.groupBy("stage_id").agg(F.array_sort(F.collect_set("ref")).alias(name))
    asked = F.transform(F.array_sort(F.collect_list(F.struct("seq", "query"))), lambda x: x["query"])
    out = stages.select("stage_id", T.digest(F.concat_ws(":", "stage_id", "input_hash", "result_hash")).alias("lineage"))
    parts = (refs(evidence, "evidence"), refs(omitted(evidence, selected, ["stage_id", "ref"]), "omissions"), searches.groupBy("stage_id").agg(asked.alias("searches")), required_refs(bundles).withColumnRenamed("refs", "required"))
    for part in parts:
        out = out.join(part, "stage_id", "left")
    none = F.expr("cast(array() as array<string>)")
    return out.select("stage_id", "lineage", *(F.coalesce(c, none).alias(c) for c in ("evidence", "omissions", "searches", "required")))


def bundle_import(manifest: DataFrame, files: DataFrame, version: int = 1, parts: int = 3) -> DataFrame:
    """Files of an evidence bundle (SC15): another schema version, another number of parts, or a digest that is not the
    bound one is an error. ``manifest``: bundle_id, schema_version, path, digest; ``files``: bundle_id, path, body."""
    w = Window.partitionBy("bundle_id")
    held = manifest.withColumn("parts", F.count("*").over(w)).join(files.withColumn("found", F.sha2("body", 256)), ["bundle_id", "path"], "left")
    fault = F.when(F.col("schema_version") != version, "unknown schema version").when(F.col("parts") != parts, "bundle is not complete").when(~F.col("found").eqNullSafe(F.col("digest")), "file is not the bound one")
    return held.select("bundle_id", F.when(fault.isNull(), F.col("path")).otherwise(F.raise_error(fault)).alias("path"), "body")


def lifecycle(events: DataFrame, key: str = "ledger_id", order: str = "seq") -> DataFrame:
    """Lifecycle of ledgers (CP15): what each event finds and whether it is allowed.

    ``events``: ``kind`` ("initialize", "start", "disable", "call"), ``limits``, ``provider``. A ledger is created once;
    again only with the same limits; nothing else goes before it, no call before the start; a
    provider that was disabled stays so.
    """
    w = Window.partitionBy(key).orderBy(order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    limits = F.first(F.when(F.col("kind") == "initialize", F.col("limits")), ignorenulls=True).over(before)
    started = F.coalesce(F.max((F.col("kind") == "start").cast("int")).over(before) == 1, F.lit(False))
    off = F.max(F.when(F.col("kind") == "disable", 1).otherwise(0)).over(Window.partitionBy(key, "provider").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    e = events.select("*", limits.alias("set_limits"), started.alias("started"), F.coalesce(off == 1, F.lit(False)).alias("disabled"))
    problem = (
        F.when((F.col("kind") == "initialize") & F.col("set_limits").isNotNull() & (F.col("set_limits") != F.col("limits")), "other limits")
        .when((F.col("kind") != "initialize") & F.col("set_limits").isNull(), "not initialized")
        .when((F.col("kind") == "call") & ~F.col("started"), "not started")
        .when((F.col("kind") == "call") & F.col("disabled"), "provider disabled")
    )
    return e.withColumn("problem", problem)


def installed(models: DataFrame, slug: str) -> DataFrame:
    """Models of exactly this slug that the catalogue lists (SC16). ``models``: raw JSON in ``entry``."""
    m = models.select(F.from_json("entry", "slug string, visibility string").alias("m")).select("m.*")
    return m.where((F.col("slug") == slug) & (F.col("visibility") == "list"))


def provider_events(raw: Column) -> Column:
    """An event line of a provider as (type, text, exhausted) (CP21): lines that are no JSON are ``unparsed``; a used-up
    quota is told by its words."""
    e = F.from_json(raw, "type string, text string, error string")
    type_ = F.coalesce(e["type"], F.lit("unparsed"))
    text = F.coalesce(e["text"], e["error"], F.when(e["type"].isNull(), raw))
    return F.struct(type_.alias("type"), text.alias("text"), F.coalesce(F.lower(text).rlike("usage limit|quota|rate limit"), F.lit(False)).alias("exhausted"))


def report_sources(reports: DataFrame, cited: DataFrame, sources: DataFrame) -> DataFrame:
    """Sources of each report (PR18): aliases S1… in the order of citation, labels, and those cited that are missing.

    ``reports``: report_id, made_at; ``cited``: report_id, seq, source_id; ``sources``: source_id, label.
    """
    first = cited.groupBy("report_id", "source_id").agg(F.min("seq").alias("seq")).join(sources.select("source_id", "label"), "source_id", "left")
    w = Window.partitionBy("report_id").orderBy("seq", "source_id")
    known = first.where("label is not null").withColumn("alias", F.concat(F.lit("S"), F.row_number().over(w).cast("string")))
    lines = known.groupBy("report_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "alias", "label"))), lambda x: F.concat_ws(" · ", x["alias"], x["label"])), "\n").alias("lines"), F.count("*").alias("n"))
    missing = first.where("label is null").groupBy("report_id").agg(F.array_sort(F.collect_set("source_id")).alias("missing"))
    out = reports.join(lines, "report_id", "left").join(missing, "report_id", "left")
    n = F.coalesce("n", F.lit(0))
    return out.select("report_id", F.coalesce("lines", F.lit("")).alias("lines"), F.coalesce(F.col("missing").cast("array<string>"), F.expr("cast(array() as array<string>)")).alias("missing"), F.concat(F.lit("Sources: "), n.cast("string"), F.lit(" · "), "made_at").alias("metadata"))


def next_open(questions: DataFrame, key: str, rank: Column, question: str) -> DataFrame:
    """The first open question of each run by priority, then id, and how many wait (WN10)."""
    return questions.groupBy(key).agg(F.min_by(question, F.struct(rank, F.col(question))).alias("next"), F.count("*").alias("waiting"))


def delivered(evidence: DataFrame, key: str = "source_id", order: tuple[str, ...] = ("seq", "ref")) -> DataFrame:
    """Evidence with its place in the order of delivery (TK5)."""
    return evidence.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long"))


def previews(omitted: DataFrame, key: str, order: str, n_bytes: str, most: int = 8, capacity: int = 2048) -> DataFrame:
    """The first omitted items that are shown (TK6): at most ``most``, and while their bytes fit."""
    w = Window.partitionBy(key).orderBy(order)
    upto = F.sum(n_bytes).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return omitted.withColumn("k", F.row_number().over(w)).withColumn("upto", upto).where((F.col("k") <= most) & (F.col("upto") <= capacity)).drop("k", "upto")
