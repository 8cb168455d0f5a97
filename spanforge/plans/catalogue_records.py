"""Queries over records around evidence: identities, bindings, omissions, handoffs, lifecycles and report parts."""

from __future__ import annotations

import threading

from pyspark.sql import Window
from pyspark.sql import functions as F

from spanforge.functions import text as T
from spanforge.operators import evidence, reading, reading_index, records, report, retrieval, settled, structure, views, workflow
from spanforge.plans import search as api
from spanforge.plans import supervised
from spanforge.plans.catalogue import CHUNKS, LIMIT, ORACLES, REFS, bundles_of, chunks_of, evidence_rows, items_of, lexical_sql, passages_of, query, read, units_of
from spanforge.sources import ingest
from spanforge.sources.durable import Durable
from spanforge.sources.tables import shared, written

WORD3 = "regexp_extract(text, '([a-z]+)', 1)"


@query(f"WITH {REFS} SELECT doc_id, chunk_id, length(text) AS n_chars, 1::BIGINT AS n_spans, seq % 1000 * {LIMIT} AS first_start FROM ev")
def concise_passages(spark, d):
    c = records.concise(evidence_rows(spark, d), ("doc_id", "source_id", "version"))
    return c.select("doc_id", "chunk_id", F.length("text").cast("long").alias("n_chars"), F.size("spans").cast("long").alias("n_spans"), F.col("spans")[0]["start"].cast("long").alias("first_start"))


@query(f"WITH {CHUNKS} SELECT doc_id AS source_id, 'opening' AS name, substr(chunk_text, 1, 20) AS value FROM chunks WHERE chunk_no = 0")
def source_context(spark, d):
    """Every source with an annotation that must stand in its first chunk."""
    p = passages_of(spark, d)
    notes = p.where("chunk_no = 0").select("source_id", F.lit("opening").alias("name"), F.substr("chunk_text", F.lit(1), F.lit(20)).alias("value"), "chunk_id")
    s = records.source_context(read(spark, d, "documents").where("length(text) > 0").select(F.col("doc_id").alias("source_id")), notes, p)
    return s.select("source_id", F.explode("annotations").alias("name", "value"))


@query("SELECT doc_id, coalesce(source, '') || ' ' || CASE WHEN lang <> 'en' THEN lang ELSE '' END AS identity FROM documents")
def identity_text(spark, d):
    return read(spark, d, "documents").select("doc_id", records.identity_text(F.col("source"), F.when(F.col("lang") != "en", F.col("lang"))).alias("identity"))


@query("SELECT source_id, row_number() OVER (PARTITION BY lang ORDER BY source_id) AS place FROM (SELECT sha256(doc_id::VARCHAR) AS source_id, lang FROM documents)")
def source_list(spark, d):
    """Sources in the order of their ids, numbered within a language (SC5)."""
    s = read(spark, d, "documents").select(F.sha2(F.col("doc_id").cast("string"), 256).alias("source_id"), "lang")
    return s.select("source_id", F.row_number().over(Window.partitionBy("lang").orderBy("source_id")).cast("long").alias("place"))


@query(f"WITH {CHUNKS} SELECT doc_id, string_agg(chunk_id, ',' ORDER BY chunk_no) AS chunk_ids FROM chunks GROUP BY doc_id")
def passages_in_order(spark, d):
    """Passages of every source in chunk order, c2 before c10 (SC7)."""
    c = ingest.passages(chunks_of(spark, d), "doc_id")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("place", "chunk_id"))), lambda x: x["chunk_id"])
    return c.groupBy("doc_id").agg(F.array_join(ordered, ",").alias("chunk_ids"))


@query(f"""WITH {CHUNKS}, u AS (SELECT doc_id, k AS unit_no, k * 700 AS s, least((k + 1) * 700, length(text)) AS e FROM documents, unnest(range(0, (length(text) + 699) // 700)) t(k))
SELECT u.doc_id, unit_no, CASE WHEN c.doc_id IS NULL THEN 'unknown block' ELSE 'unit outside its block' END AS problem FROM u LEFT JOIN chunks c ON c.doc_id = u.doc_id AND c.chunk_no = u.unit_no // 2 WHERE c.doc_id IS NULL OR s < start_at OR e > end_at""")
def unit_anchors(spark, d):
    """Units of 700 characters against the chunk that two of them name."""
    u = units_of(spark, d).withColumn("block_id", F.concat(F.lit("c"), F.floor(F.col("unit_no") / 2).cast("string")))
    b = chunks_of(spark, d).select("doc_id", F.col("chunk_id").alias("block_id"), "start_at", "end_at")
    return records.anchor_problems(u, b, "doc_id").select("doc_id", "unit_no", "problem")


@query(f"""WITH {CHUNKS}, m AS (SELECT DISTINCT '{{"chunk_id":"' || chunk_id || '","end_at":' || end_at || ',"start_at":' || start_at || '}}' AS meta FROM chunks) SELECT sha256(meta) AS binding, meta FROM m""")
def chunk_bindings(spark, d):
    return records.bindings(chunks_of(spark, d), ("start_at", "end_at", "chunk_id"))


@query(f"WITH {REFS} SELECT ref, seq FROM ev WHERE seq % 5 = 0")
def evidence_omitted(spark, d):
    e = evidence_rows(spark, d).select("ref", "seq")
    return records.omitted(e, e.where("seq % 5 <> 0"), ["ref"])


@query(f"WITH {REFS} SELECT doc_id % 40 AS stage_id, count(DISTINCT ref) AS n, sha256(string_agg(DISTINCT ref, ',' ORDER BY ref)) AS refs_sha256 FROM ev GROUP BY 1")
def required_refs(spark, d):
    b = evidence_rows(spark, d).groupBy("doc_id").agg(F.collect_list("ref").alias("refs")).withColumn("stage_id", F.col("doc_id") % 40)
    return records.required_refs(b).select("stage_id", F.size("refs").cast("long").alias("n"), F.sha2(F.array_join("refs", ","), 256).alias("refs_sha256"))


@query("WITH a AS (SELECT user_id, list(DISTINCT event_type ORDER BY event_type) AS s FROM events GROUP BY 1), b AS (SELECT user_id, list(DISTINCT event_type ORDER BY event_type) AS s FROM events WHERE event_id % 3 = 0 GROUP BY 1) SELECT a.user_id, coalesce(a.s = b.s, false) AS same FROM a LEFT JOIN b USING (user_id)")
def index_coverage(spark, d):
    """Whether every event type of a user is among a third of the log."""
    e = read(spark, d, "events")
    return records.same_sets(e, e.where("event_id % 3 = 0"), "user_id", "event_type")


@query("SELECT conv_id, count(*) AS n_tasks, count(*) <= 4 AS accepted FROM conversations GROUP BY conv_id")
def plan_tasks(spark, d):
    """Turns as the tasks of a plan of at most four: longer ones are not accepted."""
    return records.plans_within(read(spark, d, "conversations"), "conv_id", 4)


@query("""WITH s AS (SELECT conv_id, role, list(length(coalesce(text, '')) ORDER BY length(coalesce(text, ''))) AS l FROM conversations GROUP BY ALL), w AS (SELECT conv_id, role, greatest(1, l[len(l) // 2 + 1]) AS width FROM s)
SELECT conv_id, role, width, width / sum(width) OVER (PARTITION BY conv_id) AS share FROM w""")
def column_widths(spark, d):
    """Roles as columns of a table, their turns as cells."""
    return records.column_widths(read(spark, d, "conversations"), "conv_id", "role", "text").withColumn("width", F.col("width").cast("long"))


@query("SELECT doc_id, lang FROM documents")
def pruned_inputs(spark, d):
    """Inputs of a review without what it does not read; the scan reads two columns."""
    e = read(spark, d, "documents").withColumnsRenamed({"text": "trace", "source": "usage", "n_chars": "searches"})
    return records.pruned(e, "review")


@query(f"""WITH {REFS}, p AS (SELECT doc_id % 40 AS stage_id, ref, strlen(text) AS n, seq % 3 <> 0 AS selected FROM ev)
SELECT stage_id, count(*) FILTER (selected) AS n_selected, count(*) FILTER (NOT selected) AS n_omitted, sha256(coalesce(string_agg(ref, ',' ORDER BY ref) FILTER (selected), '')) AS selection_sha256, (coalesce(sum(n) FILTER (selected), 0) + 100)::BIGINT AS request_bytes FROM p GROUP BY 1""")
def selection_manifest(spark, d):
    e = evidence_rows(spark, d).select((F.col("doc_id") % 40).alias("stage_id"), "ref", F.octet_length("text").cast("long").alias("n_bytes"), (F.col("seq") % 3 != 0).alias("selected"))
    return records.selection_manifest(e.drop("n_bytes"), e.select("ref", "n_bytes"), 100)


@query("""SELECT event_id, strlen('{"evidence": [], "inputs": ' || user_id || ', "stage": "' || event_type || '"}') + 13 AS n_bytes, sha256('{"evidence": [], "inputs": ' || user_id || ', "stage": "' || event_type || '"}') AS body_sha256 FROM events""")
def framed_request(spark, d):
    e = read(spark, d, "events").select("event_id", records.framed(F.col("event_type"), F.col("user_id").cast("string"), F.lit("[]"), "answer string").alias("r"))
    return e.select("event_id", F.col("r.n_bytes").cast("long").alias("n_bytes"), F.sha2("r.body", 256).alias("body_sha256"))


@query(f"WITH {CHUNKS} SELECT doc_id AS source_id, chunk_id, CASE WHEN doc_id % 3 = 0 THEN 'about ' || doc_id || chr(10) || 'more' END AS context FROM chunks")
def context_load(spark, d):
    n = read(spark, d, "documents").where("doc_id % 3 = 0").select(F.col("doc_id").alias("source_id"), F.explode(F.array(F.struct(F.lit("a").alias("cache_key"), F.concat(F.lit("about "), F.col("doc_id").cast("string")).alias("generated")), F.struct(F.lit("b").alias("cache_key"), F.lit("more").alias("generated")))).alias("x")).select("source_id", "x.*")
    return records.with_context(passages_of(spark, d), n).select("source_id", "chunk_id", "context")


@query(f"""WITH {REFS}, e AS (SELECT doc_id % 40 AS stage_id, ref, seq, doc_id FROM ev), s AS (SELECT user_id % 40 AS stage_id, sha256(string_agg(event_type, ',' ORDER BY event_id)) AS searches, count(*) AS n_searches FROM events GROUP BY 1),
x AS (SELECT stage_id, count(DISTINCT ref) AS n_evidence, count(DISTINCT ref) FILTER (seq % 4 = 0) AS n_omitted, count(DISTINCT ref) FILTER (doc_id % 2 = 0) AS n_required FROM e GROUP BY 1)
SELECT item_id::VARCHAR AS stage_id, sha256(item_id || ':in:out') AS lineage, coalesce(n_evidence, 0) AS n_evidence, coalesce(n_omitted, 0) AS n_omitted, coalesce(n_required, 0) AS n_required, coalesce(n_searches, 0) AS n_searches, coalesce(searches, sha256('')) AS searches FROM benchmark LEFT JOIN x ON x.stage_id = item_id LEFT JOIN s ON s.stage_id = item_id""")
def handoff_collect(spark, d):
    e = evidence_rows(spark, d).select((F.col("doc_id") % 40).cast("string").alias("stage_id"), "ref", "seq", "doc_id")
    stages = read(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("stage_id"), F.lit("in").alias("input_hash"), F.lit("out").alias("result_hash"))
    searches = read(spark, d, "events").select((F.col("user_id") % 40).cast("string").alias("stage_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("query"))
    bundles = e.where("doc_id % 2 = 0").groupBy("stage_id", "doc_id").agg(F.collect_list("ref").alias("refs"))
    h = records.collected(stages, e.select("stage_id", "ref"), e.where("seq % 4 <> 0").select("stage_id", "ref"), searches, bundles)
    n = lambda c, name: F.size(c).cast("long").alias(name)
    return h.select("stage_id", "lineage", n("evidence", "n_evidence"), n("omissions", "n_omitted"), n("required", "n_required"), n("searches", "n_searches"), F.sha2(F.array_join("searches", ","), 256).alias("searches"))


@query("SELECT conv_id AS bundle_id, turn::VARCHAR AS path, length(text) AS n_chars FROM conversations")
def bundle_import(spark, d):
    """Conversations as bundles of hash-bound files, each as complete as its own manifest says."""
    c = read(spark, d, "conversations")
    files = c.select(F.col("conv_id").alias("bundle_id"), F.col("turn").cast("string").alias("path"), F.col("text").alias("body"))
    manifest = files.select("bundle_id", F.lit(1).alias("schema_version"), "path", F.sha2("body", 256).alias("digest"))
    parts = F.count("*").over(Window.partitionBy("bundle_id"))
    return records.bundle_import(manifest, files, 1, parts).select("bundle_id", "path", F.length("body").cast("long").alias("n_chars"))


@query("""WITH e AS (SELECT user_id, event_id, row_number() OVER w AS k, event_type AS provider, CASE WHEN row_number() OVER w = 1 THEN 'initialize' WHEN row_number() OVER w = 3 THEN 'start' WHEN event_id % 5 = 0 THEN 'disable' ELSE 'call' END AS kind FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
s AS (SELECT *, max((kind = 'disable')::INT) OVER (PARTITION BY user_id, provider ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS off FROM e)
SELECT user_id, event_id, CASE WHEN kind = 'call' AND k < 3 THEN 'not started' WHEN kind = 'call' AND off = 1 THEN 'provider disabled' END AS problem FROM s""")
def ledger_lifecycle(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = read(spark, d, "events").select("user_id", "event_id", F.col("event_type").alias("provider"), F.row_number().over(w).alias("k"))
    kind = F.when(F.col("k") == 1, "initialize").when(F.col("k") == 3, "start").when(F.col("event_id") % 5 == 0, "disable").otherwise("call")
    return records.lifecycle(e.withColumn("kind", kind).withColumn("limits", F.lit("10")), "user_id", "event_id").select("user_id", "event_id", "problem")


@query("SELECT count(*) AS n FROM documents WHERE source = 'src1' AND doc_id % 2 = 0")
def model_lookup(spark, d):
    e = read(spark, d, "documents").select(F.to_json(F.struct(F.col("source").alias("slug"), F.when(F.col("doc_id") % 2 == 0, "list").otherwise("hide").alias("visibility"))).alias("entry"))
    return records.installed(e, "src1").agg(F.count("*").alias("n"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'error' WHEN 1 THEN 'message' ELSE 'unparsed' END AS type, CASE event_id % 3 WHEN 0 THEN 'Usage limit reached' WHEN 1 THEN event_type ELSE 'no json ' || event_id END AS text, event_id % 3 = 0 AS exhausted FROM events""")
def provider_events(spark, d):
    raw = F.when(F.col("event_id") % 3 == 0, '{"type": "error", "error": "Usage limit reached"}').when(F.col("event_id") % 3 == 1, F.to_json(F.struct(F.lit("message").alias("type"), F.col("event_type").alias("text")))).otherwise(F.concat(F.lit("no json "), F.col("event_id").cast("string")))
    return read(spark, d, "events").select("event_id", records.provider_events(raw).alias("e")).select("event_id", "e.*")


@query("""WITH c AS (SELECT user_id AS report_id, event_id % 30 AS source_id, min(event_id) AS seq FROM events GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY seq, source_id) AS n FROM c WHERE source_id % 4 <> 0),
l AS (SELECT report_id, string_agg('S' || n || ' · ' || 'source ' || source_id, chr(10) ORDER BY seq) AS lines, count(*) AS n FROM k GROUP BY 1), m AS (SELECT report_id, string_agg(source_id::VARCHAR, ',' ORDER BY source_id) AS missing FROM c WHERE source_id % 4 = 0 GROUP BY 1)
SELECT r.report_id, coalesce(lines, '') AS lines, coalesce(missing, '') AS missing, 'Sources: ' || coalesce(n, 0) || ' · 2024-01-01' AS metadata FROM (SELECT DISTINCT report_id FROM c) r LEFT JOIN l USING (report_id) LEFT JOIN m USING (report_id)""")
def report_sources(spark, d):
    """Users as reports, their events as citations; every fourth source is missing."""
    e = read(spark, d, "events").select(F.col("user_id").alias("report_id"), F.col("event_id").alias("seq"), (F.col("event_id") % 30).alias("source_id"))
    s = spark.range(30).where("id % 4 <> 0").select(F.col("id").alias("source_id"), F.concat(F.lit("source "), F.col("id").cast("string")).alias("label"))
    r = records.report_sources(e.select("report_id").distinct().withColumn("made_at", F.lit("2024-01-01")), e, s)
    numbers = F.transform(F.array_sort(F.transform("missing", lambda x: x.cast("long"))), lambda x: x.cast("string"))
    return r.select("report_id", "lines", F.array_join(numbers, ",").alias("missing"), "metadata")


@query("SELECT doc_id AS source_id, length(text) + (doc_id % 7 = 0)::INT AS n_chars, doc_id % 7 <> 0 AS valid FROM documents")
def validated_sources(spark, d):
    """Stored texts against the hashes of the day they were stored: some were changed since, and those that were not open."""
    docs = read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("source_id"), "doc_id", "text", F.sha2("text", 256).alias("text_hash"))
    stored = docs.withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    told = ingest.with_validity(stored)
    opened = ingest.validated(told.where("valid")).unionByName(told.where("not valid"))
    return opened.select(F.col("doc_id").alias("source_id"), F.length("text").cast("long").alias("n_chars"), "valid")


@query(f"WITH {CHUNKS} SELECT doc_id AS source_id, chunk_id FROM chunks WHERE doc_id % 10 = 3 OR (doc_id % 10 = 4 AND chunk_no = 0)")
def reverified_evidence(spark, d):
    """Evidence of other versions, and passages that were changed."""
    p = passages_of(spark, d)
    text = F.when((F.col("source_id") % 10 == 4) & (F.col("chunk_no") == 0), F.concat("chunk_text", F.lit("!"))).otherwise(F.col("chunk_text"))
    e = p.select("source_id", "chunk_id", F.when(F.col("source_id") % 10 == 3, "v0").otherwise("v1").alias("version"), text.alias("text"), F.array(F.struct(F.col("start_at").alias("start"), F.col("end_at").alias("end"))).alias("spans"))
    s = read(spark, d, "documents").select(F.col("doc_id").alias("source_id"), F.lit("v1").alias("version"), "text")
    return evidence.reverify(e, s).select("source_id", "chunk_id")


@query(f"""WITH {CHUNKS}, t AS (SELECT doc_id, start_at, end_at FROM chunks WHERE chunk_no % 2 = 0), u AS (SELECT doc_id, k * 700 AS start_at, least((k + 1) * 700, length(text)) AS end_at FROM documents, unnest(range(0, (length(text) + 699) // 700)) x(k)),
n AS (SELECT * FROM u WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.doc_id = u.doc_id AND t.start_at <= u.start_at AND u.end_at <= t.end_at)), a AS (SELECT * FROM t UNION SELECT * FROM n)
SELECT doc_id AS focus_id, count(*) AS n_spans, sum(end_at - start_at)::BIGINT AS used FROM a GROUP BY 1""")
def reading_extended(spark, d):
    """Every second chunk, extended by the units that it does not hold."""
    t = chunks_of(spark, d).where("chunk_no % 2 = 0").select(F.col("doc_id").alias("focus_id"), "start_at", "end_at")
    u = units_of(spark, d).select(F.col("doc_id").alias("focus_id"), F.col("unit_start").alias("start_at"), F.col("unit_end").alias("end_at"))
    return reading.extended(t, u, 10**9).select("focus_id", F.size("spans").cast("long").alias("n_spans"), F.col("used").cast("long").alias("used"))


@query(f"WITH {REFS} SELECT source_id, 'v1' AS version, seq, ref FROM ev")
def evidence_ungroup(spark, d):
    return evidence.ungroup(evidence.group_passages(evidence_rows(spark, d).select("source_id", "version", "seq", "ref")))


@query("SELECT count(*) > 0 AND bool_and(toxic = 0 OR quality = 0) AS accepted FROM labels")
def scope_accepted(spark, d):
    s = read(spark, d, "labels").select(F.when((F.col("toxic") == 0) | (F.col("quality") == 0), "supported").otherwise("unresolved").alias("status"))
    return evidence.accepted(s)


@query("SELECT item_id AS query_id, trim(text) AS query, CASE WHEN item_id % 2 = 0 THEN sha256(item_id::VARCHAR) END AS scope FROM benchmark")
def inline_scopes(spark, d):
    b = read(spark, d, "benchmark")
    name = F.sha2(F.col("item_id").cast("string"), 256)
    q = b.select(F.col("item_id").alias("query_id"), F.when(F.col("item_id") % 2 == 0, F.concat("text", F.lit(" source_id:"), name)).otherwise(F.col("text")).alias("query"))
    return api.scoped(q, b.select(name.alias("source_id")))


@query("SELECT event_id, event_type AS text, '[S' || user_id || ' c1]' AS note FROM events")
def table_note_cells(spark, d):
    c = read(spark, d, "events").select("event_id", report.table_notes(F.concat("event_type", F.lit(" [S"), F.col("user_id").cast("string"), F.lit(" c1]"))).alias("t"))
    return c.select("event_id", "t.text", F.array_join("t.notes", ",").alias("note"))


@query(f"WITH {CHUNKS} SELECT doc_id, count(*) FILTER (chunk_no > 0 AND NOT contains(regexp_replace(first, '\\s+', '', 'g'), regexp_replace(chunk_text, '\\s+', '', 'g'))) AS n_lost FROM (SELECT *, first(chunk_text) OVER (PARTITION BY doc_id ORDER BY chunk_no) AS first FROM chunks) GROUP BY doc_id")
def export_omissions(spark, d):
    """Documents of which the first chunk alone is exported; blanks do not count."""
    # a row holds one chunk and what is exported, never a document
    docs = read(spark, d, "documents").select(F.struct("doc_id", F.substr("text", F.lit(1), F.lit(LIMIT)).alias("exported")).alias("k"), "text")
    c = structure.paragraph_chunks(docs, "k", limit=LIMIT).select("k.*", "chunk_text")
    lost = c.select("doc_id", F.size(report.omitted_text(F.array("chunk_text"), F.col("exported"))).alias("n"))
    return lost.groupBy("doc_id").agg(F.sum("n").cast("long").alias("n_lost"))


@query("SELECT event_id AS figure_id, CASE WHEN event_id % 6 = 0 THEN 'unknown source' ELSE '' END || CASE WHEN event_id % 6 = 0 AND event_id % 4 = 0 THEN ',' ELSE '' END || CASE WHEN event_id % 4 = 0 THEN 'missing field' ELSE '' END AS problems FROM events WHERE event_id % 6 = 0 OR event_id % 4 = 0")
def figure_checks(spark, d):
    e = read(spark, d, "events")
    f = e.select(F.col("event_id").alias("figure_id"), F.array(F.when(F.col("event_id") % 6 == 0, "none").otherwise("s")).alias("source_ids"), F.when(F.col("event_id") % 4 == 0, " ").otherwise("t").alias("title"), F.lit("c").alias("caption"), F.lit("p").alias("period"), F.lit("u").alias("unit"), F.array("value").alias("values"), F.lit("bar").alias("kind"))
    return report.figure_problems(f, spark.createDataFrame([("s",)], "source_id string")).select("figure_id", F.array_join("problems", ",").alias("problems"))


@query("SELECT user_id, event_type, 'S' || (row_number() OVER (PARTITION BY user_id ORDER BY min(event_id)) + 2) AS alias FROM events GROUP BY user_id, event_type")
def source_aliases(spark, d):
    s = read(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first_seen"))
    return report.aliases(s, 2, per=["user_id"]).select("user_id", "event_type", "alias")


@query("SELECT event_type AS stage, user_id, round(value, 6) AS result FROM events WHERE event_id % 3 <> 0")
def recovered_stages(spark, d):
    """Stage results with the digest of their checkpoint; every third checkpoint is of another result."""
    e = read(spark, d, "events")
    stage = F.concat_ws(":", "event_type", F.col("user_id").cast("string"), F.col("event_id").cast("string"))
    files = e.select(stage.alias("stage"), F.col("event_type"), "user_id", "value", F.col("value").cast("string").alias("result"))
    marks = e.select(stage.alias("stage"), T.digest(F.when(F.col("event_id") % 3 == 0, F.lit("other")).otherwise(F.col("value").cast("string"))).alias("digest"))
    return workflow.recovered(files, marks).select(F.col("event_type").alias("stage"), "user_id", F.round("value", 6).alias("result"))


@query(f"WITH {CHUNKS} SELECT f.doc_id AS source_id, f.chunk_id, n.chunk_id AS passage_id FROM chunks f JOIN chunks n ON n.doc_id = f.doc_id AND abs(n.chunk_no - f.chunk_no) <= 1")
def surrounding_passages(spark, d):
    """Each passage with those around it."""
    p = passages_of(spark, d)
    return api.surrounding_passages(p, p, 1, 10_000).select("source_id", "chunk_id", "passage_id")


@query(ORACLES["evidence_union_by_ref"])
def settled_evidence(spark, d):
    """Two settlings, and the second one again: durable state in which each reference stands once (ST2)."""
    e = evidence_rows(spark, d).select("ref", "seq", "text")
    first, again = e.withColumn("origin", F.lit("a")), e.where("seq % 3 = 0").withColumn("seq", F.col("seq") + 1_000_000_000).withColumn("origin", F.lit("b"))
    state = Durable(spark, shared(spark), "ref", first.schema)
    for rows in (first, again, again):
        settled.settle(state, rows)
    return state.rows()


@query(f"""WITH {REFS}, b AS (SELECT doc_id, list(ref) AS refs FROM ev JOIN labels USING (doc_id) GROUP BY doc_id)
SELECT doc_id AS bundle_id, len(refs)::INT AS n_refs, CASE WHEN doc_id % 2 = 0 THEN 'unassessed' ELSE 'adequate' END AS adequacy FROM b""")
def settled_bundles(spark, d):
    """Bundles that the state holds stay as they are; a later run adds the others (ST2)."""
    known = evidence_rows(spark, d).select("ref")
    every = bundles_of(spark, d).select("bundle_id", "refs")
    first = every.where("bundle_id % 2 = 0").withColumn("adequacy", F.lit("unassessed"))
    state = Durable(spark, shared(spark), "bundle_id", first.schema)
    settled.settle_bundles(state, first, known)
    settled.settle_bundles(state, every.withColumn("adequacy", F.lit("adequate")), known)
    return state.rows().select("bundle_id", F.size("refs").alias("n_refs"), "adequacy")


@query(f"""WITH {CHUNKS} SELECT doc_id AS source_id, chunk_no::INT AS focus_no, (SELECT count(*) FROM chunks n WHERE n.doc_id = c.doc_id AND abs(n.chunk_no - c.chunk_no) <= 1)::INT AS n_units,
 'complete_window' AS status, doc_id % 10 = 3 OR doc_id % 10 = 7 AS rebuilt FROM chunks c WHERE doc_id % 10 <> 9""")
def reading_index_refresh(spark, d):
    """Windows of all chunks from an index that was kept: some sources changed since, some are new, some gone (CP6)."""
    docs = read(spark, d, "documents").select("doc_id", "text")
    units = lambda df: api.units_of(structure.paragraph_chunks(df, limit=LIMIT).withColumnRenamed("doc_id", "source_id"))
    path = shared(spark)
    earlier = docs.where("doc_id % 10 <> 7").withColumn("text", F.when(F.col("doc_id") % 10 == 3, F.concat("text", F.lit(" more"))).otherwise(F.col("text")))
    reading_index.refresh(units(earlier), path)
    index, changed = reading_index.refresh(units(docs.where("doc_id % 10 <> 9")), path)
    rebuilt = changed.where("version is not null").select("source_id", F.lit(True).alias("rebuilt"))
    return index.rows().join(rebuilt, "source_id", "left").select("source_id", "focus_no", F.size("units").alias("n_units"), "status", F.coalesce("rebuilt", F.lit(False)).alias("rebuilt"))


VIEW = 2600
#: Greedy fill: a unit after the other by nearness, each taken if it still fits.
VIEWS = f"""WITH RECURSIVE {CHUNKS}, lex AS ({lexical_sql()}),
parts AS (SELECT doc_id, chunk_no, start_at, regexp_extract_all(chunk_text, '[^。！？.!?]+[。！？.!?]*|^[。！？.!?]+') AS p FROM chunks),
sent AS (SELECT doc_id, chunk_no, k, p[k] AS body, start_at + coalesce(list_sum(list_transform(p[1:k - 1], lambda x: length(x))), 0) AS a FROM parts, unnest(range(1, len(p) + 1)) t(k)),
unit AS (SELECT f.doc_id, f.chunk_id, row_number() OVER (PARTITION BY f.doc_id, f.chunk_id ORDER BY s.chunk_no, s.k) AS i, s.body, s.a <= f.start_at AND f.start_at < s.a + length(s.body) AS focal
 FROM chunks f JOIN sent s ON s.doc_id = f.doc_id AND abs(s.chunk_no - f.chunk_no) <= 1 WHERE regexp_matches(s.body, '[^。！？.!?]')),
focus AS (SELECT doc_id, chunk_id, min(i) AS c FROM unit WHERE focal GROUP BY ALL),
w AS (SELECT f.doc_id, f.chunk_id, string_agg(n.chunk_text, chr(10) ORDER BY n.chunk_no) AS whole FROM chunks f JOIN chunks n ON n.doc_id = f.doc_id AND abs(n.chunk_no - f.chunk_no) <= 1 GROUP BY ALL),
cand AS (SELECT query_id, source_id, lex.chunk_id, length(b.text) AS q, whole, c FROM lex JOIN benchmark b ON b.item_id = query_id JOIN w ON w.doc_id = source_id AND w.chunk_id = lex.chunk_id LEFT JOIN focus ON focus.doc_id = source_id AND focus.chunk_id = lex.chunk_id),
big AS (SELECT * FROM cand WHERE q + length(whole) + 1 > {VIEW}),
must AS (SELECT query_id, source_id, big.chunk_id, q + sum(length(body) + 1) AS used, list(i) AS ids FROM big JOIN unit ON unit.doc_id = source_id AND unit.chunk_id = big.chunk_id AND abs(i - c) <= 1 GROUP BY query_id, source_id, big.chunk_id, q),
rest AS (SELECT doc_id, unit.chunk_id, side, i, length(body) + 1 AS cost, row_number() OVER (PARTITION BY doc_id, unit.chunk_id, side ORDER BY abs(i - c), side * i) AS n FROM unit JOIN focus USING (doc_id, chunk_id), unnest([-1, 1]) t(side) WHERE abs(i - c) > 1),
fill(query_id, source_id, chunk_id, side, n, used, ids) AS (SELECT query_id, source_id, chunk_id, side, 0::BIGINT, used, ids FROM must, unnest([-1, 1]) t(side) WHERE used <= {VIEW}
 UNION ALL SELECT f.query_id, f.source_id, f.chunk_id, f.side, r.n, CASE WHEN used + cost <= {VIEW} THEN used + cost ELSE used END, CASE WHEN used + cost <= {VIEW} THEN list_append(ids, r.i) ELSE ids END
 FROM fill f JOIN rest r ON r.doc_id = f.source_id AND r.chunk_id = f.chunk_id AND r.side = f.side AND r.n = f.n + 1),
last AS (SELECT query_id, source_id, chunk_id, side, arg_max(ids, n) AS ids FROM fill GROUP BY ALL),
view AS (SELECT query_id, source_id, l.chunk_id, side, chr(10) || string_agg(body, chr(10) ORDER BY i) AS text FROM last l JOIN unit u ON u.doc_id = source_id AND u.chunk_id = l.chunk_id AND list_contains(ids, i) GROUP BY ALL),
two AS (SELECT query_id, source_id, chunk_id, list(text ORDER BY side) AS t FROM view GROUP BY ALL),
found AS (SELECT query_id, source_id, chunk_id, [chr(10) || whole] AS t, 'ready' AS status FROM cand WHERE q + length(whole) + 1 <= {VIEW}
 UNION ALL SELECT big.query_id, big.source_id, big.chunk_id, CASE WHEN t IS NULL THEN [] WHEN t[1] = t[2] THEN t[1:1] ELSE t END, CASE WHEN t IS NULL THEN 'context_too_large' ELSE 'context_incomplete' END FROM big LEFT JOIN two USING (query_id, source_id, chunk_id))
SELECT query_id, source_id, chunk_id, len(t)::INT AS n_views, sha256(array_to_string(t, chr(31))) AS views_sha256, status FROM found"""


@query(VIEWS)
def search_views(spark, d):
    """Views of each candidate under a limit that most exceed: whole sentences by nearness, in two directions (UD4)."""
    p, items = passages_of(spark, d), items_of(spark, d)
    pool = written(retrieval.lexical(p, items, 64).select("query_id", "source_id", "chunk_id", F.col("rank").alias("place")), shared(spark))
    c = pool.join(api.blocks(pool, p, api.units_of(p), api.Settings()), ["source_id", "chunk_id"]).join(items, "query_id").withColumn("identity", F.lit(""))
    found = views.with_views(api.sentenced(c), VIEW, keep=("query_id", "source_id", "chunk_id"))
    return found.select("query_id", "source_id", "chunk_id", F.size("views").alias("n_views"), F.sha2(F.array_join("views", "\u001f"), 256).alias("views_sha256"), F.col("view_status").alias("status"))


@query(f"""WITH lex AS ({lexical_sql()}), hits AS (SELECT DISTINCT query_id FROM lex)
SELECT item_id AS query_id, mode, status AS retrieval_status, mode = 'ready' AND query_id IS NOT NULL AS found
FROM benchmark LEFT JOIN hits ON query_id = item_id CROSS JOIN (VALUES ('ready', 'ready'), ('late', 'reranker_deadline'), ('cancelled', 'reranker_cancelled'),
 ('no scorer', 'reranker_unavailable'), ('changed', 'reranker_snapshot_mismatch'), ('broken', 'dense_retrieval_failed')) t(mode, status)""")
def supervised_statuses(spark, d):
    """One search in each of the ways that it can end (CP4): a row for every query and way."""
    p, items = passages_of(spark, d), items_of(spark, d)
    stop = threading.Event()
    stop.set()
    manifest = items.select(F.col("query_id").cast("string").alias("path"), F.sha2("query", 256).alias("sha256"))
    files = items.select(F.col("query_id").cast("string").alias("path"), F.concat("query", F.lit("!")).cast("binary").alias("content"))
    broken = lambda passages, queries, limit: api.lexical(passages, queries, limit).withColumn("rank", F.raise_error(F.lit("index does not match")).cast("int"))
    score, out = retrieval.overlap_score, None
    for mode, seconds, options in (
        ("ready", 3600, {"score": score}), ("late", 0, {"score": score}), ("cancelled", 3600, {"score": score, "cancelled": stop}), ("no scorer", 3600, {}),
        ("changed", 3600, {"score": score, "snapshot": supervised.changed_files(files, manifest)}), ("broken", 3600, {"score": score, "provider": broken}),
    ):
        _, rows = supervised.search(p, items, seconds, **options)
        rows = rows.select("query_id", F.lit(mode).alias("mode"), "retrieval_status", (F.col("n_blocks") > 0).alias("found"))
        out = rows if out is None else out.unionByName(rows)
    return out
