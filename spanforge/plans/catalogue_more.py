"""More queries over the driver tables: text functions, orderings, sinks and state."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from spanforge.functions import text as T
from spanforge.operators import coverage_state, evidence, records, report, retrieval, structure, workflow
from spanforge.plans import search as api
from spanforge.plans.catalogue import CHUNKS, LIMIT, REFS, WORDS, bundles_of, chunks_of, cover_sql, evidence_rows, items_of, lexical_sql, passages_of, query, read
from spanforge.sources import ingest, publishing, tables


def shared(spark, name: str) -> str:
    """A new folder that all executors see."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("SELECT doc_id, CASE WHEN length(text) <= 1200 THEN text ELSE substr(text, 1, 1200) END AS preview, CASE WHEN length(text) > 1200 THEN sha256(text) END AS sha256 FROM documents")
def concise_preview(spark, d):
    p = read(spark, d, "documents").select("doc_id", T.preview("text").alias("p"))
    return p.select("doc_id", F.col("p.text").alias("preview"), F.col("p.sha256").alias("sha256"))


@query("SELECT doc_id, strlen(text)::BIGINT AS n_bytes, sha256(text) AS text_hash FROM documents")
def payload_bytes(spark, d):
    return read(spark, d, "documents").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), T.digest("text").alias("text_hash"))


@query("SELECT vec_id, len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0)) AS ok FROM embeddings")
def vector_validation(spark, d):
    return read(spark, d, "embeddings").select("vec_id", T.valid_vector("embedding", 64).alias("ok"))


@query("""WITH t AS (SELECT vec_id, p, embedding[p]::DOUBLE + (vec_id % 2) * embedding[16 + p]::DOUBLE + embedding[32 + p]::DOUBLE AS total FROM embeddings, unnest(range(1, 17)) x(p)),
n AS (SELECT vec_id, sqrt(sum(total * total)) AS norm FROM t GROUP BY 1) SELECT vec_id, p - 1 AS at, round(total / greatest(norm, 1e-12), 6) + 0.0 AS value FROM t JOIN n USING (vec_id)""")
def masked_pooling(spark, d):
    """Each vector as four token vectors, the second masked out of even ones and the last of all."""
    e = read(spark, d, "embeddings")
    tokens = F.transform(F.array(*map(F.lit, (1, 17, 33, 49))), lambda i: F.slice("embedding", i, F.lit(16)))
    mask = F.array(F.lit(1), (F.col("vec_id") % 2).cast("int"), F.lit(1), F.lit(0))
    pooled = e.select("vec_id", F.posexplode(T.pooled(tokens, mask)).alias("at", "value"))
    return pooled.select("vec_id", F.col("at").cast("long").alias("at"), (F.round("value", 6) + 0.0).alias("value"))


@query(f"""WITH {CHUNKS} SELECT doc_id, count(*) AS chunk_count, arg_min(chunk_text, chunk_no) AS first_passage FROM chunks GROUP BY doc_id""")
def source_inventory(spark, d):
    return chunks_of(spark, d).groupBy("doc_id").agg(F.count("*").alias("chunk_count"), F.min_by("chunk_text", "chunk_no").alias("first_passage"))


@query(f"""WITH {REFS}, o AS (SELECT doc_id, ref, strlen(text) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY ref) AS k, sum(strlen(text)) OVER (PARTITION BY doc_id ORDER BY ref) AS upto FROM ev)
SELECT doc_id, ref, n::BIGINT AS n FROM o WHERE k <= 8 AND upto <= 2048""")
def omitted_previews(spark, d):
    e = evidence_rows(spark, d).select("doc_id", "ref", F.octet_length("text").cast("long").alias("n"))
    return records.previews(e, "doc_id", "ref", "n")


@query(f"WITH {REFS} SELECT source_id, ref, row_number() OVER (PARTITION BY source_id ORDER BY seq, ref) AS place FROM ev")
def delivery_order(spark, d):
    return records.delivered(evidence_rows(spark, d)).select("source_id", "ref", "place")


@query("""SELECT conv_id, arg_min(turn, (CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 ELSE 2 END, turn)) AS next_turn, count(*) AS waiting FROM conversations GROUP BY conv_id""")
def next_question(spark, d):
    """The first open question by priority, then id."""
    rank = F.when(F.col("role") == "system", 0).when(F.col("role") == "user", 1).otherwise(2)
    return records.next_open(read(spark, d, "conversations"), "conv_id", rank, "turn").withColumnRenamed("next", "next_turn")


@query("SELECT doc_id, CASE WHEN source IS DISTINCT FROM 'src0' THEN source END AS source, CASE WHEN lang IS DISTINCT FROM 'en' THEN lang END AS lang FROM documents")
def fixed_field_dedup(spark, d):
    return read(spark, d, "documents").select("doc_id", T.without_parent("source", F.lit("src0")).alias("source"), T.without_parent("lang", F.lit("en")).alias("lang"))


@query("""WITH p AS (SELECT conv_id, turn, k, CASE k WHEN 0 THEN '# ' || role WHEN 1 THEN text ELSE '| ' || role || ' | ' || turn || ' |' END AS body FROM conversations, unnest([0, 1, 2]) t(k)), b AS (SELECT *, trim(body) AS block_text FROM p WHERE trim(body) <> '')
SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, k) - 1)::BIGINT AS block_no, CASE WHEN starts_with(body, '#') THEN 'heading' WHEN starts_with(body, '|') THEN 'table' ELSE 'paragraph' END AS kind, block_text FROM b""")
def text_blocks(spark, d):
    """Conversations as Markdown, a heading, a paragraph and a table row a turn, blank lines between them, split again."""
    c = read(spark, d, "conversations")
    turn = F.concat_ws("\n \n", F.concat(F.lit("# "), "role"), "text", F.concat_ws(" ", F.lit("|"), "role", F.lit("|"), F.col("turn").cast("string"), F.lit("|")))
    whole = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", turn.alias("t")))), lambda x: x["t"]), "\n\t\n").alias("text"))
    b = structure.text_blocks(whole, "conv_id", "text")
    w = Window.partitionBy("conv_id").orderBy("part")
    return b.select("conv_id", (F.row_number().over(w) - 1).cast("long").alias("block_no"), "kind", "block_text")


@query(f"""WITH {CHUNKS} SELECT doc_id, count(*) FILTER (end_at - start_at < {LIMIT}) AS n_short, count(*) FILTER (start_at = 0) AS n_first FROM chunks GROUP BY doc_id""")
def reading_limit_counts(spark, d):
    return chunks_of(spark, d).groupBy("doc_id").agg(F.count_if(F.col("end_at") - F.col("start_at") < LIMIT).alias("n_short"), F.count_if(F.col("start_at") == 0).alias("n_first"))


@query(f"""WITH {REFS}, b AS (SELECT doc_id % 40 AS bundle_id, doc_id % 4 <> 3 AS complete, ref FROM ev JOIN labels USING (doc_id))
SELECT bundle_id, count(DISTINCT ref) AS n_refs, CASE WHEN bool_and(complete) THEN 'complete_window' ELSE 'partial_parent' END AS structure FROM b GROUP BY bundle_id""")
def bundle_merge(spark, d):
    b = bundles_of(spark, d).withColumn("bundle_id", F.col("question_id")).withColumn("continuations", F.array(F.lit("c")))
    return evidence.merge_bundles(b).select("bundle_id", F.size("refs").cast("long").alias("n_refs"), "structure")


@query("SELECT event_id, event_type FROM events WHERE event_type || ':' || user_id NOT IN (SELECT event_type || ':' || user_id FROM events WHERE event_id % 10 = 0)")
def stage_memo(spark, d):
    """Stages whose input digest has no result yet (UD16)."""
    e = read(spark, d, "events").withColumn("input", T.digest(F.concat_ws(":", "event_type", F.col("user_id").cast("string"))))
    return e.join(e.where("event_id % 10 = 0").select("input"), "input", "left_anti").select("event_id", "event_type")


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_id + user_id WHEN 1 THEN event_id - user_id ELSE event_id * user_id END::VARCHAR AS value FROM events")
def calculate(spark, d):
    e = read(spark, d, "events")
    op = F.element_at(F.array(*map(F.lit, ("add", "subtract", "multiply"))), (F.col("event_id") % 3 + 1).cast("int"))
    return e.select("event_id", report.calculate(op, F.col("event_id").cast("string"), F.col("user_id").cast("string")).alias("value"))


@query(f"""WITH {CHUNKS}, c AS (SELECT item_id AS cite_id, item_id AS source_id, 0 AS low, 2 AS high FROM benchmark) SELECT cite_id, list(DISTINCT start_at ORDER BY start_at)::VARCHAR AS pages FROM c JOIN chunks ON doc_id = source_id AND chunk_no BETWEEN low AND high GROUP BY cite_id""")
def citation_pages(spark, d):
    cites = read(spark, d, "benchmark").select(F.col("item_id").alias("cite_id"), F.col("item_id").alias("source_id"), F.lit(0).alias("low"), F.lit(2).alias("high"))
    chunks = passages_of(spark, d).withColumnRenamed("start_at", "page")
    return report.cited_pages(cites, chunks).select("cite_id", F.concat(F.lit("["), F.array_join("pages", ", "), F.lit("]")).alias("pages"))


@query("SELECT 'S' || doc_id AS alias, sha256(doc_id::VARCHAR) AS source_id FROM documents")
def declared_sources(spark, d):
    s = read(spark, d, "documents").select("doc_id", F.sha2(F.col("doc_id").cast("string"), 256).alias("source_id"))
    short = F.concat(F.substr("source_id", F.lit(1), F.lit(12)), F.lit("…"), F.substr("source_id", F.lit(57)))
    return report.resolve_declared(s.select(F.concat(F.lit("S"), F.col("doc_id").cast("string")).alias("alias"), short.alias("abbreviated")), s)


@query("SELECT doc_id, source || ' · ' || lang AS label FROM documents")
def source_labels(spark, d):
    return read(spark, d, "documents").select("doc_id", report.source_label(F.col("source"), F.lit(""), F.col("lang"), F.lit(None).cast("string")).alias("label"))


@query("SELECT conv_id, 'digraph {' || chr(10) || '  rankdir=' || CASE WHEN count(*) > 5 THEN 'TB' ELSE 'LR' END || ';' || chr(10) || string_agg('  \"t' || turn || '\";', chr(10) ORDER BY turn) || chr(10) || coalesce(string_agg('  \"t' || (turn - 1) || '\" -> \"t' || turn || '\";', chr(10) ORDER BY turn) FILTER (turn > lo), '') || chr(10) || '}' AS dot FROM (SELECT *, min(turn) OVER (PARTITION BY conv_id) AS lo FROM conversations) GROUP BY conv_id")
def figure_dot(spark, d):
    g = read(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    name = lambda t: F.concat(F.lit("t"), t.cast("string"))
    nodes = F.transform("turns", name)
    edges = F.transform(F.slice("turns", 2, F.greatest(F.size("turns") - 1, F.lit(0))), lambda t: F.struct(name(t - 1).alias("src"), name(t).alias("dst")))
    return g.select("conv_id", report.figure_dot(nodes, edges).alias("dot"))


@query("SELECT count(*) AS n, sum(doc_id)::BIGINT AS ids, sum(length(text))::BIGINT AS chars FROM documents")
def published_index(spark, d):
    """Published in batches, then opened: the rows are checked against the manifest."""
    docs, path = read(spark, d, "documents"), tables.shared(spark)
    rows = max(1, docs.count() // 7)
    publishing.publish(docs, path, ["doc_id"], rows)
    opened = publishing.published(spark, path)
    return opened.agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"), F.sum(F.length("text")).alias("chars"))


def bucketed(text):
    """A stated embedding without a model: distinct tokens counted in 64 buckets of their MD5."""
    bucket = F.transform(T.tokens(text), lambda t: F.pmod(F.conv(F.substr(F.md5(t.cast("binary")), F.lit(1), F.lit(4)), 16, 10).cast("int"), F.lit(64)))
    # bound to a variable, or the text would be tokenised for each of the buckets
    counts = lambda seen: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: (F.size(seen) - F.size(F.array_remove(seen, b))).cast("double"))
    return F.get(F.transform(F.array(bucket), counts), 0)


def bucket_sql(text: str) -> str:
    return f"unnest(list_transform({WORDS.format(text)}, lambda t: ('0x' || substr(md5(t), 1, 4))::INT % 64))"


DENSE = f"""cb AS (SELECT doc_id, chunk_no, b, count(*) AS n FROM (SELECT doc_id, chunk_no, {bucket_sql('chunk_text')} AS b FROM chunks) GROUP BY ALL), cl AS (SELECT doc_id, chunk_no, sqrt(sum(n * n)::DOUBLE) AS l FROM cb GROUP BY ALL),
qb AS (SELECT item_id, b, count(*) AS n FROM (SELECT item_id, {bucket_sql('text')} AS b FROM benchmark) GROUP BY ALL), ql AS (SELECT item_id, sqrt(sum(n * n)::DOUBLE) AS l FROM qb GROUP BY ALL),
dots AS (SELECT item_id, doc_id, chunk_no, sum(cb.n * qb.n)::DOUBLE AS dot FROM cb JOIN qb USING (b) GROUP BY ALL),
dd AS (SELECT ql.item_id AS query_id, cl.doc_id AS source_id, cl.chunk_no, round(1 - coalesce(dot, 0) / (cl.l * ql.l), 9) AS distance FROM cl CROSS JOIN ql LEFT JOIN dots ON dots.item_id = ql.item_id AND dots.doc_id = cl.doc_id AND dots.chunk_no = cl.chunk_no),
dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, source_id, chunk_no) AS rank FROM dd) WHERE rank <= 64)"""


@query(f"""WITH RECURSIVE {CHUNKS}, lex AS ({lexical_sql()}), {DENSE},
pool0 AS (SELECT query_id, source_id, chunk_id, max(lr) AS lr, max(dr) AS dr FROM (SELECT query_id, source_id, chunk_id, rank AS lr, NULL::BIGINT AS dr FROM lex UNION ALL SELECT query_id, source_id, 'c' || chunk_no, NULL, rank FROM dense) GROUP BY 1, 2, 3),
pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(1.0::DOUBLE / (60 + lr), 0) + coalesce(1.0::DOUBLE / (60 + dr), 0) DESC, source_id, chunk_id) AS place FROM pool0) WHERE place <= 64),
w AS (SELECT f.doc_id AS source_id, f.chunk_id, list(n.doc_id || ':' || n.start_at || ':' || n.end_at ORDER BY n.chunk_no) AS refs, string_agg(n.chunk_text, chr(10) ORDER BY n.chunk_no) AS view FROM chunks f JOIN chunks n ON n.doc_id = f.doc_id AND abs(n.chunk_no - f.chunk_no) <= 1 GROUP BY 1, 2),
x AS (SELECT query_id, place, source_id, chunk_id, refs, len(list_intersect({WORDS.format('b.text')}, {WORDS.format('view')})) / sqrt(greatest(1, len({WORDS.format('view')}))) AS score FROM pool JOIN w USING (source_id, chunk_id) JOIN benchmark b ON b.item_id = query_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, place) AS rank FROM x), {cover_sql('ranked', 6)}
SELECT r.query_id, r.source_id, r.chunk_id, r.score, r.rank AS place, len(refs) AS n_units, 'ready' AS retrieval_status FROM ranked r JOIN cover ON cover.query_id = r.query_id WHERE list_contains(kept, r.rank)""")
def search_pipeline(spark, d):
    """Hybrid candidates, windows of the chunk and its neighbours, scores of the whole windows, uncovered blocks."""
    p = passages_of(spark, d)
    vectors = p.select((F.col("source_id") * 100_000 + F.col("chunk_no")).alias("unit_id"), "source_id", "chunk_id", F.sha2("chunk_text", 256).alias("text_hash"), bucketed("chunk_text").alias("embedding"))
    index = shared(spark, "vectors")
    vectors.write.parquet(index)
    vectors = spark.read.parquet(index)
    found = api.search(p, items_of(spark, d), api.Settings(view_characters=10_000), provider=api.hybrid(vectors, bucketed, 64), score=retrieval.overlap_score, trace=shared(spark, "trace"))
    return found.select("query_id", "source_id", "chunk_id", "score", F.col("place").cast("long").alias("place"), F.size("units").cast("long").alias("n_units"), "retrieval_status")


COVERAGE = """u AS (SELECT user_id, event_id, event_id // 100 AS batch_no, 'q' || event_id % 5 AS question_id, ['unresolved', 'partial', 'supported', 'conflicting'][event_id % 4 + 1] AS state, event_id % 37 = 5 AS bad FROM events),
b AS (SELECT user_id, batch_no, bool_or(bad) AS refused FROM u GROUP BY ALL), g AS (SELECT user_id, question_id, arg_max(state, event_id) AS state FROM u JOIN b USING (user_id, batch_no) WHERE NOT refused GROUP BY ALL),
n AS (SELECT user_id, count(*) FILTER (refused) AS n_refused FROM b GROUP BY ALL)"""


def coverage_inputs(spark, d):
    """Coverage updates from the event log, five questions a stage; some name a bundle of another question, and their batch is refused."""
    e = read(spark, d, "events")
    q = F.concat(F.lit("q"), (F.col("event_id") % 5).cast("string"))
    state = F.element_at(F.array(*(F.lit(s) for s in coverage_state.STATES)), (F.col("event_id") % 4 + 1).cast("int"))
    of = lambda k, n: F.concat(F.lit("b"), (n % 5).cast("string"), F.lit(k))
    wrong = F.when(F.col("event_id") % 37 == 5, F.col("event_id") + 1).otherwise(F.col("event_id"))
    updates = e.select(F.col("user_id").alias("stage_id"), F.floor(F.col("event_id") / 100).alias("batch_no"), F.col("event_id").alias("seq"), q.alias("question_id"), state.alias("state"), F.array(of("x", F.col("event_id")), of("y", wrong)).alias("bundle_ids"))
    stages = e.select(F.col("user_id").alias("stage_id")).distinct()
    n = F.explode(F.sequence(F.lit(0), F.lit(4)))
    questions = stages.select("stage_id", n.alias("n")).select("stage_id", F.concat(F.lit("q"), F.col("n").cast("string")).alias("question_id"))
    bundles = questions.select("stage_id", F.explode(F.array(F.lit("x"), F.lit("y"))).alias("k"), "question_id").select("stage_id", F.concat(F.lit("b"), F.substr("question_id", F.lit(2)), "k").alias("bundle_id"), "question_id", F.when(F.col("k") == "x", "adequate").otherwise("unassessed").alias("adequacy"))
    return updates, bundles, questions


COVERED = f"""WITH {COVERAGE} SELECT n.user_id AS stage_id, 'q' || k AS question_id, coalesce(state, 'unresolved') AS state, (CASE WHEN state IS NULL THEN 0 ELSE 2 END)::INT AS n_bundles, n_refused::INT AS n_refused FROM n CROSS JOIN unnest([0, 1, 2, 3, 4]) t(k) LEFT JOIN g ON g.user_id = n.user_id AND g.question_id = 'q' || k"""


@query(COVERED)
def coverage_machine(spark, d):
    return coverage_state.coverage_states(*coverage_inputs(spark, d))


@query("SELECT item_id AS brief_id, 'q-' || substr(sha256(text), 1, 12) AS question_id, text AS question, CASE WHEN item_id % 2 = 0 THEN 'important' ELSE 'essential' END AS priority, 'unresolved' AS state FROM benchmark")
def question_seeding(spark, d):
    b = read(spark, d, "benchmark")
    one = F.array(F.struct(F.col("text").alias("question"), F.lit("important").alias("priority")))
    none = F.expr("cast(array() as array<struct<question:string,priority:string>>)")
    return workflow.seed_questions(b.select(F.col("item_id").alias("brief_id"), F.col("text").alias("brief"), F.when(F.col("item_id") % 2 == 0, one).otherwise(none).alias("questions")))


@query("SELECT doc_id::VARCHAR AS source_id, 'k' AS cache_key, 'about ' || source AS generated FROM documents")
def context_insert(spark, d):
    """Half is stored, all is inserted: each key once."""
    docs = read(spark, d, "documents")
    new = docs.select(F.col("doc_id").cast("string").alias("source_id"), F.lit("k").alias("cache_key"), F.concat(F.lit("about "), "source").alias("generated"), F.array(F.lit("b0")).alias("block_ids"))
    stored = new.where(F.col("source_id").cast("long") % 2 == 0)
    blocks = new.select("source_id", F.lit("b0").alias("block_id"))
    return workflow.add_context(stored, new, blocks).select("source_id", "cache_key", "generated")


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'tool not allowed' WHEN 1 THEN 'empty content' WHEN 2 THEN 'material issue without a quote' ELSE '' END AS problems FROM events""")
def output_validation(spark, d):
    e = read(spark, d, "events")
    raw = F.element_at(F.array(*map(F.lit, ('{"tool": "rm"}', '{"content": " "}', '{"content": "x", "issues": [{"severity": "material", "kind": "k", "location": "l"}]}', '{"content": "x", "figures": [{"kind": "bar", "title": "t", "values": [1.0, null]}]}'))), (F.col("event_id") % 4 + 1).cast("int"))
    return e.select("event_id", F.array_join(workflow.output_problems(raw), ",").alias("problems"))


@query("SELECT source AS path FROM documents GROUP BY source HAVING bool_or(doc_id % 97 = 5)")
def corpus_signature(spark, d):
    """Sources whose digest changes when some of their texts do."""
    e = read(spark, d, "documents")
    other = F.when(F.col("doc_id") % 97 == 5, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    signed = lambda text: evidence.tree_digest(e.select("source", "doc_id", F.sha2(text, 256).alias("line")), "source", "doc_id", "line").withColumnRenamed("source", "path")
    now, was = signed(F.col("text")), signed(other)
    return workflow.manifest_mismatch(now, was).select("path")


@query("""WITH o AS (SELECT user_id, event_id, row_number() OVER w AS n, ['A', 'B', 'C'][event_id % 3 + 1] AS kind, lag(value > 20) OVER w AS adequate FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, event_id, n <= 3 AND kind = ['A', 'B', 'C'][least(n, 3)] AND (n = 1 OR coalesce(adequate, false)) AS allowed FROM o""")
def diagnostic_sequence(spark, d):
    e = read(spark, d, "events")
    kind = F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), (F.col("event_id") % 3 + 1).cast("int"))
    a = e.select("user_id", "event_id", kind.alias("kind"), F.when(F.col("value") > 20, "adequate").otherwise("short").alias("outcome"))
    return workflow.diagnostics(a, "user_id", "event_id").select("user_id", "event_id", "allowed")


@query("""WITH RECURSIVE p AS (SELECT conv_id, turn, strlen(text) AS n, CASE WHEN row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 4 THEN 0 ELSE 1 END AS part FROM conversations),
q AS (SELECT *, row_number() OVER w AS pos, sum(n) OVER w AS upto FROM p WINDOW w AS (PARTITION BY conv_id, part ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
r(conv_id, part, a, z) AS (SELECT conv_id, part, min(pos), max(pos) FROM q GROUP BY 1, 2
 UNION ALL SELECT conv_id, part, CASE h WHEN 0 THEN a ELSE a + (z - a + 1) // 2 END, CASE h WHEN 0 THEN a + (z - a + 1) // 2 - 1 ELSE z END FROM (SELECT r.* FROM r JOIN q e ON e.conv_id = r.conv_id AND e.part = r.part AND e.pos = r.z JOIN q s ON s.conv_id = r.conv_id AND s.part = r.part AND s.pos = r.a WHERE z > a AND e.upto - s.upto + s.n > 1500), unnest([0, 1]) x(h)),
leaf AS (SELECT conv_id, part, a, min(z) AS z FROM r GROUP BY 1, 2, 3), b AS (SELECT *, row_number() OVER (PARTITION BY conv_id, part ORDER BY a) - 1 AS batch FROM leaf)
SELECT q.conv_id, turn, q.part, batch FROM q JOIN b ON b.conv_id = q.conv_id AND b.part = q.part AND pos BETWEEN a AND z""")
def judge_batches(spark, d):
    return workflow.judge_batches(read(spark, d, "conversations"), "conv_id", "turn", "text", 1500).select("conv_id", "turn", "part", "batch")


@query("SELECT vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id % 3, embedding[2]::DOUBLE, embedding[1]::DOUBLE, vec_id) - 1 AS place FROM embeddings")
def reading_order(spark, d):
    """Vectors as boxes: page, top edge, left edge, offset."""
    box = F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double"))
    b = read(spark, d, "embeddings").select("label", "vec_id", (F.col("vec_id") % 3).cast("int").alias("page"), box.alias("bbox"), F.col("vec_id").alias("start_at"))
    return structure.reading_order(b, "label").select("vec_id", F.col("place").cast("long").alias("place"))


@query(r"SELECT event_id, regexp_matches(v, '^[(+−-]?[0-9,.]+%?\)?$') AS numeric FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN '(' || event_id || '.5)' WHEN 1 THEN event_id || '%' ELSE event_type END AS v FROM events)")
def numeric_cells(spark, d):
    v = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("("), F.col("event_id").cast("string"), F.lit(".5)"))).when(F.col("event_id") % 3 == 1, F.concat(F.col("event_id").cast("string"), F.lit("%"))).otherwise(F.col("event_type"))
    return read(spark, d, "events").select("event_id", T.numeric_cell(v).alias("numeric"))


@query("SELECT event_id, json_extract_string(props, '$.' || k) AS value, k AS name FROM events, (SELECT unnest(json_keys(props)) AS k, event_id AS id FROM events) WHERE id = event_id")
def event_payload(spark, d):
    """Free-form payloads of the log as rows."""
    e = read(spark, d, "events").select("event_id", F.from_json("props", "map<string,string>").alias("p"))
    return e.select("event_id", F.explode("p").alias("name", "value"))
