"""Queries over the driver tables, each with the DuckDB SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanforge.functions import text as T
from spanforge.operators import evidence, intervals, ledger, packing, postings, reading, retrieval, review, structure, transport, units, vector_index
from spanforge.sources.html import html_blocks as parse_pages
from spanforge.sources.tables import shared, written
from spanforge.streaming import replay as streams

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
LIMIT = 1600


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def chunks_of(spark: SparkSession, d: str) -> DataFrame:
    return structure.paragraph_chunks(read(spark, d, "documents").select("doc_id", "text"), limit=LIMIT)


def passages_of(spark: SparkSession, d: str) -> DataFrame:
    return chunks_of(spark, d).withColumnRenamed("doc_id", "source_id")


CHUNKS = f"""chunks AS (SELECT doc_id, i AS chunk_no, 'c' || i AS chunk_id, i * {LIMIT} AS start_at, least((i + 1) * {LIMIT}, length(text)) AS end_at,
 substr(text, CAST(i * {LIMIT} + 1 AS BIGINT), {LIMIT}) AS chunk_text FROM documents, unnest(range(0, (length(text) + {LIMIT - 1}) // {LIMIT})) t(i))"""
WORDS = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9_]+'))"


@query(f"WITH {CHUNKS} SELECT doc_id, chunk_no, chunk_id, start_at, end_at, chunk_text FROM chunks")
def chunk_paragraph(spark, d):
    return chunks_of(spark, d)


TABLE_LIMIT = 60


@query(f"""WITH lines AS (SELECT l_orderkey, l_linenumber, l_linenumber || ' | ' || strftime(l_shipdate, '%Y-%m-%d') || ' | ' || l_returnflag || l_linestatus || ' | ' || l_partkey || ' | ' || l_suppkey || ' | ' || l_orderkey || ' of the order table' AS line FROM lineitem),
head AS (SELECT 'Line | Date | Flags | Part | Supplier | Order' AS h),
pieces AS (SELECT l_orderkey, l_linenumber, line, k, substr(line, CAST(k * ({TABLE_LIMIT} - length(h) - 1) + 1 AS BIGINT), CAST({TABLE_LIMIT} - length(h) - 1 AS BIGINT)) AS piece, h FROM lines, head, unnest(range(0, CAST(ceil(length(line) / ({TABLE_LIMIT} - length(h) - 1)) AS BIGINT))) t(k))
SELECT l_orderkey, 'c' || (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, line, k) - 1) AS chunk_id, h || chr(10) || piece AS chunk_text FROM pieces""")
def chunk_table_header_repeat(spark, d):
    li = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat_ws(" | ", "l_linenumber", F.date_format("l_shipdate", "yyyy-MM-dd"), F.concat("l_returnflag", "l_linestatus"), "l_partkey", "l_suppkey", F.concat(F.col("l_orderkey").cast("string"), F.lit(" of the order table"))).alias("line"))
    rows = li.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "line")))["line"].alias("rows"))
    tables = rows.select("l_orderkey", F.concat(F.lit("Line | Date | Flags | Part | Supplier | Order\n"), F.array_join("rows", "\n")).alias("text"))
    return structure.table_chunks(tables, "l_orderkey", "text", TABLE_LIMIT).select("l_orderkey", "chunk_id", "chunk_text")


@query("""SELECT conv_id, turn, coalesce(sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_at,
(coalesce(sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(text))::BIGINT AS end_at FROM conversations""")
def canonical_offsets(spark, d):
    return structure.with_offsets(read(spark, d, "conversations"), "conv_id", "turn", "text").select("conv_id", "turn", "start_at", "end_at")


@query("""SELECT conv_id, turn, 'b' || (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) AS block_id,
coalesce(last_value(CASE WHEN role = 'system' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS section FROM conversations""")
def section_carry(spark, d):
    c = structure.with_section(read(spark, d, "conversations"), "conv_id", "turn", "text", F.col("role") == "system")
    return structure.numbered(c, "conv_id", "turn").select("conv_id", "turn", "block_id", "section")


@query(f"SELECT doc_id, CAST(len({WORDS.format('text')}) AS BIGINT) AS n_tokens FROM documents")
def tokens_stats(spark, d):
    return read(spark, d, "documents").select("doc_id", F.size(T.tokens("text")).cast("long").alias("n_tokens"))


WHOLE = "(SELECT doc_id, 'text' AS chunk_id, 0 AS start_at, text AS chunk_text FROM documents)"


def lexical_sql(scope: str = "", passages: str = "chunks") -> str:
    return f"""WITH {CHUNKS}, p AS (SELECT doc_id, chunk_id, start_at, {WORDS.format('chunk_text')} AS tk FROM {passages}),
e AS (SELECT doc_id, chunk_id, start_at, len(tk) AS size, unnest(tk) AS token FROM p),
q AS (SELECT DISTINCT item_id, unnest({WORDS.format('text')}) AS token FROM benchmark),
s AS (SELECT item_id AS query_id, doc_id AS source_id, chunk_id, start_at, count(*) / sqrt(greatest(1, size)) AS score FROM e JOIN q USING (token) {scope} GROUP BY ALL, size)
SELECT query_id, source_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source_id, start_at, chunk_id) AS rank FROM s) WHERE rank <= 64""".replace("GROUP BY ALL, size", "GROUP BY item_id, doc_id, chunk_id, start_at, size")


@query(lexical_sql())
def lexical_topk(spark, d):
    q = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return retrieval.lexical(passages_of(spark, d), q)


@query(lexical_sql())
def posting_topk(spark, d):
    """The same ranks from a posting store on disk, whose segments are left out by their bounds (JN1)."""
    q = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    path = shared(spark)
    postings.write_store(passages_of(spark, d), path)
    return postings.search_store(spark, path, q)[0]


@query(lexical_sql("WHERE doc_id = item_id"))
def lexical_scoped_topk(spark, d):
    q = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), F.col("item_id").alias("scope"))
    return retrieval.lexical(passages_of(spark, d), q, scope="scope")


def dense_inputs(spark, d):
    v = read(spark, d, "embeddings").select(F.col("vec_id").alias("unit_id"), "embedding", F.col("label").alias("scope"))
    q = v.where("unit_id % 100 = 0").select(F.col("unit_id").alias("query_id"), F.col("embedding").alias("query_embedding"), F.col("scope").alias("query_scope"))
    return v, q


def dense_sql(scope: str = "") -> str:
    return f"""WITH q AS (SELECT vec_id AS query_id, embedding AS qe, label AS ql FROM embeddings WHERE vec_id % 100 = 0),
c AS (SELECT query_id, vec_id AS unit_id, round(1 - list_cosine_similarity(embedding::DOUBLE[], qe::DOUBLE[]), 9) AS distance FROM embeddings, q {scope}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, unit_id) AS rank FROM c) SELECT query_id, unit_id, abs(distance) AS distance, rank FROM r WHERE rank <= 64"""


@query(dense_sql())
def dense_topk(spark, d):
    return retrieval.dense(*dense_inputs(spark, d)).withColumn("distance", F.abs("distance"))


@query(dense_sql("WHERE label = ql"))
def dense_scoped_topk(spark, d):
    return retrieval.dense(*dense_inputs(spark, d), scoped=True).withColumn("distance", F.abs("distance"))


def index_of(spark, d):
    path = shared(spark)
    vector_index.build(dense_inputs(spark, d)[0], path, 64)
    return vector_index.open_index(spark, path)


@query(dense_sql())
def indexed_topk(spark, d):
    """Nearest vectors from a stored index of inverted lists, all of which are read (JN3)."""
    return vector_index.search(index_of(spark, d), dense_inputs(spark, d)[1], exact=True).withColumn("distance", F.abs("distance"))


@query(f"""WITH x AS ({dense_sql()}) SELECT count(DISTINCT query_id) AS queries, count(*) AS neighbours, true AS enough FROM x""")
def indexed_recall(spark, d):
    """Exact neighbours, and whether 0.9 of them are found in the lists that a search probes."""
    index, asked = index_of(spark, d), dense_inputs(spark, d)[1]
    found = vector_index.search(index, asked).select("query_id", "unit_id", F.lit(True).alias("found"))
    both = retrieval.dense(*dense_inputs(spark, d)).join(found, ["query_id", "unit_id"], "left")
    return both.agg(F.count_distinct("query_id").alias("queries"), F.count("*").alias("neighbours"), (F.count("found") >= 0.9 * F.count("*")).alias("enough"))


def items_of(spark, d):
    return read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def branches_of(spark, d):
    """Two rankings of the documents for each item: by tokens of their chunks, and by tokens of the whole texts."""
    whole = read(spark, d, "documents").select(F.col("doc_id").alias("source_id"), F.lit("text").alias("chunk_id"), F.lit(0).alias("start_at"), F.col("text").alias("chunk_text"))
    ranks = lambda p: retrieval.lexical(p, items_of(spark, d)).select("query_id", "source_id", "rank")
    return {"chunks": ranks(passages_of(spark, d)), "texts": ranks(whole)}


FUSED = f"""lex AS ({lexical_sql()}), whole AS ({lexical_sql(passages=WHOLE)}),
b AS (SELECT query_id, source_id, min(rank) AS rank_chunks, NULL::BIGINT AS rank_texts FROM lex GROUP BY 1, 2 UNION ALL SELECT query_id, source_id, NULL, min(rank) FROM whole GROUP BY 1, 2),
f AS (SELECT query_id, source_id, min(rank_chunks) AS rank_chunks, min(rank_texts) AS rank_texts FROM b GROUP BY 1, 2),
s AS (SELECT *, coalesce(1.0::DOUBLE / (60 + rank_chunks), 0) + coalesce(1.0::DOUBLE / (60 + rank_texts), 0) AS rrf FROM f),
fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, source_id) AS rank FROM s) WHERE rank <= 64)"""


def cover_sql(ranked: str, limit: int) -> str:
    """Walk over ``ranked`` (query_id, rank without gaps, refs): a row per query with the ranks kept."""
    return f"""walk(query_id, k, seen, kept) AS (SELECT DISTINCT query_id, 0::BIGINT, []::VARCHAR[], []::BIGINT[] FROM {ranked}
 UNION ALL SELECT w.query_id, x.rank, CASE WHEN len(kept) < {limit} AND NOT list_has_all(seen, refs) THEN list_distinct(list_concat(seen, refs)) ELSE seen END,
 CASE WHEN len(kept) < {limit} AND NOT list_has_all(seen, refs) THEN list_append(kept, x.rank) ELSE kept END FROM walk w JOIN {ranked} x ON x.query_id = w.query_id AND x.rank = w.k + 1),
cover AS (SELECT query_id, arg_max(kept, k) AS kept FROM walk GROUP BY query_id)"""


@query(f"WITH {FUSED} SELECT query_id, source_id, rank_chunks, rank_texts, rrf, rank FROM fused")
def rrf_fusion(spark, d):
    return retrieval.fuse(branches_of(spark, d), ["source_id"])


@query(f"""WITH {CHUNKS}, u AS (SELECT doc_id, k AS unit_no, k * 700 AS unit_start, least((k + 1) * 700, length(text)) AS unit_end FROM documents, unnest(range(0, (length(text) + 699) // 700)) t(k))
SELECT doc_id, chunk_id, unit_no FROM chunks JOIN u USING (doc_id) WHERE start_at < unit_end AND end_at > unit_start""")
def interval_bindings(spark, d):
    u = units_of(spark, d)
    out = intervals.overlaps(chunks_of(spark, d), u.withColumnsRenamed({"unit_start": "block_start", "unit_end": "block_end"}), "doc_id")
    return out.select("doc_id", "chunk_id", "unit_no")


def units_of(spark, d, size: int = 700):
    u = structure.paragraph_chunks(read(spark, d, "documents").select("doc_id", "text"), limit=size)
    return u.select("doc_id", F.col("chunk_no").alias("unit_no"), F.col("start_at").alias("unit_start"), F.col("end_at").alias("unit_end"))


@query(f"""WITH {CHUNKS}, u AS (SELECT doc_id, k AS unit_no, k * 700 AS unit_start, least((k + 1) * 700, length(text)) AS unit_end FROM documents, unnest(range(0, (length(text) + 699) // 700)) t(k))
SELECT doc_id, unit_no, unit_start, unit_end FROM u WHERE NOT EXISTS (SELECT 1 FROM chunks c WHERE c.doc_id = u.doc_id AND unit_start >= start_at AND unit_end <= end_at)""")
def span_containment_anti(spark, d):
    return intervals.uncovered(units_of(spark, d), chunks_of(spark, d), "doc_id")


@query(f"""WITH {CHUNKS}, b AS (SELECT doc_id, length(text) // 2 AS point FROM documents WHERE length(text) > 0)
SELECT doc_id, point, chunk_id FROM b JOIN chunks USING (doc_id) WHERE start_at <= point AND point < end_at""")
def point_in_interval(spark, d):
    p = read(spark, d, "documents").select("doc_id", F.floor(F.length("text") / 2).alias("point"))
    u = chunks_of(spark, d).withColumnsRenamed({"start_at": "unit_start", "end_at": "unit_end"})
    return intervals.containing(p, u, "doc_id").select("doc_id", "point", "chunk_id")


GROUPS = """g0 AS (SELECT *, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn) = role OR lag(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) < 200 THEN 0 ELSE 1 END AS fresh FROM conversations),
g AS (SELECT conv_id, turn, sum(fresh) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS group_no FROM g0)"""


def groups_of(spark, d):
    joins = (F.col("previous.role") == F.col("this.role")) | (F.length("previous.text") < 200)
    return structure.with_groups(read(spark, d, "conversations").select("conv_id", "turn", "role", "text"), "conv_id", "turn", joins)


@query(f"WITH {GROUPS} SELECT conv_id, turn, group_no::BIGINT AS group_no FROM g")
def reading_groups(spark, d):
    return groups_of(spark, d).select("conv_id", "turn", F.col("group_no").cast("long").alias("group_no"))


@query(f"WITH {GROUPS} SELECT f.conv_id, f.turn AS focus_turn, g.turn, g.group_no::BIGINT AS group_no FROM g f JOIN g ON f.conv_id = g.conv_id AND g.group_no BETWEEN f.group_no - 1 AND f.group_no + 1")
def surrounding_window(spark, d):
    g = groups_of(spark, d).select("conv_id", "turn", F.col("group_no").cast("long").alias("group_no"))
    return structure.surrounding(g, "conv_id", "group_no", 1).select("conv_id", "focus_turn", "turn", "group_no")


@query(r"""WITH RECURSIVE t AS (SELECT doc_id, length(regexp_extract(text, '^[。！？.!?]+')) AS lead, regexp_extract_all(text, '[^。！？.!?]+[。！？.!?]*') AS parts FROM documents),
s AS (SELECT doc_id, unit_no, part, lead FROM (SELECT doc_id, lead, unnest(parts) AS part, generate_subscripts(parts, 1) - 1 AS unit_no FROM t)),
u AS (SELECT doc_id, unit_no, length(part) AS size FROM s), f AS (SELECT doc_id, max(unit_no) // 2 AS focus_no FROM u GROUP BY doc_id),
c AS (SELECT doc_id, focus_no, unit_no, size, row_number() OVER (PARTITION BY doc_id ORDER BY abs(unit_no - focus_no), unit_no) - 1 AS k FROM u JOIN f USING (doc_id) WHERE abs(unit_no - focus_no) <= 2),
fill(doc_id, k, used, units) AS (SELECT doc_id, 0::BIGINT, CASE WHEN size <= 800 THEN size ELSE 0 END, CASE WHEN size <= 800 THEN [unit_no] ELSE [] END FROM c WHERE k = 0
 UNION ALL SELECT c.doc_id, c.k, CASE WHEN len(units) > 0 AND used + size <= 800 THEN used + size ELSE used END, CASE WHEN len(units) > 0 AND used + size <= 800 THEN list_append(units, unit_no) ELSE units END FROM fill JOIN c ON c.doc_id = fill.doc_id AND c.k = fill.k + 1),
w AS (SELECT doc_id, arg_max(used, k) AS used, arg_max(units, k) AS units FROM fill GROUP BY doc_id), o AS (SELECT c.doc_id, list(unit_no ORDER BY unit_no) FILTER (NOT list_contains(units, unit_no)) AS omitted FROM c JOIN w USING (doc_id) GROUP BY 1)
SELECT doc_id, focus_no, array_to_string(list_sort(units), ',') AS units, coalesce(array_to_string(omitted, ','), '') AS omitted, used, CASE WHEN len(units) = 0 THEN 'oversized_unit' WHEN omitted IS NULL THEN 'complete_window' ELSE 'partial_parent' END AS status FROM w JOIN o USING (doc_id) JOIN f USING (doc_id)""")
def reading_window_greedy(spark, d):
    """Around the middle sentence of every document, within 800 characters."""
    s = read(spark, d, "documents").select("doc_id", F.posexplode(T.sentences("text")).alias("unit_no", "s"))
    u = s.select("doc_id", "unit_no", F.col("unit_no").alias("group_no"), F.col("s.start").alias("start_at"), F.col("s.end").alias("end_at"))
    u = written(u, shared(spark))  # four joins read the places of the sentences; the texts are cut up once
    f = u.groupBy("doc_id").agg(F.floor(F.max("unit_no") / 2).cast("int").alias("focus_no")).select(F.col("doc_id").alias("focus_id"), "doc_id", "focus_no")
    listed = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return reading.windows(u, f, "doc_id", 800, reach=2).select("doc_id", F.col("focus_no").cast("long").alias("focus_no"), listed("units"), listed("omitted"), F.col("used").cast("long").alias("used"), "status")


@query("""WITH RECURSIVE t AS (SELECT conv_id, turn, role = 'system' AS head, text, length(text) AS n, coalesce(sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM conversations),
runs AS (SELECT conv_id, turn, sum(fresh) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM (SELECT conv_id, turn, (head IS DISTINCT FROM lag(head) OVER (PARTITION BY conv_id ORDER BY turn))::INT AS fresh FROM t)),
stops AS (SELECT conv_id, turn, p FROM t, unnest(range(1, n + 1)) x(p) WHERE p = n OR substr(text, p, 1) IN ('。', '！', '？', '!', '?', '；', ';', chr(10)) OR (substr(text, p, 1) = '.' AND regexp_matches(substr(text, p + 1, 1), '\\s'))),
cuts(conv_id, turn, n, a, z, hard) AS (SELECT conv_id, turn, n, 0::BIGINT, 0::BIGINT, false FROM t
 UNION ALL SELECT c.conv_id, c.turn, c.n, c.z, coalesce(nxt, c.z + 512), nxt IS NULL FROM (SELECT cuts.*, (SELECT max(p) FROM stops s WHERE s.conv_id = cuts.conv_id AND s.turn = cuts.turn AND p > cuts.z AND p <= cuts.z + 512) AS nxt FROM cuts WHERE z < n) c),
pieces AS (SELECT conv_id, turn, run, head, base + a AS a, base + z AS z, hard, hard OR head AS alone, substr(text, a + 1, z - a) AS body, row_number() OVER (PARTITION BY conv_id ORDER BY turn, a) AS k FROM cuts JOIN t USING (conv_id, turn) JOIN runs USING (conv_id, turn) WHERE z > 0),
pack(conv_id, k, unit_no, size, run, alone) AS (SELECT conv_id, k, 0, length(body), run, alone FROM pieces WHERE k = 1
 UNION ALL SELECT x.conv_id, x.k, CASE WHEN x.alone OR p.alone OR x.run <> p.run OR p.size + 1 + length(x.body) > 512 THEN unit_no + 1 ELSE unit_no END, CASE WHEN x.alone OR p.alone OR x.run <> p.run OR p.size + 1 + length(x.body) > 512 THEN length(x.body) ELSE p.size + 1 + length(x.body) END, x.run, x.alone FROM pack p JOIN pieces x ON x.conv_id = p.conv_id AND x.k = p.k + 1)
SELECT conv_id, unit_no, CASE WHEN any_value(head) THEN 'heading' ELSE 'paragraph' END AS kind, bool_or(hard) AS fallback_split, string_agg(a::BIGINT || '-' || z::BIGINT, ',' ORDER BY k) AS spans, string_agg(body, chr(10) ORDER BY k) AS unit_text FROM pack JOIN pieces USING (conv_id, k) GROUP BY conv_id, unit_no""")
def embedding_units(spark, d):
    """Turns as paragraphs, those of the system as headings, in units of 512 characters."""
    b = read(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("role") == "system", "heading").otherwise("paragraph").alias("kind"), F.lit("").alias("section"), F.lit(None).cast("int").alias("page"), "text")
    placed = structure.with_offsets(b, "conv_id", "turn", "text")
    u = units.embedding_units(placed, "conv_id", "turn", 512)
    return u.withColumn("spans", F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start_at"].cast("string"), s["end_at"].cast("string"))), ","))


def evidence_rows(spark, d):
    c = chunks_of(spark, d)
    spans = F.array(F.struct(F.col("start_at").alias("start"), F.col("end_at").alias("end"), F.lit(None).cast("int").alias("page")))
    source = F.sha2(F.col("doc_id").cast("string"), 256)
    return c.select("doc_id", source.alias("source_id"), F.lit("v1").alias("version"), (F.col("doc_id") * 1000 + F.col("chunk_no")).alias("seq"), "chunk_id", T.reference(source, F.lit("v1"), spans).alias("ref"), F.col("chunk_text").alias("text"), spans.alias("spans"))


REFS = f"""{CHUNKS}, ev AS (SELECT doc_id, sha256(doc_id::VARCHAR) AS source_id, doc_id * 1000 + chunk_no AS seq, chunk_id, chunk_text AS text,
sha256('{{"source_id": "' || sha256(doc_id::VARCHAR) || '", "spans": [{{"end": ' || end_at || ', "page": null, "start": ' || start_at || '}}], "version": {{"hash": "v1"}}}}') AS ref FROM chunks)"""


@query(f"WITH {REFS} SELECT doc_id, chunk_id, ref FROM ev")
def evidence_reference(spark, d):
    return evidence_rows(spark, d).select("doc_id", "chunk_id", "ref")


@query(f"WITH {REFS} SELECT source_id, 'v1' AS version, min(seq) AS first_seen, count(*) AS n, sha256(string_agg(ref, ',' ORDER BY seq)) AS refs_sha256 FROM ev GROUP BY source_id")
def evidence_group(spark, d):
    g = evidence.group_passages(evidence_rows(spark, d).select("source_id", "version", "seq", "ref"))
    refs = F.array_join(F.transform("passages", lambda p: p["ref"]), ",")
    return g.select("source_id", "version", "first_seen", F.size("passages").cast("long").alias("n"), F.sha2(refs, 256).alias("refs_sha256"))


@query(f"WITH {REFS}, two AS (SELECT ref, seq, text, 'a' AS origin FROM ev UNION ALL SELECT ref, seq + 1000000000, text, 'b' FROM ev WHERE seq % 3 = 0) SELECT ref, min(seq) AS seq, arg_max(origin, seq) AS origin, any_value(text) AS text FROM two GROUP BY ref")
def evidence_union_by_ref(spark, d):
    e = evidence_rows(spark, d).select("ref", "seq", "text")
    again = e.where("seq % 3 = 0").withColumn("seq", F.col("seq") + 1_000_000_000)
    return evidence.union_by_ref(e.withColumn("origin", F.lit("a")), again.withColumn("origin", F.lit("b"))).select("ref", "seq", "origin", "text")


@query(f"WITH {REFS} SELECT sha256(text) AS ref, max(seq) AS seq, arg_max(chunk_id, seq) AS chunk_id FROM ev GROUP BY 1")
def returned_dedup(spark, d):
    e = evidence_rows(spark, d).select(F.sha2("text", 256).alias("ref"), "seq", "chunk_id")
    return evidence.returned_once(e).select("ref", "seq", "chunk_id")


@query(f"""WITH {CHUNKS}, s AS (SELECT DISTINCT doc_id, start_at, end_at FROM chunks), t AS (SELECT doc_id, start_at, end_at, row_number() OVER (PARTITION BY doc_id ORDER BY start_at, end_at) - 1 AS span_no FROM s)
SELECT doc_id, span_no, start_at, end_at FROM t""")
def span_dictionary(spark, d):
    e = evidence_rows(spark, d).select(F.col("doc_id").alias("source_id"), "chunk_id", F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))
    table, _ = evidence.span_dictionary(e)
    return table.select(F.col("source_id").alias("doc_id"), F.col("span_no").cast("long").alias("span_no"), F.col("span.start").alias("start_at"), F.col("span.end").alias("end_at"))


HEADER = 50


@query(f"""WITH {REFS}, e AS (SELECT *, seq % 1000 AS n, '0-{HEADER},' || ((seq % 1000) * {LIMIT}) || '-' || ((seq % 1000) * {LIMIT} + length(text)) AS spans FROM ev)
SELECT e.source_id, e.seq, sha256(e.text) AS text_sha256, e.spans, e.chunk_id || ':' || e.spans || CASE WHEN e.n % 2 = 1 THEN ';' || p.chunk_id || ':' || p.spans ELSE '' END AS chunk_refs, false AS boxes
FROM e LEFT JOIN e p ON p.source_id = e.source_id AND p.seq = e.seq - 1""")
def compact_round_trip(spark, d):
    """Passages with a header span and bindings to one or two chunks, coded, decoded, coded again and decoded (AG3, AG4, AG5)."""
    e = evidence_rows(spark, d).withColumn("n", F.col("seq") % 1000)
    span = lambda a, z: F.struct(a.cast("int").alias("start"), z.cast("int").alias("end"), F.lit(None).cast("int").alias("page"), F.lit("box").alias("bbox"))
    own = F.array(span(F.lit(0), F.lit(HEADER)), span(F.col("spans")[0]["start"], F.col("spans")[0]["end"]))
    before = (F.col("n") - 1) * LIMIT
    earlier = F.array(span(F.lit(0), F.lit(HEADER)), span(before, before + LIMIT))
    bind = lambda chunk, spans: F.struct(chunk.alias("chunk_id"), spans.alias("spans"))
    refs = F.when(F.col("n") % 2 == 1, F.array(bind(F.col("chunk_id"), own), bind(F.concat(F.lit("c"), (F.col("n") - 1).cast("string")), earlier))).otherwise(F.array(bind(F.col("chunk_id"), own)))
    back = transport.decode(transport.encode(e.select("source_id", "version", "seq", "chunk_id", "text", own.alias("spans"), refs.alias("chunk_refs"))))
    back = transport.decode(transport.encode(back))
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    listed = F.array_join(F.transform("chunk_refs", lambda r: F.concat(r["chunk_id"], F.lit(":"), shown(r["spans"]))), ";")
    boxes = F.lit("bbox" in back.schema["spans"].dataType.elementType.fieldNames())
    return back.select("source_id", "seq", F.sha2("text", 256).alias("text_sha256"), shown(F.col("spans")).alias("spans"), listed.alias("chunk_refs"), boxes.alias("boxes"))


@query(f"""WITH RECURSIVE {FUSED.replace('lex AS (WITH', 'lex AS (WITH', 1)}, {CHUNKS}, r AS (SELECT doc_id, list_sort(list(DISTINCT sha256(chunk_text))) AS refs FROM chunks GROUP BY doc_id),
ranked AS (SELECT query_id, rank, refs FROM fused JOIN r ON r.doc_id = source_id), {cover_sql('ranked', 6)} SELECT query_id, array_to_string(kept, ',') AS kept FROM cover""")
def selection_cover_dedup(spark, d):
    fused = rrf_fusion(spark, d)
    refs = fused.join(chunks_of(spark, d).groupBy(F.col("doc_id").alias("source_id")).agg(F.array_sort(F.collect_set(F.sha2("chunk_text", 256))).alias("refs")), "source_id")
    return retrieval.select_uncovered(refs, 6).select("query_id", F.array_join(F.col("kept").cast("array<string>"), ",").alias("kept"))


@query(f"""WITH {FUSED}, {CHUNKS}, q AS (SELECT item_id AS query_id, {WORDS.format('text')} AS qt FROM benchmark), v AS (SELECT DISTINCT doc_id AS source_id, chunk_no, {WORDS.format('chunk_text')} AS vt FROM chunks),
x AS (SELECT query_id, rank AS place, max(len(list_intersect(qt, vt)) / sqrt(greatest(1, len(vt)))) AS score, count(*) AS pairs FROM fused JOIN q USING (query_id) JOIN v USING (source_id) GROUP BY 1, 2)
SELECT query_id, place, score, pairs, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, place) AS rank FROM x""")
def rerank_blocks(spark, d):
    """All chunks of each fused candidate as views; a candidate goes by its best."""
    fused = rrf_fusion(spark, d)
    views = chunks_of(spark, d).groupBy(F.col("doc_id").alias("source_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "chunk_text"))), lambda x: x["chunk_text"]).alias("views"))
    c = fused.join(items_of(spark, d), "query_id").join(views, "source_id").select("query_id", F.col("rank").alias("place"), "query", "views")
    return retrieval.rerank(c, retrieval.overlap_score)


def bundles_of(spark, d):
    lab = read(spark, d, "labels")
    e = evidence_rows(spark, d).join(lab, "doc_id")
    b = e.groupBy(F.col("doc_id").alias("bundle_id")).agg(F.array_sort(F.collect_list("ref")).alias("refs"), F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return b.select(
        "bundle_id", (F.col("bundle_id") % 40).alias("question_id"), "refs", F.when(F.col("quality") == 1, "adequate").otherwise("unassessed").alias("adequacy"),
        F.when(F.col("bundle_id") % 4 == 3, "partial_parent").otherwise("complete_window").alias("structure"), F.when(F.col("toxic") == 1, "conflicts").otherwise("supports").alias("relation"),
    )


def questions_of(spark, d):
    state = F.element_at(F.array(*(F.lit(s) for s in ("supported", "conflicting", "partial", "unresolved"))), (F.col("item_id") % 4 + 1).cast("int"))
    return read(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), state.alias("state"))


@query(f"""WITH {REFS}, b AS (SELECT doc_id AS bundle_id, doc_id % 40 AS question_id, list(ref) AS refs, max(quality) AS quality, max(toxic) AS toxic, doc_id % 4 <> 3 AS complete, bool_and(seq % 5 <> 0) AS available FROM ev JOIN labels USING (doc_id) GROUP BY doc_id),
a AS (SELECT question_id, bool_or(quality = 1 AND complete) AS adequate, bool_or(toxic = 1 AND len(refs) > 1) AS conflict FROM b WHERE available GROUP BY 1),
q AS (SELECT item_id AS question_id, ['supported', 'conflicting', 'partial', 'unresolved'][item_id % 4 + 1] AS state FROM benchmark)
SELECT question_id, state, CASE WHEN state = 'supported' AND NOT coalesce(adequate, false) OR state = 'conflicting' AND NOT coalesce(conflict, false) THEN CASE WHEN a.question_id IS NULL THEN 'unresolved' ELSE 'partial' END ELSE state END AS delivered_state FROM q LEFT JOIN a USING (question_id)""")
def coverage_rollup(spark, d):
    selected = evidence_rows(spark, d).where("seq % 5 <> 0").select("ref")
    return evidence.coverage(questions_of(spark, d), bundles_of(spark, d), selected)


#: A row for each turn: the question at the head of the queue takes its first offer that fits, and goes to the end; else it leaves.
PACKING = f"""WITH RECURSIVE {REFS},
sized AS (SELECT doc_id, ref, length(ref) + strlen(replace(replace(replace(replace(replace(text, chr(92), 'xx'), '"', 'xx'), chr(10), 'xx'), chr(13), 'xx'), chr(9), 'xx'))
  + 5 * len(regexp_extract_all(text, '[\\x00-\\x07\\x0b\\x0e-\\x1f]')) + 25 AS bytes FROM ev),
b AS (SELECT doc_id, doc_id % 40 AS stage, (doc_id % 7)::INT AS q, max(quality) = 1 AS adequate, max(toxic) = 1 AS conflict, sum(bytes) AS cost, min(ref) AS ref FROM sized JOIN labels USING (doc_id) GROUP BY doc_id),
p AS (SELECT stage, q, arg_min(doc_id % 3, ref) AS tier FROM b GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY stage, deal, q ORDER BY NOT conflict, cost, doc_id::VARCHAR) AS r FROM (SELECT b.*, tier * 2 + (NOT adequate)::INT AS deal FROM b JOIN p USING (stage, q))),
deals AS (SELECT stage, deal, list(DISTINCT q ORDER BY q) AS qs FROM o GROUP BY ALL),
turn(stage, n, deal, qs, past, used, got) AS (
  SELECT DISTINCT stage, 0, -1::BIGINT, []::INT[], [0, 0, 0, 0, 0, 0, 0]::BIGINT[], 0::HUGEINT, NULL::BIGINT FROM b
  UNION ALL
  SELECT t.stage, t.n + 1, t.deal + (len(t.qs) = 0)::INT,
    CASE WHEN len(t.qs) = 0 THEN coalesce(d.qs, []) WHEN o.r IS NULL THEN t.qs[2:] ELSE list_append(t.qs[2:], t.qs[1]) END,
    CASE WHEN len(t.qs) = 0 THEN [0, 0, 0, 0, 0, 0, 0] WHEN o.r IS NULL THEN t.past ELSE list_transform(range(1, 8), lambda i: CASE WHEN i = t.qs[1] + 1 THEN o.r ELSE t.past[i] END) END,
    t.used + coalesce(o.cost, 0), o.doc_id
  FROM (SELECT *, (SELECT min(r) FROM o WHERE o.stage = turn.stage AND o.deal = turn.deal AND o.q = turn.qs[1] AND o.r > turn.past[turn.qs[1] + 1] AND o.cost + turn.used <= 24000) AS r FROM turn WHERE NOT (deal >= 5 AND len(qs) = 0)) t
  LEFT JOIN o ON o.stage = t.stage AND o.deal = t.deal AND o.q = t.qs[1] AND o.r = t.r
  LEFT JOIN deals d ON d.stage = t.stage AND d.deal = t.deal + 1 AND len(t.qs) = 0),
small AS (SELECT stage, sum(cost) <= 24000 AS whole FROM b GROUP BY stage)
SELECT b.stage AS stage_id, ev.ref, whole OR got IS NOT NULL AS selected FROM b JOIN ev USING (doc_id) JOIN small ON small.stage = b.stage LEFT JOIN turn ON turn.got = b.doc_id"""


@query(PACKING)
def evidence_packing(spark, d):
    """One stage per question: its bundles' originals under 24,000 serialized bytes."""
    e = evidence_rows(spark, d).select("ref", F.col("text").alias("body")).dropDuplicates(["ref"])
    b = bundles_of(spark, d).select("*", F.explode("refs").alias("ref")).join(e, "ref")
    priority = F.element_at(F.array(*(F.lit(p) for p in ("essential", "important", "optional"))), (F.col("bundle_id") % 3 + 1).cast("int"))
    rows = b.select(F.col("question_id").alias("stage_id"), "ref", "body", F.col("bundle_id").cast("string").alias("bundle_id"), (F.col("bundle_id") % 7).cast("string").alias("question_id"), priority.alias("priority"), F.lit("partial").alias("state"), "adequacy", "relation", F.lit(False).alias("required"))
    return packing.pack(rows, 24_000)


def claims_of(spark, d):
    hits = lexical_topk(spark, d).where("rank = 1 and score > 1")
    return hits.select(F.col("query_id").alias("item_id"), F.lit("supported").alias("status"), F.concat(F.lit("source "), F.col("source_id").cast("string")).alias("explanation"))


SCOPE = f"""lex AS ({lexical_sql()}), sc AS (SELECT b.item_id, coalesce(CASE WHEN l.source_id IS NOT NULL THEN 'supported' END, 'unresolved') AS status, coalesce('source ' || l.source_id, 'unexamined') AS explanation
FROM benchmark b LEFT JOIN (SELECT * FROM lex WHERE rank = 1 AND score > 1) l ON b.item_id = l.query_id)"""


@query(f"WITH {SCOPE} SELECT item_id, status, explanation FROM sc")
def scope_status(spark, d):
    return evidence.scope_status(read(spark, d, "benchmark").select("item_id"), claims_of(spark, d))


@query(f"WITH {SCOPE} SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 'supported' ELSE status END AS status, CASE WHEN item_id % 3 = 0 THEN 'recovered' ELSE explanation END AS explanation FROM sc")
def merge_scope(spark, d):
    again = read(spark, d, "benchmark").select("item_id", F.when(F.col("item_id") % 3 == 0, "supported").otherwise("unresolved").alias("status"), F.lit("recovered").alias("explanation"))
    return evidence.merge_scope(scope_status(spark, d), again)


CRITERIA = ("coverage", "accuracy", "clarity")


def rubric_of(spark, d):
    lab = read(spark, d, "labels")
    each = lab.select(F.col("doc_id").alias("review_id"), "quality", "toxic", F.explode(F.array(*map(F.lit, CRITERIA))).alias("criterion"))
    rating = F.when((F.col("criterion") == "coverage") & (F.col("quality") == 0), "Partly meets").when((F.col("criterion") == "accuracy") & (F.col("review_id") % 11 == 0), "Does not meet").otherwise("Meets")
    explained = F.when((F.col("review_id") % 13 == 0) & (F.col("criterion") == "clarity"), "  ").otherwise("because")
    return each.select("review_id", "criterion", rating.alias("rating"), explained.alias("explanation"))


@query("""SELECT doc_id AS review_id, CASE WHEN doc_id % 13 = 0 THEN 'partial' ELSE 'complete' END AS status,
CASE WHEN doc_id % 13 = 0 OR doc_id % 11 = 0 OR toxic = 1 THEN 'needs revision' WHEN quality = 0 THEN 'ready with disclosed limitations' ELSE 'ready' END AS decision FROM labels""")
def rubric_decision(spark, d):
    lab = read(spark, d, "labels")
    reviews = lab.select(F.col("doc_id").alias("review_id"), F.lit("ready").alias("decision"), F.lit("all").alias("review_scope"))
    issues = lab.select(F.col("doc_id").alias("review_id"), F.when(F.col("toxic") == 1, "material").otherwise("minor").alias("severity"))
    return review.assess(rubric_of(spark, d), reviews, issues, CRITERIA)


def issues_of(spark, d):
    e = read(spark, d, "events")
    kind = F.element_at(F.array(*(F.lit(k) for k in ("missing_evidence", "conflict", "source_limitation", "explanation"))), (F.col("event_id") % 4 + 1).cast("int"))
    return e.select((F.col("user_id") % 50).alias("report_id"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 3 == 0, "minor").otherwise("material").alias("severity"), kind.alias("kind"), F.concat("event_type", F.lit(" at "), (F.col("event_id") % 20).cast("string")).alias("location"), F.array(F.col("event_type")).alias("origins"))


ISSUES = """i AS (SELECT user_id % 50 AS report_id, event_id AS seq, CASE WHEN event_id % 3 = 0 THEN 'minor' ELSE 'material' END AS severity, ['missing_evidence', 'conflict', 'source_limitation', 'explanation'][event_id % 4 + 1] AS kind, event_type || ' at ' || event_id % 20 AS location FROM events),
f AS (SELECT report_id, severity, kind, location, min(seq) AS seq FROM i GROUP BY ALL), n AS (SELECT *, 'finding-' || (row_number() OVER (PARTITION BY report_id ORDER BY seq) - 1) AS finding_id FROM f),
r AS (SELECT report_id, finding_id, seq, kind, location, CASE WHEN kind IN ('missing_evidence', 'conflict') THEN 'research' WHEN kind = 'source_limitation' THEN 'qualify' ELSE 'revise' END AS action FROM n WHERE severity = 'material')"""


@query(f"WITH {ISSUES} SELECT report_id, finding_id, action, kind, location FROM r")
def issue_route(spark, d):
    return review.route(issues_of(spark, d), ["severity", "kind", "location"], "report_id").select("report_id", "finding_id", "action", "kind", "location")


@query(f"WITH {ISSUES} SELECT report_id || ':' || finding_id AS finding_id, action FROM r WHERE NOT (action = 'revise' OR seq % 7 = 0)")
def unresolved_findings(spark, d):
    routed = review.route(issues_of(spark, d), ["severity", "kind", "location"], "report_id")
    routed = routed.select(F.concat_ws(":", F.col("report_id").cast("string"), "finding_id").alias("finding_id"), "action", "seq")
    records = routed.where("action = 'revise' or seq % 7 = 0").select("finding_id", F.lit("resolved").alias("status"), F.lit("done").alias("explanation"))
    return review.unresolved(routed, records).select("finding_id", "action")


def invocations_of(spark, d):
    e = read(spark, d, "events")
    return e.select("user_id", "event_id", "event_type", F.col("value").alias("wanted"), F.when(F.col("event_type") == "error", F.lit(None).cast("double")).otherwise(F.col("value") / 2).alias("seconds"), F.least(F.col("value"), F.lit(900.0)).alias("reserved"))


@query("""WITH c AS (SELECT user_id, event_id, coalesce(CASE WHEN event_type <> 'error' THEN value / 2 END, least(value, 900.0)) AS charged FROM events)
SELECT user_id, event_id, round(coalesce(sum(charged) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 4) AS used_before, round(sum(charged) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS used_after FROM c WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def ledger_usage(spark, d):
    return ledger.usage(invocations_of(spark, d), "user_id", ["event_id"]).select("user_id", "event_id", F.round("used_before", 4).alias("used_before"), F.round("used_after", 4).alias("used_after"))


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, value AS wanted, CASE WHEN event_type <> 'error' THEN value / 2 END AS seconds, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
r(user_id, event_id, k, used, n, cap, admitted, lim) AS (SELECT DISTINCT user_id, NULL::BIGINT, 0::BIGINT, 0.0::DOUBLE, 0, NULL::DOUBLE, false, NULL::VARCHAR FROM e
 UNION ALL SELECT e.user_id, e.event_id, e.k, CASE WHEN n < 10 AND least(wanted, 60.0, 400.0 - used) > 0 THEN used + coalesce(seconds, least(wanted, 60.0, 400.0 - used)) ELSE used END,
 CASE WHEN n < 10 AND least(wanted, 60.0, 400.0 - used) > 0 THEN n + 1 ELSE n END, least(wanted, 60.0, 400.0 - used), n < 10 AND least(wanted, 60.0, 400.0 - used) > 0,
 CASE WHEN n >= 10 THEN 'call_ceiling' WHEN wanted <= 60.0 AND wanted <= 400.0 - used THEN 'requested_allowance' WHEN 60.0 <= 400.0 - used THEN 'call_cap' ELSE 'aggregate_invocation' END FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)
SELECT user_id, event_id, admitted, CASE WHEN admitted THEN cap END AS reserved, lim AS limiting_resource, used AS used_after FROM r WHERE k > 0""")
def ledger_admission(spark, d):
    return ledger.admissions(invocations_of(spark, d), "user_id", ["event_id"], 400.0, 60.0, 10)


@query("""WITH l AS (SELECT event_id, value AS allowance, 'requested_allowance' AS limit_name, 0 AS position FROM events UNION ALL SELECT event_id, 50.0, 'campaign_elapsed', 1 FROM events UNION ALL SELECT event_id, (event_id % 90)::DOUBLE, 'attempt_elapsed', 2 FROM events)
SELECT event_id, min(allowance) AS cap, arg_min(limit_name, (allowance, position)) AS limiting_resource FROM l GROUP BY event_id""")
def limiting_resource(spark, d):
    e = read(spark, d, "events").select("event_id", "value")
    limit = lambda a, n, i: F.struct(a.alias("allowance"), F.lit(n).alias("limit_name"), F.lit(i).alias("position"))
    limits = F.array(limit(F.col("value"), "requested_allowance", 0), limit(F.lit(50.0), "campaign_elapsed", 1), limit((F.col("event_id") % 90).cast("double"), "attempt_elapsed", 2))
    return ledger.limiting(e.select("event_id", F.inline(limits)), ["event_id"])


@query("SELECT user_id, event_id, event_type, back FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS back FROM events) WHERE back <= 8")
def event_last8(spark, d):
    return ledger.last_outcomes(read(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", ["event_id"]).select("user_id", "event_id", "event_type", F.col("back").cast("long").alias("back"))


@query("SELECT user_id, query, last_id AS event_id FROM (SELECT user_id, sha256(event_type || event_id % 7) AS query, max(event_id) AS last_id, arg_max(value < 20, event_id) AS failed FROM events GROUP BY ALL) WHERE failed")
def failed_queries_latest(spark, d):
    e = read(spark, d, "events").select("user_id", F.sha2(F.concat("event_type", (F.col("event_id") % 7).cast("string")), 256).alias("query"), "event_id", (F.col("value") < 20).alias("failed"))
    return ledger.standing_failures(e, ["user_id", "query"], ["event_id"])


@query()
def html_blocks(spark, d):
    return parse_pages(read(spark, d, "pages"))


@query(f"WITH {CHUNKS} SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def quote_places(spark, d):
    """Documents that hold a benchmark text word for word."""
    q = read(spark, d, "benchmark").select("item_id", F.col("text").alias("quote"))
    return evidence.places(q, read(spark, d, "documents"), "item_id", "doc_id")


@query(f"""WITH {CHUNKS}, q AS (SELECT item_id, item_id AS doc_id, 'c' || item_id % 2 AS chunk_id, text AS quote FROM benchmark) SELECT item_id, q.doc_id, q.chunk_id FROM q LEFT JOIN chunks c ON q.doc_id = c.doc_id AND q.chunk_id = c.chunk_id WHERE NOT coalesce(length(quote) > 0 AND contains(chunk_text, quote), false)""")
def quote_violations(spark, d):
    q = read(spark, d, "benchmark").select("item_id", F.col("item_id").alias("doc_id"), F.concat(F.lit("c"), (F.col("item_id") % 2).cast("string")).alias("chunk_id"), F.col("text").alias("quote"))
    return evidence.misquoted(q, chunks_of(spark, d), ["doc_id", "chunk_id"]).select("item_id", "doc_id", "chunk_id")


@query("""WITH t AS (SELECT event_type AS name, user_id::VARCHAR AS arguments, min(event_id) AS seq, arg_min(value::VARCHAR, event_id) AS result FROM events WHERE event_id % 2 = 0 GROUP BY 1, 2)
SELECT e.event_id, t.seq IS NOT NULL AS found, round(t.result::DOUBLE, 6) AS result FROM events e LEFT JOIN t ON t.name = e.event_type AND t.arguments = e.user_id::VARCHAR""")
def replay_lookup(spark, d):
    e = read(spark, d, "events").select("event_id", F.col("event_type").alias("name"), F.col("user_id").cast("string").alias("arguments"), F.lit("s").alias("sources"), F.col("value").cast("string").alias("result"))
    trace = e.where("event_id % 2 = 0").withColumnRenamed("event_id", "seq")
    return evidence.replay(e.drop("result"), trace).select("event_id", "found", F.round(F.col("result").cast("double"), 6).alias("result"))


@query("""WITH a AS (SELECT source, doc_id // 1000 AS g, count(*) AS n, sha256(string_agg(doc_id || ':' || sha256(text), ',' ORDER BY doc_id)) AS h FROM documents GROUP BY ALL),
b AS (SELECT source, g // 1000 AS g, sum(n) AS n, sha256(string_agg(h, ',' ORDER BY g)) AS h FROM a GROUP BY source, a.g // 1000)
SELECT source, sum(n)::BIGINT AS n, sha256(string_agg(h, ',' ORDER BY g)) AS digest FROM b GROUP BY source""")
def manifest_digest(spark, d):
    """A digest of digests per source (AG16, SC11)."""
    e = read(spark, d, "documents").select("source", "doc_id", F.concat_ws(":", F.col("doc_id").cast("string"), F.sha2("text", 256)).alias("line"))
    return evidence.tree_digest(e, "source", "doc_id", "line")


@query(f"""WITH {FUSED}, l AS (SELECT query_id, count(DISTINCT source_id) AS n_lexical FROM lex GROUP BY 1), h AS (SELECT query_id, count(*) AS n_fused, count(*) FILTER (rank <= 6) AS n_returned FROM fused GROUP BY 1),
x AS (SELECT query_id, count(*) AS n_new FROM fused f WHERE NOT EXISTS (SELECT 1 FROM lex l WHERE l.query_id = f.query_id AND l.source_id = f.source_id) GROUP BY 1)
SELECT query_id, n_lexical, n_fused, n_returned, coalesce(n_new, 0) AS n_new FROM l JOIN h USING (query_id) LEFT JOIN x USING (query_id)""")
def eval_paired(spark, d):
    """Lexical against fused pools of each item (AG15)."""
    b = branches_of(spark, d)
    lex = b["chunks"].select("query_id", "source_id").distinct()
    fused = retrieval.fuse(b, ["source_id"])
    both = fused.join(lex.withColumn("in_lexical", F.lit(True)), ["query_id", "source_id"], "left")
    f = both.groupBy("query_id").agg(F.count("*").alias("n_fused"), F.count_if(F.col("rank") <= 6).alias("n_returned"), F.count_if(F.col("in_lexical").isNull()).alias("n_new"))
    return lex.groupBy("query_id").agg(F.count("*").alias("n_lexical")).join(f, "query_id").select("query_id", "n_lexical", "n_fused", "n_returned", "n_new")


@query("SELECT event_type, count(*) AS n, round(sum(value), 2) AS value FROM (SELECT DISTINCT ON (event_id) * FROM events) GROUP BY event_type")
def stream_event_dedup(spark, d):
    return streams.deduplicated_totals(spark, f"{d}/events.parquet")


@query("SELECT user_id, count(*) AS n, round(sum(value), 2) AS used, max(event_id) AS last_event FROM events GROUP BY user_id")
def stream_ledger(spark, d):
    return streams.ledger_totals(spark, f"{d}/events.parquet")
