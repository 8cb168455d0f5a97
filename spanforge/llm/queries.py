"""The queries of this package, each over its whole intended table."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import clusters, conversations, decontaminate, fingerprints, licenses, mixing, near_dup, page_text, pii, quality, repeats, secrets, urls
from .common import read, span_list
from .oracles import ORACLES as MORE_ORACLES


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.personal_data(docs)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id",
        *(count(k.name) for k in pii.BASE),
        F.sha2(span_list(F.col("base")), 256).alias("base_sha256"),
        span_list(F.concat("base", "more")).alias("spans"),
        F.array_max(F.transform(F.concat("base", "more"), lambda s: s["score"])).alias("max_score"),
    )


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.secrets(docs)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    rank = lambda s: F.element_at(F.create_map(*(F.lit(x) for kv in secrets.ORDER.items() for x in kv)), s["kind"])
    by_start = F.array_sort(
        F.concat("base", "more"),
        lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).when(rank(a) < rank(b), -1).when(rank(a) > rank(b), 1).otherwise(0),
    )
    return found.select("doc_id", *(count(k) for k in ("assign", "access", "hex")), F.sha2(span_list(F.col("base")), 256).alias("base_sha256"), span_list(by_start).alias("spans"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = licenses.licenses(docs)
    base = F.filter("places", lambda s: s["base"])
    labels = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda s: s["label"]))), ",")
    start = F.transform(base, lambda s: s["start"])
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(start).alias("first_word"),
        F.array_max(start).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda s: s["score"])), F.lit(0.0)).alias("score"),
    )


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(read(spark, sf_dir, "documents"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = page_text.extract_pages(read(spark, sf_dir, "pages"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Budget: the tokens there are; entropy 0.97 of the largest, no source more than 4 times."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mixed(docs).select("doc_id", "source", "copies", "weight", "block", "block_order")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op6_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(read(spark, sf_dir, "documents"))


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(read(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damaged(read(spark, sf_dir, "conversations")))


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.inertia(read(spark, sf_dir, "embeddings"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read(spark, sf_dir, "pages"))


QUERIES = {"op13_url_filter": op13_url_filter, "op12_clusters": op12_clusters, "op11_conversation_repair": op11_conversation_repair, "op8_repeats": op8_repeats, "op6_near_dup": op6_near_dup, "op5_decontaminate": op5_decontaminate, "op7_mixing": op7_mixing, "op9_page_text": op9_page_text, "op1_quality": op1_quality, "op3_fingerprints": op3_fingerprints, "op4_licenses": op4_licenses, "op2_secrets": op2_secrets, "op10_pii": op10_pii}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What the contracts of two operators say, pair by pair and window by window.
ORACLES: dict[str, str] = {
    "op6_near_dup": f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(words) < 5 THEN [array_to_string(words, ' ')] ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i : i + 4], ' ')) END) AS shingles FROM w WHERE len(words) > 0),
e AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS shared FROM e a JOIN e b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * shared >= 75 * (na + nb - shared)), links AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.other)
SELECT d.doc_id, coalesce(len(shingles), 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d LEFT JOIN s USING (doc_id) JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1) USING (doc_id)""",
    "op8_repeats": """WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents), pieces AS (SELECT doc_id, j, substr(h, 200 * j + 1, 400) AS p FROM h, unnest(range(0, length(h) // 200 + 1)) t(j)),
w AS (SELECT doc_id, 100 * j + i AS i, substr(p, 2 * i + 1, 200) AS s FROM pieces, unnest(range(0, least(100, length(p) // 2 - 99))) t(i)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY md5(s) ORDER BY doc_id, i) AS nth FROM w) WHERE nth > 1),
runs AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS z FROM (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT doc_id, i, (i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -1000) > 100)::INT AS fresh FROM again)) GROUP BY doc_id, run),
cuts AS (SELECT doc_id, a, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM runs UNION ALL SELECT doc_id, length(h) // 2, coalesce(z, 0) FROM h LEFT JOIN (SELECT doc_id, max(z) AS z FROM runs GROUP BY 1) USING (doc_id)),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY since, a) AS k FROM cuts JOIN h USING (doc_id) GROUP BY doc_id)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(k)) AS kept_sha256 FROM h JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans FROM runs GROUP BY 1) USING (doc_id)""",
}
ORACLES |= MORE_ORACLES
