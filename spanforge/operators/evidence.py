"""Grouping, union, transport and audit of evidence passages."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from spanforge.functions import text as T


def group_passages(passages: DataFrame, source: str = "source_id", version: str = "version", order: str = "seq") -> DataFrame:
    """One row per source in first-seen order with its passages in order (AG2, H18); two versions of a source are an error."""
    body = F.struct(order, *(c for c in passages.columns if c not in (source, version, order)))
    out = passages.groupBy(source).agg(F.min(version).alias(version), F.max(version).alias("__high"), F.min(order).alias("first_seen"), F.array_sort(F.collect_list(body)).alias("passages"))
    checked = F.when(F.col(version).eqNullSafe(F.col("__high")), F.col(version)).otherwise(F.raise_error(F.lit("conflicting versions of a source")))
    return out.withColumn(version, checked).drop("__high")


def ungroup(grouped: DataFrame, source: str = "source_id", version: str = "version") -> DataFrame:
    """Inverse of ``group_passages`` (AG3)."""
    return grouped.select(source, version, F.explode("passages").alias("p")).select(source, version, "p.*")


def union_by_ref(*parts: DataFrame, ref: str = "ref", text: str = "text", order: str = "seq") -> DataFrame:
    """Union of evidence by reference (ST1, ST2): the first place stays, the last row's fields win, two texts of one ref are an error."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p, allowMissingColumns=True)
    fields = [c for c in every.columns if c not in (ref, order)]
    # texts are told apart by their digests: a row carries its text once
    out = every.groupBy(ref).agg(F.max_by(F.struct(*fields), order).alias("row"), F.min(order).alias(order), F.min(F.sha2(text, 256)).alias("__low"), F.max(F.sha2(text, 256)).alias("__high"))
    ok = F.when(F.col("__low").eqNullSafe(F.col("__high")), F.col("row")).otherwise(F.raise_error(F.lit("one reference with two texts")))
    return out.withColumn("row", ok).select(ref, order, "row.*")


def returned_once(rows: DataFrame, ref: str = "ref", order: str = "seq") -> DataFrame:
    """The last row of each reference (ST7)."""
    return rows.groupBy(ref).agg(F.max_by(F.struct(*(c for c in rows.columns if c != ref)), order).alias("row")).select(ref, "row.*")


def span_dictionary(passages: DataFrame, source: str = "source_id", spans: str = "spans") -> tuple[DataFrame, DataFrame]:
    """Distinct spans of each source, numbered, and passages that point at them (AG5).

    Returns ``(table, coded)``; ``coded`` keeps the plain spans of a passage where pointers would not be shorter.
    """
    each = passages.select(source, F.explode(spans).alias("span")).distinct()
    w = Window.partitionBy(source).orderBy("span")
    table = each.withColumn("span_no", F.row_number().over(w) - 1)
    at = passages.select("*", F.posexplode(spans).alias("__at", "span")).join(table, [source, "span"])
    keys = [c for c in passages.columns if c != spans]
    coded = at.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("__at", "span_no"))), lambda x: x["span_no"]).alias("span_refs"), F.transform(F.array_sort(F.collect_list(F.struct("__at", "span"))), lambda x: x["span"]).alias("__plain"))
    shorter = F.octet_length(F.to_json("span_refs")) < F.octet_length(F.to_json("__plain"))
    coded = coded.withColumn(spans, F.when(~shorter, F.col("__plain"))).withColumn("span_refs", F.when(shorter, F.col("span_refs"))).drop("__plain")
    return table, coded


def compact(passages: DataFrame, source: str = "source_id", version: str = "version", order: str = "seq") -> DataFrame:
    """Columnar transport of a source's passages: one array per field, equal lengths, in order (AG4)."""
    grouped = group_passages(passages, source, version, order)
    fields = grouped.schema["passages"].dataType.elementType.fieldNames()
    return grouped.select(source, version, "first_seen", F.struct(*(_field(f) for f in fields)).alias("columns"))


def _field(name: str) -> Column:
    return F.transform("passages", lambda p: p[name]).alias(name)


def expand(compacted: DataFrame, source: str = "source_id", version: str = "version") -> DataFrame:
    """Inverse of ``compact``."""
    fields = compacted.schema["columns"].dataType.fieldNames()
    rows = F.arrays_zip(*(F.col(f"columns.{f}").alias(f) for f in fields))
    return compacted.select(source, version, F.explode(rows).alias("p")).select(source, version, "p.*")


def misquoted(quotes: DataFrame, chunks: DataFrame, on: list[str], quote: str = "quote", text: str = "chunk_text") -> DataFrame:
    """Quotes that are empty, or not in the chunk they name, or whose chunk is missing (FI6)."""
    found = quotes.join(chunks.select(*on, F.col(text).alias("__text")), on, "left")
    return found.where(~F.coalesce((F.length(quote) > 0) & F.col("__text").contains(F.col(quote)), F.lit(False))).drop("__text")


def reverify(evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """Evidence whose text is no longer what its spans say, or whose version is another (JN9, JN4)."""
    s = sources.select("source_id", F.col("version").alias("__version"), F.col("text").alias("__text"))
    both = evidence.join(s, "source_id", "left")
    pieces = F.transform("spans", lambda x: F.substr(F.col("__text"), x["start"] + 1, x["end"] - x["start"]))
    ok = F.col("version").eqNullSafe(F.col("__version")) & ((F.col("text") == F.array_join(pieces, "\n")) | (F.col("text") == F.array_join(pieces, "")))
    return both.where(~F.coalesce(ok, F.lit(False))).drop("__version", "__text")


def merge_bundles(bundles: DataFrame) -> DataFrame:
    """Bundles of one id: refs and continuations united and sorted, complete only if all are (AG18)."""
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    complete = F.when(F.bool_and(F.col("structure") == "complete_window"), "complete_window").otherwise("partial_parent").alias("structure")
    return bundles.groupBy("bundle_id", "question_id").agg(union("refs"), union("continuations"), complete)


def coverage(questions: DataFrame, bundles: DataFrame, selected: DataFrame) -> DataFrame:
    """What a selection delivers of each question (AG8, JN12).

    A bundle is available if all its refs are selected; "supported" holds only with an adequate
    complete one, "conflicting" only with a conflict of two refs or more; else partial or unresolved.
    """
    refs = bundles.select("bundle_id", F.explode("refs").alias("ref")).join(selected.select("ref").distinct().withColumn("have", F.lit(True)), "ref", "left")
    have = refs.groupBy("bundle_id").agg(F.bool_and(F.coalesce("have", F.lit(False))).alias("available"))
    b = bundles.join(have, "bundle_id", "left").withColumn("available", F.coalesce("available", F.size("refs") == 0))
    per = b.where("available").groupBy("question_id").agg(
        F.bool_or((F.col("adequacy") == "adequate") & (F.col("structure") == "complete_window")).alias("adequate"),
        F.bool_or((F.col("relation") == "conflicts") & (F.size("refs") > 1)).alias("conflict"),
    )
    q = questions.join(per.withColumn("any", F.lit(True)), "question_id", "left")
    less = F.when(F.col("any"), "partial").otherwise("unresolved")
    state = F.when((F.col("state") == "supported") & ~F.coalesce("adequate", F.lit(False)), less).when((F.col("state") == "conflicting") & ~F.coalesce("conflict", F.lit(False)), less).otherwise(F.col("state"))
    return q.select("question_id", "state", state.alias("delivered_state"))


def scope_status(required: DataFrame, claims: DataFrame) -> DataFrame:
    """Required scope items with their claims; without one unresolved and unexamined (JN10)."""
    out = required.join(claims, "item_id", "left")
    return out.select("item_id", F.coalesce("status", F.lit("unresolved")).alias("status"), F.coalesce("explanation", F.lit("unexamined")).alias("explanation"))


def accepted(scope: DataFrame, states: tuple[str, ...] = ("supported",)) -> DataFrame:
    """Whether there are items and all are accepted (AG10)."""
    return scope.agg((F.count("*") > 0).alias("some"), F.bool_and(F.col("status").isin(*states)).alias("each")).select((F.col("some") & F.coalesce("each", F.lit(False))).alias("accepted"))


def merge_scope(scope: DataFrame, recovered: DataFrame) -> DataFrame:
    """Items that a recovery found supported replace the earlier ones (JN11)."""
    r = recovered.where("status = 'supported'").select("item_id", F.struct("status", "explanation").alias("r"))
    out = scope.join(r, "item_id", "left")
    return out.select("item_id", F.coalesce("r.status", "status").alias("status"), F.coalesce("r.explanation", "explanation").alias("explanation"))


def replay(calls: DataFrame, trace: DataFrame) -> DataFrame:
    """Results of recorded calls by the digest of name, arguments and sources (JN15); ``found`` is false for a miss."""
    key = lambda df: T.digest(F.concat_ws("\u001f", "name", "arguments", "sources"))
    t = trace.withColumn("__key", key(trace)).groupBy("__key").agg(F.min_by("result", "seq").alias("result"))
    return calls.withColumn("__key", key(calls)).join(t, "__key", "left").withColumn("found", F.col("result").isNotNull()).drop("__key")


def tree_digest(lines: DataFrame, key: str, order: str, line: str, fan: int = 1000, levels: int = 3) -> DataFrame:
    """``key``, ``n``, ``digest`` of its lines in order, as a tree: lines of ``order // fan`` give a digest, and so on
    up, so that no row holds more than about ``fan`` digests of a level while ids are dense."""
    at = lines.select(key, F.col(order).alias("at"), F.col(line).alias("line"), F.lit(1).cast("bigint").alias("n"))
    for level in range(levels):
        up = F.floor(F.col("at") / fan) if level < levels - 1 else F.lit(0)
        held = F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"])
        at = at.withColumn("up", up.cast("bigint")).groupBy(key, "up").agg(F.sum("n").alias("n"), F.sha2(F.array_join(held, ","), 256).alias("line")).withColumnRenamed("up", "at")
    return at.select(key, "n", F.col("line").alias("digest"))


#: Words of a quote, after its first, that a document must hold next to each other.
ANCHOR, LEAST_WORDS = 4, 6
#: Bytes of the quotes that one automaton holds, and automata that a set of quotes is worked through with before words are joined.
BLOCK_BYTES, BLOCKS = 16 * 2**20, 4


def _matcher(quotes: list[tuple[object, str]], schema: pa.Schema):  # noqa: ANN202
    """(quote, document) for each quote that a text holds: one walk over the text, whatever the number of quotes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        found = ahocorasick.Automaton()
        ids: dict[str, list] = {}
        for quote_id, quote in quotes:
            ids.setdefault(quote, []).append(quote_id)
        for quote in ids:
            if quote:
                found.add_word(quote, quote)
        found.make_automaton()
        everywhere = ids.get("", [])
        for batch in batches:
            pairs = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text is not None:
                    held = {q for _, q in found.iter(text)} if len(found) else ()
                    pairs += [(quote_id, doc_id) for q in held for quote_id in ids[q]] + [(quote_id, doc_id) for quote_id in everywhere]
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], schema.field(i).type) for i in range(2)], schema=schema)

    return run


def _walked(quotes: DataFrame, docs: DataFrame, blocks: int) -> DataFrame:
    """Places of quotes (id, text) in documents (id, text), a pass over the documents for each block of quotes."""
    schema = StructType([quotes.schema[0], docs.schema[0]])
    out = None
    for b in range(blocks):
        part = quotes if blocks == 1 else quotes.where(F.pmod(F.xxhash64(quotes.columns[1]), F.lit(blocks)) == b)
        rows = part.toArrow()  # of a checked size
        found = docs.mapInArrow(_matcher(list(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist())), to_arrow_schema(schema)), schema)
        out = found if out is None else out.unionByName(found)
    return out


def places(quotes: DataFrame, docs: DataFrame, quote_id: str, doc_id: str, quote: str = "quote", text: str = "text") -> DataFrame:
    """(``quote_id``, ``doc_id``) where the text contains the quote.

    A set of quotes of a bounded size goes to every task as an automaton, and each text is walked once. Of
    a larger one, long quotes are found by an equality join: their second to fifth word, by single
    blanks, are whole words wherever they stand. Digests of words are joined, and texts are fetched for
    the documents that share one; quotes below ``LEAST_WORDS`` words are walked in blocks.
    """
    asked = quotes.select(quote_id, quote).where(F.col(quote).isNotNull())
    texts = docs.select(doc_id, text)
    blocks = lambda q: max(1, -(-(q.agg(F.sum(F.octet_length(quote) + 16)).first()[0] or 0) // BLOCK_BYTES))
    n = blocks(asked)
    if n <= BLOCKS:
        return _walked(asked, texts, n)
    words = F.split(F.col(quote), " ")
    key = lambda w, at: F.xxhash64(F.array_join(F.slice(w, at, ANCHOR), " "))
    long = asked.where(F.size(words) >= LEAST_WORDS).select(quote_id, F.col(quote).alias("quote__"), key(words, F.lit(2)).alias("key__"))
    w = F.split(F.col(text), " ")
    grams = F.transform(F.sequence(F.lit(1), F.size(w) - ANCHOR + 1), lambda i: key(w, i))
    keyed = texts.where(F.size(w) >= ANCHOR).select(F.col(doc_id).alias("doc__"), F.explode(F.array_distinct(grams)).alias("key__"))
    # a digest that many quotes or many documents share is a hot key of a join, which AQE splits
    met = keyed.join(long.select("key__", quote_id), "key__").select("doc__", quote_id).distinct()
    both = texts.join(met, F.col(doc_id).eqNullSafe(F.col("doc__"))).join(long.select(quote_id, "quote__"), quote_id)
    found = both.where(F.col(text).contains(F.col("quote__"))).select(quote_id, doc_id)
    short = asked.where(F.size(words) < LEAST_WORDS)
    return found.unionByName(_walked(short, texts, blocks(short)).select(quote_id, doc_id))
