"""Column expressions over text: tokens, spans, digests, sentences. Offsets are code points."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"([a-z0-9_]+|[\x{3400}-\x{9fff}])"
PAIR = r"(?s)(?=([\x{3400}-\x{9fff}].))"
#: What Python's str.strip removes and Java's Unicode class does not hold.
BLANK = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]"
SENTENCE = r"[^。！？.!?]+[。！？.!?]*"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text: str | Column) -> Column:
    """Set of lower-case words, single CJK signs, and pairs that begin with a CJK sign (PR1)."""
    t = col(text)
    return F.array_distinct(F.concat(F.regexp_extract_all(F.lower(t), F.lit(WORD), F.lit(1)), F.regexp_extract_all(t, F.lit(PAIR), F.lit(1))))


def strip(text: str | Column) -> Column:
    """Unicode white space off both ends."""
    return F.regexp_replace(col(text), rf"^{BLANK}+|{BLANK}+\z", "")


def slice_text(text: str | Column, start: Column, end: Column) -> Column:
    return F.substr(col(text), start + 1, end - start)


def span_text(text: str | Column, spans: str | Column) -> Column:
    """Texts of an array of (start, end) spans joined by line feeds (PR2, PR3); fails on a span out of bounds."""
    t, s = col(text), col(spans)
    ok = F.forall(s, lambda x: (x["start"] >= 0) & (x["start"] <= x["end"]) & (x["end"] <= F.length(t)))
    joined = F.array_join(F.transform(s, lambda x: F.substr(t, x["start"] + 1, x["end"] - x["start"])), "\n")
    return F.when(ok, joined).otherwise(F.raise_error(F.lit("span outside its text")))


def digest(canonical: str | Column) -> Column:
    """SHA-256 of a canonical string (PR4)."""
    return F.sha2(col(canonical).cast("string"), 256)


def json_string(c: str | Column) -> Column:
    """A JSON string literal with Unicode left as it is."""
    e = col(c)
    for raw, put in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
        e = F.replace(e, F.lit(raw), F.lit(put))
    return F.concat(F.lit('"'), e, F.lit('"'))


def json_spans(spans: str | Column) -> Column:
    """Canonical JSON of (start, end, page) spans: sorted keys, blanks after separators, null page."""
    one = lambda s: F.concat(F.lit('{"end": '), s["end"].cast("string"), F.lit(', "page": '), F.coalesce(s["page"].cast("string"), F.lit("null")), F.lit(', "start": '), s["start"].cast("string"), F.lit("}"))
    return F.concat(F.lit("["), F.array_join(F.transform(col(spans), one), ", "), F.lit("]"))


def reference(source_id: str | Column, version_hash: str | Column, spans: str | Column) -> Column:
    """Key of a piece of evidence: digest of source, spans and version (PR5)."""
    return digest(F.concat(F.lit('{"source_id": '), json_string(source_id), F.lit(', "spans": '), json_spans(spans), F.lit(', "version": {"hash": '), json_string(version_hash), F.lit("}}")))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once: a lambda that names an expression works it out for each element."""
    return F.get(F.transform(F.array(value), use), 0)


def running(lengths: Column) -> Column:
    """Sum of the elements before each element.

    Sums are appended to short arrays, over the square root of the elements at a time: an array that
    grows to the whole is copied at each element.
    """

    def within(block: Column, base: Column) -> Column:
        start = F.struct(base.alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
        return F.aggregate(block, start, lambda a, n: F.struct((a["at"] + n).alias("at"), F.array_append(a["out"], a["at"]).alias("out")), lambda a: a["out"])

    def blocked(x: Column) -> Column:
        width = F.greatest(F.lit(1), F.floor(F.sqrt(F.size(x).cast("double"))).cast("int"))
        cut = F.transform(F.sequence(F.lit(0), F.size(x) - 1, width), lambda i: F.slice(x, i + 1, width))
        sums = lambda c: F.transform(c, lambda b: F.aggregate(b, F.lit(0), lambda a, n: a + n))
        return bound(cut, lambda c: bound(within(sums(c), F.lit(0)), lambda bases: F.flatten(F.zip_with(c, bases, within))))

    return bound(lengths, lambda x: F.when(F.size(x) > 0, blocked(x)).otherwise(F.expr("cast(array() as array<int>)")))


def spans_of_parts(parts: Column) -> Column:
    """Array of (start, end, part) of the consecutive parts of a text."""
    span = lambda p, at: F.struct(at.alias("start"), (at + F.length(p)).alias("end"), p.alias("part"))
    return bound(parts, lambda x: F.zip_with(x, running(F.transform(x, lambda p: F.length(p))), span))


def sentences(text: str | Column) -> Column:
    """Array of (start, end) of the reading sentences of a text (PR9); leading terminators belong to none."""
    parts = F.regexp_extract_all(col(text), F.lit(rf"([^。！？.!?]+[。！？.!?]*|^[。！？.!?]+)"), F.lit(1))
    some = F.filter(spans_of_parts(parts), lambda s: s["part"].rlike("[^。！？.!?]"))
    return F.transform(some, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))


def inline_scope(query: str | Column) -> Column:
    """(source ids named in a query, the query without them) (PR11)."""
    q = col(query)
    pattern = r"\bsource_id:([a-f0-9]{64})\b"
    return F.struct(F.array_distinct(F.regexp_extract_all(q, F.lit(pattern), F.lit(1))).alias("scopes"), strip(F.regexp_replace(q, pattern, "")).alias("query"))


def preview(text: str | Column, limit: int = 1200) -> Column:
    """A text, or its head and digest if it is longer (PR12)."""
    t = col(text)
    return F.when(F.length(t) <= limit, F.struct(t.alias("text"), F.lit(None).cast("string").alias("sha256"))).otherwise(F.struct(F.substr(t, F.lit(1), F.lit(limit)).alias("text"), F.sha2(t, 256).alias("sha256")))


def valid_vector(v: str | Column, dimension: int) -> Column:
    """Right dimension, finite, not all zero (PR20)."""
    x = col(v)
    return (F.size(x) == dimension) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(x, lambda e: e != 0)


def dot(a: str | Column, b: str | Column) -> Column:
    """Dot product in double, in the order of the elements."""
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: str | Column, b: str | Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def pooled(token_vectors: str | Column, mask: str | Column) -> Column:
    """Mean of the unmasked token vectors, L2-normalised (PR21)."""
    kept = F.transform(F.filter(F.arrays_zip(col(token_vectors).alias("v"), col(mask).alias("m")), lambda x: x["m"] != 0), lambda x: x["v"])
    zero = F.transform(F.element_at(col(token_vectors), 1), lambda _: F.lit(0.0))
    total = F.aggregate(kept, zero, lambda a, v: F.zip_with(a, v, lambda x, y: x + y.cast("double")))
    norm = F.sqrt(F.aggregate(total, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(total, lambda x: x / F.greatest(norm, F.lit(1e-12)))


def without_parent(child: str | Column, parent: str | Column) -> Column:
    """A field that repeats its parent's is left out (PR24)."""
    return F.when(~col(child).eqNullSafe(col(parent)), col(child))


def numeric_cell(c: str | Column) -> Column:
    """Cells that a table sets flush right (PR26)."""
    return strip(c).rlike(r"^[(+−-]?[\d,.]+%?\)?$")
