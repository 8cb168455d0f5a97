"""Report text: calculations, citations, declared sources, figures."""

from __future__ import annotations

import unicodedata
from decimal import Decimal, getcontext, localcontext

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.functions import text as T

#: Whole numbers that built-in decimals take.
WHOLE = r"^(0|-?[1-9]\d{0,17})$"
OPERATIONS = {"add": lambda a, b: a + b, "subtract": lambda a, b: a - b, "multiply": lambda a, b: a * b, "divide": lambda a, b: a / b}


def _value(op: str, left: str, right: str) -> str | None:
    try:
        with localcontext() as c:
            c.prec = getcontext().prec
            a, b = Decimal(left), Decimal(right)
            if not (a.is_finite() and b.is_finite()):
                return None
            return str(OPERATIONS[op](a, b))
    except (ArithmeticError, KeyError, TypeError):
        return None


def calculate(op: Column, left: Column, right: Column) -> Column:
    """Exact decimal arithmetic on two numbers in text, as text (PR19, H8); null for what has no finite result.

    Whole numbers of up to eighteen digits are added, subtracted and multiplied by built-in
    decimals; Python's decimals see the other rows only.
    """

    @F.pandas_udf("string")
    def run(o: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x[0] is None else _value(*x) for x in zip(o, a, b, strict=True)], dtype=object)

    whole = left.rlike(WHOLE) & right.rlike(WHOLE) & op.isin("add", "subtract", "multiply")
    # products beyond the 28 digits of a Python decimal are left to it
    whole = F.coalesce(whole & ((op != "multiply") | (F.length(left) + F.length(right) <= 26)), F.lit(False))
    a, b = (F.when(whole, c).cast("decimal(18,0)") for c in (left, right))
    exact = F.when(op == "add", (a + b).cast("string")).when(op == "subtract", (a - b).cast("string")).otherwise((a * b).cast("string"))
    hard = lambda c: F.when(~whole, c)
    return F.when(whole, exact).otherwise(run(hard(op), hard(left), hard(right)))


def cited_pages(citations: DataFrame, chunks: DataFrame, widest: int = 500) -> DataFrame:
    """Pages of cited chunk ranges (PR16): ``cite_id``, ``source_id``, ``low``, ``high`` (chunk numbers) to sorted ``pages``."""
    ok = citations.withColumn("high", F.when(F.col("high") - F.col("low") <= widest, F.col("high")).otherwise(F.raise_error(F.lit("cited range too wide"))))
    each = ok.select("cite_id", "source_id", F.explode(F.sequence("low", "high")).alias("chunk_no"))
    return each.join(chunks.select("source_id", "chunk_no", "page"), ["source_id", "chunk_no"]).groupBy("cite_id").agg(F.sort_array(F.collect_set("page")).alias("pages"))


def citations(report: Column) -> Column:
    """(source, low, high) of each ``[S2 c45–c47]`` in a text."""
    found = F.regexp_extract_all(report, F.lit(r"\[(S\d+ c\d+(?:[–-]c\d+)?)\]"), F.lit(1))

    def one(c: Column) -> Column:
        n = F.regexp_extract_all(c, F.lit(r"(\d+)"), F.lit(1))
        low = n[1].cast("int")
        return F.struct(F.concat(F.lit("S"), n[0]).alias("source"), low.alias("low"), F.coalesce(F.get(n, 2).cast("int"), low).alias("high"))

    return F.transform(found, one)


def resolve_declared(declared: DataFrame, sources: DataFrame) -> DataFrame:
    """Abbreviated ids ``prefix…suffix`` to the one source they fit (PR17); none or several is an error.

    Prefixes of eight characters are the join key; shorter ones are an error, so no pair is tried in vain.
    """
    parts = F.split("abbreviated", "…")
    d = declared.withColumn("prefix", F.when(F.length(parts[0]) >= 8, parts[0]).otherwise(F.raise_error(F.lit("abbreviation too short")))).withColumn("suffix", F.coalesce(F.get(parts, 1), F.lit("")))
    s = sources.select("source_id", F.substr("source_id", F.lit(1), F.lit(8)).alias("k"))
    hit = d.withColumn("k", F.substr("prefix", F.lit(1), F.lit(8))).join(s, "k", "left")
    fits = F.col("source_id").startswith(F.col("prefix")) & F.col("source_id").endswith(F.col("suffix"))
    out = hit.groupBy("alias", "abbreviated").agg(F.count_if(fits).alias("n"), F.max(F.when(fits, F.col("source_id"))).alias("source_id"))
    return out.select("alias", F.when(F.col("n") == 1, F.col("source_id")).otherwise(F.raise_error(F.lit("abbreviation fits no or several sources"))).alias("source_id"))


def aliases(sources: DataFrame, taken: int = 0, order: str = "first_seen", per: list[str] | None = None) -> DataFrame:
    """``S1`` … in first-seen order, after those taken (JN14), for each report (``per``) or the sources of one."""
    w = Window.partitionBy(*(per or [F.lit(0)])).orderBy(order)
    return sources.withColumn("alias", F.concat(F.lit("S"), (F.row_number().over(w) + taken).cast("string")))


def source_label(alias: Column, issuer: Column, title: Column, date: Column) -> Column:
    """``alias · issuer · title · date`` without the issuer at the head of the title (PR15)."""
    short = F.when(title.startswith(issuer), T.strip(F.substr(title, F.length(issuer) + 1))).otherwise(title)
    part = lambda c: F.when(F.trim(c) != "", c)
    return F.concat_ws(" · ", alias, part(issuer), part(short), part(date))


def figure_dot(nodes: Column, edges: Column) -> Column:
    """DOT text of a diagram (SK7): top to bottom beyond five nodes, else left to right."""
    way = F.when(F.size(nodes) > 5, "TB").otherwise("LR")
    quoted = lambda c: T.json_string(c)
    n = F.array_join(F.transform(nodes, lambda x: F.concat(F.lit("  "), quoted(x), F.lit(";"))), "\n")
    e = F.array_join(F.transform(edges, lambda x: F.concat(F.lit("  "), quoted(x["src"]), F.lit(" -> "), quoted(x["dst"]), F.lit(";"))), "\n")
    return F.concat_ws("\n", F.lit("digraph {"), F.concat(F.lit("  rankdir="), way, F.lit(";")), n, e, F.lit("}"))


def figure_problems(figures: DataFrame, sources: DataFrame) -> DataFrame:
    """Figures that name unknown sources, lack a required field, or have values that are not finite (SK7, FI7)."""
    known = sources.agg(F.collect_set("source_id").alias("known"))
    f = figures.join(F.broadcast(known)) if sources.limit(10_001).count() <= 10_000 else None
    if f is None:
        cited = figures.select("figure_id", F.explode("source_ids").alias("source_id")).join(sources.select("source_id"), "source_id", "left_anti").groupBy("figure_id").agg(F.count("*").alias("unknown"))
        f = figures.join(cited, "figure_id", "left")
        unknown = F.coalesce("unknown", F.lit(0)) > 0
    else:
        unknown = F.size(F.array_except("source_ids", "known")) > 0
    blank = F.lit(False)
    for c in ("title", "caption", "period", "unit"):
        blank = blank | F.coalesce(F.trim(c) == "", F.lit(True))
    wild = F.exists("values", lambda v: v.isNotNull() & (F.isnan(v) | (F.abs(v) == float("inf"))))
    problems = F.array_compact(F.array(F.when(unknown, F.lit("unknown source")), F.when(blank, F.lit("missing field")), F.when(F.coalesce(wild, F.lit(False)), F.lit("value not finite")), F.when(~F.col("kind").isin("bar", "diagram"), F.lit("unknown kind"))))
    return f.select("figure_id", problems.alias("problems")).where(F.size("problems") > 0)


def table_notes(cell: Column, limit: int = 80) -> Column:
    """Citations and long commentary moved out of a table cell (PR14): struct of ``text`` and ``notes``."""
    marks = r"\[S\d+[^\]]*\]|\[[0-9a-f]{8,}[^\]]*\]|【[^】]*】"
    cites = F.regexp_extract_all(cell, F.lit(f"({marks})"), F.lit(1))
    bare = T.strip(F.regexp_replace(cell, marks, ""))
    at = F.instr(bare, "；")
    long = (F.length(bare) > limit) & (at > 0)
    return F.struct(F.when(long, F.substr(bare, F.lit(1), at - 1)).otherwise(bare).alias("text"), F.concat(F.when(long, F.array(F.substr(bare, at + 1))).otherwise(F.expr("cast(array() as array<string>)")), cites).alias("notes"))


def omitted_text(fragments: Column, exported: Column) -> Column:
    """Fragments that an export lost (SK6): blanks aside, and signs of one compatibility form alike (a ligature is its letters)."""

    def bare(text: str) -> str:
        text = "".join(text.split())
        return text if text.isascii() else unicodedata.normalize("NFKC", text)

    def lost(parts: pa.Array, whole: pa.Array) -> pa.Array:
        # a row at a time is Python's, not a batch
        rows = ((p.as_py(), w.as_py()) for p, w in zip(parts, whole, strict=True))
        found = ((p, bare(w or "")) for p, w in rows)
        return pa.array((None if p is None else [f for f in p if f is not None and bare(f) not in h] for p, h in found), pa.list_(pa.string()))

    return F.arrow_udf(lost, "array<string>")(fragments, exported)
