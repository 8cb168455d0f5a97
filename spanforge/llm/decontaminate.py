"""Benchmark decontamination by canonical templates, in built-in expressions only.

Numbers, names and units of a text become typed placeholders; windows of ``WIDTH`` such tokens are
hashed and joined with the windows of the benchmark. Matches of one document and item on one
diagonal (window place minus item place) are checked for slot consistency: each value of the
item must stand for one value of the document all along. So a question with its numbers or names
replaced is found, and a text that happens to have the form is not once its values contradict.
The share of the item's tokens that consistent windows cover decides. Windows that are placeholders
in the main, and items of few tokens, are hashed with their values and match word for word only.

The documents are not shuffled: the benchmark's windows are broadcast if their number is within
``BROADCAST_ROWS`` and joined by a shuffle of window rows otherwise.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_of

WIDTH = 8
#: Items of fewer tokens say little: they are looked for whole, and with their own values only.
LEAST_TOKENS = 5
#: Least share of tokens that are literal in a window of words, and of an item that must be covered.
LITERAL, COVERED = 0.5, 0.7
BROADCAST_ROWS = 200_000

#: Stands for a name in a canonical text: a private-use character, a token of its own.
NAME_MARK = "\ue000"
_IN = r"\p{L}\p{M}0-9%$€£¥°\ue000"
TOKEN = r"[0-9]+(?:[.,][0-9]+)*+|[\p{L}\p{M}]+(?:['’][\p{L}\p{M}]+)*+|[%$€£¥°\ue000]"
#: A capitalised word that follows a token of the same sentence, at most 4 signs away.
NAME = rf"(?=\p{{Lu}})(?<=[{_IN}][^{_IN}.!?\n'’]{{1,4}})\p{{Lu}}[\p{{Ll}}\p{{M}}]+(?:['’][\p{{Ll}}\p{{M}}]+)*+(?![\p{{L}}\p{{M}}'’])"
NUMBERS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
UNITS = "% $ € £ ¥ ° km cm mm m mi ft kg g mg lb lbs oz l ml s ms min h hr hrs kmh mph meter meters metre metres kilometer kilometers mile miles foot feet inch inches gram grams kilogram kilograms pound pounds liter liters second seconds minute minutes hour hours day days week weeks month months year years dollar dollars cent cents euro euros percent degree degrees".split()


PLACEHOLDERS = ("<num>", "<name>", "<unit>")


def _prefix_tree(words: list[str]) -> str:
    """Pattern of any of some words that tries each letter once."""
    if not any(words):
        return ""
    heads: dict[str, list[str]] = {}
    for w in words:
        if w:
            heads.setdefault(w[0], []).append(w[1:])
    branches = [head.replace("$", r"\$") + _prefix_tree(rest) for head, rest in heads.items()]
    if len(branches) == 1 and "" not in words:
        return branches[0]
    return f"(?:{'|'.join(branches)})" + ("?" if "" in words else "")


NUMBER = f" (?:[0-9][0-9.,]*+|{_prefix_tree(NUMBERS)})(?![^ ])"
UNIT = f" {_prefix_tree(UNITS)}(?![^ ])"


def canonical(text: Column) -> Column:
    """The text as blank-separated tokens, numbers, names and units as placeholders; one token for each of ``raw_tokens``.

    Every token has a blank before it until the end, so that patterns start at a plain sign.
    """
    marked = F.lower(F.regexp_replace(text, NAME, NAME_MARK))
    plain = F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(marked, F.lit(TOKEN), F.lit(0)), " "))
    typed = F.regexp_replace(F.regexp_replace(plain, NUMBER, " <num>"), UNIT, " <unit>")
    return F.substr(F.replace(typed, F.lit(NAME_MARK), F.lit("<name>")), F.lit(2))


def raw_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def verbatim(text: Column) -> Column:
    """The text as blank-separated tokens in lower case, with their values."""
    return F.array_join(raw_tokens(F.lower(text)), " ")


def count(canon: Column | str) -> Column:
    c = F.col(canon) if isinstance(canon, str) else canon
    return F.when(c == "", 0).otherwise(F.size(F.split(c, " ")))


def with_windows(df: DataFrame, kept: list[str], text: str, widths: list[int], tokens=canonical) -> DataFrame:
    """A row per window: ``kept``, ``canon`` (the canonical text), ``at``, ``width`` and the hash ``h`` of its tokens.

    One regular expression yields all windows of a width, so that no token costs an interpreted step.
    The outer form keeps the planner from evaluating the windows a second time as a filter; a text
    without one leaves a row with a null place. ``tokens``: ``canonical``, or ``verbatim``.
    """
    df = df.select(*kept, tokens(text_of(text)).alias("canon"))
    parts = []
    for w in widths:
        every = F.regexp_extract_all(F.concat(F.lit(" "), "canon"), F.lit(rf" (?=((?:[^ ]++ ){{{w - 1}}}[^ ]++))"), F.lit(1))
        parts.append(df.select(*kept, "canon", F.posexplode_outer(every).alias("at", "window")).select(*kept, "canon", "at", F.lit(w).alias("width"), F.xxhash64("window", F.lit(w)).alias("h")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def slots(canon: str | Column, raw: str | Column) -> Column:
    """Values of a window's placeholders, with their types."""
    here = F.arrays_zip(F.slice(F.split(canon, " "), F.col("at") + 1, F.col("width")).alias("c"), F.slice(raw, F.col("at") + 1, F.col("width")).alias("t"))
    return F.transform(F.filter(here, lambda s: s["c"].isin(*PLACEHOLDERS)), lambda s: F.struct(s["c"].alias("c"), F.lower(s["t"]).alias("v")))


def same_values(pairs: Column) -> Column:
    return F.forall(pairs, lambda p: p["b"] == p["d"])


def agreeing(lines: str) -> Column:
    """Windows of the lines that agree: from the one of most windows on, each that gives no value of the item two values."""
    start = F.struct(F.expr("cast(array() as array<struct<b:string,d:string>>)").alias("pairs"), F.expr("cast(array() as array<int>)").alias("at"))

    def step(a: Column, x: Column) -> Column:
        both = F.array_union(a["pairs"], x["pairs"])
        agree = F.size(F.array_distinct(F.transform(both, lambda p: p["b"]))) == F.size(both)
        return F.when(agree, F.struct(both.alias("pairs"), F.array_union(a["at"], x["at"]).alias("at"))).otherwise(a)

    return F.aggregate(F.array_sort(lines), start, step, lambda a: a["at"])


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", item: str = "item_id", text: str = "text", covered: float = COVERED) -> DataFrame:
    """Rows ``key``, ``item``, ``coverage``, ``windows``, ``kind``.

    The windows of an item that a document holds are those of its lines (one offset of the item in the
    document), taken while their values agree: one value of the item stands for one value throughout.
    The kind is "exact" if the windows with the item's own values cover as much as these, else
    "reparameterised".

    Null and empty texts match nothing; rows that repeat, or share a key, count as one document;
    an empty table of either kind gives no rows; other columns are not read.
    """
    items = benchmark.select(F.col(item).alias("item__"), F.col(text).alias("text"))
    sized = items.withColumn("n", count(canonical(text_of("text")))).where("n > 0")
    widths = sorted(r[0] for r in sized.select(F.least("n", F.lit(WIDTH))).distinct().collect()) or [WIDTH]
    raw = raw_tokens(text_of("text"))
    asked = with_windows(sized, ["item__", "text", "n"], "text", widths).where((F.col("width") == F.least("n", F.lit(WIDTH))) & F.col("at").isNotNull())
    asked = asked.withColumn("item_slots", slots("canon", raw))
    wordy = (F.col("n") >= LEAST_TOKENS) & (F.col("width") - F.size("item_slots") >= F.col("width") * LITERAL)
    own_values = F.array_join(F.slice(F.split(verbatim(text_of("text")), " "), F.col("at") + 1, F.col("width")), " ")
    asked = asked.withColumn("wordy", wordy).withColumn("h", F.when(F.col("wordy"), F.col("h")).otherwise(F.xxhash64(own_values, "width")))
    asked = materialize(asked.select("item__", "h", F.col("at").alias("item_at"), F.col("n").alias("item_n"), "width", "item_slots", "wordy"), "asked")
    exact_widths = sorted(r[0] for r in asked.where("not wordy").select("width").distinct().collect())
    widths = sorted(r[0] for r in asked.where("wordy").select("width").distinct().collect()) or [WIDTH]
    worded, literal = asked.where("wordy").drop("width"), asked.where("not wordy").drop("width")

    own = docs.select(F.col(key).alias("key__"), F.col(text).alias("text"))
    few = asked.count() <= BROADCAST_ROWS
    near = F.broadcast if few else lambda df: df
    if few:
        # both texts ride along by reference until a window has matched
        hit = with_windows(own, ["key__", "text"], "text", widths).join(near(worded), "h").withColumn("slots", slots("canon", raw))
    else:
        found = with_windows(own.withColumn("raw", raw), ["key__", "raw"], "text", widths)
        hit = found.select("key__", "h", "at", "width", slots("canon", "raw").alias("slots")).join(worded, "h")
    hit = hit.select("key__", "item__", "item_at", "item_n", "width", "at", "item_slots", "slots", "wordy")
    if exact_widths:
        same = with_windows(own, ["key__"], "text", exact_widths, verbatim).select("key__", "h", "at", "width").join(near(literal), "h")
        hit = hit.unionByName(same.select("key__", "item__", "item_at", "item_n", "width", "at", "item_slots", F.col("item_slots").alias("slots"), "wordy"))

    both = F.arrays_zip(F.transform("item_slots", lambda s: F.concat(s["c"], s["v"])).alias("b"), F.transform("slots", lambda s: F.concat(s["c"], s["v"])).alias("d"))

    def gathered(name: str, which: Column) -> Column:
        at = F.collect_set(F.when(which, F.col("item_at")))
        return F.struct(at.alias("at"), F.array_distinct(F.flatten(F.collect_set(F.when(which, both)))).alias("pairs")).alias(name)

    def consistent(c: str) -> Column:
        return F.size(F.array_distinct(F.transform(f"{c}.pairs", lambda p: p["b"]))) == F.size(f"{c}.pairs")

    diagonal = (F.col("at") - F.col("item_at")).alias("diagonal")
    line = hit.groupBy("key__", "item__", "item_n", "width", diagonal).agg(gathered("every", F.lit(True)), gathered("words", F.col("wordy")))
    # the most windows that contradict nothing
    best = F.when(consistent("every"), F.col("every")).when(consistent("words"), F.col("words"))
    line = line.select("key__", "item__", "item_n", "width", best.alias("best")).where(F.size("best.at") > 0)
    # lines of one assignment of values are one: a text that repeats an item has one of them, not one a copy
    values = F.array_sort("best.pairs").alias("pairs")
    line = line.select("key__", "item__", "item_n", "width", values, F.col("best.at").alias("at"))
    line = line.groupBy("key__", "item__", "item_n", "width", "pairs").agg(F.array_distinct(F.flatten(F.collect_set("at"))).alias("at"))
    per = line.groupBy("key__", "item__", "item_n", "width").agg(F.collect_list(F.struct((-F.size("at")).alias("n"), "pairs", F.array_sort("at").alias("at"))).alias("lines"))
    size = lambda at: F.size(F.array_distinct(F.flatten(F.transform(at, lambda a: F.sequence(a, a + F.col("width") - 1)))))
    whole, verbatim_at = agreeing("lines"), F.array_distinct(F.flatten(F.transform(F.filter("lines", lambda x: same_values(x["pairs"])), lambda x: x["at"])))
    per = per.select("key__", "item__", "item_n", "width", whole.alias("at"), verbatim_at.alias("exact_at")).withColumn("exact", size("exact_at") >= size("at"))
    per = per.withColumn("at", F.when(F.col("exact"), F.col("exact_at")).otherwise(F.col("at")))
    out = per.select(F.col("key__").alias(key), F.col("item__").alias(item), F.round(size("at") / F.col("item_n"), 6).alias("coverage"), F.size("at").cast("bigint").alias("windows"), F.when(F.col("exact"), "exact").otherwise("reparameterised").alias("kind"))
    return out.where(F.col("coverage") >= covered)
