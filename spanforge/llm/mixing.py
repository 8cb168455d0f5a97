"""Mixing sources to target weights by temperature.

With p the token share of a source, its weight is p^a / sum p^a. The exponent a in [0, 1] is
bisected to the largest entropy wanted that keeps the repetition of every source within a limit.
The weights are realised as block permutations on a token budget: documents are dealt into blocks
of about ``block_docs`` by a hash of their id, each pass over a source visits its blocks in an order
of its own, and the last pass ends inside a block where the budget of the source is used up.

Only one row per document of (hash, source, tokens), written once, feeds the sums; no text is
shuffled. Decisions are one row per source, which Spark broadcasts only if their size allows it.
"""

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, free_name, materialize, text_of

#: Points in which each round of the search splits the interval of the exponent; 4 rounds reach 1e-6.
SECTIONS, ROUNDS = 33, 4


@dataclass(frozen=True)
class Mix:
    """``budget``: tokens of the mix as a multiple of the tokens there are (None: so many that no source is cut below one pass);
    ``entropy``: wanted entropy of the weights as a share of the largest, log(number of sources);
    ``repeats``: most passes over any source; ``block_docs``: documents of a block, about."""

    budget: float | None = 1.0
    entropy: float = 0.97
    repeats: float = 4.0
    block_docs: int = 4096
    seed: int = 17


def tokens(text: str | Column = "text") -> Column:
    """Whitespace-separated words."""
    return F.regexp_count(text_of(text), F.lit(r"\S+")).cast("bigint")


def _power_sums(sources: DataFrame, exponents: list[float]) -> list[tuple[float, float]]:
    """Sum of p^a and of p^a log p for each exponent, from one pass over the sources."""
    row = sources.agg(*(F.struct(F.sum(F.pow("p", F.lit(a))), F.sum(F.pow("p", F.lit(a)) * F.log("p"))) for a in exponents)).first()
    return [tuple(x) for x in row]


def exponent(sources: DataFrame, mix: Mix) -> float:
    """Largest a in [0, 1] whose entropy reaches the target, raised where a source would repeat too often.

    To the driver come sums only, however many sources there are.
    """
    n, least, most = sources.agg(F.count("*"), F.min("p"), F.max("p")).first()
    if not n:
        return 1.0

    def ok(a: float, sums: tuple[float, float]) -> bool:
        z, weighted = sums
        return math.log(z) - a * weighted / z >= mix.entropy * math.log(n) - 1e-12

    def repeats(a: float, z: float) -> float:
        """Passes over the smallest source: its weight times the budget over its tokens."""
        return (most / least) ** (1 - a) if mix.budget is None else least ** (a - 1) / z * mix.budget

    def search(good) -> tuple[float, float]:
        """Where ``good`` turns from true (low a) to false, as an interval."""
        low, high = 0.0, 1.0
        for _ in range(ROUNDS):
            grid = [low + (high - low) * i / (SECTIONS - 1) for i in range(SECTIONS)]
            sums = _power_sums(sources, grid)
            holds = [good(a, s) for a, s in zip(grid, sums, strict=True)]
            last = max((i for i, x in enumerate(holds) if x), default=-1)
            if last < 0:
                return low, low
            if last == SECTIONS - 1:
                return high, high
            low, high = grid[last], grid[last + 1]
        return low, high

    a = search(ok)[0]
    if repeats(a, _power_sums(sources, [a])[0][0]) > mix.repeats:
        a = search(lambda x, s: repeats(x, s[0]) > mix.repeats)[1]
    return a


def mixed(docs: DataFrame, mix: Mix = Mix(), key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """``docs`` with ``copies`` (times in the mix), ``weight`` of the source, ``block`` and ``block_order`` of the last pass.

    A null source counts as the source "". Texts without a word cost nothing and are in every pass;
    rows of equal ids stand or fall together; an empty table stays empty; input columns of the new
    names are replaced.
    """
    h, name, size = (free_name(docs, x) for x in ("hash", "name", "size"))
    hashed = F.xxhash64(F.col(key), F.lit(mix.seed))
    named = F.coalesce(F.col(source).cast("string"), F.lit(""))
    narrow = materialize(docs.select(hashed.alias(h), named.alias(name), tokens(text).alias(size)), "mix")
    sums = materialize(narrow.groupBy(name).agg(F.count("*").alias("docs"), F.sum(size).alias("tokens")), "mix-sources")
    total = sums.agg(F.sum("tokens")).first()[0] or 0
    shares = sums.where("tokens > 0").withColumn("p", F.col("tokens") / F.lit(total))
    a = exponent(shares, mix)
    z, _ = _power_sums(shares, [a])[0]
    budget = None if mix.budget is None else mix.budget * total
    if budget is None:  # the source with the least weight for its share gets one pass
        budget = (shares.agg(F.max(F.col("tokens") * F.lit(z) / F.pow("p", F.lit(a)))).first()[0]) or 0
    weight = F.coalesce(F.pow(F.col("tokens") / F.lit(max(1, total)), F.lit(a)) / F.lit(z or 1.0), F.lit(0.0))
    # a relative 1e-9 so that a source meant to have whole passes does not lose one to rounding
    passes = F.when(F.col("tokens") > 0, F.col("weight") * F.lit(float(budget)) / F.col("tokens") * (1 + 1e-9)).otherwise(F.lit(1.0))
    plan = sums.withColumn("weight", weight).withColumn("passes", passes)
    plan = plan.select(name, "weight", F.floor("passes").alias("full"), ((F.col("passes") - F.floor("passes")) * F.col("tokens")).alias("rest"), F.greatest(F.lit(1), F.ceil(F.col("docs") / mix.block_docs)).alias("blocks"))
    plan = materialize(plan, "mix-plan")

    block = F.pmod(F.col(h), F.col("blocks")).alias("block")

    def order(of: Column, full: Column) -> Column:
        return F.xxhash64(of, full, F.col(name), F.lit(mix.seed + 1))

    turn = F.xxhash64(F.col(h), F.col("full"), F.lit(mix.seed + 2))
    dealt = narrow.join(plan, name).select(name, "full", "rest", block, turn.alias("turn"), size)
    by_block = dealt.groupBy(name, "full", "rest", "block").agg(F.sum(size).alias("n")).withColumn("at", order(F.col("block"), F.col("full")))
    line = Window.partitionBy(name).orderBy("at", "block")
    by_block = by_block.withColumn("upto", F.sum("n").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    # the first block that the rest of the budget does not cover; at most one of each source
    border = by_block.where(F.col("upto") > F.col("rest")).groupBy(name).agg(F.min_by(F.struct("at", "block", (F.col("rest") - F.col("upto") + F.col("n")).alias("left")), F.struct("at", "block")).alias("b"))
    border = materialize(border.select(name, F.col("b.at").alias("border"), F.col("b.block").alias("border_block"), F.col("b.left").alias("left")), "mix-border")
    inside = dealt.join(border, name).where(F.col("block") == F.col("border_block"))
    ties = Window.partitionBy(name).orderBy("turn").rangeBetween(Window.unboundedPreceding, 0)
    cut = inside.withColumn("upto", F.sum(size).over(ties)).where(F.col("upto") <= F.col("left")).groupBy(name).agg(F.max("turn").alias("cut"))
    decision = materialize(plan.drop("rest").join(border.drop("left"), name, "left").join(cut, name, "left"), "mix-decision")

    new = {"copies", "weight", "block", "block_order"}
    kept = [column(c) for c in docs.columns if c.lower() not in new]
    stems = {x: free_name(docs, f"d_{x}") for x in decision.columns if x != name}
    d = decision.select(name, *(F.col(x).alias(y) for x, y in stems.items()))
    c = lambda x: F.col(stems[x])
    mine = F.pmod(F.col(h), c("blocks"))
    at = order(mine, c("full"))
    before = (at < c("border")) | ((at == c("border")) & (mine < c("border_block")))
    partly = (at == c("border")) & (mine == c("border_block")) & (F.xxhash64(F.col(h), c("full"), F.lit(mix.seed + 2)) <= c("cut"))
    # without a border there was no block to cut: the rest covers no token
    extra = F.when(c("border").isNull(), 0).when(before | F.coalesce(partly, F.lit(False)), 1).otherwise(0)
    out = docs.select(*kept, hashed.alias(h), named.alias(name)).join(d, name)
    return out.select(*kept, (c("full") + extra).cast("bigint").alias("copies"), c("weight").alias("weight"), mine.alias("block"), at.alias("block_order"))
