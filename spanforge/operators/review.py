"""Review rubric, issue routing and resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ratings and decisions of a review.
RATINGS = ("Meets", "Partly meets", "Does not meet")
DECISIONS = ("ready", "ready with disclosed limitations", "needs revision")


def assess(rubric: DataFrame, reviews: DataFrame, issues: DataFrame, criteria: tuple[str, ...]) -> DataFrame:
    """Decision of each review (AG11).

    ``rubric``: review_id, criterion, rating, explanation; ``reviews``: review_id, decision, review_scope;
    ``issues``: review_id, severity. Incomplete rubrics, material issues and a "Does not meet" need
    revision; "ready" with a "Partly meets" discloses limitations.
    """
    good = F.coalesce(F.col("rating").isin(*RATINGS) & (F.trim("explanation") != ""), F.lit(False))
    per = rubric.groupBy("review_id").agg(
        F.count("*").alias("n"), F.collect_set("criterion").alias("seen"), F.bool_and(good).alias("good"), F.bool_or(F.col("rating") == "Does not meet").alias("fails"), F.bool_or(F.col("rating") == "Partly meets").alias("partly"),
    )
    material = issues.groupBy("review_id").agg(F.bool_or(F.col("severity") == "material").alias("material"))
    all_seen = (F.col("n") == len(criteria)) & (F.size(F.array_except(F.array(*map(F.lit, criteria)), "seen")) == 0)
    out = reviews.join(per, "review_id", "left").join(material, "review_id", "left")
    complete = F.coalesce(all_seen & F.col("good") & F.col("decision").isin(*DECISIONS) & (F.trim("review_scope") != ""), F.lit(False))
    false = F.lit(False)
    decision = (
        F.when(~complete | F.coalesce("material", false) | F.coalesce("fails", false), "needs revision")
        .when((F.col("decision") == "ready") & F.coalesce("partly", false), "ready with disclosed limitations")
        .otherwise(F.col("decision"))
    )
    return out.select("review_id", F.when(complete, "complete").otherwise("partial").alias("status"), decision.alias("decision"))


def findings(issues: DataFrame, content: list[str], order: str = "seq") -> DataFrame:
    """Issues of equal content once, in first-seen order, with their origins united (ST3)."""
    return issues.groupBy(*content).agg(F.min(order).alias(order), F.array_sort(F.array_distinct(F.flatten(F.collect_list("origins")))).alias("origins"))


def route(issues: DataFrame, content: list[str], scope: str, order: str = "seq") -> DataFrame:
    """``finding-{i}`` and the action of each material finding (UD13, H21); all findings are numbered, then the material ones kept."""
    w = Window.partitionBy(scope).orderBy(order)
    out = findings(issues, [scope, *content], order).withColumn("finding_id", F.concat(F.lit("finding-"), (F.row_number().over(w) - 1).cast("string")))
    action = F.when(F.col("kind").isin("missing_evidence", "conflict"), "research").when(F.col("kind") == "source_limitation", "qualify").otherwise("revise")
    return out.withColumn("action", action).where("severity = 'material'")


def unresolved(issues: DataFrame, records: DataFrame) -> DataFrame:
    """Findings without an explained "resolved" record (JN13); unknown or repeated record ids are an error."""
    known = issues.select("finding_id").distinct().withColumn("known", F.lit(True))
    checked = records.groupBy("finding_id").agg(F.count("*").alias("n"), F.bool_or((F.col("status") == "resolved") & (F.trim("explanation") != "")).alias("done")).join(known, "finding_id", "left")
    done = F.when((F.col("n") == 1) & F.col("known"), F.col("done")).otherwise(F.raise_error(F.lit("unknown or duplicate finding id")))
    return issues.join(checked.select("finding_id", done.alias("done")), "finding_id", "left").where(~F.coalesce("done", F.lit(False))).drop("done")
