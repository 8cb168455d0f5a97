"""Connected components of a link table, as rounds of joins with written tables between them."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def components(links: DataFrame) -> DataFrame:
    """``id``, ``component`` (smallest id reachable) of every id in ``links`` (``a``, ``b`` bigint).

    Alternates large-star and small-star steps: every node hands its neighbours to the smallest of
    them, the links become stars in a logarithmic number of rounds, and no step gathers more than
    the links of one node, pre-aggregated to a minimum. Nothing is sent to the driver but a flag.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        new = materialize(small, "links")
        # links that were not there before; the rounds end when the stars stand still
        if new.join(edges, ["a", "b"], "left_anti").isEmpty() and edges.join(new, ["a", "b"], "left_anti").isEmpty():
            break
        discard(edges)
        edges = new
    members = edges.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "id")
    roots = members.select(F.col("component").alias("id"), "component").distinct()
    return materialize(members.unionByName(roots).groupBy("id").agg(F.min("component").alias("component")), "components")
