"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnout.llm.files import written


def components(links: DataFrame, most_rounds: int = 60, steps: list[str] | None = None) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); root is the smallest node reachable.

    ``steps`` notes the folders of the tables written.  Each round is two aggregations with a join on the links, written; rounds grow with the logarithm of a
    component's size.  Only counts come to the driver.  Raises if it has not settled after ``most_rounds``.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    edges = written(edges, steps)
    for _ in range(most_rounds):
        # Large star: every larger neighbour of u is linked to the smallest node around u.
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionAll(least.where("m < u").select("u", F.col("m").alias("v"))).where("u != v").distinct()
        # Small star: u and its smaller neighbours are linked to the smallest of them.
        smaller = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = large.join(smaller, "u")
        new = small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(small.select("u", F.col("m").alias("v"))).distinct()
        new = written(new, steps)
        state = new.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("u").alias("us")).first()
        crossing = new.select("u").intersect(new.select("v")).limit(1).count()
        edges = new
        if state["n"] == state["us"] and not crossing:
            roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots)
    raise RuntimeError("components did not settle")
