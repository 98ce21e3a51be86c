"""Connected components over a table of links, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quellspan.session import scratch, written


def components(links: DataFrame, name: str = "components", most_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of ``links(a, b)``; root is the smallest node that can be reached.

    Alternates large-star and small-star steps until no link changes. A hub of many links is only ever joined to its one
    minimum, from a table of its own, so Spark may split its partition; nothing is gathered in a task or the driver.
    """
    stars = written(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-links"
    )
    before = None
    for _ in range(most_rounds):
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        with scratch(links.sparkSession):
            least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{name}-large")
            large = written(
                both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), f"{name}-up"
            )
            nearest = written(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}-small")
            down = large.join(nearest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            stars = written(down.unionByName(nearest.withColumnRenamed("m", "v")).distinct(), f"{name}-down", keep=True)
        now = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            roots = stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
        before = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
