"""Connected components of a link table, by contraction.

Each round points every node at the smallest node among itself and its
neighbours, follows the pointers once more, replaces the ends of all links by
what they point at and drops links whose ends have met.  A round is grouped
minima (combined map-side, so a hub is no hot group) and equi-joins; links and
pointers are cut to the shared checkpoint folder after each round.  Nothing
but one row count a round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import checkpointed


def components(links: DataFrame) -> DataFrame:
    """``node``, ``component`` (smallest node of its component) for every end of the links ``x``, ``y``."""
    links = checkpointed(links.filter("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct())
    found = None
    while True:
        both = links.select(F.col("x").alias("node"), F.col("y").alias("other")).union(links.select("y", "x"))
        least = both.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("up"))
        least = checkpointed(least)
        up = least.alias("a").join(least.alias("b"), F.col("a.up") == F.col("b.node")).select("a.node", F.col("b.up").alias("up"))
        up = checkpointed(up)
        if found is None:
            found = up.select("node", F.col("up").alias("component"))
        else:
            found = found.join(up.withColumnRenamed("node", "component"), "component", "left").select(
                "node", F.coalesce("up", "component").alias("component")
            )
        found = checkpointed(found)
        a, b = up.select(F.col("node").alias("x"), F.col("up").alias("ux")), up.select(F.col("node").alias("y"), F.col("up").alias("uy"))
        moved = links.join(a, "x").join(b, "y").filter("ux <> uy")
        links = checkpointed(moved.select(F.least("ux", "uy").alias("x"), F.greatest("ux", "uy").alias("y")).distinct())
        if links.isEmpty():
            return found
