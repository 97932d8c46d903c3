"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from measurelens.operators.common import settle


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of a link; ``root`` is the smallest node that is reachable.

    Each round points every root at its smallest neighbour, follows the pointers
    twice and contracts the links, so the number of roots at least halves.  All
    tables are written to the shared folder, which cuts the lineage; nothing is
    gathered on the driver, and no task holds a whole component.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges = settle(edges)
    labels = settle(edges.select(F.explode(F.array("u", "v")).alias("node")).distinct().select("node", F.col("node").alias("root")))
    while not edges.isEmpty():
        # v < u, so every pointer goes down and no circle can arise
        hook = edges.groupBy("u").agg(F.min("v").alias("to"))
        hook = settle(hook)
        for _ in range(2):
            again = hook.select(F.col("u").alias("to"), F.col("to").alias("further"))
            hook = hook.join(again, "to", "left").select("u", F.coalesce("further", "to").alias("to"))
        hook = settle(hook)
        labels = settle(labels.join(hook.withColumnRenamed("u", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root")))
        left = edges.join(hook, "u").select(F.col("to").alias("x"), "v")
        both = left.join(hook.select(F.col("u").alias("v"), F.col("to").alias("y")), "v", "left").select("x", F.coalesce("y", "v").alias("y"))
        edges = settle(both.where("x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct())
    return labels
