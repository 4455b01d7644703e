"""Connected components of a link table, by star contraction.

Every round points each node at the smallest neighbour it knows and rewires
its larger neighbours to that one; the links shrink to one star per component.
Nothing but the number of changed links reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusforge.session import shared_dir


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root): for links (a, b), the smallest node reachable from each node.

    ``a`` and ``b`` are of one ordered type. Self-links and repeated links are
    fine; nodes without a link to another node do not appear.
    """
    shared_dir(links.sparkSession)  # sets a checkpoint folder where none is set
    edges = (links.where(F.col("a") != F.col("b"))
             .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().checkpoint())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        # large star: larger neighbours are linked to the smallest
        large = (both.where(F.col("v") > F.col("u")).join(least, "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # small star: a node and its smaller neighbours are linked to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v")))
                 .where(F.col("u") != F.col("v")).distinct())
        after = small.checkpoint()
        # A star forest: no node has two parents, no parent is a child.
        if (after.groupBy("u").count().where("count > 1").isEmpty()
                and after.join(after.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty()):
            break
        edges = after
    roots = after.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
