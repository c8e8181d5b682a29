"""Connected components of a links table by alternating large-star and small-star rounds, all in joins and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinegrid.llm.common import Scratch


def connected_components(links: DataFrame) -> DataFrame:
    """links: a, b (long), a saved table. Returns node, root for every node that has a link; root is the smallest node reachable.

    Minima are found by partial aggregation and go back by an equi-join that AQE splits where one node is hot.
    """
    scratch = Scratch(links.sparkSession, "components")
    count = links.count()
    edges = scratch.save(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), count)
    mark, old = None, []
    while True:
        sym = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sym.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = scratch.save(small.select("e.*").where("u <> v").distinct(), 2 * count)
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).collect()[0]
        if now == mark:
            break
        mark = now
        old.append(edges)
        if len(old) > 2:
            scratch.drop(old.pop(0))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
