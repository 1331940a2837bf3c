"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from reviewflow.session import discard, stored


def components(links: DataFrame, passes: int = 40) -> DataFrame:
    """node, component_id (its least reachable node) of every node of ``links`` (a, b).

    Alternates the large-star and the small-star step: every node links its
    larger neighbours, then all its neighbours, to the least one it sees. A star
    per component remains after a number of passes that grows with the logarithm
    of the graph. Each step is one aggregation and one join by node, whose
    skewed side Spark may split; each pass is written out, which cuts lineage.
    The large-star step also tells whether its input is stars already, that is, no node
    has two smaller neighbours, or a smaller and a larger one.
    """
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    if edges.isEmpty():  # its plan would be cut and tell nothing
        return _named(edges)
    for _ in range(passes + 1):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count_if(F.expr("v < u")).alias("below"), F.max("v").alias("most"))
        seen = Observation()
        least = least.observe(seen, F.max(F.expr("below > 1 OR below = 1 AND most > u")).alias("open")).select("u", "m")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.where("u <> v").distinct(), "large-star")
        if seen.get["open"] is False:
            discard(large)
            return _named(edges)
        discard(edges)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        discard(large)
    raise RuntimeError(f"components did not settle in {passes} passes")


def _named(stars: DataFrame) -> DataFrame:
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component_id")).unionByName(
        stars.select(F.col("v").alias("node"), F.col("v").alias("component_id")).distinct()
    )
