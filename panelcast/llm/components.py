"""Connected components of a link table by large-star and small-star steps.

Every step replaces each node's links by links to its smallest neighbour, with
one combined minimum per node and one join, so a hub's links are never held in
one place. The number of steps grows with the logarithm of the component sizes.
Each step is written to the shared stage folder and read back, which cuts the
lineage and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.sources.stage import write_stage


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``component``, its smallest reachable node, for every node with a link to another.

    Null ends, links of a node to itself and repeated links change nothing.
    """
    edges = links.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where(f"`{a}` <> `{b}`").distinct()
    edges = write_stage(edges, "components")
    state = None
    while True:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = edges.join(least.withColumnRenamed("u", "lo"), "lo").select("hi", F.col("m").alias("lo")).where("hi <> lo")
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select(F.when(F.col("lo") == F.col("m"), F.col("hi")).otherwise(F.col("lo")).alias("hi"), F.col("m").alias("lo"))
        edges = write_stage(small.where("hi <> lo").distinct(), "components")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).head()
        if now == state:
            break
        state = now
    ends = edges.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return ends.unionByName(edges.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
