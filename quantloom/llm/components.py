"""Connected components of a graph that is only held as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def star_round(links: DataFrame) -> DataFrame:
    """One large-star and one small-star step on links (u, v) with u > v, as a table.

    The least neighbours are tables too, not aggregates within the join: a join on the root of a large
    component, one hot key, is only split (or the small side broadcast) where both sides are shuffled as they are.
    """
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    nearest = materialise(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u")))
    large = materialise(both.join(nearest, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
    least = materialise(large.groupBy("u").agg(F.min("v").alias("m")))
    small = large.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    done = materialise(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
    for used in (nearest, large, least):
        discard(used)
    return done


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) of every node that has a link; columns u, v of a link in any order.

    Alternating star steps: each round halves the distance to the root or better and is written to
    the shared folder, so that no plan grows and a lost executor costs one round at most.  Nulls and
    links of a node to itself are left out.
    """
    start = links.filter("u is not null and v is not null and u != v")
    current = materialise(start.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    while True:
        seen = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % F.lit(1 << 40))).first()
        if seen[0] == 0 or tuple(seen) == state:
            break
        state = tuple(seen)
        later = star_round(current)
        discard(current)
        current = later
    roots = current.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
