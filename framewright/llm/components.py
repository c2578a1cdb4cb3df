"""Connected components of a graph in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.skew import join_keyed
from framewright.storage import discard, materialize


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root of all nodes of ``edges`` (a, b; long): root is the smallest node of the component.

    Each round points every node, by its neighbours, at the smallest node it
    sees, in two steps (larger neighbours, then smaller ones), so paths shrink
    by about half a round.  A round shuffles the edges twice, keeps one row per
    distinct edge and is written, so a lost executor costs one round at most; what
    the round before wrote is deleted.
    Hubs are grouped by minimum only: no list of neighbours is ever collected, and
    a hub's minimum reaches its neighbours by a broadcast (``join_keyed``).  The rounds
    end as soon as all components are stars, without one more to see that none changes.
    """
    links = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    links = materialize(links, "links")
    for _ in range(most_rounds):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n"))
        least = materialize(least, "least")
        large = join_keyed(both.filter("v > u"), least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.filter("u <> v").distinct(), "large-star")
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")
        small = join_keyed(large, least, "u")
        small = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = materialize(
            small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small-star"
        )
        for done in (links, large):
            discard(done)
        links = after
        if stars(links):
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = links.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return roots.unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def stars(links: DataFrame) -> bool:
    """Whether each larger end u of distinct ``links`` has one smaller end v, which is no larger end itself."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("above"), F.lit(0).alias("below"))
    ends = ends.unionByName(links.select(F.col("v").alias("node"), F.lit(0).alias("above"), F.lit(1).alias("below")))
    seen = ends.groupBy("node").agg(F.sum("above").alias("above"), F.max("below").alias("below"))
    return seen.filter((F.col("above") > 1) | (F.col("above") > 0) & (F.col("below") > 0)).isEmpty()
