"""Connected components of a graph given by its edges, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hangarlog.llm.frames import stash


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Columns node, root for every node of edges (a, b); root is the component's smallest node.

    Large-star and small-star rounds: each node's neighbours are linked to the
    smallest node it knows, never to each other, so the number of edges does
    not grow. The rows of a component's root meet in one task of the join.
    """
    links = stash(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    for _ in range(most_rounds):
        # The links are distinct, and no number of them overflows an exclusive or.
        state = links.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("bit_xor(xxhash64(v, u))")).first()
        if state == before:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = state
        both = links.union(links.select("v", "u"))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(small, "u")
        links = stash(star.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            small.select("u", F.col("m").alias("v"))).distinct())
    raise RuntimeError("components did not settle")
