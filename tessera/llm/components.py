"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.runtime import discard, settle


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, component (its least node), one row per node that has a link.

    ``links`` has the long columns a and b.  Each round hangs every node's
    larger neighbours, then its smaller ones, on its least neighbour; the
    table never grows beyond the links it began with, and converges in a
    logarithmic number of rounds.  Every round is written and reread, so the
    lineage stays short and a lost executor costs one round.  A hub is only
    ever aggregated (minimum) and joined, never gathered into one row.
    """
    edges = settle(links.selectExpr("greatest(a, b) AS a", "least(a, b) AS b").filter("a <> b").distinct(), "links")
    before = None
    for _ in range(max_rounds):
        both = edges.union(edges.selectExpr("b AS a", "a AS b"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").selectExpr("b AS a", "m AS b").filter("a <> b")
        large = settle(large.distinct(), "large-star")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        hung = small.selectExpr("b AS a", "m AS b").union(small.selectExpr("a", "m AS b")).filter("a <> b")
        old, edges = edges, settle(hung.distinct(), "small-star")
        discard(old, large)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"links did not settle in {max_rounds} rounds")
    leaves = edges.selectExpr("a AS node", "b AS component")
    return leaves.union(edges.selectExpr("b AS node", "b AS component").distinct())
