"""Connected components by alternating large-star and small-star rounds."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.session import freeze


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link the larger (large star) or the smaller neighbours of each node to its least one."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("least"))
    least = least.select(F.col("a").alias("node"), F.least("a", "least").alias("least"))
    linked = both.join(least.hint("merge"), both["a"] == least["node"])
    if large:
        linked = linked.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        own = least.select(F.col("node").alias("a"), F.col("least").alias("b"))
        linked = linked.select(F.col("b").alias("a"), F.col("least").alias("b")).union(own)
    return linked.where("a > b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of an edge.

    ``edges`` has two long columns ``a`` and ``b``; order, repeats and loops do not matter, and edges with a
    null end are ignored.  Both rounds keep the components and shrink the number of
    rounds to the logarithm of their size; hubs are split by adaptive skew joins.
    """
    pairs = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    pairs = freeze(pairs.distinct())

    def state(df):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = state(pairs)
    while before[0]:
        # every node hangs on one smaller node only: after small star, edges are (larger, smaller)
        pairs = freeze(_star(_star(pairs, large=True), large=False))
        after = state(pairs)
        if after == before:
            break
        before = after
    found = pairs.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return found.union(found.select("component", "component")).distinct()
