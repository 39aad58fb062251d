"""Connected components of a graph by repeated contraction; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanloom.llm.frames import written


def _roots(parent: DataFrame) -> DataFrame:
    """Follow parents (a, p), p < a, until every p is a root; doubles the reach each time."""
    while True:
        above = parent.select(F.col("a").alias("p"), F.col("p").alias("q"))
        joined = parent.join(above, "p", "left")
        if joined.filter("q IS NOT NULL").isEmpty():
            return parent
        parent = written(joined.select("a", F.coalesce("q", "p").alias("p")), "parents")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): the smallest node reachable, for every node that an edge joins to a smaller one.

    Each round points every node to its smallest smaller neighbour, follows those
    pointers to their roots and keeps only the distinct edges between roots, so the
    edges shrink geometrically. Nulls and loops are no edges; repeated edges count once.
    """
    high, low = F.greatest(a, b).alias("a"), F.least(a, b).alias("b")
    joined = edges.filter(F.col(a) != F.col(b)).select(high, low)
    left = written(joined.distinct(), "edges")
    found = None
    while not left.isEmpty():
        parent = _roots(written(left.groupBy("a").agg(F.min("b").alias("p")), "parents"))
        if found is None:
            found = parent
        else:
            # Nodes whose root moved on, and the roots of this round themselves.
            moved = parent.select(F.col("a").alias("p"), F.col("p").alias("q"))
            found = found.join(moved, "p", "left").select("a", F.coalesce("q", "p").alias("p"))
            found = written(found.union(parent), "roots")
        for end in ("a", "b"):
            to = parent.select(F.col("a").alias(end), "p")
            left = left.join(to, end, "left").withColumn(end, F.coalesce("p", end)).drop("p")
        apart = left.filter("a <> b").select(
            F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
        )
        left = written(apart.distinct(), "edges")
    if found is None:
        found = left.select("a", F.col("b").alias("p"))
    return found.select(F.col("a").alias("node"), F.col("p").alias("root"))
