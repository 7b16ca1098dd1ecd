"""Connected components of a graph given as a table of edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

def _mark(edges: DataFrame) -> tuple:
    """A count and a sum of hashes: equal for equal sets of edges."""
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    return row[0], row[1]


def stars(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): every node that has an edge, with the least node of its component.

    Each round ties all larger neighbours of a node to its least one, then all smaller ones. Minima are combined before the
    exchange and joined back to the edges, dealt out by node whatever their number, where adaptive execution splits a node with very many. Rounds grow with the
    logarithm of the nodes and end by themselves; each is written to the shared folder, so a lost executor costs one round at most.
    """
    now = cut(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct())
    mark = _mark(now)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least.hint("merge"), "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        met = down.join(low.hint("merge"), "a")
        tied = met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(met.select("a", F.col("m").alias("b")))
        now = cut(tied.filter("a <> b").distinct(), instead_of=now)
        if (new := _mark(now)) == mark:
            break
        mark = new
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
