"""Connected components of an edge table, by alternating large-star and small-star rounds.

Everything stays in DataFrames: each round joins the edges with the smallest neighbour
of their nodes. Minima are combined before the shuffle and written, so that the join is
between two tables and adaptive execution can split the edges of a node that has very
many. Each round is written to the shared folder, so lost executors cost one at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, stage_scope


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) of comparable ids to (node, root): root is the smallest id that can be reached.

    Nodes without an edge are absent. Loops and repeated edges do not matter. No edges: no rows.
    """
    with stage_scope(edges.sparkSession):
        current = cut_lineage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
        size, before = current.count(), None
        while size:
            state = current.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first()
            if state == before:
                break
            before = state
            current = cut_lineage(_small_star(cut_lineage(_large_star(current))))
        current = cut_lineage(current, outlive=True)
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of every node are tied to the smallest of the node and its neighbours."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("m"))
    least = cut_lineage(least)
    # Every edge (a, b) has a > b: its larger end a is a larger neighbour of b alone.
    return edges.join(least, edges["b"] == least["node"]).select("a", F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them."""
    least = cut_lineage(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), "m"))
    others = edges.join(least, edges["a"] == least["node"]).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return others.union(least.select(F.col("node").alias("a"), F.col("m").alias("b"))).distinct()
