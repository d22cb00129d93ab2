"""Connected components of a table of links, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from textloom.session import written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``comp`` (the smallest node reachable) for every node of ``edges``.

    Each node has a parent, itself at first.  A round offers the grandparents of a
    node's neighbours to the node and to its parent, so whole trees are hooked at their
    roots and not node by node, and then halves the way to the root.  Rounds follow the
    logarithm of a component's size.  Parents are written out each round; nothing is
    collected but whether any has changed.
    """
    both = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
    both = written(both.union(both.select("y", "x")).distinct(), "edges")
    parents = written(both.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("m")).select("node", F.least("node", "m").alias("comp")), "parents")
    while True:
        above = parents.select(F.col("node").alias("comp"), F.col("comp").alias("top"))
        known = written(parents.join(above, "comp").select("node", "comp", "top"), "grandparents")
        near = both.join(known.select(F.col("node").alias("y"), "top"), "y").groupBy("x").agg(F.min("top").alias("m"))
        found = known.join(near.withColumnRenamed("x", "node"), "node").select("node", "comp", F.least("top", "m").alias("m"))
        # what a node finds goes to itself and to its parent; many children of one parent meet in partial minima
        offers = found.select("node", "m").union(found.select("comp", "m")).groupBy("node").agg(F.min("m").alias("m"))
        moved = written(parents.join(offers, "node").select("node", F.least("comp", "m").alias("comp"), (F.col("m") < F.col("comp")).alias("changed")), "parents")
        parents = moved.select("node", "comp")
        if not moved.where("changed").head(1):
            return parents
