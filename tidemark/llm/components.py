"""Connected components of a large graph by contraction, with every step a join or a partial aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def components(edges: DataFrame) -> DataFrame:
    """node, root for each node of the edges (a, b: long); root is one node of its component. No edges give no rows.

    Each round points every node at its smallest neighbour, follows the pointers to their ends, and contracts the edges
    to those ends; the number of components that are left at least halves. A node with very many edges is pre-aggregated.
    """
    n = edges.count()
    edges = written(edges.where("a <> b").select("a", "b").distinct(), "edges", n)
    mapping = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("p")).select("node", F.least("node", "p").alias("p")), "parents", 2 * n)
        while True:
            up, top = parent.select(F.col("node").alias("p"), F.col("p").alias("q")), parent.select(F.col("node").alias("q"), F.col("p").alias("r"))
            step = written(parent.join(up, "p").join(top, "q").select("node", F.col("r").alias("p"), (F.col("q") != F.col("r")).alias("moved")), "parents", 2 * n)
            discard(parent)
            parent = step.drop("moved")
            if step.where("moved").isEmpty():
                break
        last = parent.select(F.col("node").alias("root"), F.col("p").alias("next"))
        mapping = parent.select("node", F.col("p").alias("root")) if mapping is None else written(mapping.join(last, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "roots", 2 * n)
        a, b = (parent.select(F.col("node").alias(x), F.col("p").alias(f"{x}_root")) for x in "ab")
        left = edges.join(a, "a").join(b, "b").select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).where("a <> b").distinct()
        contracted = written(left, "edges", n)
        discard(edges)
        edges = contracted
        if edges.isEmpty():
            return mapping
