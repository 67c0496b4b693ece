"""Connected components of an edge table by repeated joins; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep

#: A path of length n needs about log2(n) rounds; this bound is for a fault only.
MOST_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """v, root: for every vertex of an undirected edge table (a, b) the least vertex of its component.

    Each round gives every vertex the least label among itself and its neighbours, hangs old roots under the least label
    offered to any of their members, and then jumps one pointer; it ends when no label moves. Self-loops and repeated
    edges change nothing; an empty table gives an empty one.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = keep(both, "edges")
    labels = keep(both.groupBy(F.col("a").alias("v")).agg(F.min(F.least("a", "b")).alias("root")), "labels")
    for _ in range(MOST_ROUNDS):
        offered = both.join(labels.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v")).agg(F.min("root").alias("near"))
        met = labels.join(offered, "v").select("v", "root", F.least("root", "near").alias("near"))
        # What any member of a root was offered, the root takes; labels then look up their label's own.
        up = met.select(F.col("root").alias("v"), "near").union(met.select("v", "near")).groupBy("v").agg(F.min("near").alias("root"))
        up = keep(up, "up")
        jumped = up.alias("x").join(up.select(F.col("v").alias("root"), F.col("root").alias("top")), "root").select("v", F.least("root", "top").alias("root"))
        new = keep(jumped, "labels")
        moved = new.join(labels.withColumnRenamed("root", "old"), "v").filter("root <> old").limit(1).count()
        labels = new
        if not moved:
            return labels
    raise RuntimeError("components did not settle")
