"""Connected components of a bipartite graph of nodes and the keys that tie them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpusforge.runtime import cut


def components(edges: DataFrame, node: str = "node", key: str = "key", name: str = "component", rounds: int = 60) -> DataFrame:
    """One row per node with the least node of its component.

    Each round takes the least label over every key and jumps along labels, so the number of rounds grows with the
    logarithm of the longest chain. Hot keys only meet in aggregations with partial results. Rows with a null node or
    key tie nothing; a node that only has such rows is not returned.
    """
    e = cut(edges.select(F.col(node).alias("n"), F.col(key).alias("k")).where("n is not null and k is not null").distinct())
    labels = e.select("n").distinct().withColumn("c", F.col("n"))
    for _ in range(rounds):
        least = e.join(labels, "n").groupBy("k").agg(F.min("c").alias("m"))
        seen = e.join(least, "k").groupBy("n").agg(F.min("m").alias("m"))
        new = labels.join(seen, "n").select("n", F.least("c", "m").alias("c"), F.col("c").alias("old"))
        to = new.select(F.col("n").alias("c"), F.col("c").alias("cc"))
        new = cut(new.join(to, "c").select("n", F.least("c", "cc").alias("c"), "old"))
        labels = new.select("n", "c")
        if not new.where("c <> old").limit(1).count():
            return labels.select(F.col("n").alias(node), F.col("c").alias(name))
    raise RuntimeError("the components did not settle")
