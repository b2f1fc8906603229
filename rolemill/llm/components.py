"""Connected components of a graph of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolemill.llm.common import discard, written


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b); the root is the component's smallest node.

    Each round every node hooks on to its smallest neighbour, chains of hooks are shortened, and the
    links are drawn anew between roots. Hooks go to smaller nodes only, so they form no circle, and a
    component of n nodes is done after about log n rounds. Each round is written and the one before
    it deleted, minima are pre-aggregated, and only counts come to the driver.
    """
    links = written(links.where("a <> b").select("a", "b").distinct(), "links")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    roots = written(both.select(F.col("a").alias("node")).distinct().withColumn("root", F.col("node")), "roots")
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = written(both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("b")), "hooks")
        for _ in range(2):
            onward = hooks.select(F.col("a").alias("b"), F.col("b").alias("c"))
            hooks = written(hooks.join(onward, "b").select("a", F.col("c").alias("b")), "hooks", gone=[hooks])
        moved = hooks.withColumnsRenamed({"a": "root", "b": "to"})
        roots = written(roots.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "roots", gone=[roots])
        from_a = hooks.select("a", F.col("b").alias("x"))
        from_b = hooks.select(F.col("a").alias("b"), F.col("b").alias("y"))
        ends = links.join(from_a, "a").join(from_b, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
        links = written(ends.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links", gone=[links, hooks])
    discard(links)
    return roots
