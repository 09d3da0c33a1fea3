"""Connected components of an undirected graph, by hooking to the least neighbour and contracting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewell.llm.common import forget, written


def components(links: DataFrame) -> DataFrame:
    """(node, component) for each node of `links` (a, b longs): the component is its least node.

    In each round every node points to its least neighbour, pointers are followed twice over,
    and the graph is contracted to the nodes pointed to, until no link is left between two of
    them. No list of neighbours is ever gathered. Loops and repeated links do no harm.
    """
    left = written(links.filter("a <> b").select("a", "b").distinct(), "links")
    labels = None
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        to = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to")).withColumnRenamed("a", "node"), "hooks")
        for _ in range(2):
            step = to.select(F.col("node").alias("to"), F.col("to").alias("next"))
            before, to = to, written(to.join(step, "to").select("node", F.col("next").alias("to")), "hooks")
            forget(before)
        ends = [to.select(F.col("node").alias(c), F.col("to").alias(c + "_to")) for c in "ab"]
        before, now = left, left.join(ends[0], "a").join(ends[1], "b").select(F.col("a_to").alias("a"), F.col("b_to").alias("b"))
        left = written(now.filter("a <> b").distinct(), "links")
        forget(before)
        if labels is None:
            labels = written(to.withColumnRenamed("to", "component"), "labels")
        else:
            step = to.select(F.col("node").alias("component"), F.col("to").alias("next"))
            before, now = labels, labels.join(step, "component", "left").select("node", F.coalesce("next", "component").alias("component"))
            labels = written(now, "labels")
            forget(before)
        forget(to)
    return labels if labels is not None else left.select(F.col("a").alias("node"), F.col("b").alias("component"))
