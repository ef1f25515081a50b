"""Connected components of a table of links, by contraction.

In each round every node points to the smallest of itself and its neighbours, and
the links are carried over to the nodes pointed to. Links between a node and itself
go. The graph shrinks until no link is left; then the pointers are followed.
All of it are joins and aggregates; only the number of links left reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def components(links: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of each node that has a link; ``component`` is one node of it. What is written goes to ``scratch``."""
    left = scratch.keep(links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter(F.col("a") != F.col("b")).distinct(), "links")
    rounds: list[DataFrame] = []
    while not left.isEmpty():
        both = left.unionAll(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("least"))
        rounds.append(scratch.keep(least.select(F.col("a").alias("node"), F.least("a", "least").alias("to")), "pointers"))
        one = rounds[-1].select(F.col("node").alias("a"), F.col("to").alias("to_a"))
        other = rounds[-1].select(F.col("node").alias("b"), F.col("to").alias("to_b"))
        moved = left.join(one, "a").join(other, "b").filter(F.col("to_a") != F.col("to_b"))
        left = scratch.keep(moved.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), "links")
    if not rounds:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = rounds[0].select("node", F.col("to").alias("component"))
    for pointers in rounds[1:]:
        further = pointers.select(F.col("node").alias("component"), "to")
        found = found.join(further, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return found
