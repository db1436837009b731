"""Connected components by alternating large-star and small-star steps.

A step takes the least neighbour of every node (an aggregate with partial sums) and
joins it back to the node's links. The least neighbours are written first, so both
sides of the join are plain shuffles, and adaptive execution splits a node with
very many links over tasks; nothing gathers a node's links. Each step's result is
written to the shared folder: lineage stays short, and a lost executor costs no
more than the step at hand. Tables of steps that are done with are deleted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import dropped
from .common import written


def _star(links: DataFrame, large: bool) -> tuple[DataFrame, DataFrame]:
    """Links each node's neighbours (larger ones, or smaller ones and itself) to the least of all; and the table of least ones."""
    if large:
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        both = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    moved = both.join(least, "u")
    if large:
        out = moved.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = moved.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.where("u <> m").select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct(), least


def connected_components(links: DataFrame, *, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node that has a link; root is the component's least node.

    links has columns a and b (long, not null). Equal ends are dropped."""
    edges = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    mark = None
    for _ in range(most_rounds):
        large, one = _star(edges, True)
        small, two = _star(large, False)
        before, edges = edges, written(small, "star")
        dropped(before, one, two)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
