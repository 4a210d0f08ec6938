"""Recursion over a table, semi-naive: each round joins only what the last one found."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.session import spooled


def reachable(edges: DataFrame, source: str, target: str, rounds: int = 1000) -> DataFrame:
    """(start, node, depth): every node that a path of edges leads to from each source, with the fewest edges that do.

    A node that lies on a cycle reaches itself. Null ends are no edges, repeated edges count once, an empty table gives no rows; other columns are ignored.
    Each round is written: pairs found last join the edges, and what was found before goes. More than `rounds` are an error.
    """
    edges = spooled(edges.select(F.col(source).alias("node"), F.col(target).alias("next")).filter("node is not null and next is not null").distinct(), "edges")
    found = last = spooled(edges.select(F.col("node").alias("start"), F.col("next").alias("node"), F.lit(1).alias("depth")), "round")
    depth = 1
    while not last.isEmpty():
        if depth > rounds:
            raise ValueError(f"paths of over {rounds} edges")
        depth += 1
        ahead = last.select("start", "node").join(edges, "node").select("start", F.col("next").alias("node")).distinct()
        last = spooled(ahead.join(found.select("start", "node"), ["start", "node"], "left_anti").withColumn("depth", F.lit(depth)), "round")
        found = found.unionByName(last)
    return found
