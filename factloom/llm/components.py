"""Connected components of a graph of long ids by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import few_files, staged, unstage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges are (a, b) with a > b. Large star: every node links its larger neighbours to the least
    of its neighbours and itself; small star: its smaller ones and itself."""
    if large:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    met = both.join(least, "u")
    moved = met.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")) if large else met.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of `edges` (a, b): root is the least node reachable. Each round is
    written to the shared folder, in files by the number of edges, which no round adds to; rounds grow as the
    logarithm of the longest path. The neighbours of a large star's centre meet its least one in a plain sort-merge
    join, which adaptive execution splits where one key is large."""
    now = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    sign = None
    while True:
        row = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(row) == sign or not row[0]:
            break
        sign = tuple(row)
        after = staged(few_files(_star(_star(now, True), False), row[0]))
        unstage(now)
        now = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b"), F.col("b")).distinct())
