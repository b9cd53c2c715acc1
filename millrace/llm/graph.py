"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a minimum for each node (summed up before the shuffle) and a join; tables are
written to the shared folder, and no edge or label reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import forget, parts, written

FEW = 20_000  # edges that one task takes without hurry


def _star(edges: DataFrame, large: bool, n_edges: int) -> DataFrame:
    """One step over edges (a, b), a < b. Large: all larger neighbours of a node join its least one; small: all smaller ones.

    Nodes with more than one part in eight of what a task gets on average, 16 a task at most, would
    fill single tasks of a join: their least neighbours are broadcast, the others' joined.
    """
    tasks = parts(edges.sparkSession)
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("a", "m"))
    if n_edges < FEW:
        joined = both.join(least.drop("n"), "a")
    else:
        joined = _spread(both, least, max(64, n_edges // (8 * tasks)))
    if large:
        out = joined.where("b > a").select(F.col("m").alias("a"), "b")
    else:
        out = joined.select(F.col("m").alias("a"), "b").unionByName(least.select(F.col("m").alias("a"), F.col("a").alias("b")))
    return out.where("a < b").distinct()


def _spread(both: DataFrame, least: DataFrame, most: int) -> DataFrame:
    hub = F.col("n") > most
    marked = both.join(F.broadcast(least.where(hub).drop("n")), "a", "left")
    return marked.where("m is null").drop("m").join(least.where(~hub).drop("n"), "a").unionByName(marked.where("m is not null"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (its least node) of every node of an edge. Self links and repeats do no harm; no edges, no rows."""
    pair = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct()
    now, seen = written(pair, "edges"), None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen or not mark[0]:
            break
        seen = tuple(mark)
        half = written(_star(now, True, mark[0]), "edges")
        nxt = written(_star(half, False, mark[0]), "edges")
        forget(half)
        forget(now)
        now = nxt
    nodes = now.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return nodes.unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
