"""Connected components by alternating star contractions; nothing is gathered in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm._batches import with_checkpoints


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction of (a, b) edges with a > b.

    Large star: each node's larger neighbours go to the least node of its neighbourhood. Small star: so do
    its smaller neighbours and the node itself. The least node is an aggregate with partial sums on the map side, joined
    back on the node; a node with very many neighbours is a skewed join that adaptive execution splits.
    """
    if large:
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionAll(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
        least = both.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("least"))
        out = edges.select(F.col("b").alias("node"), F.col("a").alias("other")).join(least, "node").select(F.col("other").alias("a"), F.col("least").alias("b"))
        return out.where("a > b").distinct()
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    out = edges.join(least, "a").select(F.when(F.col("b") == F.col("least"), F.col("a")).otherwise(F.col("b")).alias("x"), F.col("least").alias("b"), "a")
    moved = out.select(F.col("x").alias("a"), "b").unionAll(out.select("a", "b"))
    return moved.where("a > b").distinct()


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """(node, class) of every node in the edges (a, b); class is the least node that it is linked to.

    Self-loops, null ends and repeated edges do nothing. Each round's edges are cut off by a reliable checkpoint, so a
    lost executor costs one round at most. The rounds grow with the logarithm of the longest chain.
    """
    with_checkpoints(edges.sparkSession)
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = state(now)
    for _ in range(limit):
        now = _star(_star(now, True), False).checkpoint()
        after = state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("the components didn't settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("class"))
