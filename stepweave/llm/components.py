"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepweave.llm.common import written


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the least of its neighbours and itself."""
    near = _both(edges)
    least = written(near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")
    return near.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, is tied to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    least = written(down.groupBy("a").agg(F.min("b").alias("m")), "least")
    tied = down.join(least, "a")
    return (tied.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b: bigint); the component is its least node.

    Each round is written to the shared folder, and so are the least neighbours, so that the join with them can be split
    where one node has very many edges; rounds end when the edges are stars, which takes about as many rounds as
    the logarithm of the number of nodes.
    """
    state, last = written(edges.where("a <> b").distinct(), "edges"), None
    while True:
        now = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == last or now[0] == 0:
            break
        last = now
        state = written(_small(_large(state)), "edges")
    centres = state.select("b").distinct()
    return state.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        centres.select(F.col("b").alias("node"), F.col("b").alias("component")))
