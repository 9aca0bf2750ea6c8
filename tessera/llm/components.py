"""Connected components by alternating stars: every round is two aggregations and joins over the edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, materialise


def _star(both: DataFrame, larger: bool) -> DataFrame:
    """Links to each node's least neighbour (or itself): of its larger neighbours, or of its smaller ones and itself.
    Minima are aggregated partially, and a node with very many neighbours is a skewed join, not one group."""
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    linked = both.join(least, "u")
    if larger:
        out = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """node, label (the least node of its component) for every node of edges(u, v) that isn't a label itself."""
    edges = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    for _ in range(most):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = materialise(_star(both, True), "large-star")
        small = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        new = materialise(_star(small, False), "small-star")
        discard(large)
        discard(edges)
        edges = new
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
        before = state
    raise RuntimeError("components have not settled")
