"""Algebra on edge tables: symmetrisation, normalisation, transition matrices, statistics. No table is densified."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.schema import require_choice, require_columns


def swapped(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")


def drop_loops(edges: DataFrame) -> DataFrame:
    """Without self edges and explicit zeros."""
    return edges.where((F.col("src") != F.col("dst")) & (F.col("weight") != 0))


def clip_negative(edges: DataFrame) -> DataFrame:
    return edges.withColumn("weight", F.greatest("weight", F.lit(0.0)))


def symmetrise(edges: DataFrame, method: str = "max") -> DataFrame:
    """Combines (i, j) with (j, i), an absent edge being 0: max, min, mean, or `or` (1 where either is non-zero)."""
    method = require_choice(method, "max", "min", "mean", "or")
    require_columns(edges, "src", "dst", "weight")
    both = edges.select("src", "dst", "weight").withColumn("side", F.lit(1)).unionByName(swapped(edges).withColumn("side", F.lit(2)))
    w, n = F.col("weight"), F.count_distinct("side")
    if method == "mean":
        value = F.sum(w) / 2
    elif method == "or":
        value = F.max(F.when(w != 0, 1.0).otherwise(0.0))
    else:
        # one side alone meets an implicit 0
        value = F.greatest(F.max(w), F.when(n < 2, 0.0)) if method == "max" else F.least(F.min(w), F.when(n < 2, 0.0))
    return both.groupBy("src", "dst").agg(value.alias("weight")).where("weight <> 0")


def fuzzy_union(edges: DataFrame) -> DataFrame:
    """p + q - p q of the two directions, clipped to [0, 1]; zeros go."""
    both = edges.select("src", "dst", F.col("weight").alias("p"), F.lit(0.0).alias("q"))
    both = both.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(0.0).alias("p"), F.col("weight").alias("q")))
    out = both.groupBy("src", "dst").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    w = F.least(F.greatest(F.col("p") + F.col("q") - F.col("p") * F.col("q"), F.lit(0.0)), F.lit(1.0))
    return out.select("src", "dst", w.alias("weight")).where("weight <> 0")


def row_normalise(edges: DataFrame, key: str = "src", value: str = "weight") -> DataFrame:
    """Divides by the row's sum; a row that sums to 0 stays as it is. The sums come from an aggregation and a join, so
    a long row is not one window group."""
    sums = edges.groupBy(key).agg(F.sum(value).alias("__sum"))
    out = edges.join(sums, key)
    return out.withColumn(value, F.when(F.col("__sum") != 0, F.col(value) / F.col("__sum")).otherwise(F.col(value))).select(edges.columns)


def transition(edges: DataFrame, symmetric: bool = True, method: str = "max") -> DataFrame:
    """Random-walk matrix: negative weights clipped, symmetrised, loops dropped, rows normalised, in this order."""
    out = clip_negative(edges)
    if symmetric:
        out = symmetrise(out, method)
    return row_normalise(drop_loops(out))


def matrix_stats(edges: DataFrame, vertices: DataFrame | None = None, tolerance: float = 1e-10) -> DataFrame:
    """One row: n, nnz, density, least, greatest and mean stored value, whether symmetric, range of the row sums (rows
    without edges sum to 0). vertices(id) gives all rows; without it, the ends of the edges are all."""
    edges = edges.where("weight <> 0")
    if vertices is None:
        vertices = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    n = vertices.select("id").distinct().agg(F.count(F.lit(1)).alias("n"))
    stored = edges.agg(F.count(F.lit(1)).alias("nnz"), F.min("weight").alias("min_value"), F.max("weight").alias("max_value"), F.avg("weight").alias("mean_value"))
    pair = edges.unionByName(swapped(edges).withColumn("weight", -F.col("weight"))).groupBy("src", "dst").agg(F.sum("weight").alias("gap"))
    even = pair.agg((F.coalesce(F.max(F.abs("gap")), F.lit(0.0)) <= tolerance).alias("is_symmetric"))
    sums = vertices.select("id").distinct().join(edges.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("s")), "id", "left")
    sums = sums.agg(F.min(F.coalesce("s", F.lit(0.0))).alias("min_row_sum"), F.max(F.coalesce("s", F.lit(0.0))).alias("max_row_sum"))
    one = n.join(stored).join(even).join(sums)  # one row each
    return one.withColumn("density", F.col("nnz") / (F.col("n") * F.col("n")))


def from_dense(rows: DataFrame, id_col: str = "id", row_col: str = "row") -> DataFrame:
    """Edges from dense rows: column j of row i is edge (i, j); zeros are absent."""
    out = rows.select(F.col(id_col).alias("src"), F.posexplode(row_col).alias("dst", "weight"))
    return out.where("weight <> 0").select(F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst"), F.col("weight").cast("double").alias("weight"))


def graph(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of a graph."""
    vertices = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    return vertices, edges


def undirected(edges: DataFrame) -> DataFrame:
    """One edge (src < dst) a pair, weights of both directions added; loops keep their own weight."""
    return edges.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.sum("weight").alias("weight"))


def membership_probability(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """id, cluster, p: the share of a node's edge weight that goes to each cluster."""
    out = edges.join(labels.select(F.col("id").alias("dst"), "cluster"), "dst").groupBy(F.col("src").alias("id"), "cluster").agg(F.sum("weight").alias("p"))
    return row_normalise(out, "id", "p")


def strongest(edges: DataFrame, key: str = "dst") -> DataFrame:
    """Of each node's edges the heaviest, ties to the smaller other end."""
    other = "src" if key == "dst" else "dst"
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("weight"), other))
    return edges.withColumn("__r", rank).where("__r = 1").drop("__r")


__all__ = [n for n in dir() if not n.startswith("_")]
