"""Profiles of clusters: expression per cluster, dot plots, and other tables that plots are drawn from."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.schema import require_choice, require_columns


def to_long(wide: DataFrame, properties: list[str], id_col: str = "id") -> DataFrame:
    """expression(id, property, value) from one column a property."""
    return wide.unpivot(id_col, properties, "property", "value").select(F.col(id_col).alias("id"), "property", F.col("value").cast("double").alias("value"))


def cluster_profile(expression: DataFrame, labels: DataFrame, statistic: str = "mean", keys: list[str] | None = None) -> DataFrame:
    """keys, cluster, property, value, scaled: mean, median or sum of each property in each cluster, and the same between
    0 and 1 per property, (x - min) / (max - min + 1e-8)."""
    statistic, keys = require_choice(statistic, "mean", "median", "sum"), keys or []
    require_columns(expression, "id", "property", "value")
    f = {"mean": F.avg, "median": F.median, "sum": F.sum}[statistic]
    out = expression.join(labels.select(*keys, "id", "cluster"), "id").groupBy(*keys, "cluster", "property").agg(f("value").alias("value"))
    w = Window.partitionBy("property")
    low, high = F.min("value").over(w), F.max("value").over(w)
    return out.withColumn("scaled", (F.col("value") - low) / (high - low + 1e-8))


def size_map(scaled: DataFrame, low: float = 20.0, high: float = 200.0) -> DataFrame:
    return scaled.withColumn("marker", low + (high - low) * F.col("scaled"))


def dotplot(expression: DataFrame, groups: DataFrame) -> DataFrame:
    """groupby, cluster, property, mean, fraction, scaled, marker. groups(groupby, id, cluster) may hold several
    groupings. fraction is the share of values above 0; scaled is min-max of the means per grouping and property (0 if
    all are equal); the marker is 20 + 180 * fraction."""
    out = expression.join(groups, "id").groupBy("groupby", "cluster", "property")
    out = out.agg(F.avg("value").alias("mean"), F.avg(F.when(F.col("value") > 0, 1.0).otherwise(0.0)).alias("fraction"))
    w = Window.partitionBy("groupby", "property")
    low, high = F.min("mean").over(w), F.max("mean").over(w)
    scaled = F.when(high > low, (F.col("mean") - low) / (high - low)).otherwise(0.0)
    return out.withColumn("scaled", scaled).withColumn("marker", 20 + 180 * F.col("fraction"))


def edge_widths(edges: DataFrame, low: float = 0.1, high: float = 2.0) -> DataFrame:
    """Upper-triangle edges with a width between low and high by min-max of their weights (low if all are equal)."""
    upper = edges.where("src < dst")
    ends = upper.agg(F.min("weight").alias("a"), F.max("weight").alias("b"))
    share = F.when(F.col("b") > F.col("a"), (F.col("weight") - F.col("a")) / (F.col("b") - F.col("a"))).otherwise(0.0)
    return upper.join(ends).select("src", "dst", "weight", (low + (high - low) * share).alias("width"))


def centroids(positions: DataFrame, labels: DataFrame) -> DataFrame:
    """cluster, x, y: where a cluster's name goes."""
    return positions.join(labels, "id").groupBy("cluster").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))


def spread_names(places: list[tuple[str, float, float]], gap: float, rounds: int = 200) -> list[tuple[str, float, float]]:
    """Names pushed apart, all pairs at once, until no two are closer than the gap. Names in one place leave it in
    directions of their own. Driver-side, a row a cluster."""
    xy, n = np.array([p[1:] for p in places], float).reshape(-1, 2), len(places)
    turn = np.pi * (3 - 5**0.5) * np.arange(n)
    xy += 1e-9 * gap * np.stack([np.cos(turn), np.sin(turn)], axis=1)
    for _ in range(rounds):
        away = xy[:, None] - xy[None]
        far = np.sqrt((away**2).sum(axis=2))
        np.fill_diagonal(far, np.inf)
        missing = np.maximum(gap - far, 0)
        if not missing.any():
            break
        # a little more than half of what is missing, so a pair alone is apart after one round
        xy += (away * (missing / far * 0.51)[:, :, None]).sum(axis=1)
    return [(name, float(x), float(y)) for (name, _, _), (x, y) in zip(places, xy, strict=True)]


def cluster_counts(labels: DataFrame, keys: list[str]) -> DataFrame:
    """Number of clusters of each labeling, for comparisons side by side."""
    return labels.groupBy(*keys).agg(F.count_distinct("cluster").alias("n_clusters"))


def colour_index(labels: DataFrame) -> DataFrame:
    """cluster, colour: its place among all clusters of all labelings."""
    return labels.select("cluster").distinct().withColumn("colour", F.row_number().over(Window.orderBy("cluster")) - 1)


def bar_blocks(order: DataFrame, levels: DataFrame) -> DataFrame:
    """level, cluster, start, stop: runs of neighbouring leaves order(id, position) with the same cluster."""
    w = Window.partitionBy("level", "cluster").orderBy("position")
    rows = levels.join(order, "id").withColumn("island", F.col("position") - F.row_number().over(w))
    return rows.groupBy("level", "cluster", "island").agg(F.min("position").alias("start"), (F.max("position") + 1).alias("stop")).drop("island")


def mean_positions(order: DataFrame, levels: DataFrame) -> DataFrame:
    """level, cluster, x: mean place of a cluster's leaves."""
    return levels.join(order, "id").groupBy("level", "cluster").agg(F.avg("position").alias("x"))


def representatives(rows: DataFrame, order: str, n: int) -> DataFrame:
    """n of the rows at even steps in the order, first and last included; for tables of clusters or levels."""
    place = F.row_number().over(Window.orderBy(order)) - 1
    numbered = rows.withColumn("__place", place).withColumn("__last", F.count(F.lit(1)).over(Window.partitionBy()) - 1)
    step = F.sequence(F.lit(0), F.lit(n - 1))
    wanted = F.transform(step, lambda i: F.floor(i * F.col("__last") / max(n - 1, 1) + 0.5))
    return numbered.where((F.col("__last") < n) | F.array_contains(wanted, F.col("__place").cast("long"))).drop("__place", "__last")
