"""Annotation: rules from clusters to labels, weighted votes, and propagation along a graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.durable import cut
from tessera.functions.labels import normalise_missing
from tessera.operators.edges import drop_loops, row_normalise
from tessera.schema import require_columns

UNASSIGNED = "unassigned"


def apply_rules(labels: DataFrame, rules: DataFrame, default: str = UNASSIGNED) -> DataFrame:
    """id, label: the rule of the row's cluster, compared as strings; clusters without a rule get the default."""
    require_columns(rules, "cluster", "label")
    own = labels.withColumn("__c", F.col("cluster").cast("string"))
    table = rules.select(F.col("cluster").cast("string").alias("__c"), "label")
    return own.join(table, "__c", "left").select("id", F.coalesce("label", F.lit(default)).alias("label"))


def _votes(labels: DataFrame, rules: DataFrame, weights: DataFrame | None, default: str) -> DataFrame:
    """id, class, p for each class a rule names: the sum of the weights of the row's rules. The default class has what is
    missing to 1, and what rules give it is added."""
    require_columns(labels, "res_key", "cluster", "id")
    own = labels.select("id", F.col("res_key").cast("string").alias("res_key"), F.col("cluster").cast("string").alias("cluster"))
    table = rules.select(F.col("res_key").cast("string").alias("res_key"), F.col("cluster").cast("string").alias("cluster"), normalise_missing(F.col("label")).alias("label"))
    table = table.withColumn("label", F.coalesce("label", F.lit(default)))
    hits = own.join(table, ["res_key", "cluster"])
    if weights is None:
        hits = hits.withColumn("w", F.lit(1.0))
    else:
        w = weights.select("id", F.col("res_key").cast("string").alias("res_key"), F.col("confidence").alias("w"))
        # a missing confidence (a single repetition) counts as 1
        hits = hits.join(w, ["id", "res_key"], "left").withColumn("w", F.coalesce("w", F.lit(1.0)))
    votes = hits.groupBy("id", F.col("label").alias("class")).agg(F.sum("w").alias("p"))
    given = votes.groupBy("id").agg(F.sum("p").alias("s"))
    rest = own.select("id").distinct().join(given, "id", "left").select("id", F.lit(default).alias("class"), F.greatest(1 - F.coalesce("s", F.lit(0.0)), F.lit(0.0)).alias("p"))
    return votes.unionByName(rest).groupBy("id", "class").agg(F.sum("p").alias("p"))


def annotate_hierarchical(labels: DataFrame, rules: DataFrame, weights: DataFrame | None = None, default: str = UNASSIGNED, normalise: bool = True) -> DataFrame:
    """annot(id, class, p): soft annotation by rules over several labelings (labels: res_key, id, cluster). Rows without
    an entry for a class are 0."""
    votes = _votes(labels, rules, weights, default)
    return row_normalise(votes, "id", "p") if normalise else votes


def predict_vote(labels: DataFrame, rules: DataFrame, weights: DataFrame | None = None, default: str = UNASSIGNED) -> DataFrame:
    """id, label: the class of greatest weight; a tie at the top, or no vote at all, gives the default."""
    votes = _votes(labels, rules, weights, default)
    best = votes.groupBy("id").agg(F.max("p").alias("top"))
    tops = votes.join(best, "id").where("p = top and top > 0").groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("class").alias("class"))
    label = F.when(F.col("n") == 1, F.col("class")).otherwise(F.lit(default))
    return best.select("id").join(tops, "id", "left").select("id", F.coalesce(label, F.lit(default)).alias("label"))


def dominant(annot: DataFrame) -> DataFrame:
    """id, label, p: the class of greatest weight, ties to the class that sorts first."""
    r = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("p"), "class"))
    return annot.withColumn("__r", r).where("__r = 1").select("id", F.col("class").alias("label"), "p")


def random_walk(edges: DataFrame, normalise: bool = True) -> DataFrame:
    return row_normalise(drop_loops(edges)) if normalise else edges


def spread(walk: DataFrame, annot: DataFrame) -> DataFrame:
    """One step T P: a node's new weights are its neighbours' weighted by its row."""
    out = walk.join(annot.select(F.col("id").alias("dst"), "class", "p"), "dst")
    return out.groupBy(F.col("src").alias("id"), "class").agg(F.sum(F.col("weight") * F.col("p")).alias("p"))


def _damped(walk: DataFrame, annot: DataFrame, start: DataFrame, alpha: float) -> DataFrame:
    both = spread(walk, annot).withColumn("p", F.col("p") * alpha).unionByName(start.withColumn("p", F.col("p") * (1 - alpha)))
    return both.groupBy("id", "class").agg(F.sum("p").alias("p"))


def propagate(edges: DataFrame, annot: DataFrame, k: int = 1, normalise: bool = True, alpha: float = 0.9) -> DataFrame:
    """annot after k steps. One step is undamped; more are P <- alpha T P + (1 - alpha) P0 each."""
    if k < 1 or not 0 <= alpha <= 1:
        raise ValueError("k is at least 1, alpha in [0, 1]")
    walk = random_walk(edges, normalise)
    start = annot.select("id", "class", "p")
    if k == 1:
        return spread(walk, start)
    walk, now = cut(walk, "walk"), start
    for i in range(k):
        now = _damped(walk, now, start, alpha)
        if i % 4 == 3 and i + 1 < k:
            now = cut(now, "propagate")
    return now


def propagate_until(edges: DataFrame, annot: DataFrame, max_iter: int = 100, tolerance: float = 1e-6, alpha: float = 0.9) -> tuple[DataFrame, int, bool]:
    """One undamped step, then damped ones until the largest change is below the tolerance: (annot, steps, converged).
    One number a step reaches the driver."""
    walk, start = cut(random_walk(edges), "walk"), cut(annot.select("id", "class", "p"), "start")
    now = cut(spread(walk, start), "propagate")
    for i in range(1, max_iter):
        new = cut(_damped(walk, now, start, alpha), "propagate")
        gap = new.unionByName(now.withColumn("p", -F.col("p"))).groupBy("id", "class").agg(F.sum("p").alias("gap"))
        change = gap.agg(F.max(F.abs("gap"))).first()[0] or 0.0
        now = new
        if change < tolerance:
            return now, i + 1, True
    return now, max_iter, False


def key_of(name: Column) -> Column:
    """The resolution key in a column name such as leiden_0.3: its numeric suffix, or the whole name."""
    suffix = F.element_at(F.split(name, "_"), -1)
    return F.when(suffix.try_cast("double").isNotNull(), suffix).otherwise(name)
