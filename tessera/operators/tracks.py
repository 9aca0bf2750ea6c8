"""Clusters followed across repeated clusterings, and how sure each row's cluster is."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.contingency import mapping_of


def _overlaps(labels: DataFrame, keys: list[str]) -> DataFrame:
    """keys, rep_a, a, rep_b, b, n for all pairs of repetitions rep_a <= rep_b."""
    x = labels.select(*keys, "id", F.col("rep").alias("rep_a"), F.col("cluster").alias("a"))
    y = labels.select(*keys, "id", F.col("rep").alias("rep_b"), F.col("cluster").alias("b"))
    return x.join(y, [*keys, "id"]).where("rep_a <= rep_b").groupBy(*keys, "rep_a", "a", "rep_b", "b").agg(F.count(F.lit(1)).alias("n"))


def cluster_tracks(labels: DataFrame, threshold: float = 0.1, keys: list[str] | None = None) -> DataFrame:
    """keys, track_id, rep, cluster. Repetitions in order, clusters in rising order: each joins the track with the highest
    Jaccard similarity to the union of the track's members so far, above the threshold, else it opens a track.

    A union's size is needed, so rows that have the same cluster in every repetition are counted as one pattern: what a
    task sees is the number of distinct patterns, not of rows."""
    keys = keys or []
    rows = labels if keys else labels.withColumn("__k", F.lit(0))
    by = keys or ["__k"]
    fields = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    pattern = F.transform(F.sort_array(F.collect_list(F.struct("rep", "cluster"))), lambda x: F.concat_ws(":", x["rep"].cast("string"), x["cluster"].cast("string")))
    patterns = rows.groupBy(*by, "id").agg(pattern.alias("p")).groupBy(*by, "p").agg(F.count(F.lit(1)).alias("n"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        size = pdf["n"].tolist()
        holders: dict[tuple[int, int], set[int]] = {}
        for i, p in enumerate(pdf["p"]):
            for x in p:
                rep, c = x.split(":")
                holders.setdefault((int(rep), int(c)), set()).add(i)
        weigh = lambda s: sum(size[i] for i in s)
        tracks: list[set[int]] = []
        out = []
        for rep, c in sorted(holders):
            own, best, top = holders[rep, c], -1, threshold
            for t, union in enumerate(tracks):
                common = weigh(own & union)
                j = common / (weigh(own) + weigh(union) - common)
                if j > top:
                    best, top = t, j
            if best < 0:
                best = len(tracks)
                tracks.append(set())
            tracks[best] |= own
            out.append((*pdf[by].iloc[0], best, rep, c))
        return pd.DataFrame(out, columns=[*by, "track_id", "rep", "cluster"])

    out = patterns.groupBy(*by).applyInPandas(run, ", ".join(f"{k} {fields[k]}" for k in by) + ", track_id int, rep int, cluster int")
    return out if keys else out.drop("__k")


def track_consistency(labels: DataFrame, tracks: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per track: mean and deviation of the Jaccard similarities of its appearances in different places, stability
    (appearances / repetitions, which may pass 1), coverage (repetitions that have it / repetitions), sizes."""
    keys = keys or []
    pairs = _overlaps(labels, keys)
    sizes = labels.groupBy(*keys, "rep", "cluster").agg(F.count(F.lit(1)).alias("size"))
    reps = labels.groupBy(*keys).agg(F.count_distinct("rep").alias("reps")) if keys else labels.agg(F.count_distinct("rep").alias("reps"))
    own = tracks.join(sizes, [*keys, "rep", "cluster"])
    a = own.select(*keys, "track_id", F.col("rep").alias("rep_a"), F.col("cluster").alias("a"), F.col("size").alias("sa"))
    b = own.select(*keys, "track_id", F.col("rep").alias("rep_b"), F.col("cluster").alias("b"), F.col("size").alias("sb"))
    both = a.join(b, [*keys, "track_id"]).where("rep_a < rep_b or (rep_a = rep_b and a < b)").join(pairs, [*keys, "rep_a", "a", "rep_b", "b"], "left")
    n = F.coalesce("n", F.lit(0))
    both = both.withColumn("j", n / (F.col("sa") + F.col("sb") - n))
    scores = both.groupBy(*keys, "track_id").agg(F.avg("j").alias("mean_consistency"), F.stddev_pop("j").alias("std_consistency"))
    out = own.groupBy(*keys, "track_id").agg(F.count(F.lit(1)).alias("occurrences"), F.count_distinct("rep").alias("in_reps"), F.avg("size").alias("mean_size"), F.stddev_pop("size").alias("std_size"))
    out = out.join(scores, [*keys, "track_id"], "left")
    out = out.join(reps, keys) if keys else out.join(reps)
    alone = F.col("occurrences") == 1
    return out.select(
        *keys, "track_id", F.when(alone, 1.0).otherwise(F.col("mean_consistency")).alias("mean_consistency"), F.when(alone, 0.0).otherwise(F.col("std_consistency")).alias("std_consistency"),
        (F.col("occurrences") / F.col("reps")).alias("stability"), (F.col("in_reps") / F.col("reps")).alias("coverage"), "mean_size", "std_size", F.col("occurrences").cast("int").alias("occurrences"),
    )


def top_tracks(consistency: DataFrame, n: int = 10) -> dict[str, DataFrame]:
    """The n best tracks by consistency, by stability and by mean size; ties to the smaller track."""
    return {c: consistency.orderBy(F.desc(c), "track_id").limit(n) for c in ("mean_consistency", "stability", "mean_size")}


def final_labels(labels: DataFrame, tracks: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, id, cluster: the rows of repetition 0 named by the track of their cluster."""
    keys = keys or []
    first = tracks.where("rep = 0").groupBy(*keys, "cluster").agg(F.min("track_id").alias("track_id"))
    return labels.where("rep = 0").join(first, [*keys, "cluster"]).select(*keys, "id", F.col("track_id").alias("cluster"))


def aligned(labels: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """labels with every repetition renamed to agree best with repetition 0."""
    keys = keys or []
    rows = labels if keys else labels.withColumn("__k", F.lit(0))
    by = keys or ["__k"]
    ref = rows.where("rep = 0").select(*by, "id", F.col("cluster").alias("a_cluster"))
    cells = ref.join(rows.select(*by, "id", "rep", F.col("cluster").alias("b_cluster")), [*by, "id"]).groupBy(*by, "rep", "a_cluster", "b_cluster").agg(F.count(F.lit(1)).alias("n"))
    fields = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        head = pdf[[*by, "rep"]].iloc[0].tolist()
        return pd.DataFrame([(*head, a, b) for a, b in mapping_of(pdf)], columns=[*by, "rep", "cluster", "to"])

    schema = ", ".join(f"{k} {fields[k]}" for k in by) + ", rep int, cluster int, to int"
    names = cells.groupBy(*by, "rep").applyInPandas(run, schema)
    return rows.join(names, [*by, "rep", "cluster"]).select(*keys, "rep", "id", F.col("to").alias("cluster"))


def confidence(labels: DataFrame, keys: list[str] | None = None, align: bool = True) -> DataFrame:
    """keys, id, confidence: the share of repetitions that give the row its most frequent label; null with fewer than two
    repetitions."""
    keys = keys or []
    own = aligned(labels, keys) if align else labels
    reps = labels.groupBy(*keys).agg(F.count_distinct("rep").alias("reps")) if keys else labels.agg(F.count_distinct("rep").alias("reps"))
    out = own.groupBy(*keys, "id", "cluster").agg(F.count(F.lit(1)).alias("n")).groupBy(*keys, "id").agg(F.max("n").alias("n"))
    out = out.join(reps, keys) if keys else out.join(reps)
    return out.select(*keys, "id", F.when(F.col("reps") > 1, F.col("n") / F.col("reps")).alias("confidence"))
