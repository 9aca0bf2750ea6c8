"""Clusterings over many resolutions: sweeps, profiles, summaries and access to their tables."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.annotate import annotate_hierarchical, predict_vote
from tessera.operators.community import clustering_metrics, communities, louvain_scale
from tessera.operators.contingency import consistency
from tessera.operators.tracks import cluster_tracks, confidence, final_labels, track_consistency
from tessera.schema import require_choice


def midpoints(transitions: DataFrame, low: float, high: float) -> DataFrame:
    """resolution: the range's ends, the middles between consecutive transitions(resolution), and the middle between the
    last one and the upper end, without repeats."""
    inner = transitions.where((F.col("resolution") > low) & (F.col("resolution") < high)).select("resolution").distinct()
    after = F.coalesce(F.lead("resolution").over(Window.orderBy("resolution")), F.lit(float(high)))
    mids = inner.select(((F.col("resolution") + after) / 2).alias("resolution"))
    ends = transitions.sparkSession.createDataFrame([(float(low),), (float(high),)], "resolution double")
    return mids.unionByName(ends).distinct().orderBy("resolution")


def resolution_profile(edges: DataFrame, low: float = 0.0, high: float = 1.0, partition_type: str = "rb", seed: int = 0, width: float = 0.02, most: int = 64) -> list[float]:
    """Resolutions between which the number of clusters changes, by bisection: each round clusters all open midpoints in
    one job, until intervals are narrower than width or `most` resolutions have been tried."""
    require_choice(partition_type, "rb", "cpm", "modularity")

    def sizes(rs: list[float]) -> dict[float, int]:
        got = communities(edges, rs, 1, "leiden", partition_type, seed).where("error is null").groupBy("res_id").agg(F.count_distinct("cluster").alias("n")).collect()
        return {rs[r["res_id"]]: r["n"] for r in got}

    known = sizes([low, high])
    open_ = [(low, high)]
    while open_ and len(known) < most:
        open_ = [(a, b) for a, b in open_ if b - a > width and known.get(a) != known.get(b)]
        mids = [(a + b) / 2 for a, b in open_][: most - len(known)]
        if not mids:
            break
        known |= sizes(mids)
        open_ = [x for a, b in open_ for x in ((a, (a + b) / 2), ((a + b) / 2, b)) if (a + b) / 2 in known]
    rs = sorted(known)
    return [(a + b) / 2 for a, b in zip(rs[:-1], rs[1:], strict=True) if known[a] != known[b]]


def skip_repeated_counts(counts: DataFrame) -> DataFrame:
    """counts(resolution, n_clusters) where n_clusters is more than at every lower resolution."""
    before = F.max("n_clusters").over(Window.orderBy("resolution").rowsBetween(Window.unboundedPreceding, -1))
    return counts.withColumn("__b", before).where("__b is null or n_clusters > __b").drop("__b")


class MultiresolutionClustering:
    """Repeated clusterings over resolutions. fit() fills tables keyed by res_id; the resolutions are sorted, and both the
    number and the value are kept. With values given the range is ignored; without values, a range is profiled."""

    def __init__(self, method: str = "leiden", resolution_values: list[float] | None = None, resolution_range: tuple[float, float] | None = (0.0, 1.0), seed: int = 0, partition_type: str = "rb", n_repetitions: int = 10, consistency_metric: str = "ari", weighted: bool = True):
        self.method = require_choice(method, "leiden", "louvain")
        if resolution_values is None and (resolution_range is None or self.method == "louvain"):
            raise ValueError("resolution values or, for leiden, a range are needed")
        self.values, self.range = resolution_values, resolution_range
        self.seed, self.partition_type, self.n_repetitions, self.metric, self.weighted = seed, partition_type, n_repetitions, consistency_metric, weighted

    def fit(self, edges: DataFrame) -> MultiresolutionClustering:
        spark = edges.sparkSession
        values = self.values
        if values is None:
            found = resolution_profile(edges, *self.range, self.partition_type, self.seed)
            table = spark.createDataFrame([(x,) for x in found], "resolution double")
            values = [r["resolution"] for r in midpoints(table, *self.range).collect()]
        self.resolution_list = sorted(set(map(float, values)))
        self.resolutions = spark.createDataFrame(list(enumerate(self.resolution_list)), "res_id int, resolution double")
        scale = louvain_scale(edges) if self.method == "louvain" else 1.0
        got = communities(edges, self.resolution_list, self.n_repetitions, self.method, self.partition_type, self.seed, self.weighted, scale)
        self.failures = got.where("error is not null").select("res_id", "rep", "error")
        for r in self.failures.collect():
            warnings.warn(f"resolution {r['res_id']}, repetition {r['rep']}: {r['error']}", stacklevel=2)
        self.runs = got.where("error is null").select("res_id", "rep", "id", "cluster")
        self.tracks = cluster_tracks(self.runs, keys=["res_id"])
        if self.method == "leiden" and self.n_repetitions > 1:
            self.labels = final_labels(self.runs, self.tracks, ["res_id"])
        else:
            self.labels = self.runs.where("rep = 0").select("res_id", "id", "cluster")
        self.confidence = confidence(self.runs, ["res_id"])
        self.cluster_metrics = track_consistency(self.runs, self.tracks, ["res_id"])
        self.consistency = consistency(self.runs, self.metric, by=["res_id"])
        self.metrics = clustering_metrics(edges, self.labels, ["res_id"]).join(self.resolutions, "res_id")
        return self

    def get_labels(self, resolution: float) -> DataFrame:
        return self.labels.join(self.resolutions.where(F.col("resolution") == float(resolution)), "res_id").select("id", "cluster")

    def observed_clusters(self) -> DataFrame:
        return self.labels.join(self.resolutions, "res_id").select("res_id", "resolution", "cluster").distinct()

    def observed_confidence(self) -> DataFrame:
        return self.confidence.join(self.resolutions, "res_id")

    def cluster_metric(self, metric: str = "stability", res_id: int | None = None) -> DataFrame:
        out = self.cluster_metrics if res_id is None else self.cluster_metrics.where(F.col("res_id") == res_id)
        return out.select("res_id", "track_id", metric)

    def best_resolution(self, metric: str = "modularity") -> float:
        """The resolution of the greatest n_clusters, modularity or consistency; the lowest of equals."""
        metric = require_choice(metric, "n_clusters", "modularity", "consistency")
        rows = self.metrics.join(self.consistency.select("res_id", F.col("mean").alias("consistency")), "res_id", "left")
        return best_resolution(rows, metric)

    def _keyed(self) -> tuple[DataFrame, DataFrame]:
        own = lambda df: df.withColumn("res_key", F.col("res_id").cast("string")).drop("res_id")
        return own(self.labels), own(self.confidence)

    def predict_proba(self, rules: DataFrame, normalise: bool = True) -> DataFrame:
        """annot(id, class, p) by rules(res_key, cluster, label), res_key being a res_id: votes weigh as much as the point's
        confidence in that resolution, and the unassigned class has what is missing to 1."""
        labels, weights = self._keyed()
        return annotate_hierarchical(labels, rules, weights, normalise=normalise)

    def predict(self, rules: DataFrame) -> DataFrame:
        """id, label: the class of greatest weight under the same votes."""
        labels, weights = self._keyed()
        return predict_vote(labels, rules, weights)

    def consistency_summary(self) -> DataFrame:
        return consistency_summary(self.runs, self.metric, ["res_id"])

    def summary(self) -> DataFrame:
        return range_summary(self.metrics, self.consistency, self.failures)


def consistency_summary(runs: DataFrame, metric: str = "ari", by: list[str] | None = None) -> DataFrame:
    """by, n_repetitions, consistency_metric, mean, std, scores of all pairs of repetitions, and clusters: an array with one
    struct a track, in order of its number. One row for each labeling that was repeated."""
    by = by or []
    per = track_consistency(runs, cluster_tracks(runs, keys=by or None), by or None)
    fields = [c for c in per.columns if c not in by]
    clusters = F.sort_array(F.collect_list(F.struct("track_id", *[c for c in fields if c != "track_id"]))).alias("clusters")
    parts = [runs.groupBy(*by).agg(F.count_distinct("rep").alias("n_repetitions")), consistency(runs, metric, by=by or None), per.groupBy(*by).agg(clusters)]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, by) if by else out.join(p)  # a row each
    return out.select(*by, "n_repetitions", F.lit(metric).alias("consistency_metric"), "mean", "std", "scores", "clusters")


def best_resolution(metrics: DataFrame, metric: str) -> float:
    return metrics.where(F.col(metric).isNotNull()).agg(F.max_by("resolution", F.struct(F.col(metric), -F.col("resolution")))).first()[0]


def range_summary(metrics: DataFrame, consistencies: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    """One row: resolutions that worked and failed, range and list of cluster counts, range and mean of consistency, best
    resolution by each metric."""
    rows = metrics.join(consistencies.select("res_id", F.col("mean").alias("consistency")), "res_id", "left")
    listed = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("res_id", F.col(c).alias("v")))), lambda x: x["v"])
    best = [F.max_by("resolution", F.struct(F.col(c), -F.col("resolution"))).alias(f"best_{c}") for c in ("n_clusters", "modularity", "consistency")]
    out = rows.agg(
        F.count(F.lit(1)).alias("n_successful"), F.min("n_clusters").alias("min_clusters"), F.max("n_clusters").alias("max_clusters"), listed("n_clusters").alias("n_clusters"),
        F.min("consistency").alias("min_consistency"), F.max("consistency").alias("max_consistency"), F.avg("consistency").alias("mean_consistency"), *best,
    )
    n = failures.select("res_id").distinct().count() if failures is not None else 0
    return out.withColumn("n_failed", F.lit(n))
