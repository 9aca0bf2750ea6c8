"""Comparing labelings by their contingency table.

The table of two labelings is one join and one aggregation; every metric after it works on its cells and margins, which
are as many as there are pairs of clusters, not rows. Only expected mutual information and the assignment problem leave
SQL, as numpy on the aggregated table.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.schema import require_choice

METRICS = ("ari", "ami", "nmi", "homogeneity", "completeness", "v_measure")
SIMILARITIES = ("jaccard", "overlap", "precision", "recall", "f1")


def contingency(a: DataFrame, b: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """a_cluster, b_cluster, n for labels(id, cluster) a and b; keys are further columns that both are matched on."""
    keys = keys or []
    left = a.select("id", *keys, F.col("cluster").alias("a_cluster"))
    right = b.select("id", *keys, F.col("cluster").alias("b_cluster"))
    return left.join(right, ["id", *keys]).groupBy(*keys, "a_cluster", "b_cluster").agg(F.count(F.lit(1)).alias("n"))


def contingency_of(rows: DataFrame, a: str, b: str) -> DataFrame:
    """The table of two columns of one table: no join at all."""
    return rows.groupBy(F.col(a).alias("a_cluster"), F.col(b).alias("b_cluster")).agg(F.count(F.lit(1)).alias("n"))


def _pairs(n: Column) -> Column:
    return n * (n - 1) / 2


def agreement(table: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, n, ari, mi, h_a, h_b, nmi, homogeneity, completeness, v_measure of contingency tables; a is the reference."""
    keys = keys or []
    t = table.withColumn("n", F.col("n").cast("double"))
    group = lambda *c: t.groupBy(*keys, *c).agg(F.sum("n").alias("s"))
    entropy = -F.sum(F.col("s") / F.col("total") * F.ln(F.col("s") / F.col("total")))
    total = group() if keys else t.agg(F.sum("n").alias("s"))
    total = total.withColumnRenamed("s", "total")
    match = lambda x, y: x.join(y, keys) if keys else x.join(y)  # noqa: E731  one row without keys
    by_key = lambda x: x.groupBy(*keys)
    a = by_key(match(group("a_cluster"), total)).agg(F.sum(_pairs(F.col("s"))).alias("pairs_a"), entropy.alias("h_a"))
    b = by_key(match(group("b_cluster"), total)).agg(F.sum(_pairs(F.col("s"))).alias("pairs_b"), entropy.alias("h_b"))
    cells = match(t, total).join(group("a_cluster").withColumnRenamed("s", "sa"), [*keys, "a_cluster"]).join(group("b_cluster").withColumnRenamed("s", "sb"), [*keys, "b_cluster"])
    mi = F.sum(F.col("n") / F.col("total") * F.ln(F.col("total") * F.col("n") / (F.col("sa") * F.col("sb"))))
    cells = by_key(cells).agg(F.sum(_pairs(F.col("n"))).alias("pairs"), F.greatest(mi, F.lit(0.0)).alias("mi"), F.max("total").alias("total"))
    out = match(match(cells, a), b)
    expected = F.when(F.col("total") > 1, F.col("pairs_a") * F.col("pairs_b") / _pairs(F.col("total"))).otherwise(0.0)
    most = (F.col("pairs_a") + F.col("pairs_b")) / 2
    ari = F.when(most == expected, 1.0).otherwise((F.col("pairs") - expected) / (most - expected))
    h, c = F.col("homogeneity"), F.col("completeness")
    out = out.withColumn("ari", ari).withColumn("h_a", F.greatest("h_a", F.lit(0.0))).withColumn("h_b", F.greatest("h_b", F.lit(0.0)))
    out = out.withColumn("homogeneity", F.when(F.col("h_a") < 1e-15, 1.0).otherwise(F.col("mi") / F.col("h_a")))
    out = out.withColumn("completeness", F.when(F.col("h_b") < 1e-15, 1.0).otherwise(F.col("mi") / F.col("h_b")))
    out = out.withColumn("nmi", F.when(F.col("h_a") + F.col("h_b") < 1e-15, 1.0).otherwise(2 * F.col("mi") / (F.col("h_a") + F.col("h_b"))))
    out = out.withColumn("v_measure", F.when(h + c == 0, 0.0).otherwise(2 * h * c / (h + c)))
    return out.select(*keys, F.col("total").cast("bigint").alias("n"), "ari", "mi", "h_a", "h_b", "nmi", "homogeneity", "completeness", "v_measure")


def expected_mutual_information(a: np.ndarray, b: np.ndarray) -> float:
    """Mean mutual information of random tables with these margins (hypergeometric model)."""
    n = int(a.sum())
    if n == 0:
        return 0.0
    lf = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, n + 1)))])
    out = 0.0
    for x in a.astype(int):
        for y in b.astype(int):
            k = np.arange(max(1, x + y - n), min(x, y) + 1)
            if len(k):
                logp = lf[x] + lf[y] + lf[n - x] + lf[n - y] - lf[n] - lf[k] - lf[x - k] - lf[y - k] + -lf[n - x - y + k]
                out += float((k / n * np.log(n * k / (x * y)) * np.exp(logp)).sum())
    return out


def ami(table: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys and ami. One numpy call for each table of counts."""
    keys = keys or []
    rows = table if keys else table.withColumn("__k", F.lit(0))
    by = keys or ["__k"]
    fields = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot_table(index="a_cluster", columns="b_cluster", values="n", fill_value=0, aggfunc="sum").to_numpy(float)
        a, b, n = m.sum(1), m.sum(0), m.sum()
        cell = m > 0
        mi = max(float((m / n * np.log(np.where(cell, n * m / np.outer(a, b), 1)))[cell].sum()), 0.0)
        h = lambda s: float(-(s / n * np.log(s / n)).sum())
        mean = (h(a) + h(b)) / 2
        if len(a) == len(b) == 1 or len(a) == len(b) == n:
            value = 1.0
        else:
            e = expected_mutual_information(a, b)
            gap = mean - e
            gap = math.copysign(max(abs(gap), np.finfo(float).eps), gap)
            value = (mi - e) / gap
        return pd.DataFrame([[*pdf[by].iloc[0], value]], columns=[*by, "ami"])

    out = rows.groupBy(*by).applyInPandas(run, ", ".join(f"{k} {fields[k]}" for k in by) + ", ami double")
    return out if keys else out.drop("__k")


def pairwise(labels: DataFrame, metric: str = "ari", rep_col: str = "rep", by: list[str] | None = None) -> DataFrame:
    """by, rep_a, rep_b, score for all pairs rep_a < rep_b of repeated labelings (by: columns such as res_id)."""
    metric, by = require_choice(metric, *METRICS), by or []
    a = labels.select(*by, F.col(rep_col).alias("rep_a"), "id", F.col("cluster").alias("a_cluster"))
    b = labels.select(*by, F.col(rep_col).alias("rep_b"), "id", F.col("cluster").alias("b_cluster"))
    keys = [*by, "rep_a", "rep_b"]
    table = a.join(b, [*by, "id"]).where("rep_a < rep_b").groupBy(*keys, "a_cluster", "b_cluster").agg(F.count(F.lit(1)).alias("n"))
    scored = ami(table, keys) if metric == "ami" else agreement(table, keys)
    return scored.select(*keys, F.col(metric).alias("score"))


def consistency(labels: DataFrame, metric: str = "ari", rep_col: str = "rep", by: list[str] | None = None) -> DataFrame:
    """Mean and population deviation of the pairwise scores, and the scores themselves in order of their pairs."""
    scores = pairwise(labels, metric, rep_col, by)
    stats = [F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"), F.transform(F.sort_array(F.collect_list(F.struct("rep_a", "rep_b", "score"))), lambda x: x["score"]).alias("scores")]
    return scores.groupBy(*by).agg(*stats) if by else scores.agg(*stats)


def similarity(inter: Column, a: Column, b: Column, metric: str) -> Column:
    """Of a class of size a and a cluster of size b with this intersection; precision is the share of the cluster,
    recall the share of the class."""
    metric = require_choice(metric, *SIMILARITIES)
    ratio = lambda x, y: F.when(y == 0, 0.0).otherwise(x / y)
    if metric == "f1":
        p, r = ratio(inter, b), ratio(inter, a)
        return F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r))
    return ratio(inter, {"jaccard": a + b - inter, "overlap": F.least(a, b), "precision": b, "recall": a}[metric])


def class_scores(annot: DataFrame, labels: DataFrame, metric: str = "jaccard", res_col: str | None = "res_id") -> DataFrame:
    """res, class, cluster, score of all pairs of a class and a cluster, those without overlap included. annot is
    (id, class) with missing classes left out; sizes count all rows of a cluster."""
    keys = [res_col] if res_col else []
    known = annot.where("class is not null")
    inter = labels.join(known, "id").groupBy(*keys, "class", "cluster").agg(F.count(F.lit(1)).alias("inter"))
    classes = known.groupBy("class").agg(F.count(F.lit(1)).alias("size_a"))
    clusters = labels.groupBy(*keys, "cluster").agg(F.count(F.lit(1)).alias("size_b"))
    pairs = classes.join(clusters)  # numbers of classes and clusters
    pairs = pairs.join(inter, [*keys, "class", "cluster"], "left").withColumn("inter", F.coalesce("inter", F.lit(0)))
    return pairs.select(*keys, "class", "cluster", similarity(F.col("inter"), F.col("size_a"), F.col("size_b"), metric).alias("score"))


def project(annot: DataFrame, labels: DataFrame, metric: str = "jaccard", min_overlap: float = 0.0, res_col: str | None = "res_id") -> DataFrame:
    """The best cluster of each class (in each resolution) if its score reaches min_overlap; ties to the least cluster."""
    scores = class_scores(annot, labels, metric, res_col)
    best = Window.partitionBy("class", *([res_col] if res_col else [])).orderBy(F.desc("score"), "cluster")
    return scores.withColumn("__r", F.row_number().over(best)).where((F.col("__r") == 1) & (F.col("score") >= min_overlap)).drop("__r")


def match_clusters(annot: DataFrame, labels: DataFrame, metric: str = "jaccard", min_overlap: float = 0.0) -> DataFrame:
    return project(annot, labels, metric, min_overlap, None)


def binary_agreement(n11: Column, a: Column, b: Column, n: Column, metric: str) -> Column:
    """jaccard or ari of two sets as binary labelings of n rows."""
    if require_choice(metric, "jaccard", "ari") == "jaccard":
        return similarity(n11, a, b, "jaccard")
    cells = _pairs(n11) + _pairs(a - n11) + _pairs(b - n11) + _pairs(n - a - b + n11)
    rows, cols = _pairs(a) + _pairs(n - a), _pairs(b) + _pairs(n - b)
    expected, most = rows * cols / _pairs(n), (rows + cols) / 2
    return F.when(most == expected, 1.0).otherwise((cells - expected) / (most - expected))


def binary_information(n11: Column, a: Column, b: Column, n: Column) -> Column:
    """nmi of two sets as binary labelings."""
    part = lambda x, p, q: F.when(x > 0, x / n * F.ln(n * x / (p * q))).otherwise(0.0)
    h = lambda s: -(F.when(s > 0, s / n * F.ln(s / n)).otherwise(0.0) + F.when(n - s > 0, (n - s) / n * F.ln((n - s) / n)).otherwise(0.0))
    mi = part(n11, a, b) + part(a - n11, a, n - b) + part(b - n11, n - a, b) + part(n - a - b + n11, n - a, n - b)
    return F.when(h(a) + h(b) < 1e-15, 1.0).otherwise(F.greatest(mi, F.lit(0.0)) * 2 / (h(a) + h(b)))


def partition_match(target: DataFrame, levels: DataFrame, metric: str = "jaccard") -> DataFrame:
    """For each target cluster the best (level, cluster) by ari, ami, nmi or jaccard of the two as sets; of scores that
    agree to nine places, as those of a set and its complement, the first in order of level and cluster wins. levels is
    labels with a level column."""
    metric = require_choice(metric, "ari", "ami", "nmi", "jaccard")
    inter = target.select("id", F.col("cluster").alias("target")).join(levels.select("id", "level", "cluster"), "id")
    inter = inter.groupBy("target", "level", "cluster").agg(F.count(F.lit(1)).cast("double").alias("n11"))
    a = target.groupBy(F.col("cluster").alias("target")).agg(F.count(F.lit(1)).cast("double").alias("a"))
    b = levels.groupBy("level", "cluster").agg(F.count(F.lit(1)).cast("double").alias("b"))
    n = target.agg(F.count(F.lit(1)).cast("double").alias("n"))
    pairs = a.join(b).join(n).join(inter, ["target", "level", "cluster"], "left").withColumn("n11", F.coalesce("n11", F.lit(0.0)))
    c = [F.col(x) for x in ("n11", "a", "b", "n")]
    if metric == "ami":
        score = F.pandas_udf(_binary_ami, "double")(*c)
    else:
        score = binary_information(*c) if metric == "nmi" else binary_agreement(*c, metric)
    pairs = pairs.withColumn("score", score)
    best = Window.partitionBy("target").orderBy(F.desc(F.round("score", 9)), "level", "cluster")
    out = pairs.withColumn("__r", F.row_number().over(best)).where("__r = 1")
    return out.select("target", "level", "cluster", "score", F.col("a").cast("bigint").alias("n_cells"))


def _binary_ami(n11: pd.Series, a: pd.Series, b: pd.Series, n: pd.Series) -> pd.Series:
    out = []
    for x, p, q, t in zip(n11, a, b, n, strict=True):
        rows, cols = np.array([p, t - p]), np.array([q, t - q])
        m = np.array([[x, p - x], [q - x, t - p - q + x]])
        rows, cols = rows[rows > 0], cols[cols > 0]
        if len(rows) == len(cols) == 1:
            out.append(1.0)
            continue
        e = expected_mutual_information(rows, cols)
        full_r, full_c = m.sum(1), m.sum(0)
        mi = sum(v / t * math.log(t * v / (full_r[i] * full_c[j])) for (i, j), v in np.ndenumerate(m) if v > 0)
        h = lambda s: -float((s / t * np.log(s / t)).sum())  # noqa: B023, E731
        gap = (h(rows) + h(cols)) / 2 - e
        out.append((mi - e) / math.copysign(max(abs(gap), np.finfo(float).eps), gap))
    return pd.Series(out)


def correspondence(matches: DataFrame, threshold: float = 0.1) -> DataFrame:
    """One row: mean, least, greatest and population deviation of the scores, levels used, targets without a match."""
    weak = F.col("score") < threshold
    return matches.agg(
        F.avg("score").alias("mean_score"), F.min("score").alias("min_score"), F.max("score").alias("max_score"), F.stddev_pop("score").alias("std_score"),
        F.count_distinct("level").alias("n_levels"), F.count_if(weak).alias("n_unmatched"), F.coalesce(F.sum(F.when(weak, F.col("n_cells"))), F.lit(0)).alias("unmatched_cells"),
    )


# --- consistent assignment ------------------------------------------------------------------------------------------


#: Clusters of a labeling that are assigned on the driver, in time cubic in their number.
MAX_ASSIGNED = 2_000


def best_assignment(weight: np.ndarray) -> np.ndarray:
    """Column of each row in an assignment of greatest total weight (square matrix): shortest augmenting paths over
    potentials, one row at a time."""
    n = len(weight)
    cost = weight.max() - weight if n else weight
    u, v = np.zeros(n + 1), np.zeros(n + 1)
    row_of = np.full(n + 1, -1)
    for i in range(n):
        row_of[n] = i
        j, reach, used, via = n, np.full(n, np.inf), np.zeros(n + 1, bool), np.full(n, n)
        while row_of[j] != -1:
            used[j] = True
            r = row_of[j]
            free = np.flatnonzero(~used[:n])
            step = cost[r, free] - u[r] - v[free]
            better = step < reach[free]
            reach[free[better]] = step[better]
            via[free[better]] = j
            k = free[reach[free].argmin()]
            d = reach[k]
            u[row_of[used]] += d
            v[used] -= d
            reach[free] -= d
            j = k
        while j != n:
            row_of[j] = row_of[via[j]]
            j = via[j]
    out = np.empty(n, int)
    out[row_of[:n]] = np.arange(n)
    return out


def assign_consistently(reference: DataFrame, labels: DataFrame) -> DataFrame:
    """labels renamed to agree best with the reference: the mean of row and column shares of the contingency table is
    maximised over one-to-one maps. Clusters beyond the reference's number get fresh names behind its largest."""
    for side in (reference, labels):
        if side.select("cluster").distinct().limit(MAX_ASSIGNED + 1).count() > MAX_ASSIGNED:
            raise ValueError(f"an assignment takes at most {MAX_ASSIGNED} clusters a side")
    cells = contingency(reference, labels).toPandas()  # at most the square of that
    names = mapping_of(cells)
    spark = labels.sparkSession
    table = spark.createDataFrame(pd.DataFrame(names, columns=["cluster", "to"]), "cluster int, to int")
    return labels.join(F.broadcast(table), "cluster").withColumn("cluster", F.col("to")).select(labels.columns)


def mapping_of(cells: pd.DataFrame) -> list[tuple[int, int]]:
    m = cells.pivot_table(index="a_cluster", columns="b_cluster", values="n", fill_value=0, aggfunc="sum").sort_index().sort_index(axis=1)
    ref, new = list(m.index), list(m.columns)
    x = m.to_numpy(float)
    w = (x / np.maximum(x.sum(1, keepdims=True), 1) + x / np.maximum(x.sum(0, keepdims=True), 1)) / 2
    size = max(w.shape)
    square = np.zeros((size, size))
    square[: w.shape[0], : w.shape[1]] = w
    column = best_assignment(square)
    fresh = max(ref, default=-1)
    out = []
    for j, name in enumerate(new):
        i = int(np.flatnonzero(column == j)[0])
        if i < len(ref):
            out.append((int(name), int(ref[i])))
        else:
            fresh += 1
            out.append((int(name), int(fresh)))
    return out
