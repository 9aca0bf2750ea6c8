"""Tool plans: clustering and annotation of a dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.durable import cut
from tessera.functions.labels import one_hot, wide
from tessera.operators import annotate as A
from tessera.operators.community import communities, louvain_scale
from tessera.operators.multires import MultiresolutionClustering
from tessera.operators.tracks import cluster_tracks, confidence, final_labels
from tessera.sources.dataset import Dataset


def _cluster(data: Dataset, method: str, resolution: float, key: str, neighbors_key, adjacency, weighted, seed, partition_type, n_repetitions) -> Dataset:
    edges = data.adjacency(neighbors_key, adjacency)
    got = communities(edges, [resolution], n_repetitions, method, partition_type, seed, weighted)
    runs = got.where("error is null").select("rep", "id", "cluster")
    labels = final_labels(runs, cluster_tracks(runs)) if n_repetitions > 1 and method == "leiden" else runs.where("rep = 0").select("id", "cluster")
    data.add_obs(key, labels)
    data.uns[key] = {"params": {"resolution": resolution, "seed": seed, "partition_type": partition_type, "n_repetitions": n_repetitions, "use_weights": weighted}}
    if n_repetitions > 1:
        data.add_obs(f"{key}_confidence", confidence(runs), "confidence", False)
    return data


def leiden(data: Dataset, resolution: float = 0.5, neighbors_key: str | None = None, adjacency: DataFrame | None = None, use_weights: bool = True, seed: int = 0, partition_type: str = "rb", n_repetitions: int = 1, key_added: str = "leiden") -> Dataset:
    return _cluster(data, "leiden", resolution, key_added, neighbors_key, adjacency, use_weights, seed, partition_type, n_repetitions)


def louvain(data: Dataset, resolution: float = 0.5, neighbors_key: str | None = None, adjacency: DataFrame | None = None, use_weights: bool = True, seed: int = 0, n_repetitions: int = 1, key_added: str = "louvain") -> Dataset:
    return _cluster(data, "louvain", resolution, key_added, neighbors_key, adjacency, use_weights, seed, "rb", n_repetitions)


def _multi(data: Dataset, model: MultiresolutionClustering, edges: DataFrame, key: str) -> Dataset:
    model.fit(edges)
    labels = cut(model.labels, "labels")
    for i, r in enumerate(model.resolution_list):
        data.add_obs(f"{key}_{r:g}", labels.where(F.col("res_id") == i))
    data.uns[key] = {"resolutions": model.resolution_list, "model": model}
    return data


def multiresolution_leiden(data: Dataset, resolutions: tuple | list = (0, 1), neighbors_key: str | None = None, adjacency: DataFrame | None = None, seed: int = 0, partition_type: str = "rb", n_repetitions: int = 10, consistency_metric: str = "ari", key_added: str = "leiden") -> Dataset:
    """A pair (as a tuple) is a range to be profiled; a list holds values. One obs column a resolution, named by it."""
    is_range = isinstance(resolutions, tuple) and len(resolutions) == 2
    model = MultiresolutionClustering("leiden", None if is_range else list(resolutions), resolutions if is_range else None, seed, partition_type, n_repetitions, consistency_metric)
    return _multi(data, model, data.adjacency(neighbors_key, adjacency), key_added)


def multiresolution_louvain(data: Dataset, resolutions: tuple | list = (0.1, 0.3, 0.5, 0.7, 1.0), neighbors_key: str | None = None, adjacency: DataFrame | None = None, seed: int = 0, n_repetitions: int = 10, consistency_metric: str = "ari", key_added: str = "louvain") -> Dataset:
    model = MultiresolutionClustering("louvain", list(resolutions), None, seed, "rb", n_repetitions, consistency_metric)
    return _multi(data, model, data.adjacency(neighbors_key, adjacency), key_added)


def _rules(data: Dataset, mapping: dict) -> DataFrame:
    rows = [(str(k[0]), str(k[1]), str(v)) if isinstance(k, tuple) else ("", str(k), str(v)) for k, v in mapping.items()]
    return data.obs.sparkSession.createDataFrame(rows, "res_key string, cluster string, label string")


def annotate(data: Dataset, mapping: dict, clustering_key: str, key_added: str = "annotation") -> Dataset:
    labels = data.obs.select("id", F.col(clustering_key).alias("cluster"))
    return data.add_obs(key_added, A.apply_rules(labels, _rules(data, mapping)), "label")


def _store_annotation(data: Dataset, annot: DataFrame, classes: list[str], key: str) -> Dataset:
    annot = cut(annot, "annotation")
    data.add_obs(key, A.dominant(annot), "label")
    names = [F.col(f"`{c}`").alias(f"{key}_{c}_prob") for c in classes]
    data.obs = data.obs.drop(*[f"{key}_{c}_prob" for c in classes]).join(wide(annot, classes).select("id", *names), "id", "left")
    return data


def propagate_annotation(data: Dataset, annotation_key: str, neighbors_key: str | None = None, k: int = 1, alpha: float = 0.9, key_added: str | None = None) -> Dataset:
    """Spreads a label column along the graph: the random-walk matrix if there is one, else the connectivities."""
    annot = cut(one_hot(data.obs, "id", annotation_key), "one-hot")
    prefix = "" if neighbors_key is None else f"{neighbors_key}_"
    walk = data.obsp.get(f"{prefix}transitions")
    edges = walk if walk is not None else data.adjacency(neighbors_key)
    out = A.propagate(edges, annot, k, normalise=walk is None, alpha=alpha)
    classes = [r["class"] for r in annot.select("class").distinct().orderBy("class").collect()]
    return _store_annotation(data, out, classes, key_added or f"{annotation_key}_propagated")


def annotate_hierarchical(data: Dataset, mapping: dict, clustering_key: str, confidence_key: str | None = None, key_added: str = "hierarchical_annotation", normalise: bool = True) -> Dataset:
    """Soft annotation from the obs columns clustering_key_<resolution>; rules name a resolution (or full column) and a
    cluster."""
    columns = [c for c in data.obs.columns if c.startswith(f"{clustering_key}_") and not c.endswith(("_confidence", "_prob"))]
    if not columns:
        raise ValueError(f"no columns {clustering_key}_*")
    name = lambda c: c.removeprefix(f"{clustering_key}_")
    labels = None
    for c in columns:
        part = data.obs.select("id", F.lit(name(c)).alias("res_key"), F.col(f"`{c}`").alias("cluster"))
        labels = part if labels is None else labels.unionByName(part)
    fixed = {(_res_key(k[0], clustering_key), k[1]): v for k, v in mapping.items()}
    weights = None
    if confidence_key is not None:
        for c in columns:
            own = f"{confidence_key}_{name(c)}"
            if own in data.obs.columns:
                part = data.obs.select("id", F.lit(name(c)).alias("res_key"), F.col(f"`{own}`").cast("double").alias("confidence"))
                weights = part if weights is None else weights.unionByName(part)
    out = A.annotate_hierarchical(labels, _rules(data, fixed), weights, normalise=normalise)
    classes = sorted({str(v) for v in mapping.values()}) + [A.UNASSIGNED]
    return _store_annotation(data, out, list(dict.fromkeys(classes)), key_added)


def _res_key(key, prefix: str) -> str:
    text = str(key).removeprefix(f"{prefix}_")
    try:
        return f"{float(text):g}"
    except ValueError:
        return text


__all__ = [n for n in dir() if not n.startswith("_")] + ["louvain_scale"]
