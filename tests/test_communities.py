"""Community detection and what is built on it, on graphs with planted groups."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import community as CM
from tessera.operators import contingency as CT
from tessera.operators import multires as MR
from tessera.operators.knn import knn_graph
from tessera.operators.edges import symmetrise
from tessera.plans import pp, tl
from tessera.sources.dataset import Dataset


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(0)
    centres = np.array([[0, 0], [8, 0], [0, 8], [8, 8]])
    x = centres.repeat(25, 0) + rng.normal(0, 0.6, (100, 2))
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, features array<double>")
    truth = spark.createDataFrame([(i, i // 25) for i in range(100)], "id bigint, cluster int")
    edges = symmetrise(knn_graph(points, 8))
    return points, truth, edges


@pytest.mark.parametrize(("kind", "resolution"), [("rb", 0.5), ("modularity", 1.0), ("cpm", 0.05), ("rber", 0.3), ("surprise", 1.0)])
def test_leiden_finds_blobs(blobs, kind, resolution):
    _, truth, edges = blobs
    got = CM.communities(edges, [resolution], 1, "leiden", kind).select("id", "cluster")
    ari = CT.agreement(CT.contingency(truth, got)).first()["ari"]
    if kind in ("rb", "cpm", "rber"):
        assert ari > 0.95
    else:  # finer groups may score higher than the planted ones, never lower
        assert ari > 0.4
    if kind == "modularity":
        assert CM.modularity(edges, got).first()[0] >= CM.modularity(edges, truth).first()[0] - 1e-9


def test_louvain_and_distributed(blobs):
    _, truth, edges = blobs
    got = CM.communities(edges, [0.5], 1, "louvain").select("id", "cluster")
    assert CT.agreement(CT.contingency(truth, got)).first()["ari"] > 0.95
    far = CM.louvain_distributed(edges, 0.5, 6, 4).select("id", F.col("cluster").cast("int").alias("cluster"))
    assert CT.agreement(CT.contingency(truth, far)).first()["ari"] > 0.8
    assert CM.modularity(edges, truth).first()[0] > 0.7


def test_communities_are_connected_and_repeatable(blobs):
    _, _, edges = blobs
    a = CM.communities(edges, [1.0], 2).select("rep", "id", "cluster")
    assert a.exceptAll(CM.communities(edges, [1.0], 2).select("rep", "id", "cluster")).isEmpty()
    pdf, e = a.where("rep = 0").toPandas().set_index("id")["cluster"], edges.toPandas()
    inside = e[pdf.loc[e["src"]].to_numpy() == pdf.loc[e["dst"]].to_numpy()]
    root = {i: i for i in pdf.index}
    for _ in range(100):
        for s, d in zip(inside["src"], inside["dst"], strict=True):
            root[s] = root[d] = min(root[s], root[d])
    assert len({root[i] for i in pdf.index}) == pdf.nunique()


def test_multiresolution(blobs):
    _, truth, edges = blobs
    m = MR.MultiresolutionClustering("leiden", [1.0, 0.3], None, n_repetitions=3).fit(edges)
    assert m.resolution_list == [0.3, 1.0] and m.failures.isEmpty()
    assert CT.agreement(CT.contingency(truth, m.get_labels(0.3))).first()["ari"] > 0.95
    assert m.summary().first()["n_successful"] == 2
    assert m.best_resolution("consistency") == 0.3
    with pytest.raises(ValueError):
        MR.MultiresolutionClustering("louvain", None, None)


def test_dataset_round_trip_and_plans(spark, blobs, tmp_path):
    points, truth, _ = blobs
    data = Dataset(points, truth.withColumnRenamed("cluster", "label"))
    pp.neighbors(data, 8)
    tl.leiden(data, 0.5)
    got = data.obs.select("id", F.col("leiden").cast("int").alias("cluster"))
    assert CT.agreement(CT.contingency(truth, got)).first()["ari"] > 0.9
    tl.annotate(data, {0: "x"}, "label")
    assert data.obs.where("annotation = 'x'").count() == 25
    data.write(str(tmp_path / "d"))
    back = Dataset.read(spark, str(tmp_path / "d"))
    assert back.obs.count() == 100 and back.adjacency().count() == data.adjacency().count()
    with pytest.raises(ValueError):
        back.adjacency("other")
    with pytest.raises(ValueError):
        back.rep("nothing")
