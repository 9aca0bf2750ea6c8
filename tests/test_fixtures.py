"""Small inputs with known results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import annotate as A
from tessera.operators import coassoc as CO
from tessera.operators import contingency as CT
from tessera.operators import decompose as DE
from tessera.operators import edges as E
from tessera.operators import fuzzy as FZ
from tessera.operators import hierarchy as H
from tessera.operators import knn as N
from tessera.operators import multires as MR
from tessera.operators import profile as PF
from tessera.operators import resample as RS
from tessera.operators import thin as TH
from tessera.operators import tracks as TR

EDGES = "src bigint, dst bigint, weight double"


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def as_dict(df, *keys, value="weight"):
    return {tuple(r[k] for k in keys): r[value] for r in df.collect()}


def labels(spark, values, extra=None, name="res_id"):
    if extra is None:
        return frame(spark, [(i, c) for i, c in enumerate(values)], "id bigint, cluster int")
    return frame(spark, [(r, i, c) for r, v in zip(extra, values, strict=True) for i, c in enumerate(v)], f"{name} int, id bigint, cluster int")


def test_transition(spark):
    e = [(0, 1, 0.8), (1, 0, 0.8), (0, 2, 0.4), (2, 0, 0.4), (1, 2, 0.2), (2, 1, 0.2)]
    got = as_dict(E.transition(frame(spark, e, EDGES)), "src", "dst")
    want = {(0, 1): 2 / 3, (0, 2): 1 / 3, (1, 0): 0.8, (1, 2): 0.2, (2, 0): 2 / 3, (2, 1): 1 / 3}
    assert got == pytest.approx(want)


def test_matrix_stats(spark):
    m = [[0, 1, 2], [1, 0, 3], [2, 3, 0]]
    e = frame(spark, [(i, j, float(m[i][j])) for i in range(3) for j in range(3)], EDGES)
    r = E.matrix_stats(e).first()
    assert r["is_symmetric"] and r["nnz"] == 6 and r["n"] == 3
    assert (r["density"], r["min_value"], r["max_value"], r["mean_value"], r["min_row_sum"], r["max_row_sum"]) == pytest.approx((6 / 9, 1, 3, 2, 3, 5))


@pytest.mark.parametrize(("method", "want"), [("max", 0.6), ("min", 0.2), ("mean", 0.4), ("or", 1.0)])
def test_symmetrise(spark, method, want):
    got = as_dict(E.symmetrise(frame(spark, [(0, 1, 0.6), (1, 0, 0.2)], EDGES), method), "src", "dst")
    assert got == pytest.approx({(0, 1): want, (1, 0): want})


def test_symmetrise_one_way(spark):
    e = frame(spark, [(0, 1, 0.6)], EDGES)
    assert as_dict(E.symmetrise(e, "min"), "src", "dst") == {}
    assert as_dict(E.symmetrise(e, "mean"), "src", "dst") == pytest.approx({(0, 1): 0.3, (1, 0): 0.3})


def test_propagate_one_step(spark):
    near = {0: [1, 2], 1: [0, 2, 3], 2: [0, 1, 3, 4], 3: [1, 2, 4], 4: [2, 3]}
    e = frame(spark, [(i, j, 1.0) for i, v in near.items() for j in v], EDGES)
    annot = frame(spark, [(0, "T", 1.0), (1, "B", 1.0), (2, "u", 1.0), (3, "u", 1.0), (4, "u", 1.0)], "id bigint, class string, p double")
    got = as_dict(A.propagate(e, annot), "id", "class", value="p")
    want = {(0, "B"): 1 / 2, (0, "u"): 1 / 2, (1, "T"): 1 / 3, (1, "u"): 2 / 3, (2, "T"): 1 / 4, (2, "B"): 1 / 4, (2, "u"): 1 / 2, (3, "B"): 1 / 3, (3, "u"): 2 / 3, (4, "u"): 1.0}
    assert got == pytest.approx(want)


def test_propagate_until_converges(spark):
    e = frame(spark, [(0, 1, 1.0), (1, 0, 1.0)], EDGES)
    annot = frame(spark, [(0, "a", 1.0), (1, "b", 1.0)], "id bigint, class string, p double")
    out, steps, converged = A.propagate_until(e, annot, 60, 1e-4, 0.5)
    assert converged and steps > 1
    sums = {r["id"]: r["s"] for r in out.groupBy("id").agg(F.sum("p").alias("s")).collect()}
    assert sums == pytest.approx({0: 1, 1: 1}, abs=1e-3)


CLASSES = [(0, "T"), (1, "T"), (2, "B"), (3, "B"), (4, "NK")]


def test_projection(spark):
    lab = labels(spark, [[0, 0, 1, 1, 2], [0, 1, 2, 2, 3]], [0, 1])
    got = {(r["class"], r["res_id"]): (r["cluster"], r["score"]) for r in CT.project(frame(spark, CLASSES, "id bigint, class string"), lab).collect()}
    assert got == {("T", 0): (0, 1.0), ("T", 1): (0, 0.5), ("B", 0): (1, 1.0), ("B", 1): (2, 1.0), ("NK", 0): (2, 1.0), ("NK", 1): (3, 1.0)}


def test_match(spark):
    lab, annot = labels(spark, [0, 0, 1, 1, 2]), frame(spark, CLASSES, "id bigint, class string")
    assert {r["class"]: (r["cluster"], r["score"]) for r in CT.match_clusters(annot, lab).collect()} == {"T": (0, 1.0), "B": (1, 1.0), "NK": (2, 1.0)}
    scores = {(r["class"], r["cluster"]): r["score"] for r in CT.class_scores(annot, lab, res_col=None).collect()}
    assert len(scores) == 9 and scores["T", 1] == 0


def test_annotate_hierarchical(spark):
    lab = labels(spark, [[0, 0, 1, 1, 2], [0, 1, 1, 2, 2]], [0, 1], "res_key")
    rules = frame(spark, [("0", "1", "T"), ("0", "2", "B"), ("1", "0", "NK")], "res_key string, cluster string, label string")
    got = {k: v for k, v in as_dict(A.annotate_hierarchical(lab, rules), "id", "class", value="p").items() if v}
    assert got == {(0, "NK"): 1.0, (1, "unassigned"): 1.0, (2, "T"): 1.0, (3, "T"): 1.0, (4, "B"): 1.0}
    assert {r["id"]: r["label"] for r in A.predict_vote(lab, rules).collect()} == {0: "NK", 1: "unassigned", 2: "T", 3: "T", 4: "B"}


def test_votes_for_the_default_are_added(spark):
    lab = labels(spark, [[0], [0], [0]], [0, 1, 2], "res_key")
    rules = frame(spark, [("0", "0", "A"), ("1", "0", "unassigned"), ("2", "0", "unassigned")], "res_key string, cluster string, label string")
    assert A.predict_vote(lab, rules).first()["label"] == "unassigned"


def test_assign_consistently(spark):
    ref, new = labels(spark, [0, 0, 1, 1, 2, 2]), labels(spark, [2, 2, 0, 0, 1, 1])
    out = CT.assign_consistently(ref, new).orderBy("id").collect()
    assert [r["cluster"] for r in out] == [0, 0, 1, 1, 2, 2]


def test_best_assignment_is_optimal():
    from itertools import permutations

    rng = np.random.default_rng(0)
    for n in (1, 2, 4, 6):
        w = rng.random((n, n))
        got = w[np.arange(n), CT.best_assignment(w)].sum()
        assert got == pytest.approx(max(w[np.arange(n), list(p)].sum() for p in permutations(range(n))))


def test_coassociation(spark):
    runs = [[0, 0, 1, 1, 2, 2, 2, 1], [0, 0, 1, 1, 2, 2, 2, 2], [0, 0, 0, 1, 1, 2, 2, 2], [0, 0, 1, 1, 1, 2, 2, 2], [0, 1, 1, 1, 2, 2, 2, 0]]
    c = CO.coassociation(labels(spark, runs, range(5), "run"))
    got = as_dict(c, "src", "dst")
    assert (got[0, 1], got[2, 3], got[5, 6], got[6, 7]) == pytest.approx((0.8, 0.8, 1.0, 0.6)) and (0, 4) not in got
    ids = spark.range(8)
    assert all(v == 1 for k, v in as_dict(CO.full(c, ids), "src", "dst").items() if k[0] == k[1])
    soft = CO.soft_membership(c, labels(spark, runs[0]))
    assert all(s == pytest.approx(1) for s in [r["s"] for r in soft.groupBy("id").agg(F.sum("p").alias("s")).collect()])


def test_scale_saturates_in_compat_mode(spark):
    rows = [(0, i + 1, 0.1 * (i + 1)) for i in range(14)] + [(100, 101 + i, 5 * i / 60) for i in range(60)]
    d = frame(spark, rows, EDGES)
    near = d.groupBy("src").agg(F.sort_array(F.collect_list("weight")).alias("ds"))
    got = {r["src"]: r["s"] for r in near.select("src", FZ.local_scale(F.col("ds"), F.array_min("ds"), 15, "compat").alias("s")).collect()}
    assert got[0] == pytest.approx(1000, abs=1e-3) and got[100] < 200


def test_midpoints(spark):
    got = MR.midpoints(frame(spark, [(0.2,), (0.6,)], "resolution double"), 0, 1)
    assert [r[0] for r in got.collect()] == pytest.approx([0, 0.4, 0.8, 1])


def test_distribution():
    assert list(RS.distribute_samples(100, ["a", "b", "c"]).values()) == [34, 33, 33]


def test_splits_have_exact_sizes(spark):
    s = RS.shuffle_splits(spark.range(101), 4, 0.8, 3)
    n = {r["split_id"]: (r["n"], r["t"]) for r in s.groupBy("split_id").agg(F.count("id").alias("n"), F.count_if("is_train").alias("t")).collect()}
    assert n == dict.fromkeys(range(4), (101, 80))
    assert s.exceptAll(RS.shuffle_splits(spark.range(101).repartition(7), 4, 0.8, 3)).isEmpty()


def test_agreement_is_invariant_under_names(spark):
    a = labels(spark, [0, 0, 1, 1, 2, 2, 2])
    b = a.withColumn("cluster", 7 - F.col("cluster"))
    r = CT.agreement(CT.contingency(a, b)).first()
    assert [r[c] for c in ("ari", "nmi", "homogeneity", "completeness", "v_measure")] == pytest.approx([1] * 5)
    assert CT.ami(CT.contingency(a, b)).first()["ami"] == pytest.approx(1)


def test_bad_names_are_refused(spark):
    with pytest.raises(ValueError):
        CT.pairwise(labels(spark, [[0], [0]], [0, 1], "rep"), "rand")
    with pytest.raises(ValueError):
        E.symmetrise(frame(spark, [], EDGES), "median")
    with pytest.raises(ValueError):
        H.level_labels(labels(spark, [[0]], [0], "level"), 3)


def test_tracks_and_confidence(spark):
    r = labels(spark, [[0, 0, 1, 1], [1, 1, 0, 0], [0, 0, 0, 1]], [0, 1, 2], "rep")
    t = {(x["rep"], x["cluster"]): x["track_id"] for x in TR.cluster_tracks(r).collect()}
    assert t[0, 0] == t[1, 1] == t[2, 0] and t[0, 1] == t[1, 0] == t[2, 1]
    conf = {x["id"]: x["confidence"] for x in TR.confidence(r).collect()}
    assert conf == pytest.approx({0: 1, 1: 1, 2: 2 / 3, 3: 1})
    assert TR.confidence(r.where("rep = 0")).first()["confidence"] is None


def test_linkage_matches_definition():
    x = np.array([0.0, 1.0, 3.0, 7.0, 7.5])
    d = np.abs(x[:, None] - x[None, :])
    for method, top in (("single", 4.0), ("complete", 7.5)):
        m = H.linkage_matrix(d, method)
        assert m[0, 2] == 0.5 and m[-1, 2] == top and m[-1, 3] == 5
    assert H.cut_into(H.linkage_matrix(d, "average"), 5, 2).tolist() == [1, 1, 1, 2, 2]
    assert [int(c.max()) for c in H.level_cuts(H.linkage_matrix(d, "average"), 5, "powers_of_2")] == [1, 2, 4]
    assert [int(c.max()) for c in H.level_cuts(H.linkage_matrix(d, "average"), 5, "linear")] == [1, 2, 3, 4, 5]
    assert [int(c.max()) for c in H.level_cuts(H.linkage_matrix(d, "average"), 5, "linear", 2)] == [1, 2, 3]
    tied = np.ones((5, 5)) - np.eye(5)
    assert [int(c.max()) for c in H.level_cuts(H.linkage_matrix(tied, "average"), 5, "powers_of_2")] == [1, 1]
    assert sorted(H.leaf_order(H.linkage_matrix(d, "average"), 5).tolist()) == [0, 1, 2, 3, 4]


def test_single_linkage_forest_is_a_tree(spark):
    rng = np.random.default_rng(2)
    pts = rng.random((30, 2))
    d = np.sqrt(((pts[:, None] - pts[None]) ** 2).sum(-1))
    rows = [(i, j, float(d[i, j])) for i in range(30) for j in range(i)]
    got = H.single_linkage_forest(frame(spark, rows, "src bigint, dst bigint, distance double")).toPandas()
    assert len(got) == 29
    assert got["distance"].sum() == pytest.approx(H.linkage_matrix(d, "single")[:, 2].sum())


def test_thinning(spark):
    rows = [(i, f"g{j}", (i * j) % 9 + 50 * (j == 3)) for i in range(200) for j in range(5)]
    counts = frame(spark, rows, "id bigint, feature string, count bigint")
    for f in (TH.poisson_split, TH.negative_binomial_split):
        p = f(counts, 0.7, 1).toPandas()
        assert (p["train"] + p["test"] == p["count"]).all() and p["train"].min() >= 0 and p["test"].min() >= 0
        assert p["train"].sum() / p["count"].sum() == pytest.approx(0.7, abs=0.05)
        q = f(counts.repartition(7), 0.7, 1).toPandas()
        assert p.sort_values(["id", "feature"]).reset_index(drop=True).equals(q.sort_values(["id", "feature"]).reset_index(drop=True))
    assert TH.poisson_split(counts, 1.0).agg(F.sum("test")).first()[0] == 0
    with pytest.raises(Exception, match="whole numbers"):
        TH.poisson_split(frame(spark, [(0, "a", -1)], "id bigint, feature string, count bigint")).collect()


def test_knn_blocks_agree_with_theta_join(spark):
    rng = np.random.default_rng(1)
    pts = frame(spark, [(i, x.tolist()) for i, x in enumerate(rng.integers(0, 4, (60, 3)).astype(float))], "id bigint, features array<double>")
    for metric in ("euclidean", "manhattan", "chebyshev", "hamming", "minkowski"):
        a = N.knn(pts, 5, metric, block_rows=16).select("src", "dst", "rank")
        b = N.knn_by_sql(pts, 5, metric).select("src", "dst", "rank")
        assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty(), metric


@pytest.mark.parametrize("metric", ["euclidean", "manhattan", "chebyshev", "hamming", "cosine"])
@pytest.mark.parametrize("include_self", [False, True])
def test_knn_ranks_ties_by_id(spark, metric, include_self):
    """Far more points at the k-th place than k: copies, and for all but cosine distances of small whole numbers too."""
    rng = np.random.default_rng(3)
    few = rng.normal(size=(3, 4)) if metric == "cosine" else rng.integers(0, 3, (40, 4)).astype(float)
    rows = [(int(i), few[j].tolist()) for i, j in zip(rng.permutation(160) * 7, rng.integers(0, len(few), 160), strict=True)]
    pts = frame(spark, rows, "id bigint, features array<double>")
    want = sorted(map(tuple, N.knn_by_sql(pts, 5, metric, include_self).select("src", "dst", "rank").collect()))
    for block_rows in (64, 16_384):
        got = N.knn(pts, 5, metric, include_self=include_self, block_rows=block_rows).select("src", "dst", "rank")
        assert sorted(map(tuple, got.collect())) == want


def test_empty_tables(spark):
    none = frame(spark, [], EDGES)
    assert E.transition(none).isEmpty() and E.fuzzy_union(none).isEmpty()
    assert N.knn(frame(spark, [], "id bigint, features array<double>"), 3).isEmpty()


def test_dotplot_and_blocks(spark):
    ex = frame(spark, [(0, "g", 0.0), (1, "g", 2.0), (2, "g", 4.0), (3, "g", 4.0)], "id bigint, property string, value double")
    g = frame(spark, [("c", i, str(i // 2)) for i in range(4)], "groupby string, id bigint, cluster string")
    got = {r["cluster"]: (r["mean"], r["fraction"], r["scaled"], r["marker"]) for r in PF.dotplot(ex, g).collect()}
    assert got == {"0": (1.0, 0.5, 0.0, 110.0), "1": (4.0, 1.0, 1.0, 200.0)}
    order = frame(spark, [(i, i) for i in range(5)], "id bigint, position int")
    lev = labels(spark, [[1, 1, 2, 1, 2]], [0], "level")
    assert PF.bar_blocks(order, lev).count() == 4
    picked = PF.representatives(frame(spark, [(i,) for i in range(1, 6)], "v int"), "v", 3)
    assert sorted(r["v"] for r in picked.collect()) == [1, 3, 5]
    at = H.spaced(frame(spark, [("a", 1, 0.0), ("a", 2, 0.1), ("a", 3, 5.0)], "k string, id int, x double"), 1.0, ["k"])
    assert sorted(r["position"] for r in at.collect()) == [0.0, 1.0, 5.0]
    names = PF.spread_names([("a", 0.0, 0.0), ("b", 0.0, 0.0), ("c", 0.5, 0.0), ("d", 9.0, 9.0)], 1.0)
    spots = np.array([p[1:] for p in names])
    away = np.sqrt(((spots[:, None] - spots[None]) ** 2).sum(2))
    assert (away[np.triu_indices(4, 1)] > 1 - 1e-6).all() and names[3] == pytest.approx(("d", 9.0, 9.0), abs=1e-6)


def test_linkage_and_layout_refuse_before_they_gather(spark, monkeypatch):
    from tessera.operators import decompose as DE

    monkeypatch.setattr(H, "MAX_POINTS", 2)
    monkeypatch.setattr(DE, "MAX_LAYOUT", 2)
    d = frame(spark, [(0, 1, 1.0), (1, 2, 1.0), (0, 2, 2.0)], "src bigint, dst bigint, distance double")
    with pytest.raises(ValueError, match="at most 2"):
        H.linkage(d)
    with pytest.raises(ValueError, match="at most 2"):
        DE.tsne(frame(spark, [(i, [0.0, 1.0]) for i in range(3)], "id bigint, features array<double>"))


def test_sums_over_runs_equal_sums_over_pairs(spark):
    rng = np.random.default_rng(3)
    rows = [(r, i, int(rng.integers(3))) for r in range(4) for i in range(40) if rng.random() < 0.7]
    rows += [(0, 90, 7), (1, 91, 8)]  # points that never meet another
    runs = frame(spark, rows, "run int, id bigint, cluster int")
    own = frame(spark, [(i, i % 5) for i in range(40)] + [(90, 5), (91, 6), (92, 6)], "id bigint, cluster int")  # 92 is in no run
    c = CO.coassociation(runs)

    def same(a, b, *keys):
        a, b = (sorted(map(tuple, x.select(*keys, *[n for n in x.columns if n not in keys]).collect())) for x in (a, b))
        assert [r[: len(keys)] for r in a] == [r[: len(keys)] for r in b]
        assert np.allclose([r[len(keys) :] for r in a], [r[len(keys) :] for r in b])

    same(CO.cluster_stability(None, own, runs=runs), CO.cluster_stability(c, own), "cluster")
    same(CO.similarity_stability(None, own, runs=runs), CO.similarity_stability(c, own), "cluster")
    same(CO.soft_membership(None, own, runs=runs), CO.soft_membership(c, own), "id", "cluster")
    levels = own.withColumn("level", F.lit(1))
    groups = frame(spark, [(1, 0, "a"), (1, 2, "a"), (1, 6, "b")], "level int, cluster int, group string")
    same(CO.assignment_probability(None, levels, groups, runs=runs), CO.assignment_probability(c, levels, groups), "id", "group")
    same(CO.assignment_probability(None, levels, groups, unassigned="none", runs=runs), CO.assignment_probability(c, levels, groups, unassigned="none"), "id", "group")


def test_samples_of_several_steps(spark):
    points = frame(spark, [(i, [float(i), float(-i), 1.0]) for i in range(20)], "id bigint, features array<double>")
    widths = []

    def fit(train, split):
        widths.append(len(train.first()["features"]))
        return lambda part: part.select("id", F.size("features").alias("width"))

    steps = RS.MultiResampler(("a", RS.Resampler(3), fit), ("b", RS.Resampler(2, feature_train=0.67, n_feature_splits=2), fit), n_samples=5, seed=1)
    with pytest.raises(ValueError, match="fit"):
        steps.samples()
    steps.fit(points)
    assert {r["pipeline"]: r["n_samples"] for r in steps.summary().collect()} == {"a": 3, "b": 2}
    assert set(widths) == {3, 2}
    got = steps.predict(points).groupBy("pipeline", "sample_idx").agg(F.count(F.lit(1)).alias("n"), F.max("width").alias("w")).collect()
    assert sorted((r["pipeline"], r["sample_idx"], r["n"], r["w"]) for r in got) == [("a", 0, 20, 3), ("a", 1, 20, 3), ("a", 2, 20, 3), ("b", 0, 20, 2), ("b", 1, 20, 2)]
    assert steps.transform().count() == 5 * 16 and len(steps.transform(apply=False).first()["features"]) in (2, 3)
    with pytest.raises(ValueError, match="one step"):
        RS.MultiResampler()


def test_new_points_in_a_layout(spark):
    from tessera.operators import decompose as DE

    schema = "id bigint, features array<double>"
    known = frame(spark, [(i, [float(i), 0.0]) for i in range(6)] + [(9, [100.0, 0.0])], schema)
    layout = known.select("id", F.transform("features", lambda v: v * 2).alias("position"))
    new = frame(spark, [(50, [2.0, 0.0]), (51, [100.0, 1.0])], schema)
    at = {r["id"]: r["position"] for r in DE.umap_transform(new, known, layout, 4).collect()}
    assert at[50] == pytest.approx([4.0, 0.0], abs=0.2)
    # log2(4) = 2 is the sum of the weights: 1 of the nearest, 200, and about a half each of 10 and 8
    assert at[51] == pytest.approx([(200 + 5 + 4) / 2, 0.0], abs=0.1)
    back = {r["id"]: r["features"] for r in DE.umap_inverse(frame(spark, [(50, [4.0, 0.0])], "id bigint, position array<double>"), layout, known, 4).collect()}
    assert back[50] == pytest.approx([2.0, 0.0], abs=0.2)
    assert N.knn(known, 1, queries=new).select("src", "dst").orderBy("src").collect() == [(50, 2), (51, 9)]


def test_consistency_summary_of_repetitions(spark):
    rows = [(0, i, i // 3) for i in range(6)] + [(1, i, 1 - i // 3) for i in range(6)]
    one = MR.consistency_summary(frame(spark, rows, "rep int, id bigint, cluster int")).first()
    assert (one["n_repetitions"], one["consistency_metric"], one["mean"], one["scores"]) == (2, "ari", 1.0, [1.0])
    assert [c["track_id"] for c in one["clusters"]] == [0, 1] and {c["mean_consistency"] for c in one["clusters"]} == {1.0}


def test_grid_of_levels(spark):
    nodes = frame(spark, [(0, 4), (1, 7), (1, 2)], "level int, cluster int")
    got = sorted((r["level"], r["cluster"], r["x"], r["y"]) for r in H.grid_layout(nodes).collect())
    assert got == [(0, 4, 0.5, 0.0), (1, 2, 0.25, -1.0), (1, 7, 0.75, -1.0)]


def test_settled_kmeans_leaves_no_point_misplaced(spark):
    x = np.random.default_rng(3).standard_normal((300, 3))
    points = frame(spark, [(i, v.tolist()) for i, v in enumerate(x)], "id bigint, features array<double>")
    got = {r["id"]: r["cluster"] for r in DE.kmeans(points, 6, max_iter=1, settle=True).collect()}
    own = np.array([got[i] for i in range(300)])
    means = np.stack([x[own == c].mean(0) for c in range(6)])
    gap = ((x[:, None] - means[None]) ** 2).sum(2)
    assert (gap[np.arange(300), own] <= gap.min(1) + 1e-12).all()
    assert sorted(set(own)) == list(range(6))


@pytest.mark.parametrize("method", ["average", "complete", "single", "ward"])
def test_linkage_of_groups_is_that_of_their_points(method):
    rng = np.random.default_rng(5)
    group = rng.integers(6, size=20)
    x = rng.standard_normal((6, 2))
    of = lambda x: np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    whole = H.linkage_matrix(of(x[group]), method)
    own = H.with_members(H.linkage_matrix(of(x), method, np.bincount(group)), group)
    assert own[:, 2] == pytest.approx(whole[:, 2]) and own[-1, 3] == 20
    for k in (2, 3, 6):
        assert H.cut_into(own, 20, k).tolist() == H.cut_into(whole, 20, k).tolist()
    assert sorted(H.leaf_order(own, 20).tolist()) == list(range(20))


def test_linkage_of_runs_counts_sets_of_equal_points(spark, monkeypatch):
    monkeypatch.setattr(H, "MAX_POINTS", 4)
    runs = frame(spark, [(r, i, i % 3) for r in range(2) for i in range(9)], "run int, id bigint, cluster int")
    members, far = CO.grouped_distances(runs, frame(spark, [(i,) for i in range(10)], "id bigint"))
    rows = sorted(H.linkage(far, "average", members).collect(), key=lambda r: r["step"])
    assert [r["distance"] for r in rows] == [0.0] * 6 + [1.0] * 3 and rows[-1]["size"] == 10


def test_pairs_of_runs_are_listed_without_a_shuffle_of_pairs(spark, monkeypatch):
    monkeypatch.setattr(CO, "BLOCK", 3)
    rng = np.random.default_rng(1)
    own = [(r, i, int(rng.integers(3))) for r in range(3) for i in range(25) if rng.random() < 0.7 and i != 7]
    runs = frame(spark, own, "run int, id bigint, cluster int")
    held = {}
    for r, i, c in own:
        held.setdefault(i, {})[r] = c
    want = {}
    for i in range(25):
        for j in range(i + 1, 25):
            both = held.get(i, {}).keys() & held.get(j, {}).keys()
            want[i, j] = sum(held[i][r] == held[j][r] for r in both) / len(both) if both else 0.0
    got = CO.coassociation(runs)
    assert as_dict(got, "src", "dst") == pytest.approx({k: v for k, v in want.items() if v})
    dense = CO.dense_distances(None, frame(spark, [(i,) for i in range(25)], "id bigint"), runs=runs)
    assert as_dict(dense, "src", "dst", value="distance") == pytest.approx({k: 1 - v for k, v in want.items()})
    for df in (got, dense):
        assert "hashpartitioning(src" not in df._jdf.queryExecution().executedPlan().toString()


def test_coassociation_matrix_stores_no_pairs(spark, monkeypatch):
    from tessera.plans import pp
    from tessera.sources.dataset import Dataset

    names = []
    for module in (pp, CO):
        monkeypatch.setattr(module, "cut", lambda df, name="step", own=module.cut: names.append((name, df.columns)) or own(df, name))
    points = frame(spark, [(i, [float(i // 10), float(i % 10)]) for i in range(20)], "id bigint, features array<double>")
    halves = lambda p, s: p.select("id", (F.col("features")[0] > 0).cast("int").alias("cluster"))
    data = pp.coassociation_matrix(Dataset(points), 3, clusterers=[halves])
    got = as_dict(data.obsp["coassociation_connectivities"], "src", "dst")
    assert all(got[j, i] == v == 1.0 and i != j and i // 10 == j // 10 for (i, j), v in got.items()) and len(got) > 100
    walk = as_dict(data.obsp["coassociation_transitions"], "src", "dst")
    assert walk.keys() == got.keys() and sum(v for (i, _), v in walk.items() if i == 0) == pytest.approx(1)
    assert not [n for n, columns in names if "dst" in columns]


@pytest.mark.parametrize("bucket_length", [0.4, 8.0])
def test_lsh_neighbours_are_the_nearest_that_share_a_bucket(spark, bucket_length):
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    x = np.random.default_rng(2).standard_normal((60, 4))
    x[7] = x[3]
    points = frame(spark, [(i, v.tolist()) for i, v in enumerate(x)], "id bigint, features array<double>")
    got = N.lsh_knn(points, 5, bucket_length, 3)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan  # no rows of candidates
    v = points.select("id", array_to_vector("features").alias("v"))
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=bucket_length, numHashTables=3, seed=0).fit(v)
    h = {r["id"]: [b[0] for b in r["h"]] for r in model.transform(v).collect()}
    want = set()
    for i in range(60):
        near = sorted((float(np.sqrt(((x[i] - x[j]) ** 2).sum())), j) for j in range(60) if j != i and any(a == b for a, b in zip(h[i], h[j], strict=True)))
        want |= {(i, j, k + 1) for k, (_, j) in enumerate(near[:5])}
    assert {(r["src"], r["dst"], r["rank"]) for r in got.collect()} == want


@pytest.mark.parametrize(("metric", "p"), [("manhattan", 1.0), ("chebyshev", 1.0), ("minkowski", 3.0), ("minkowski", 1.5), ("minkowski", 4.0)])
def test_screened_distances_hold_their_bound(metric, p):
    from tessera.functions import distance as D

    rng = np.random.default_rng(4)
    x, y = rng.standard_normal((20, 9)), rng.standard_normal((5000, 9))
    y[:20] = x * (1 + 1e-7)  # nearer than float32 can tell
    y[20:40] = x + 1e-30
    y[40:60] = 1e-20 * rng.standard_normal((20, 9))
    x[10:] *= 1e-20
    for scale in (1.0, 1e200, 1e-200):
        d, slack = D.screen(x * scale, y * scale, metric, p)
        top = max(np.abs(x).max(), np.abs(y).max())
        true = D.exact((x / top)[:, None], (y / top)[None], metric, p)
        assert d.dtype == np.float32 and (np.abs(d - true) <= slack).all()
        ids = np.arange(20)
        r, near, far = N._best(x * scale, ids, y * scale, 100 + np.arange(5000), 5, metric, p, False)
        if scale == 1.0:
            true = D.exact(x[:, None], y[None], metric, p)
            want = [sorted(zip(true[i], 100 + np.arange(5000), strict=True))[:5] for i in range(20)]
            assert list(near) == [int(j) for w in want for _, j in w] and list(far) == [float(v) for w in want for v, _ in w]
    assert D.screen(x * np.inf, y, metric, p) is None and D.screen(x, y, "minkowski", 0.5) is None


@pytest.mark.parametrize("kept", [1 << 24, 0])
def test_tsne_is_dealt_to_tasks_and_takes_steps_of_the_definition(spark, monkeypatch, kept):
    monkeypatch.setattr(DE, "SLAB", 100)
    monkeypatch.setattr(DE, "KEPT", kept)
    n = 40
    x = np.random.default_rng(6).standard_normal((n, 5))
    points = frame(spark, [(i, v.tolist()) for i, v in enumerate(x)], "id bigint, features array<double>")
    out = DE.tsne(points, epochs=2, perplexity=8.0)
    assert out.rdd.getNumPartitions() > 1
    got = {r["id"]: r["position"] for r in out.collect()}
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    p = np.zeros((n, n))
    for i in range(n):
        lo, hi = 0.0, 100.0
        for _ in range(60):
            b = (lo + hi) / 2
            k = np.where(np.arange(n) == i, 0, np.exp(-d[i] * b))
            k /= k.sum()
            lo, hi = (b, hi) if -(k[k > 0] * np.log(k[k > 0])).sum() > np.log(8.0) else (lo, b)
        p[i] = k
    p = np.maximum((p + p.T) / (2 * n), 1e-12)
    y = np.random.Generator(np.random.Philox(0)).standard_normal((n, 2)) * 1e-4
    move = 0
    for _ in range(2):
        q = 1 / (1 + ((y[:, None] - y[None]) ** 2).sum(2))
        np.fill_diagonal(q, 0)
        move = 0.5 * move - 200 * 4 * (((12 * p - q / q.sum()) * q)[:, :, None] * (y[:, None] - y[None])).sum(1)
        y = y + move
        y = y - y.mean(0)
    assert np.array([got[i] for i in range(n)]) == pytest.approx(y, rel=1e-6)


def test_umap_layout_takes_more_than_ten_thousand_points(spark):
    ring = spark.range(10_100).selectExpr("id as src", "(id + 1) % 10100 as dst", "1.0D as weight")
    rows = DE.umap_layout(ring, epochs=2).collect()
    assert len(rows) == 10_100 and np.isfinite([r["position"] for r in rows]).all()
