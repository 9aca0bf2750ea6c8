"""Catalogue queries against their SQL in DuckDB, on the smallest tables."""

import glob
import inspect
import math
import os

import pytest

from tessera.plans.catalogue import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"
ROUNDS = ("epochs", "max_iter", "tolerance", "max_moves", "max_levels")
CHOSEN = (
    "knn_graph knn_graph_ties assign_consistently propagate_converge partition_match_ami sampled_steps_transform model_predict_proba consistency_summary umap_transform kmeans_nearest similarity_stability spaced_positions even_picks resolution_range_summary leiden_partition louvain_partition linkage_average_merges linkage_cut_levels single_linkage_forest_size thin_negbin_totals bootstrap_pca_parts tl_louvain_partition knn_graph_self knn_distances_cosine mutual_knn shuffle_splits split_fit_predict consensus_knn consensus_distances consensus_mutual potential_occurrence "
    "transition_max transition_min fuzzy_union matrix_stats connectivity_probability umap_connectivities agreement_lineitem ami_codes pairwise_ari cluster_match_f1 projection_multires "
    "partition_match_ari annotate_hier_wide predict_vote dominant_class propagate_k3 modularity track_consistency cell_confidence coassoc cluster_stability soft_membership assignment_prob "
    "hierarchy_edges_weight strongest_parent cluster_profile_median dotplot tl_annotate_hierarchical windowed_contingency"
).split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    result = duck.execute(ORACLE[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=repr)
    assert got == want


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize(("name", "module", "operator"), [("tsne_layout", "DE", "tsne"), ("umap_layout", "DE", "umap_layout"), ("fast_ica", "DE", "fast_ica"), ("louvain_distributed", "CM", "louvain_distributed")])
def test_query_runs_the_rounds_of_its_operator(spark, monkeypatch, name, module, operator):
    from tessera.plans import catalogue

    class Called(Exception):
        pass

    own = getattr(getattr(catalogue, module), operator)

    def record(*args, **kwargs):
        bound = inspect.signature(own).bind(*args, **kwargs)
        bound.apply_defaults()
        raise Called({k: bound.arguments[k] for k in bound.arguments if k in ROUNDS})

    monkeypatch.setattr(getattr(catalogue, module), operator, record)
    with pytest.raises(Called) as called:
        QUERIES[name](spark, DATA)
    assert called.value.args[0] == {k: v.default for k, v in inspect.signature(own).parameters.items() if k in ROUNDS}


@pytest.mark.parametrize("name", "dendrogram_blocks linkage_average linkage_average_merges linkage_cut linkage_cut_levels linkage_cut_natural".split())
def test_hierarchies_of_more_points_than_one_task_holds(spark, monkeypatch, name):
    from tessera.operators import hierarchy as H

    monkeypatch.setattr(H, "MAX_POINTS", 300)  # there are 500, in fewer sets of equal ones
    rows = QUERIES[name](spark, DATA).collect()
    if name == "linkage_average":
        assert sorted(r["step"] for r in rows) == list(range(499)) and max(r["size"] for r in rows) == 500
    elif name == "linkage_average_merges":
        assert [(r["n_merges"], r["last_size"], r["n_falling"]) for r in rows] == [(499, 500, 0)]
    elif name == "linkage_cut_levels":
        assert sorted((r["level"], r["n_points"]) for r in rows) == [(0, 500), (1, 500), (2, 500)]
    elif name.startswith("linkage_cut"):
        levels = {r["level"] for r in rows}
        assert levels and len({(r["level"], r["id"]) for r in rows}) == len(rows) == 500 * len(levels)
    else:
        assert len({r["level"] for r in rows}) == 5


def test_recall_of_lsh_lists_no_candidates(spark, duck, monkeypatch):
    from tessera.operators import knn as N

    own, plans = N.lsh_knn, []
    monkeypatch.setattr(N, "lsh_knn", lambda *a, **b: [out := own(*a, **b), plans.append(out._jdf.queryExecution().executedPlan().toString())][0])
    got = [tuple(r) for r in QUERIES["knn_lsh_recall"](spark, DATA).collect()]
    assert got == duck.execute(ORACLE["knn_lsh_recall"]).fetchall()
    assert "Join" not in plans[0] and "Generate" not in plans[0]
