"""Every operator as a query over the standard tables, and the same in SQL where SQL can say it.

Points are the rows of `embeddings`. Labelings that need no clustering are sign codes: resolution r numbers the
orthants of the first r dimensions. Numbers are rounded to six places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.durable import cut
from tessera.functions.labels import level_name, normalise_missing, one_hot, resolution_name, wide
from tessera.operators import annotate as A
from tessera.operators import coassoc as CO
from tessera.operators import community as CM
from tessera.operators import consensus as CS
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
from tessera.plans import pp, tl
from tessera.schema import points_from
from tessera.sources.dataset import Dataset, from_parquet
from tessera.streaming import profiles as ST

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
SPLITS = 5


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def points(spark: SparkSession, d: str) -> DataFrame:
    return points_from(table(spark, d, "embeddings"), "vec_id", "embedding")


def truth(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("cluster"))


def codes(spark: SparkSession, d: str, most: int = 3) -> DataFrame:
    """labels(res_id, id, cluster) of the sign codes with 1 .. most dimensions."""
    p = points(spark, d)
    out = None
    for r in range(1, most + 1):
        c = sum((F.col("features")[i] > 0).cast("int") * (1 << i) for i in range(r))
        part = p.select(F.lit(r).alias("res_id"), "id", c.alias("cluster"))
        out = part if out is None else out.unionByName(part)
    return out


def weighted_edges(spark: SparkSession, d: str, k: int = 10) -> DataFrame:
    """edges(src, dst, weight = 1 / (1 + distance)) of the k nearest."""
    return cut(N.knn(points(spark, d), k).select("src", "dst", (1 / (1 + F.col("distance"))).alias("weight")), "edges")


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, F.round(F.col(c), 6))
    return df


# --- SQL pieces -------------------------------------------------------------------------------------------------------

P = "p AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x, label FROM embeddings)"
DIST = {
    "euclidean": "list_distance(a.x, b.x)",
    "cosine": "list_cosine_distance(a.x, b.x)",
    "manhattan": "list_sum(list_transform(range(1, len(a.x) + 1), lambda i: abs(a.x[i] - b.x[i])))",
    "chebyshev": "list_max(list_transform(range(1, len(a.x) + 1), lambda i: abs(a.x[i] - b.x[i])))",
}


def knn_sql(k: int, metric: str = "euclidean", include_self: bool = False) -> str:
    on = "TRUE" if include_self else "a.id <> b.id"
    return f"""{P}, d AS (SELECT a.id AS src, b.id AS dst, {DIST[metric]} AS distance FROM p a JOIN p b ON {on}),
      knn AS (SELECT *, CAST(row_number() OVER (PARTITION BY src ORDER BY distance, dst) AS INTEGER) AS rank FROM d QUALIFY rank <= {k})"""


EDGES = f"{knn_sql(10)}, e AS (SELECT src, dst, 1 / (1 + distance) AS weight FROM knn)"
CODES = """lab AS (SELECT 1 AS res_id, id, CAST(x[1] > 0 AS INTEGER) AS cluster FROM p
      UNION ALL SELECT 2, id, CAST(x[1] > 0 AS INTEGER) + 2 * CAST(x[2] > 0 AS INTEGER) FROM p
      UNION ALL SELECT 3, id, CAST(x[1] > 0 AS INTEGER) + 2 * CAST(x[2] > 0 AS INTEGER) + 4 * CAST(x[3] > 0 AS INTEGER) FROM p)"""
TRAIN = f"""s AS (SELECT split_id, id, row_number() OVER (PARTITION BY split_id ORDER BY md5('0:' || split_id || ':' || id), id)
        <= floor(0.8 * (SELECT count(*) FROM p) + 1e-9) AS is_train FROM p, (SELECT CAST(range AS INTEGER) AS split_id FROM range({SPLITS})))"""
RUNS = f"""{P}, {CODES}, {TRAIN}, runs AS (SELECT split_id AS run, s.id, cluster FROM s JOIN lab ON s.id = lab.id AND lab.res_id = split_id % 3 + 1 WHERE is_train),
      hits AS (SELECT a.id AS src, b.id AS dst, count(*) AS n FROM runs a JOIN runs b ON a.run = b.run AND a.cluster = b.cluster AND a.id < b.id GROUP BY ALL),
      both_in AS (SELECT a.id AS src, b.id AS dst, count(*) AS n FROM runs a JOIN runs b ON a.run = b.run AND a.id < b.id GROUP BY ALL),
      c AS (SELECT src, dst, hits.n / both_in.n AS weight FROM hits JOIN both_in USING (src, dst)),
      cf AS (SELECT src, dst, weight FROM c UNION ALL SELECT dst, src, weight FROM c)"""


# --- neighbours -------------------------------------------------------------------------------------------------------


def _knn(spark, d, **kw) -> DataFrame:
    return rounded(N.knn(points(spark, d), 14, **kw).select("src", "dst", "rank", "distance"), "distance")


_KNN = "SELECT src, dst, rank, round(distance, 6) AS distance FROM knn"


@query(f"WITH {knn_sql(14)} {_KNN}")
def knn_graph(spark, d):
    return _knn(spark, d)


_SIGNS = "p AS (SELECT vec_id AS id, list_transform(list_slice(CAST(embedding AS DOUBLE[]), 1, 3), lambda v: CASE WHEN v > 0 THEN 1::DOUBLE ELSE 0::DOUBLE END) AS x, label FROM embeddings)"


@query(f"WITH {knn_sql(14).replace(P, _SIGNS)} {_KNN}")
def knn_graph_ties(spark, d):
    """Points with eight distinct vectors, so most places are ties, which the least ids take."""
    signs = F.transform(F.slice("features", 1, 3), lambda v: F.when(v > 0, 1.0).otherwise(0.0))
    return rounded(N.knn(points(spark, d).withColumn("features", signs), 14).select("src", "dst", "distance", "rank"), "distance")


@query(f"WITH {knn_sql(14, include_self=True)} {_KNN}")
def knn_graph_self(spark, d):
    return _knn(spark, d, include_self=True)


@query(f"WITH {knn_sql(14, 'manhattan')} {_KNN}")
def knn_distances_manhattan(spark, d):
    return _knn(spark, d, metric="manhattan")


@query(f"WITH {knn_sql(14, 'cosine')} {_KNN}")
def knn_distances_cosine(spark, d):
    return _knn(spark, d, metric="cosine")


@query(f"WITH {knn_sql(14, 'chebyshev')} {_KNN}")
def knn_distances_chebyshev(spark, d):
    return _knn(spark, d, metric="chebyshev")


@query(f"WITH {knn_sql(15)} SELECT a.src, a.dst, 1.0::DOUBLE AS weight FROM knn a JOIN knn b ON a.src = b.dst AND a.dst = b.src")
def mutual_knn(spark, d):
    return N.mutual_knn(points(spark, d), 15)


@query(f"WITH {knn_sql(10)}, g AS (SELECT src, list(dst) AS s FROM knn GROUP BY src), v AS (SELECT k.src, k.dst, len(list_intersect(a.s, b.s)) AS n FROM knn k JOIN g a ON a.src = k.src JOIN g b ON b.src = k.dst) SELECT src, dst, round(n / (20 - n), 6) AS weight FROM v")
def shared_neighbours(spark, d):
    return rounded(N.shared_neighbours(N.knn(points(spark, d), 10)), "weight")


@query()
def knn_lsh(spark, d):
    return rounded(N.lsh_knn(points(spark, d), 10, bucket_length=4.0).select("src", "dst", "rank", "distance"), "distance")


# --- resampling and consensus -------------------------------------------------------------------------------------------


def splits(spark, d) -> DataFrame:
    return cut(RS.shuffle_splits(points(spark, d), SPLITS, 0.8, 0), "splits")


@query(f"WITH {P}, {TRAIN} SELECT * FROM s")
def shuffle_splits(spark, d):
    return RS.shuffle_splits(points(spark, d), SPLITS, 0.8, 0)


@query("""WITH n AS (SELECT count(*) AS n FROM customer), r AS (SELECT CAST(range AS INTEGER) AS split_id FROM range(3)),
    s AS (SELECT split_id, c_custkey AS id, row_number() OVER (PARTITION BY split_id ORDER BY md5('7:' || split_id || ':' || c_custkey), c_custkey) AS k FROM customer, r)
    SELECT split_id, count(*) AS n_train, sum(id)::BIGINT AS id_sum FROM s, n WHERE k <= floor(0.5 * n + 1e-9) GROUP BY split_id""")
def shuffle_split_halves(spark, d):
    s = RS.shuffle_splits(table(spark, d, "customer"), 3, 0.5, 7, "c_custkey").where("is_train")
    return s.groupBy("split_id").agg(F.count(F.lit(1)).alias("n_train"), F.sum("id").alias("id_sum"))


@query("SELECT CAST(o.range * 3 + f.range AS INTEGER) AS partition_id, CAST(o.range AS INTEGER) AS obs_split, CAST(f.range AS INTEGER) AS feat_split FROM range(5) o, range(3) f")
def split_cross_features(spark, d):
    return RS.cross_splits(splits(spark, d), RS.feature_splits(spark, 64, 3, 0.5))


@query(f"""WITH {P}, f AS (SELECT feature FROM (SELECT CAST(range AS INTEGER) AS feature, row_number() OVER (ORDER BY md5('1000:0:' || range), range) AS k FROM range(64)) WHERE k <= 16)
    SELECT id, list_transform(list_sort((SELECT list(feature) FROM f)), lambda i: x[i + 1]) AS features FROM p""")
def split_feature_subset(spark, d):
    f = RS.feature_splits(spark, 64, 3, 0.25).where("split_id = 0 and is_train").orderBy("feature").collect()
    return RS.take_features(points(spark, d), [r["feature"] for r in f])


@query("SELECT * FROM (VALUES ('a', 34), ('b', 33), ('c', 33)) t(pipeline, n)")
def sample_distribution(spark, d):
    return spark.createDataFrame(list(RS.distribute_samples(100, ["a", "b", "c"]).items()), "pipeline string, n int")


@query("""WITH c AS (SELECT * FROM (VALUES ('a', 34, 0), ('b', 33, 1), ('c', 33, 2)) t(pipeline, n, i))
    SELECT pipeline, CAST(range AS INTEGER) AS sample_idx, CAST(CAST('0x' || substr(md5(i || ':' || range), 1, 8) AS BIGINT) % 10 AS INTEGER) AS split_id FROM c, range(34) WHERE range < n""")
def sampled_partitions(spark, d):
    return RS.sample_partitions(spark, RS.distribute_samples(100, ["a", "b", "c"]), 10)


@query(f"""WITH {P}, {TRAIN}, m AS (SELECT split_id, list_transform(range(1, 4), lambda i: 0) AS z, avg(x[1]) AS a, avg(x[2]) AS b FROM p JOIN s USING (id) WHERE is_train GROUP BY split_id)
    SELECT s.split_id, s.id, round(x[1] - a, 6) AS u, round(x[2] - b, 6) AS v FROM p JOIN s USING (id) JOIN m USING (split_id) WHERE NOT is_train""")
def split_fit_predict(spark, d):
    def fit(train, split):
        means = train.agg(F.avg(F.col("features")[0]).alias("a"), F.avg(F.col("features")[1]).alias("b"))
        return lambda part: part.join(means).select("id", F.round(F.col("features")[0] - F.col("a"), 6).alias("u"), F.round(F.col("features")[1] - F.col("b"), 6).alias("v"))

    return RS.Resampler(SPLITS, 0.8, 0).fit_predict(points(spark, d), fit)


_SPLIT_KNN = f"""{P}, {TRAIN}, t AS (SELECT split_id, p.id, x FROM p JOIN s USING (id) WHERE is_train),
    d AS (SELECT a.split_id, a.id AS src, b.id AS dst, list_distance(a.x, b.x) AS distance FROM t a JOIN t b ON a.split_id = b.split_id),
    k AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY split_id, src ORDER BY distance, dst) <= 15),
    pot AS (SELECT a.id AS src, b.id AS dst, count(*) AS n FROM t a JOIN t b ON a.split_id = b.split_id GROUP BY ALL)"""


@query(f"WITH {_SPLIT_KNN}, h AS (SELECT src, dst, count(*) AS hits FROM k GROUP BY ALL) SELECT src, dst, round(hits / n, 6) AS weight FROM h JOIN pot USING (src, dst)")
def consensus_knn(spark, d):
    return rounded(CS.consensus_knn(points(spark, d), 15, SPLITS), "weight")


@query(f"WITH {_SPLIT_KNN}, h AS (SELECT src, dst, sum(distance) / any_value(n) AS mean, sum(distance * distance) / any_value(n) AS sq FROM k JOIN pot USING (src, dst) WHERE src <> dst GROUP BY ALL) SELECT src, dst, round(sqrt(greatest(sq - mean * mean, 0)) / mean, 5) AS weight FROM h")
def consensus_distances(spark, d):
    out = CS.consensus_knn(points(spark, d), 15, SPLITS, mode="distances").where("src <> dst")
    return out.withColumn("weight", F.round("weight", 5))


@query(f"WITH {_SPLIT_KNN}, m AS (SELECT a.src, a.dst, count(*) AS hits FROM k a JOIN k b ON a.split_id = b.split_id AND a.src = b.dst AND a.dst = b.src GROUP BY ALL) SELECT src, dst, round(hits / n, 6) AS weight FROM m JOIN pot USING (src, dst)")
def consensus_mutual(spark, d):
    return rounded(CS.consensus_mutual(points(spark, d), 15, SPLITS), "weight")


_POTENTIAL = f"WITH {knn_sql(10)}, {TRAIN} SELECT k.src, k.dst, CAST(count(b.id) AS INTEGER) AS n FROM knn k LEFT JOIN s a ON a.id = k.src AND a.is_train LEFT JOIN s b ON b.id = k.dst AND b.split_id = a.split_id AND b.is_train GROUP BY ALL"


@query(_POTENTIAL)
def potential_occurrence(spark, d):
    return CS.potential_occurrence(weighted_edges(spark, d).select("src", "dst"), RS.split_masks(splits(spark, d)))


@query(_POTENTIAL.replace("AS INTEGER) AS n FROM", "AS BIGINT) AS n FROM"))
def potential_occurrence_join(spark, d):
    return CS.occurrences_by_join(weighted_edges(spark, d), splits(spark, d))


# --- edge algebra -------------------------------------------------------------------------------------------------------

_SYM = f"{EDGES}, u AS (SELECT src, dst, weight, 1 AS side FROM e UNION ALL SELECT dst, src, weight, 2 FROM e), y AS (SELECT src, dst, {{}} AS weight FROM u GROUP BY src, dst), z AS (SELECT * FROM y WHERE weight <> 0 AND src <> dst)"
_SYM_BY = {"max": "greatest(max(weight), 0)", "mean": "sum(weight) / 2", "min": "CASE WHEN count(*) < 2 THEN 0 ELSE min(weight) END", "or": "1.0::DOUBLE"}


def _transition(method: str) -> None:
    def run(spark, d):
        return rounded(E.transition(weighted_edges(spark, d), method=method), "weight")

    run.__name__ = f"transition_{method}"
    query(f"WITH {_SYM.format(_SYM_BY[method])} SELECT src, dst, round(weight / sum(weight) OVER (PARTITION BY src), 6) AS weight FROM z")(run)


for _method in _SYM_BY:
    _transition(_method)


@query(f"WITH {EDGES} SELECT src, dst, round(weight / sum(weight) OVER (PARTITION BY src), 6) AS weight FROM e")
def row_normalize(spark, d):
    return rounded(E.row_normalise(weighted_edges(spark, d)), "weight")


@query(f"WITH {EDGES}, u AS (SELECT src, dst, weight AS p, 0 AS q FROM e UNION ALL SELECT dst, src, 0, weight FROM e), g AS (SELECT src, dst, sum(p) AS p, sum(q) AS q FROM u GROUP BY ALL) SELECT src, dst, round(least(greatest(p + q - p * q, 0), 1), 6) AS weight FROM g")
def fuzzy_union(spark, d):
    return rounded(E.fuzzy_union(weighted_edges(spark, d)), "weight")


@query(f"WITH {EDGES} SELECT src, dst, round(greatest(weight - 0.1, 0), 6) AS weight FROM e WHERE src <> dst AND greatest(weight - 0.1, 0) <> 0")
def clip_and_drop(spark, d):
    e = weighted_edges(spark, d).withColumn("weight", F.col("weight") - 0.1)
    return rounded(E.drop_loops(E.clip_negative(e)), "weight")


@query(f"""WITH {EDGES}, n AS (SELECT count(*) AS n FROM p), r AS (SELECT p.id, coalesce(sum(weight), 0) AS s FROM p LEFT JOIN e ON e.src = p.id GROUP BY p.id),
    u AS (SELECT src, dst, sum(w) AS gap FROM (SELECT src, dst, weight AS w FROM e UNION ALL SELECT dst, src, -weight FROM e) GROUP BY ALL)
    SELECT n, (SELECT count(*) FROM e) AS nnz, round((SELECT min(weight) FROM e), 6) AS min_value, round((SELECT max(weight) FROM e), 6) AS max_value, round((SELECT avg(weight) FROM e), 6) AS mean_value,
      (SELECT max(abs(gap)) <= 1e-10 FROM u) AS is_symmetric, round((SELECT min(s) FROM r), 6) AS min_row_sum, round((SELECT max(s) FROM r), 6) AS max_row_sum, round((SELECT count(*) FROM e) / (n * n), 6) AS density FROM n""")
def matrix_stats(spark, d):
    out = E.matrix_stats(weighted_edges(spark, d), points(spark, d))
    return rounded(out, "min_value", "max_value", "mean_value", "min_row_sum", "max_row_sum", "density")


@query("SELECT vec_id AS src, CAST(i AS BIGINT) - 1 AS dst, CAST(embedding[i] AS DOUBLE) AS weight FROM embeddings, range(1, 65) t(i) WHERE embedding[i] <> 0")
def dense_to_edges(spark, d):
    return E.from_dense(points(spark, d), "id", "features")


@query(f"WITH {EDGES} SELECT least(src, dst) AS src, greatest(src, dst) AS dst, round(sum(weight), 6) AS weight FROM e GROUP BY 1, 2")
def undirected_edges(spark, d):
    return rounded(E.undirected(weighted_edges(spark, d)), "weight")


@query(f"WITH {EDGES} SELECT src AS id FROM e UNION SELECT dst FROM e")
def graph_vertices(spark, d):
    return E.graph(weighted_edges(spark, d))[0]


@query(f"WITH {EDGES}, g AS (SELECT src AS id, label AS cluster, sum(weight) AS w FROM e JOIN p ON p.id = e.dst GROUP BY ALL) SELECT id, cluster, round(w / sum(w) OVER (PARTITION BY id), 6) AS p FROM g")
def connectivity_probability(spark, d):
    return rounded(E.membership_probability(weighted_edges(spark, d), truth(spark, d)), "p")


_FUZZY = f"""RECURSIVE {knn_sql(14)}, r AS (SELECT src, list(distance ORDER BY distance) AS ds, min(distance) AS rho FROM knn GROUP BY src),
    b AS (SELECT src, ds, rho, 1e-10::DOUBLE AS lo, 1e3::DOUBLE AS hi, 500.0::DOUBLE AS mid, FALSE AS done, 0 AS i FROM r
      UNION ALL SELECT src, ds, rho, CASE WHEN NOT done AND NOT hit AND h <= log2(15) THEN m ELSE lo END, CASE WHEN NOT done AND NOT hit AND h > log2(15) THEN m ELSE hi END,
        CASE WHEN done THEN mid ELSE m END, done OR hit, i + 1
      FROM (SELECT *, abs(h - log2(15)) < 1e-5 AS hit FROM (SELECT *, (lo + hi) / 2 AS m, {{}} AS h FROM b WHERE i < 64))),
    q AS (SELECT k.src, k.dst, exp(-greatest(distance - rho, 0) / mid) AS p FROM knn k JOIN b ON b.src = k.src AND b.i = 64)"""
_SUM = "list_sum(list_transform(ds, lambda v: exp(-greatest(v - rho, 1e-10) / ((lo + hi) / 2))))"
_ENTROPY = f"ln({_SUM}) + list_sum(list_transform(ds, lambda v: exp(-greatest(v - rho, 1e-10) / ((lo + hi) / 2)) * greatest(v - rho, 1e-10) / ((lo + hi) / 2))) / {_SUM}"
_UNION = "u AS (SELECT src, dst, p, 0.0::DOUBLE AS o FROM q UNION ALL SELECT dst, src, 0.0::DOUBLE, p FROM q), g AS (SELECT src, dst, sum(p) AS p, sum(o) AS o FROM u GROUP BY ALL) SELECT src, dst, round(least(greatest(p + o - p * o, 0), 1), 5) AS weight FROM g"


def _distances(spark, d) -> DataFrame:
    return N.knn(points(spark, d), 14).select("src", "dst", F.col("distance").alias("weight"))


@query(f"WITH {_FUZZY.format(_SUM)} SELECT src, dst, round(p, 5) AS weight FROM q")
def umap_local_prob(spark, d):
    return FZ.local_probabilities(_distances(spark, d), 15).withColumn("weight", F.round("weight", 5))


@query(f"WITH {_FUZZY.format(_SUM)}, {_UNION}")
def umap_connectivities(spark, d):
    return FZ.connectivities(_distances(spark, d), 15).withColumn("weight", F.round("weight", 5))


@query(f"WITH {_FUZZY.format(_ENTROPY)}, {_UNION}")
def umap_connectivities_compat(spark, d):
    return FZ.connectivities(_distances(spark, d), 15, mode="compat").withColumn("weight", F.round("weight", 5))


# --- comparing labelings --------------------------------------------------------------------------------------------------

_AGREE = """a AS (SELECT a, sum(n) AS s FROM t GROUP BY a), b AS (SELECT b, sum(n) AS s FROM t GROUP BY b), nn AS (SELECT sum(n)::DOUBLE AS n FROM t),
    v AS (SELECT nn.n AS n, (SELECT sum(n * (n - 1) / 2) FROM t) AS s, (SELECT sum(s * (s - 1) / 2) FROM a) AS pa, (SELECT sum(s * (s - 1) / 2) FROM b) AS pb,
      (SELECT -sum(s / nn.n * ln(s / nn.n)) FROM a, nn) AS ha, (SELECT -sum(s / nn.n * ln(s / nn.n)) FROM b, nn) AS hb,
      (SELECT sum(t.n / nn.n * ln(nn.n * t.n / (a.s * b.s))) FROM t JOIN a USING (a) JOIN b USING (b), nn) AS mi FROM nn)
    SELECT CAST(n AS BIGINT) AS n, round((s - pa * pb / (n * (n - 1) / 2)) / ((pa + pb) / 2 - pa * pb / (n * (n - 1) / 2)), 6) AS ari, round(mi, 6) AS mi, round(ha, 6) AS h_a, round(hb, 6) AS h_b,
      round(2 * mi / (ha + hb), 6) AS nmi, round(mi / ha, 6) AS homogeneity, round(mi / hb, 6) AS completeness, round(2 * mi / (ha + hb), 6) AS v_measure FROM v"""
_AGREE_COLUMNS = ("ari", "mi", "h_a", "h_b", "nmi", "homogeneity", "completeness", "v_measure")


@query("SELECT l_returnflag AS a_cluster, l_linestatus AS b_cluster, count(*) AS n FROM lineitem GROUP BY ALL")
def contingency_lineitem(spark, d):
    return CT.contingency_of(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus")


@query(f"WITH {P}, {CODES} SELECT a.cluster AS a_cluster, b.cluster AS b_cluster, count(*) AS n FROM lab a JOIN lab b ON a.id = b.id AND a.res_id = 2 AND b.res_id = 3 GROUP BY ALL")
def contingency_codes(spark, d):
    c = codes(spark, d)
    return CT.contingency(c.where("res_id = 2"), c.where("res_id = 3"))


@query(f"WITH t AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS n FROM lineitem GROUP BY ALL), {_AGREE}")
def agreement_lineitem(spark, d):
    return rounded(CT.agreement(CT.contingency_of(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus")), *_AGREE_COLUMNS)


@query(f"WITH t AS (SELECT c_mktsegment AS a, c_nationkey AS b, count(*) AS n FROM customer GROUP BY ALL), {_AGREE}")
def agreement_customer(spark, d):
    return rounded(CT.agreement(CT.contingency_of(table(spark, d, "customer"), "c_mktsegment", "c_nationkey")), *_AGREE_COLUMNS)


@query(f"WITH {P}, {CODES}, t AS (SELECT label AS a, cluster AS b, count(*) AS n FROM p JOIN lab USING (id) WHERE res_id = 3 GROUP BY ALL), {_AGREE}")
def agreement_codes(spark, d):
    return rounded(CT.agreement(CT.contingency(truth(spark, d), codes(spark, d).where("res_id = 3"))), *_AGREE_COLUMNS)


@query(f"""WITH {P}, {CODES}, t AS (SELECT label AS a, cluster AS b, count(*) AS n FROM p JOIN lab USING (id) WHERE res_id = 3 GROUP BY ALL),
    a AS (SELECT a, sum(n)::BIGINT AS s FROM t GROUP BY a), b AS (SELECT b, sum(n)::BIGINT AS s FROM t GROUP BY b), m AS (SELECT sum(n)::BIGINT AS n FROM t),
    x AS (SELECT a.s AS p, b.s AS q, n, unnest(range(greatest(1, a.s + b.s - n), least(a.s, b.s) + 1)) AS k FROM a, b, m),
    e AS (SELECT sum(k / n * ln(n * k / (p * q)) * exp(lgamma(p + 1) + lgamma(q + 1) + lgamma(n - p + 1) + lgamma(n - q + 1) - lgamma(n + 1) - lgamma(k + 1) - lgamma(p - k + 1) - lgamma(q - k + 1) - lgamma(n - p - q + k + 1))) AS emi FROM x),
    v AS (SELECT (SELECT -sum(s / n * ln(s / n)) FROM a, m) AS ha, (SELECT -sum(s / n * ln(s / n)) FROM b, m) AS hb, (SELECT sum(t.n / m.n * ln(m.n * t.n / (a.s * b.s))) FROM t JOIN a USING (a) JOIN b USING (b), m) AS mi)
    SELECT round((mi - emi) / ((ha + hb) / 2 - emi), 5) AS ami FROM v, e""")
def ami_codes(spark, d):
    return CT.ami(CT.contingency(truth(spark, d), codes(spark, d).where("res_id = 3"))).withColumn("ami", F.round("ami", 5))


_PAIRWISE = f"""{P}, {CODES}, t AS (SELECT a.res_id AS rep_a, b.res_id AS rep_b, a.cluster AS a, b.cluster AS b, count(*)::DOUBLE AS n FROM lab a JOIN lab b ON a.id = b.id AND a.res_id < b.res_id GROUP BY ALL),
    g AS (SELECT rep_a, rep_b, a, sum(n) AS s FROM t GROUP BY ALL), h AS (SELECT rep_a, rep_b, b, sum(n) AS s FROM t GROUP BY ALL),
    v AS (SELECT rep_a, rep_b, sum(n) AS n, sum(n * (n - 1) / 2) AS s FROM t GROUP BY ALL), x AS (SELECT rep_a, rep_b, sum(s * (s - 1) / 2) AS pa FROM g GROUP BY ALL), y AS (SELECT rep_a, rep_b, sum(s * (s - 1) / 2) AS pb FROM h GROUP BY ALL),
    r AS (SELECT rep_a, rep_b, (s - pa * pb / (n * (n - 1) / 2)) / ((pa + pb) / 2 - pa * pb / (n * (n - 1) / 2)) AS score FROM v JOIN x USING (rep_a, rep_b) JOIN y USING (rep_a, rep_b))"""


def _reps(spark, d) -> DataFrame:
    return codes(spark, d).withColumnRenamed("res_id", "rep")


@query(f"WITH {_PAIRWISE} SELECT rep_a, rep_b, round(score, 6) AS score FROM r")
def pairwise_ari(spark, d):
    return rounded(CT.pairwise(_reps(spark, d), "ari"), "score")


@query(f"WITH {_PAIRWISE} SELECT round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std FROM r")
def consistency_ari(spark, d):
    return rounded(CT.consistency(_reps(spark, d), "ari").select("mean", "std"), "mean", "std")


_SCORES = f"""{P}, {CODES}, i AS (SELECT res_id, label AS class, cluster, count(*) AS n FROM p JOIN lab USING (id) GROUP BY ALL), a AS (SELECT label AS class, count(*) AS s FROM p GROUP BY ALL),
    b AS (SELECT res_id, cluster, count(*) AS s FROM lab GROUP BY ALL), f AS (SELECT b.res_id, a.class, b.cluster, coalesce(n, 0) AS n, a.s AS sa, b.s AS sb FROM a CROSS JOIN b LEFT JOIN i ON i.res_id = b.res_id AND i.class = a.class AND i.cluster = b.cluster)"""
_SIMILAR = {"jaccard": "n / (sa + sb - n)", "overlap": "n / least(sa, sb)", "precision": "n / sb", "recall": "n / sa", "f1": "CASE WHEN n = 0 THEN 0 ELSE 2 * (n / sb) * (n / sa) / (n / sb + n / sa) END"}


def _classes(spark, d) -> DataFrame:
    return truth(spark, d).select("id", F.col("cluster").cast("string").alias("class"))


def _match(metric: str) -> None:
    def run(spark, d):
        return rounded(CT.class_scores(_classes(spark, d), codes(spark, d), metric), "score")

    run.__name__ = f"cluster_match_{metric}"
    query(f"WITH {_SCORES} SELECT res_id, CAST(class AS VARCHAR) AS class, cluster, round({_SIMILAR[metric]}, 6) AS score FROM f")(run)


for _metric in _SIMILAR:
    _match(_metric)


@query(f"WITH {_SCORES}, j AS (SELECT res_id, CAST(class AS VARCHAR) AS class, cluster, n / (sa + sb - n) AS score FROM f) SELECT res_id, class, cluster, round(score, 6) AS score FROM j WHERE TRUE QUALIFY row_number() OVER (PARTITION BY class, res_id ORDER BY score DESC, cluster) = 1 AND score >= 0.1")
def projection_multires(spark, d):
    return rounded(CT.project(_classes(spark, d), codes(spark, d), "jaccard", 0.1), "score")


@query(f"WITH {_SCORES}, j AS (SELECT CAST(class AS VARCHAR) AS class, cluster, n / (sa + sb - n) AS score FROM f WHERE res_id = 3) SELECT class, cluster, round(score, 6) AS score FROM j QUALIFY row_number() OVER (PARTITION BY class ORDER BY score DESC, cluster) = 1")
def annotation_match(spark, d):
    return rounded(CT.match_clusters(_classes(spark, d), codes(spark, d).where("res_id = 3").drop("res_id")), "score")


_BEST = f"{_SCORES}, nn AS (SELECT count(*)::DOUBLE AS t FROM p), j AS (SELECT class AS target, res_id AS level, cluster, sa, {{}} AS score FROM f, nn), k AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY target ORDER BY score DESC, level, cluster) = 1)"
_JACCARD = _BEST.format("n / (sa + sb - n)")
_P2 = "({0} * ({0} - 1) / 2)"
_BIN_ARI = "(({c}) - ({r}) * ({k}) / {t}) / ((({r}) + ({k})) / 2 - ({r}) * ({k}) / {t})".format(
    c=" + ".join(_P2.format(x) for x in ("n", "(sa - n)", "(sb - n)", "(t - sa - sb + n)")), r=f"{_P2.format('sa')} + {_P2.format('(t - sa)')}", k=f"{_P2.format('sb')} + {_P2.format('(t - sb)')}", t=_P2.format("t")
)


def _levels(spark, d) -> DataFrame:
    return codes(spark, d).withColumnRenamed("res_id", "level")


@query(f"WITH {_JACCARD} SELECT target, level, cluster, round(score, 6) AS score, sa AS n_cells FROM k")
def partition_match_jaccard(spark, d):
    return rounded(CT.partition_match(truth(spark, d), _levels(spark, d)), "score")


@query(f"WITH {_BEST.format(f'round({_BIN_ARI}, 9)')} SELECT target, level, cluster, round(score, 6) AS score, sa AS n_cells FROM k")
def partition_match_ari(spark, d):
    return rounded(CT.partition_match(truth(spark, d), _levels(spark, d), "ari"), "score")


_LGAMMA = "exp(lgamma(p + 1) + lgamma(q + 1) + lgamma(t - p + 1) + lgamma(t - q + 1) - lgamma(t + 1) - lgamma(k + 1) - lgamma(p - k + 1) - lgamma(q - k + 1) - lgamma(t - p - q + k + 1))"
_CELL = "CASE WHEN {0} > 0 THEN {0} / t * ln(t * ({0}) / (({1}) * ({2}))) ELSE 0 END"
_BIN_MI = " + ".join(_CELL.format(*c) for c in (("n", "sa", "sb"), ("(sa - n)", "sa", "t - sb"), ("(sb - n)", "t - sa", "sb"), ("(t - sa - sb + n)", "t - sa", "t - sb")))
_BIN_H = "(-{0} / t * ln({0} / t) - (t - {0}) / t * ln((t - {0}) / t))"


@query(f"""WITH {_SCORES}, j AS (SELECT class AS target, res_id AS level, cluster, n, sa, sb, (SELECT count(*) FROM p) AS t FROM f),
    m AS (SELECT target, level, cluster, t, unnest([{{'p': sa, 'q': sb}}, {{'p': sa, 'q': t - sb}}, {{'p': t - sa, 'q': sb}}, {{'p': t - sa, 'q': t - sb}}]) AS c FROM j),
    y AS (SELECT target, level, cluster, t, c.p AS p, c.q AS q, unnest(range(greatest(1, c.p + c.q - t), least(c.p, c.q) + 1)) AS k FROM m),
    e AS (SELECT target, level, cluster, sum(k / t * ln(t * k / (p * q)) * {_LGAMMA}) AS emi FROM y GROUP BY ALL),
    v AS (SELECT target, level, cluster, sa, ({_BIN_MI} - emi) / (({_BIN_H.format('sa')} + {_BIN_H.format('sb')}) / 2 - emi) AS score FROM j JOIN e USING (target, level, cluster))
    SELECT target, level, cluster, round(score, 6) AS score, sa AS n_cells FROM v QUALIFY row_number() OVER (PARTITION BY target ORDER BY round(score, 9) DESC, level, cluster) = 1""")
def partition_match_ami(spark, d):
    return rounded(CT.partition_match(truth(spark, d), _levels(spark, d), "ami"), "score")


@query(f"WITH {_JACCARD} SELECT round(avg(score), 6) AS mean_score, round(min(score), 6) AS min_score, round(max(score), 6) AS max_score, round(stddev_pop(score), 6) AS std_score, count(DISTINCT level) AS n_levels, count(*) FILTER (WHERE score < 0.1) AS n_unmatched, CAST(coalesce(sum(sa) FILTER (WHERE score < 0.1), 0) AS BIGINT) AS unmatched_cells FROM k")
def correspondence_report(spark, d):
    return rounded(CT.correspondence(CT.partition_match(truth(spark, d), _levels(spark, d))), "mean_score", "min_score", "max_score", "std_score")


def _assignment_sql(clusters: int) -> str:
    """Best one-to-one map of the clusters 0, 1, .. to labels: over the sets of labels that the first i clusters take."""
    step = "s{b} AS MATERIALIZED (SELECT mask | (1::BIGINT << i) AS mask, max(v + w) AS v, arg_max(list_append(path, i), v + w) AS path FROM s{a} JOIN w ON cluster = {a} AND mask & (1::BIGINT << i) = 0 GROUP BY 1)"
    return f"""{_SCORES}, w AS MATERIALIZED (SELECT cluster, dense_rank() OVER (ORDER BY class) - 1 AS i, (n / sa + n / sb) / 2 AS w FROM f WHERE res_id = 3), names AS (SELECT list(class ORDER BY class) AS names FROM a),
    s0 AS (SELECT 0::BIGINT AS mask, 0.0::DOUBLE AS v, []::BIGINT[] AS path), {", ".join(step.format(a=c, b=c + 1) for c in range(clusters))}, best AS (SELECT arg_max(path, v) AS path FROM s{clusters})"""


@query(f"WITH {_assignment_sql(8)} SELECT id, CAST(names[path[cluster + 1] + 1] AS INTEGER) AS cluster FROM lab, best, names WHERE res_id = 3")
def assign_consistently(spark, d):
    return CT.assign_consistently(truth(spark, d), codes(spark, d).where("res_id = 3").select("id", "cluster"))


# --- annotation -------------------------------------------------------------------------------------------------------

_RULES = [("1", "0", "A"), ("2", "3", "B"), ("3", "5", "A"), ("3", "7", "C"), ("2", "1", "unknown")]
_RULES_SQL = "rules AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{c if c != 'unknown' else 'unassigned'}')" for a, b, c in _RULES) + ") t(res_key, cluster, label))"


def rules(spark) -> DataFrame:
    return spark.createDataFrame(_RULES, "res_key string, cluster string, label string")


def _keyed(spark, d) -> DataFrame:
    return codes(spark, d).withColumnRenamed("res_id", "res_key")


_VOTES = f"""{P}, {CODES}, {_RULES_SQL}, h AS (SELECT id, label AS class, sum(1.0::DOUBLE) AS p FROM lab JOIN rules ON CAST(lab.res_id AS VARCHAR) = rules.res_key AND CAST(lab.cluster AS VARCHAR) = rules.cluster GROUP BY ALL),
    r AS (SELECT p.id, 'unassigned' AS class, greatest(1 - coalesce(sum(h.p), 0), 0) AS p FROM p LEFT JOIN h ON h.id = p.id GROUP BY p.id), v AS (SELECT id, class, sum(p) AS p FROM (SELECT * FROM h UNION ALL SELECT * FROM r) GROUP BY ALL)"""


@query(f"WITH {P}, {CODES} SELECT id, CASE cluster WHEN 0 THEN 'A' WHEN 3 THEN 'B' ELSE 'unassigned' END AS label FROM lab WHERE res_id = 2")
def annotate_map(spark, d):
    r = spark.createDataFrame([("0", "A"), ("3", "B")], "cluster string, label string")
    return A.apply_rules(codes(spark, d).where("res_id = 2"), r)


@query(f"WITH {_VOTES} SELECT id, class, round(p / sum(p) OVER (PARTITION BY id), 6) AS p FROM v")
def annotate_hier(spark, d):
    return rounded(A.annotate_hierarchical(_keyed(spark, d), rules(spark)), "p")


@query(f"WITH {_VOTES}, n AS (SELECT id, class, p / sum(p) OVER (PARTITION BY id) AS p FROM v) SELECT id, " + ", ".join(f"round(coalesce(sum(p) FILTER (WHERE class = '{c}'), 0), 6) AS \"{c}\"" for c in ("A", "B", "C", "unassigned")) + " FROM n GROUP BY id")
def annotate_hier_wide(spark, d):
    classes = ["A", "B", "C", "unassigned"]
    return rounded(wide(A.annotate_hierarchical(_keyed(spark, d), rules(spark)), classes), *classes)


@query(f"WITH {_VOTES}, m AS (SELECT id, max(p) AS top FROM v GROUP BY id) SELECT v.id, CASE WHEN count(*) = 1 THEN min(class) ELSE 'unassigned' END AS label FROM v JOIN m ON m.id = v.id AND v.p = m.top GROUP BY v.id")
def predict_vote(spark, d):
    return A.predict_vote(_keyed(spark, d), rules(spark))


@query(f"WITH {_VOTES} SELECT id, class AS label, round(p, 6) AS p FROM (SELECT id, class, p / sum(p) OVER (PARTITION BY id) AS p FROM v) QUALIFY row_number() OVER (PARTITION BY id ORDER BY p DESC, class) = 1")
def dominant_class(spark, d):
    return rounded(A.dominant(A.annotate_hierarchical(_keyed(spark, d), rules(spark))), "p")


def _start(spark, d) -> DataFrame:
    return one_hot(truth(spark, d), "id", "cluster")


_WALK = f"{EDGES}, w AS (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS w FROM e), s0 AS (SELECT id, CAST(label AS VARCHAR) AS class, 1.0::DOUBLE AS p FROM p)"
_STEP = "s{b} AS (SELECT id, class, sum(p) AS p FROM (SELECT src AS id, class, {alpha} * w * p AS p FROM w JOIN s{a} ON s{a}.id = w.dst UNION ALL SELECT id, class, (1 - {alpha}) * p FROM s0) GROUP BY ALL)"


@query(f"WITH {_WALK} SELECT src AS id, class, round(sum(w * p), 6) AS p FROM w JOIN s0 ON s0.id = w.dst GROUP BY ALL")
def propagate_k1(spark, d):
    return rounded(A.propagate(weighted_edges(spark, d), _start(spark, d)), "p")


@query(f"WITH {_WALK}, " + ", ".join(_STEP.format(a=i, b=i + 1, alpha=0.9) for i in range(3)) + " SELECT id, class, round(p, 6) AS p FROM s3")
def propagate_k3(spark, d):
    return rounded(A.propagate(weighted_edges(spark, d), _start(spark, d), 3), "p")


_GAP = "SELECT {b} AS i, max(abs(gap)) AS gap FROM (SELECT sum(p) AS gap FROM (SELECT id, class, p FROM s{b} UNION ALL SELECT id, class, -p FROM s{a}) GROUP BY id, class)"
_UNTIL = _WALK.replace(", w AS (", ", w AS MATERIALIZED (") + ", s1 AS MATERIALIZED (SELECT src AS id, class, sum(w * p) AS p FROM w JOIN s0 ON s0.id = w.dst GROUP BY ALL), "
_UNTIL += ", ".join(_STEP.format(a=i, b=i + 1, alpha=0.5).replace(" AS (", " AS MATERIALIZED (", 1) for i in range(1, 12)) + ", gaps AS (" + " UNION ALL ".join(_GAP.format(a=i, b=i + 1) for i in range(1, 12)) + ")"
_UNTIL += ", stop AS (SELECT coalesce(min(i) FILTER (WHERE gap < 1e-3), 12) AS i FROM gaps), steps AS (" + " UNION ALL ".join(f"SELECT {i} AS i, id, class, p FROM s{i}" for i in range(1, 13)) + ")"


@query(f"WITH {_UNTIL} SELECT id, class, round(p, 6) AS p FROM steps JOIN stop USING (i)")
def propagate_converge(spark, d):
    return rounded(A.propagate_until(weighted_edges(spark, d), _start(spark, d), 12, 1e-3, 0.5)[0], "p")


@query("SELECT c_custkey AS id, CASE WHEN c_nationkey % 5 = 0 THEN NULL ELSE CAST(c_nationkey AS VARCHAR) END AS label FROM customer")
def missing_labels(spark, d):
    v = F.when(F.col("c_nationkey") % 10 == 0, "Unknown").when(F.col("c_nationkey") % 5 == 0, "NA").otherwise(F.col("c_nationkey").cast("string"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), normalise_missing(v).alias("label"))


@query("SELECT label, 'L' || label || '_C' || count(*) AS level_name, 'R' || label || '_C' || count(*) AS resolution_name FROM embeddings GROUP BY label")
def cluster_names(spark, d):
    c = truth(spark, d).groupBy(F.col("cluster").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return c.select("label", level_name(F.col("label"), F.col("n")).alias("level_name"), resolution_name(F.col("label"), F.col("n")).alias("resolution_name"))


# --- graph quality --------------------------------------------------------------------------------------------------------

_MOD = f"{EDGES}, g AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, sum(weight) AS w FROM e GROUP BY 1, 2), m AS (SELECT sum(w) AS m FROM g), x AS (SELECT w, i.label AS la, j.label AS lb FROM g JOIN p i ON i.id = a JOIN p j ON j.id = b), k AS (SELECT l, sum(w) AS d FROM (SELECT la AS l, w FROM x UNION ALL SELECT lb, w FROM x) GROUP BY l)"
_MOD_VALUE = "round((SELECT sum(w) FROM x WHERE la = lb) / m - (SELECT sum((d / (2 * m)) * (d / (2 * m))) FROM k), 6) AS modularity"


@query(f"WITH {_MOD} SELECT {_MOD_VALUE} FROM m")
def modularity(spark, d):
    return rounded(CM.modularity(weighted_edges(spark, d), truth(spark, d)), "modularity")


@query(f"WITH {_MOD} SELECT (SELECT count(DISTINCT label) FROM p) AS n_clusters, 0::BIGINT AS n_noise, {_MOD_VALUE} FROM m")
def cluster_counts(spark, d):
    return rounded(CM.clustering_metrics(weighted_edges(spark, d), truth(spark, d)), "modularity")


def _grid(spark, d, method: str, **kw) -> DataFrame:
    return CM.communities(E.symmetrise(weighted_edges(spark, d)), [0.5, 1.0], 2, method, **kw).select("res_id", "rep", "id", "cluster")


@query()
def leiden(spark, d):
    return _grid(spark, d, "leiden")


@query()
def leiden_cpm(spark, d):
    return CM.communities(E.symmetrise(weighted_edges(spark, d)), [0.05], 1, "leiden", "cpm").select("id", "cluster")


@query()
def leiden_rber(spark, d):
    return CM.communities(E.symmetrise(weighted_edges(spark, d)), [1.0], 1, "leiden", "rber").select("id", "cluster")


@query()
def leiden_surprise(spark, d):
    return CM.communities(E.symmetrise(weighted_edges(spark, d)), [1.0], 1, "leiden", "surprise").select("id", "cluster")


@query()
def louvain(spark, d):
    return _grid(spark, d, "louvain")


@query()
def louvain_distributed(spark, d):
    return CM.louvain_distributed(E.symmetrise(weighted_edges(spark, d)))


def _multi(spark, d, method: str) -> MR.MultiresolutionClustering:
    return MR.MultiresolutionClustering(method, [0.5, 1.0, 2.0], None, n_repetitions=3).fit(E.symmetrise(weighted_edges(spark, d)))


@query()
def multires_leiden(spark, d):
    return _multi(spark, d, "leiden").labels


@query()
def multires_louvain(spark, d):
    return _multi(spark, d, "louvain").labels


def _partition(labels: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_points, n_twice (points with two clusters) and n_split (clusters that aren't connected by their own edges)."""
    labels = cut(labels.select(*keys, "id", "cluster"), "labels")
    counts = labels.groupBy(*keys).agg(F.count_distinct("id").alias("n_points"), (F.count(F.lit(1)) - F.count_distinct("id")).alias("n_twice"), F.count_distinct("cluster").alias("k"))
    name = F.concat_ws("/", *[F.col(c).cast("string") for c in keys], "id")
    node = labels.select(F.xxhash64(name).alias("node"), "id", "cluster", *keys)
    a = node.select(*keys, F.col("id").alias("src"), F.col("cluster").alias("ca"), F.col("node").alias("a"))
    b = node.select(*keys, F.col("id").alias("dst"), F.col("cluster").alias("cb"), F.col("node").alias("b"))
    own = edges.select("src", "dst").join(a, "src").join(b, [*keys, "dst"]).where("ca = cb")
    forest = H.single_linkage_forest(own.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(0.0).alias("distance")))
    bonds = forest.join(node.select(F.col("node").alias("src"), *keys), "src").groupBy(*keys).agg(F.count(F.lit(1)).alias("bonds"))
    out = counts.join(bonds, keys, "left") if keys else counts.join(bonds)
    return out.select(*keys, "n_points", "n_twice", (F.col("n_points") - F.coalesce("bonds", F.lit(0)) - F.col("k")).alias("n_split"))


_RUNS = "SELECT CAST(r AS INTEGER) AS res_id, CAST(q AS INTEGER) AS rep, (SELECT count(*) FROM embeddings) AS n_points, 0::BIGINT AS n_twice, 0::BIGINT AS n_split FROM range(2) a(r), range(2) b(q)"
_WHOLE = "SELECT count(*) AS n_points, 0::BIGINT AS n_twice, 0::BIGINT AS n_split FROM embeddings"


@query(_RUNS)
def leiden_partition(spark, d):
    """Every run gives each point one cluster, and Leiden's clusters are connected."""
    return _partition(leiden(spark, d), weighted_edges(spark, d), ["res_id", "rep"])


@query(_WHOLE)
def leiden_cpm_partition(spark, d):
    return _partition(leiden_cpm(spark, d), weighted_edges(spark, d), [])


@query(_WHOLE)
def leiden_rber_partition(spark, d):
    return _partition(leiden_rber(spark, d), weighted_edges(spark, d), [])


@query(_WHOLE)
def leiden_surprise_partition(spark, d):
    return _partition(leiden_surprise(spark, d), weighted_edges(spark, d), [])


@query(f"SELECT res_id, rep, n_points, n_twice FROM ({_RUNS})")
def louvain_partition(spark, d):
    return _partition(louvain(spark, d), weighted_edges(spark, d), ["res_id", "rep"]).drop("n_split")


@query("SELECT count(*) AS n_points, 0::BIGINT AS n_twice FROM embeddings")
def louvain_distributed_partition(spark, d):
    return _partition(louvain_distributed(spark, d), weighted_edges(spark, d), []).drop("n_split")


@query("SELECT CAST(r AS INTEGER) AS res_id, (SELECT count(*) FROM embeddings) AS n_points, 0::BIGINT AS n_twice FROM range(3) a(r)")
def multires_leiden_partition(spark, d):
    return _partition(multires_leiden(spark, d), weighted_edges(spark, d), ["res_id"]).drop("n_split")


@query("SELECT CAST(r AS INTEGER) AS res_id, (SELECT count(*) FROM embeddings) AS n_points, 0::BIGINT AS n_twice FROM range(3) a(r)")
def multires_louvain_partition(spark, d):
    return _partition(multires_louvain(spark, d), weighted_edges(spark, d), ["res_id"]).drop("n_split")


@query("SELECT 1::BIGINT AS res_id, TRUE AS better")
def leiden_modularity_gain(spark, d):
    """At resolution 1 the objective is modularity, so the communities' modularity is above that of the given labels."""
    edges = E.symmetrise(weighted_edges(spark, d))
    base = CM.modularity(edges, truth(spark, d)).first()["modularity"]
    own = leiden(spark, d).where("rep = 0 and res_id = 1").select("res_id", "id", "cluster")
    return CM.clustering_metrics(edges, own, ["res_id"]).select(F.col("res_id").cast("bigint").alias("res_id"), (F.col("modularity") > base).alias("better"))


@query(f"""WITH {P}, {CODES}, c AS (SELECT res_id, count(DISTINCT cluster) AS n FROM lab GROUP BY 1)
    SELECT count(*) AS n_successful, min(n) AS min_clusters, max(n) AS max_clusters, string_agg(CAST(n AS VARCHAR), ',' ORDER BY res_id) AS n_clusters, round(min(1.0 / n), 6) AS min_consistency, round(max(1.0 / n), 6) AS max_consistency,
      round(avg(1.0 / n), 6) AS mean_consistency, max(res_id) / 10 AS best_n_clusters, max(res_id) / 10 AS best_modularity, min(res_id) / 10 AS best_consistency, 0 AS n_failed FROM c""")
def resolution_range_summary(spark, d):
    """The summary of a range of resolutions, on tables whose values are known."""
    m = codes(spark, d).groupBy("res_id").agg(F.count_distinct("cluster").alias("n_clusters"))
    m = m.withColumn("resolution", F.col("res_id") / 10).withColumn("modularity", F.col("res_id") / 7)
    out = MR.range_summary(m, m.select("res_id", (1 / F.col("n_clusters")).alias("mean")))
    return rounded(out.withColumn("n_clusters", F.array_join("n_clusters", ",")), "min_consistency", "max_consistency", "mean_consistency")


@query()
def resolution_changes(spark, d):
    """Resolutions at which the number of clusters changes, by bisection."""
    found = MR.resolution_profile(E.symmetrise(weighted_edges(spark, d)), 0.2, 1.0, width=0.1)
    return spark.createDataFrame([(x,) for x in found], "resolution double")


@query()
def resolution_summary(spark, d):
    return _multi(spark, d, "leiden").summary()


@query("SELECT * FROM (VALUES (0.0::DOUBLE), (0.4), (0.8), (1.0)) t(resolution)")
def resolution_midpoints(spark, d):
    return MR.midpoints(spark.createDataFrame([(0.2,), (0.6,)], "resolution double"), 0, 1)


@query(f"WITH {P}, {CODES}, c AS (SELECT res_id, count(DISTINCT cluster) AS n_clusters FROM lab GROUP BY 1) SELECT res_id / 10 AS resolution, n_clusters FROM c UNION ALL SELECT 0.4, 8 WHERE FALSE")
def skip_repeated_counts(spark, d):
    c = codes(spark, d).groupBy((F.col("res_id") / 10).alias("resolution")).agg(F.count_distinct("cluster").alias("n_clusters"))
    more = c.where("resolution = 0.3").withColumn("resolution", F.lit(0.4))
    return MR.skip_repeated_counts(c.unionByName(more))


# --- tracks ---------------------------------------------------------------------------------------------------------------


def _runs3(spark, d) -> DataFrame:
    """Three labelings with the same clusters but for every seventh row, as repetitions."""
    c = codes(spark, d).where("res_id = 2").select("id", "cluster")
    out = None
    for r in range(3):
        moved = F.when((F.col("id") % 7 == r) & (F.lit(r) > 0), (F.col("cluster") + 1) % 4).otherwise(F.col("cluster"))
        part = c.select(F.lit(r).alias("rep"), "id", moved.cast("int").alias("cluster"))
        out = part if out is None else out.unionByName(part)
    return out


_RUNS3 = f"{P}, {CODES}, r AS (SELECT CAST(g AS INTEGER) AS rep, id, CASE WHEN id % 7 = g AND g > 0 THEN (cluster + 1) % 4 ELSE cluster END AS cluster FROM lab, range(3) t(g) WHERE res_id = 2)"


@query(f"WITH {_RUNS3}, c AS (SELECT id, cluster, count(*) AS n FROM r GROUP BY ALL) SELECT id, round(max(n) / 3, 6) AS confidence FROM c GROUP BY id")
def cell_confidence(spark, d):
    return rounded(TR.confidence(_runs3(spark, d)), "confidence")


@query(f"WITH {_RUNS3}, f AS (SELECT cluster, dense_rank() OVER (ORDER BY cluster) - 1 AS t FROM (SELECT DISTINCT cluster FROM r)) SELECT CAST(t AS INTEGER) AS track_id, rep, r.cluster FROM r JOIN f ON f.cluster = r.cluster GROUP BY ALL")
def cluster_tracks(spark, d):
    return TR.cluster_tracks(_runs3(spark, d))


@query(f"""WITH {_RUNS3}, z AS (SELECT rep, cluster, count(*) AS s FROM r GROUP BY ALL), i AS (SELECT a.cluster, a.rep AS ra, b.rep AS rb, count(*) AS n FROM r a JOIN r b ON a.id = b.id AND a.rep < b.rep AND a.cluster = b.cluster GROUP BY ALL),
    j AS (SELECT x.cluster, coalesce(n, 0) / (x.s + y.s - coalesce(n, 0)) AS j FROM z x JOIN z y ON x.cluster = y.cluster AND x.rep < y.rep LEFT JOIN i ON i.cluster = x.cluster AND ra = x.rep AND rb = y.rep), f AS (SELECT cluster, dense_rank() OVER (ORDER BY cluster) - 1 AS t FROM (SELECT DISTINCT cluster FROM r)),
    m AS (SELECT cluster, avg(j) AS a, stddev_pop(j) AS b FROM j GROUP BY 1), k AS (SELECT cluster, count(*) AS c, avg(s) AS u, stddev_pop(s) AS v FROM z GROUP BY 1)
    SELECT CAST(t AS INTEGER) AS track_id, round(a, 6) AS mean_consistency, round(b, 6) AS std_consistency, round(c / 3, 6) AS stability, round(c / 3, 6) AS coverage, round(u, 6) AS mean_size, round(v, 6) AS std_size, CAST(c AS INTEGER) AS occurrences FROM m JOIN k USING (cluster) JOIN f USING (cluster)""")
def track_consistency(spark, d):
    r = _runs3(spark, d)
    return rounded(TR.track_consistency(r, TR.cluster_tracks(r)), "mean_consistency", "std_consistency", "stability", "coverage", "mean_size", "std_size")


@query(f"WITH {_RUNS3}, f AS (SELECT cluster, dense_rank() OVER (ORDER BY cluster) - 1 AS t FROM (SELECT DISTINCT cluster FROM r)) SELECT id, CAST(t AS INTEGER) AS cluster FROM r JOIN f ON f.cluster = r.cluster WHERE rep = 0")
def final_labels(spark, d):
    r = _runs3(spark, d)
    return TR.final_labels(r, TR.cluster_tracks(r))


# --- co-association -------------------------------------------------------------------------------------------------------


def runs(spark, d) -> DataFrame:
    s = splits(spark, d).where("is_train").join(codes(spark, d), "id")
    return s.where(F.col("res_id") == F.col("split_id") % 3 + 1).select(F.col("split_id").alias("run"), "id", "cluster")


def _cut_runs(spark, d) -> DataFrame:
    return cut(runs(spark, d), "runs")


def rounded_share(df: DataFrame, column: str) -> DataFrame:
    """The same as rounded() for shares of at most 63 runs, none of which lies half-way between two roundings; by arithmetic, as
    there are many."""
    return df.withColumn(column, F.rint(F.col(column) * 1e6) / 1e6)


@query(f"WITH {RUNS} SELECT src, dst, round(weight, 6) AS weight FROM c")
def coassoc(spark, d):
    return rounded_share(CO.coassociation(_cut_runs(spark, d)), "weight")


@query(f"WITH {RUNS} SELECT src, dst, round(1 - weight, 6) AS weight FROM c WHERE weight IS NOT NULL")
def coassoc_distance(spark, d):
    return rounded_share(CO.distances(CO.coassociation(_cut_runs(spark, d))), "weight")


@query(f"WITH {RUNS} SELECT a.id AS src, b.id AS dst, round(1 - coalesce(weight, 0), 6) AS distance FROM p a JOIN p b ON a.id < b.id LEFT JOIN c ON c.src = a.id AND c.dst = b.id")
def coassoc_dense(spark, d):
    return rounded_share(CO.dense_distances(None, points(spark, d), runs=_cut_runs(spark, d)), "distance")


@query(f"""WITH {RUNS}, z AS (SELECT label AS cluster, count(*) AS n FROM p GROUP BY 1), t AS (SELECT count(*) AS t FROM p),
    w AS (SELECT i.label AS cluster, coalesce(sum(weight) FILTER (WHERE i.label = j.label), 0) AS win, coalesce(sum(weight) FILTER (WHERE i.label <> j.label), 0) AS acr FROM cf JOIN p i ON i.id = src JOIN p j ON j.id = dst GROUP BY 1),
    v AS (SELECT cluster, n AS size, 1 - win / (n * (n - 1)) AS a, 1 - acr / (n * (t - n)) AS b FROM z JOIN w USING (cluster), t)
    SELECT cluster, size, round(CASE WHEN b > a THEN (b - a) / greatest(a, b) ELSE 0 END, 6) AS stability FROM v""")
def cluster_stability(spark, d):
    return rounded(CO.cluster_stability(None, truth(spark, d), runs=_cut_runs(spark, d)), "stability")


@query(f"""WITH {RUNS}, z AS (SELECT label AS cluster, count(*) AS n FROM p GROUP BY 1), t AS (SELECT count(*) AS t FROM p),
    w AS (SELECT i.label AS cluster, coalesce(sum(weight) FILTER (WHERE i.label = j.label), 0) AS win, coalesce(sum(weight) FILTER (WHERE i.label <> j.label), 0) AS acr FROM cf JOIN p i ON i.id = src JOIN p j ON j.id = dst GROUP BY 1),
    v AS (SELECT cluster, win / (n * (n - 1)) AS a, acr / (n * (t - n)) AS b FROM z JOIN w USING (cluster), t) SELECT cluster, round(a / (a + b), 6) AS stability FROM v""")
def similarity_stability(spark, d):
    return rounded(CO.similarity_stability(None, truth(spark, d), runs=_cut_runs(spark, d)), "stability")


@query(f"""WITH {RUNS}, z AS (SELECT label AS cluster, count(*) AS n FROM p GROUP BY 1), w AS (SELECT src AS id, j.label AS cluster, sum(weight) AS s FROM cf JOIN p j ON j.id = dst GROUP BY ALL),
    v AS (SELECT w.id, w.cluster, s / (n - CASE WHEN p.label = w.cluster THEN 1 ELSE 0 END) AS m FROM w JOIN z USING (cluster) JOIN p ON p.id = w.id WHERE s > 0) SELECT id, cluster, round(m / sum(m) OVER (PARTITION BY id), 6) AS p FROM v""")
def soft_membership(spark, d):
    return rounded(CO.soft_membership(None, truth(spark, d), runs=_cut_runs(spark, d)), "p")


_GROUPS = [(1, 0, "left"), (3, 7, "right"), (2, 3, "right")]
_ASSIGN = f"""{RUNS}, g AS (SELECT * FROM (VALUES (1, 0, 'left'), (3, 7, 'right'), (2, 3, 'right')) t(level, cluster, grp)), ch AS (SELECT DISTINCT grp, id FROM lab JOIN g ON g.level = lab.res_id AND g.cluster = lab.cluster), z AS (SELECT grp, count(*) AS n FROM ch GROUP BY 1),
    al AS (SELECT * FROM cf UNION ALL SELECT id, id, 1 FROM p), w AS (SELECT src AS id, grp, sum(weight) AS s FROM al JOIN ch ON ch.id = dst GROUP BY ALL), v AS (SELECT id, grp, s / n AS m FROM w JOIN z USING (grp))"""


@query(f'WITH {_ASSIGN} SELECT id, grp AS "group", round(m / sum(m) OVER (PARTITION BY id), 6) AS p FROM v')
def assignment_prob(spark, d):
    g = spark.createDataFrame(_GROUPS, "level int, cluster int, group string")
    return rounded(CO.assignment_probability(None, _levels(spark, d), g, runs=_cut_runs(spark, d)), "p")


@query(f"""WITH {_ASSIGN} SELECT id, grp AS "group", round(m, 6) AS p FROM v UNION ALL SELECT p.id, 'none', round(greatest(1 - coalesce(sum(m), 0), 0), 6) FROM p LEFT JOIN v ON v.id = p.id GROUP BY p.id""")
def assignment_prob_unassigned(spark, d):
    g = spark.createDataFrame(_GROUPS, "level int, cluster int, group string")
    return rounded(CO.assignment_probability(None, _levels(spark, d), g, unassigned="none", runs=_cut_runs(spark, d)), "p")


# --- hierarchy ------------------------------------------------------------------------------------------------------------

_OVER = f"{P}, {CODES}, o AS (SELECT a.res_id AS level, a.cluster AS parent, b.cluster AS child, count(*) AS n FROM lab a JOIN lab b ON a.id = b.id AND b.res_id = a.res_id + 1 GROUP BY ALL), z AS (SELECT res_id AS level, cluster, count(*) AS s FROM lab GROUP BY ALL)"


@query(f"WITH {_OVER} SELECT level, cluster, 'L' || level || '_C' || cluster AS name, s AS size FROM z")
def hierarchy_nodes(spark, d):
    return H.hierarchy_nodes(_levels(spark, d))


@query(f"WITH {_OVER} SELECT o.level, parent, CAST(o.level + 1 AS INTEGER) AS next_level, child, n AS overlap, round(n / s, 6) AS weight FROM o JOIN z ON z.level = o.level AND z.cluster = parent")
def hierarchy_edges_weight(spark, d):
    return rounded(H.hierarchy_edges(_levels(spark, d)), "weight")


_JAC = f"{_OVER}, j AS (SELECT a.level, a.cluster AS parent, b.cluster AS child, coalesce(n, 0) / (a.s + b.s - coalesce(n, 0)) AS weight FROM z a JOIN z b ON b.level = a.level + 1 LEFT JOIN o ON o.level = a.level AND o.parent = a.cluster AND o.child = b.cluster)"


@query(f"WITH {_JAC} SELECT level, parent, child, round(weight, 6) AS weight FROM j")
def hierarchy_edges_jaccard(spark, d):
    return rounded(H.jaccard_edges(_levels(spark, d)), "weight")


@query(f"WITH {_JAC} SELECT level, parent, child, round(weight, 6) AS weight FROM j QUALIFY row_number() OVER (PARTITION BY level, child ORDER BY weight DESC, parent) = 1")
def strongest_parent(spark, d):
    e = H.jaccard_edges(_levels(spark, d))
    e = e.select(F.col("parent").alias("src"), F.struct("level", "child").alias("dst"), "weight")
    return rounded(E.strongest(e).select("dst.level", F.col("src").alias("parent"), "dst.child", "weight"), "weight")


def _grouped(spark, d) -> dict[str, DataFrame]:
    """Co-association distances of all points, those of equal points once."""
    members, distances = CO.grouped_distances(_cut_runs(spark, d), points(spark, d))
    return {"distances": distances, "members": members}


@query()
def linkage_average(spark, d):
    return rounded(H.linkage(**_grouped(spark, d), method="average"), "distance")


@query("SELECT count(*) - 1 AS n_merges, count(*) AS last_size, 0::BIGINT AS n_falling FROM embeddings")
def linkage_average_merges(spark, d):
    """Average linkage merges all points, one merge at a time, at heights that never fall."""
    before = F.lag("distance").over(Window.orderBy("step"))
    rows = H.linkage(**_grouped(spark, d), method="average").withColumn("before", before)
    return rows.agg(F.count(F.lit(1)).alias("n_merges"), F.max("size").alias("last_size"), F.count_if(F.col("distance") < F.col("before") - 1e-9).alias("n_falling"))


@query("SELECT CAST(l AS INTEGER) AS level, count(*) AS n_points, 1::BIGINT << l AS asked FROM embeddings, range(3) t(l) GROUP BY l")
def linkage_cut_levels(spark, d):
    """The levels with 1, 2 and 4 clusters: every point has one cluster, and no level has more clusters than asked for."""
    rows = H.hierarchical(**_grouped(spark, d), method="average", strategy="powers_of_2", max_levels=2).groupBy("level").agg(F.count_distinct("id").alias("n_points"), F.count_distinct("cluster").alias("k"))
    asked = F.expr("shiftleft(1L, level)")
    return rows.where(F.col("k") <= asked).select("level", "n_points", asked.alias("asked"))


@query(f"""WITH RECURSIVE {knn_sql(5)}, g AS (SELECT src, dst FROM knn UNION SELECT dst, src FROM knn), r AS (SELECT id AS a, id AS b FROM p UNION SELECT r.a, g.dst FROM r JOIN g ON g.src = r.b), c AS (SELECT a, min(b) AS c FROM r GROUP BY a)
    SELECT count(*) - count(DISTINCT c) AS n_edges, count(*) - count(DISTINCT c) AS n_joined FROM c""")
def single_linkage_forest_size(spark, d):
    """A spanning forest has an edge less than points in each component."""
    f = cut(single_linkage_forest(spark, d), "forest")
    n = H.single_linkage_forest(f).agg(F.count(F.lit(1)).alias("n_joined"))
    return f.agg(F.count(F.lit(1)).alias("n_edges")).join(n)


@query(f"WITH {P}, r AS (SELECT label, id, x[1] AS v, row_number() OVER (PARTITION BY label ORDER BY x[1], id) - 1 AS k FROM p) SELECT label, id, round(k * 0.05 + max(v - k * 0.05) OVER (PARTITION BY label ORDER BY k), 6) AS position FROM r")
def spaced_positions(spark, d):
    rows = points(spark, d).join(truth(spark, d), "id").select("id", F.col("cluster").alias("label"), F.col("features")[0].alias("x"))
    return rounded(H.spaced(rows, 0.05, ["label"]).select("label", "id", "position"), "position")


@query(f"WITH {P}, r AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS k, count(*) OVER () - 1 AS m FROM (SELECT DISTINCT label FROM p)) SELECT label FROM r WHERE m < 3 OR k IN (SELECT CAST(floor(i * m / 2 + 0.5) AS BIGINT) FROM range(3) t(i))")
def even_picks(spark, d):
    return PF.representatives(truth(spark, d).select(F.col("cluster").alias("label")).distinct(), "label", 3)


@query()
def linkage_cut(spark, d):
    return H.hierarchical(**_grouped(spark, d), method="average", strategy="powers_of_2")


@query()
def linkage_cut_natural(spark, d):
    return H.hierarchical(**_grouped(spark, d), method="complete", strategy="natural", max_levels=8)


@query(f"""WITH {knn_sql(10)}, g AS (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, min(distance) AS distance FROM knn GROUP BY 1, 2) SELECT count(*) AS n_edges, count(DISTINCT src) AS n_src FROM g""")
def neighbour_graph_size(spark, d):
    g = N.knn(points(spark, d), 10).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    return g.agg(F.count(F.lit(1)).alias("n_edges"), F.count_distinct("src").alias("n_src"))


@query()
def single_linkage_forest(spark, d):
    return rounded(H.single_linkage_forest(N.knn(points(spark, d), 5)), "distance")


@query()
def dendrogram_blocks(spark, d):
    own = _grouped(spark, d)
    return PF.bar_blocks(H.dendrogram_order(**own), H.hierarchical(**own, method="average", strategy="linear", max_levels=4))


# --- profiles -------------------------------------------------------------------------------------------------------------


def expression(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem").withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return PF.to_long(li, ["l_quantity", "l_extendedprice", "l_discount"])


def line_labels(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.concat("l_returnflag", "l_linestatus").alias("cluster"))


_LONG = """w AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_returnflag || l_linestatus AS cluster, l_quantity, l_extendedprice, l_discount FROM lineitem),
    x AS (SELECT w.id, unnest([l_quantity, l_extendedprice, l_discount]) AS value, unnest(['l_quantity', 'l_extendedprice', 'l_discount']) AS property FROM w), y AS (SELECT x.id, property, value, w.cluster FROM x JOIN w ON x.id = w.id)"""


def _profile(statistic: str, sql: str) -> None:
    def run(spark, d):
        return rounded(PF.cluster_profile(expression(spark, d), line_labels(spark, d), statistic), "value", "scaled")

    run.__name__ = f"cluster_profile_{statistic}"
    query(f"""WITH {_LONG}, g AS (SELECT cluster, property, {sql}(value) AS v FROM y GROUP BY ALL) SELECT cluster, property, round(v, 6) AS value,
        round((v - min(v) OVER (PARTITION BY property)) / (max(v) OVER (PARTITION BY property) - min(v) OVER (PARTITION BY property) + 1e-8), 6) AS scaled FROM g""")(run)


for _s, _f in (("mean", "avg"), ("median", "median"), ("sum", "sum")):
    _profile(_s, _f)


@query(f"""WITH {_LONG}, q AS (SELECT 'flag' AS groupby, id, property, value, cluster[1] AS cluster FROM y UNION ALL SELECT 'both', id, property, value, cluster FROM y),
    g AS (SELECT groupby, cluster, property, avg(value) AS m, avg((value > 0)::INT) AS f FROM q GROUP BY ALL),
    h AS (SELECT *, min(m) OVER (PARTITION BY groupby, property) AS lo, max(m) OVER (PARTITION BY groupby, property) AS hi FROM g)
    SELECT groupby, cluster, property, round(m, 6) AS mean, round(f, 6) AS fraction, round(CASE WHEN hi > lo THEN (m - lo) / (hi - lo) ELSE 0 END, 6) AS scaled, round(20 + 180 * f, 6) AS marker FROM h""")
def dotplot(spark, d):
    c = line_labels(spark, d)
    groups = c.select(F.lit("flag").alias("groupby"), "id", F.substring("cluster", 1, 1).alias("cluster")).unionByName(c.select(F.lit("both").alias("groupby"), "id", "cluster"))
    return rounded(PF.dotplot(expression(spark, d), groups), "mean", "fraction", "scaled", "marker")


@query(f"WITH {EDGES}, u AS (SELECT * FROM e WHERE src < dst), m AS (SELECT min(weight) AS a, max(weight) AS b FROM u) SELECT src, dst, round(weight, 6) AS weight, round(0.1 + 1.9 * (weight - a) / (b - a), 6) AS width FROM u, m")
def plot_edges(spark, d):
    return rounded(PF.edge_widths(weighted_edges(spark, d)), "weight", "width")


@query(f"WITH {P} SELECT label AS cluster, round(avg(x[1]), 6) AS x, round(avg(x[2]), 6) AS y FROM p GROUP BY label")
def plot_centroids(spark, d):
    pos = points(spark, d).select("id", F.col("features")[0].alias("x"), F.col("features")[1].alias("y"))
    return rounded(PF.centroids(pos, truth(spark, d)), "x", "y")


@query(f"WITH {P}, {CODES} SELECT res_id, count(DISTINCT cluster) AS n_clusters FROM lab GROUP BY res_id")
def plot_cluster_counts(spark, d):
    return PF.cluster_counts(codes(spark, d), ["res_id"])


@query(f"WITH {P}, {CODES} SELECT cluster, CAST(dense_rank() OVER (ORDER BY cluster) - 1 AS INTEGER) AS colour FROM (SELECT DISTINCT cluster FROM lab)")
def plot_colours(spark, d):
    return PF.colour_index(codes(spark, d))


# --- thinning, decomposition ------------------------------------------------------------------------------------------------


def counts(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.lit("quantity").alias("feature"), F.col("l_quantity").cast("bigint").alias("count"))


@query()
def thin_poisson(spark, d):
    return TH.poisson_split(counts(spark, d))


@query()
def thin_negbin(spark, d):
    return TH.negative_binomial_split(counts(spark, d))


def _thinned(t: DataFrame) -> DataFrame:
    bad = (F.col("train") < 0) | (F.col("test") < 0) | (F.col("train") + F.col("test") != F.col("count"))
    return t.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("train") + F.col("test")).alias("total"), F.count_if(bad).alias("wrong"))


@query("SELECT count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS total, 0::BIGINT AS wrong FROM lineitem")
def thin_negbin_totals(spark, d):
    return _thinned(TH.negative_binomial_split(counts(spark, d)))


@query(f"WITH {P}, {TRAIN} SELECT split_id, count(*) AS n, 3 AS dims, 0::BIGINT AS off_centre FROM s WHERE is_train GROUP BY split_id")
def bootstrap_pca_parts(spark, d):
    """Each split's training part has its own components, which are centred on it."""
    parts, _ = DE.bootstrap_pca(points(spark, d), 3, SPLITS)
    means = [F.abs(F.avg(F.col("features")[i])) for i in range(3)]
    out = parts.groupBy("split_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("features")).alias("dims"), F.greatest(*means).alias("off"))
    return out.select("split_id", "n", "dims", (F.col("off") > 1e-6).cast("bigint").alias("off_centre"))


@query("SELECT count(DISTINCT l_orderkey * 10 + l_linenumber) AS n, CAST(sum(l_quantity) AS BIGINT) AS total FROM lineitem")
def de_split_layers(spark, d):
    """Both layers of a split dataset add up to its counts."""
    t = TH.poisson_split(counts(spark, d))
    both = t.select("id", F.col("train").alias("n")).unionByName(t.select("id", F.col("test").alias("n")))
    return both.agg(F.count_distinct("id").alias("n"), F.sum("n").alias("total"))


@query("SELECT count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS total, 0::BIGINT AS wrong FROM lineitem")
def thin_poisson_totals(spark, d):
    t = TH.poisson_split(counts(spark, d))
    bad = (F.col("train") < 0) | (F.col("test") < 0) | (F.col("train") + F.col("test") != F.col("count"))
    return t.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("train") + F.col("test")).alias("total"), F.count_if(bad).alias("wrong"))


@query()
def pca(spark, d):
    p = points(spark, d)
    return DE.pca(p, 5).transform(p).select("id", F.transform("features", lambda x: F.round(x, 6)).alias("features"))


@query(f"WITH {P}, m AS (SELECT i, avg(x[i]) AS m, var_samp(x[i]) AS v FROM p, range(1, 65) t(i) GROUP BY i) SELECT round(sum(v), 5) AS total_variance FROM m")
def pca_total_variance(spark, d):
    p = points(spark, d)
    total = float(DE.pca(p, 64).explained_variance.sum())
    return spark.createDataFrame([(round(total, 5),)], "total_variance double")


@query(f"WITH {P}, v AS (SELECT id, 0.0::DOUBLE AS z, x FROM p) SELECT count(*) AS n, round(sum(list_inner_product(x, x)), 4) AS energy FROM v")
def svd_energy(spark, d):
    p = points(spark, d)
    t = DE.truncated_svd(p, 64).transform(p)
    square = F.aggregate("features", F.lit(0.0), lambda a, x: a + x * x)
    return t.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(square), 4).alias("energy"))


@query()
def svd(spark, d):
    p = points(spark, d)
    return DE.truncated_svd(p, 5).transform(p)


@query()
def fast_ica(spark, d):
    p = points(spark, d)
    return DE.fast_ica(p, 3).transform(p)


@query()
def kmeans(spark, d):
    return DE.kmeans(points(spark, d))


@query()
def umap_layout(spark, d):
    return DE.umap_layout(E.symmetrise(weighted_edges(spark, d)))


@query()
def tsne_layout(spark, d):
    return DE.tsne(points(spark, d))


# --- composites -------------------------------------------------------------------------------------------------------------


def dataset(spark, d) -> Dataset:
    return from_parquet(spark, f"{d}/embeddings.parquet", "vec_id", "embedding", ["label"])


@query(f"WITH {_FUZZY.format(_SUM)}, u AS (SELECT src, dst, p, 0.0::DOUBLE AS o FROM q UNION ALL SELECT dst, src, 0.0::DOUBLE, p FROM q), g AS (SELECT src, dst, sum(p) AS p, sum(o) AS o FROM u GROUP BY ALL), f AS (SELECT src, dst, least(greatest(p + o - p * o, 0), 1) AS w FROM g) SELECT src, dst, round(w / sum(w) OVER (PARTITION BY src), 5) AS weight FROM f")
def pp_neighbors_transitions(spark, d):
    return pp.neighbors(dataset(spark, d), 15).obsp["transitions"].withColumn("weight", F.round("weight", 5))


_BOTH_WAYS = "v AS (SELECT src, dst, hits / n AS w FROM h JOIN pot USING (src, dst) WHERE src <> dst) SELECT src, dst, round(max(w), 6) AS weight FROM (SELECT src, dst, w FROM v UNION ALL SELECT dst, src, w FROM v) GROUP BY ALL"


@query(f"WITH {_SPLIT_KNN}, h AS (SELECT src, dst, count(*) AS hits FROM k GROUP BY ALL), {_BOTH_WAYS}")
def pp_consensus_neighbors(spark, d):
    return rounded(pp.consensus_neighbors(dataset(spark, d), 15, SPLITS).obsp["connectivities"], "weight")


@query(f"WITH {knn_sql(15, include_self=True)}, m AS (SELECT a.src, a.dst FROM knn a JOIN knn b ON a.src = b.dst AND a.dst = b.src) SELECT src, dst, 1.0::DOUBLE AS weight FROM m WHERE src <> dst")
def pp_mutual_neighbors(spark, d):
    return rounded(pp.mutual_neighbors(dataset(spark, d), 15).obsp["connectivities"], "weight")


@query(f"WITH {_SPLIT_KNN}, h AS (SELECT a.src, a.dst, count(*) AS hits FROM k a JOIN k b ON a.split_id = b.split_id AND a.src = b.dst AND a.dst = b.src GROUP BY ALL), {_BOTH_WAYS}")
def pp_consensus_mutual_neighbors(spark, d):
    return rounded(pp.consensus_mutual_neighbors(dataset(spark, d), 15, SPLITS).obsp["connectivities"], "weight")


@query()
def pp_coassociation(spark, d):
    return rounded_share(pp.coassociation_matrix(dataset(spark, d), 3, use_rep="X").obsp["coassociation_connectivities"], "weight")


@query("SELECT count(*) AS n_points, 0::BIGINT AS n_twice FROM embeddings")
def tl_louvain_partition(spark, d):
    data = tl.louvain(dataset(spark, d), 0.5, adjacency=E.symmetrise(weighted_edges(spark, d)))
    return _partition(data.obs.select("id", F.col("louvain").alias("cluster")).where("cluster is not null"), weighted_edges(spark, d), []).drop("n_split")


@query("SELECT count(*) AS n_points, 2::BIGINT AS n_resolutions FROM embeddings")
def tl_multiresolution_leiden_columns(spark, d):
    data = tl.multiresolution_leiden(dataset(spark, d), [0.5, 1.0], adjacency=E.symmetrise(weighted_edges(spark, d)), n_repetitions=2)
    own = [c for c in data.obs.columns if c.startswith("leiden_")]
    whole = data.obs.where(" and ".join(f"`{c}` is not null" for c in own))
    return whole.agg(F.count(F.lit(1)).alias("n_points")).withColumn("n_resolutions", F.lit(len(own)).cast("bigint"))


@query()
def tl_leiden(spark, d):
    data = dataset(spark, d)
    return tl.leiden(data, 0.5, adjacency=E.symmetrise(weighted_edges(spark, d))).obs.select("id", "leiden")


@query()
def tl_multiresolution_louvain(spark, d):
    data = dataset(spark, d)
    return tl.multiresolution_louvain(data, [0.5, 1.0], adjacency=E.symmetrise(weighted_edges(spark, d)), n_repetitions=2).obs


@query("SELECT vec_id AS id, CASE label WHEN 1 THEN 'one' WHEN 2 THEN 'two' ELSE 'unassigned' END AS annotation FROM embeddings")
def tl_annotate(spark, d):
    return tl.annotate(dataset(spark, d), {1: "one", "2": "two"}, "label").obs.select("id", "annotation")


@query(f"WITH {EDGES}, w AS (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS w FROM e), v AS (SELECT src AS id, CAST(label AS VARCHAR) AS class, sum(w) AS p FROM w JOIN p ON p.id = dst GROUP BY ALL) SELECT id, class AS label FROM v QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(p, 9) DESC, class) = 1")
def tl_propagate_annotation(spark, d):
    data = dataset(spark, d)
    data.obsp["connectivities"] = weighted_edges(spark, d)
    return tl.propagate_annotation(data, "label", key_added="spread").obs.select("id", F.col("spread").alias("label"))


@query(f"WITH {_VOTES} SELECT id, class AS label FROM v QUALIFY row_number() OVER (PARTITION BY id ORDER BY p DESC, class) = 1")
def tl_annotate_hierarchical(spark, d):
    data = dataset(spark, d)
    for r in (1, 2, 3):
        data.add_obs(f"code_{r}", codes(spark, d).where(F.col("res_id") == r))
    mapping = {(a, b): c if c != "unknown" else "unassigned" for a, b, c in _RULES}
    return tl.annotate_hierarchical(data, mapping, "code").obs.select("id", F.col("hierarchical_annotation").alias("label"))


# --- streams ----------------------------------------------------------------------------------------------------------------


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type AS a_cluster, user_id % 5 AS b_cluster, count(*) AS n FROM events GROUP BY ALL")
def windowed_contingency(spark, d):
    e = table(spark, d, "events").withColumn("segment", F.col("user_id") % 5)
    return ST.windowed_contingency(e, "event_type", "segment")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type AS cluster, count(*) AS n, round(avg(value), 6) AS mean, round(avg((value > 0)::INT), 6) AS fraction FROM events GROUP BY ALL")
def windowed_profile(spark, d):
    return rounded(ST.windowed_profile(table(spark, d, "events"), "event_type", "value", window="1 day"), "mean", "fraction")


# --- further views of the same operators --------------------------------------------------------------------------------


@query("WITH " + knn_sql(14).replace(DIST["euclidean"], "pow(list_sum(list_transform(range(1, len(a.x) + 1), lambda i: pow(abs(a.x[i] - b.x[i]), 3))), 1 / 3)") + f" {_KNN}")
def knn_distances_minkowski(spark, d):
    return _knn(spark, d, metric="minkowski", p=3.0)


@query("SELECT vec_id AS id, " + ", ".join(f'(label = {i})::DOUBLE AS "{i}"' for i in range(10)) + " FROM embeddings")
def membership_wide(spark, d):
    return wide(one_hot(truth(spark, d), "id", "cluster"), [str(i) for i in range(10)])


@query(f"""WITH {EDGES}, {CODES}, g AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, sum(weight) AS w FROM e GROUP BY 1, 2), m AS (SELECT sum(w) AS m FROM g),
    x AS (SELECT i.res_id, w, i.cluster AS la, j.cluster AS lb FROM g JOIN lab i ON i.id = a JOIN lab j ON j.id = b AND j.res_id = i.res_id),
    k AS (SELECT res_id, l, sum(w) AS d FROM (SELECT res_id, la AS l, w FROM x UNION ALL SELECT res_id, lb, w FROM x) GROUP BY ALL),
    q AS (SELECT res_id, sum(w) FILTER (WHERE la = lb) AS i FROM x GROUP BY 1), z AS (SELECT res_id, sum(d * d) AS dd FROM k GROUP BY 1), c AS (SELECT res_id, count(DISTINCT cluster) AS n FROM lab GROUP BY 1)
    SELECT res_id, n AS n_clusters, 0::BIGINT AS n_noise, round(i / m - dd / (4 * m * m), 6) AS modularity FROM q JOIN z USING (res_id) JOIN c USING (res_id), m""")
def multires_metrics(spark, d):
    return rounded(CM.clustering_metrics(weighted_edges(spark, d), codes(spark, d), ["res_id"]), "modularity")


@query(f"WITH {P}, {CODES} SELECT res_id / 10 AS best FROM (SELECT res_id, count(DISTINCT cluster) AS n FROM lab GROUP BY 1) ORDER BY n DESC, res_id LIMIT 1")
def best_resolution(spark, d):
    c = codes(spark, d).groupBy((F.col("res_id") / 10).alias("resolution")).agg(F.count_distinct("cluster").alias("n_clusters"))
    return spark.createDataFrame([(MR.best_resolution(c, "n_clusters"),)], "best double")


@query(f"WITH {P}, {CODES} SELECT res_id AS level, cluster, round(avg(id), 6) AS x FROM lab GROUP BY ALL")
def hierarchy_mean_positions(spark, d):
    order = points(spark, d).select("id", F.col("id").alias("position"))
    return rounded(PF.mean_positions(order, _levels(spark, d)), "x")


@query(f"WITH {P}, {CODES} SELECT id FROM lab WHERE res_id = 2 AND cluster = 3")
def hierarchy_members(spark, d):
    return H.cluster_members(_levels(spark, d), 2, 3)


@query(f"WITH {P}, {CODES}, z AS (SELECT res_id AS level, cluster, count(*) AS size, list(id ORDER BY id) AS members FROM lab WHERE res_id = 1 GROUP BY ALL) SELECT level, cluster, 'L' || level || '_C' || cluster AS name, size, members FROM z")
def hierarchy_nodes_members(spark, d):
    return H.hierarchy_nodes(_levels(spark, d).where("level = 1"), members=True)


@query()
def hierarchy_layout(spark, d):
    lev = _levels(spark, d)
    return spark.createDataFrame(H.tree_layout(H.hierarchy_nodes(lev), H.hierarchy_edges(lev)), "level int, cluster int, x double, y double")


@query(f"WITH {_RUNS3}, z AS (SELECT rep, cluster, count(*) AS s FROM r GROUP BY ALL), f AS (SELECT cluster, dense_rank() OVER (ORDER BY cluster) - 1 AS t FROM (SELECT DISTINCT cluster FROM r)) SELECT CAST(t AS INTEGER) AS track_id, round(avg(s), 6) AS mean_size FROM z JOIN f USING (cluster) GROUP BY t ORDER BY avg(s) DESC, t LIMIT 2")
def top_tracks(spark, d):
    r = _runs3(spark, d)
    top = TR.top_tracks(TR.track_consistency(r, TR.cluster_tracks(r)), 2)["mean_size"]
    return rounded(top.select("track_id", "mean_size"), "mean_size")


@query(f"WITH {_LONG}, g AS (SELECT cluster, property, avg(value) AS v FROM y GROUP BY ALL) SELECT cluster, property, round(20 + 180 * (v - min(v) OVER (PARTITION BY property)) / (max(v) OVER (PARTITION BY property) - min(v) OVER (PARTITION BY property) + 1e-8), 5) AS marker FROM g")
def profile_markers(spark, d):
    out = PF.size_map(PF.cluster_profile(expression(spark, d), line_labels(spark, d)))
    return out.select("cluster", "property", F.round("marker", 5).alias("marker"))


@query(f"WITH t AS (SELECT lang AS a, source AS b, count(*) AS n FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY ALL), {_AGREE}")
def agreement_documents(spark, d):
    docs = table(spark, d, "documents").where("lang is not null and source is not null")
    return rounded(CT.agreement(CT.contingency_of(docs, "lang", "source")), *_AGREE_COLUMNS)


@query("SELECT vec_id AS id, CAST(label AS VARCHAR) AS truth FROM embeddings")
def dataset_round_trip(spark, d):
    from tessera.durable import new_path

    data = dataset(spark, d).add_obs("truth", truth(spark, d))
    path = new_path(spark, "dataset")
    data.write(path)
    return Dataset.read(spark, path).obs.select("id", "truth")


# --- fitted samples and models ------------------------------------------------------------------------------------------

_MULTI = {"a": (4, 4), "b": (3, 3)}  # splits and samples of each step
_MULTI_SPLITS = " UNION ALL ".join(
    f"SELECT '{name}' AS pipeline, split_id, id, row_number() OVER (PARTITION BY split_id ORDER BY md5('{5 + i}:' || split_id || ':' || id), id) <= floor(0.8 * (SELECT count(*) FROM p) + 1e-9) AS is_train FROM p, (SELECT range AS split_id FROM range({n}))"
    for i, (name, (n, _)) in enumerate(_MULTI.items())
)
_MULTI_PICKS = " UNION ALL ".join(f"SELECT '{name}' AS pipeline, CAST(range AS INTEGER) AS sample_idx, CAST('0x' || substr(md5('{5 + i}:' || range), 1, 8) AS BIGINT) % {n} AS split_id FROM range({m})" for i, (name, (n, m)) in enumerate(_MULTI.items()))
_MULTI_SQL = f"{P}, s AS ({_MULTI_SPLITS}), picks AS ({_MULTI_PICKS})"


def _sampled_steps(spark, d) -> RS.MultiResampler:
    def fit(train, split):
        means = cut(train.agg(F.avg(F.col("features")[0]).alias("a"), F.avg(F.col("features")[1]).alias("b")), "means")  # one row
        return lambda part: part.join(means).select("id", F.round(F.col("features")[0] - F.col("a"), 6).alias("u"), F.round(F.col("features")[1] - F.col("b"), 6).alias("v"))

    return RS.MultiResampler(*[(name, RS.Resampler(n), fit) for name, (n, _) in _MULTI.items()], n_samples=7, seed=5).fit(points(spark, d))


@query(f"WITH {_MULTI_SQL}, m AS (SELECT pipeline, split_id, avg(x[1]) AS a, avg(x[2]) AS b FROM p JOIN s USING (id) WHERE is_train GROUP BY ALL) SELECT pipeline, sample_idx, id, round(x[1] - a, 6) AS u, round(x[2] - b, 6) AS v FROM picks JOIN m USING (pipeline, split_id), p")
def sampled_steps_predict(spark, d):
    return _sampled_steps(spark, d).predict(points(spark, d))


@query(f"WITH {_MULTI_SQL}, m AS (SELECT pipeline, split_id, avg(x[1]) AS a, avg(x[2]) AS b FROM p JOIN s USING (id) WHERE is_train GROUP BY ALL) SELECT pipeline, sample_idx, id, round(x[1] - a, 6) AS u, round(x[2] - b, 6) AS v FROM picks JOIN m USING (pipeline, split_id) JOIN s USING (pipeline, split_id) JOIN p USING (id) WHERE is_train")
def sampled_steps_transform(spark, d):
    return _sampled_steps(spark, d).transform()


@query(f"WITH {_MULTI_SQL} SELECT pipeline, count(*) AS n_samples, count(DISTINCT split_id) AS n_partitions FROM picks GROUP BY pipeline")
def sampled_steps_summary(spark, d):
    return _sampled_steps(spark, d).summary()


def _sign_model(spark, d) -> MR.MultiresolutionClustering:
    """A clustering whose tables are the sign codes, and whose confidence is known."""
    model = MR.MultiresolutionClustering("leiden", [0.1, 0.2, 0.3])
    model.labels = codes(spark, d)
    model.confidence = model.labels.select("res_id", "id", ((F.col("id") % 4 + F.col("res_id")) / 7).alias("confidence"))
    return model


_SURE = _VOTES.replace("sum(1.0::DOUBLE) AS p FROM lab", "sum((id % 4 + res_id) / 7) AS p FROM lab")


@query(f"WITH {_SURE} SELECT id, class, round(p / sum(p) OVER (PARTITION BY id), 6) AS p FROM v")
def model_predict_proba(spark, d):
    return rounded(_sign_model(spark, d).predict_proba(rules(spark)), "p")


@query(f"WITH {_SURE}, m AS (SELECT id, max(round(p, 9)) AS top FROM v GROUP BY id) SELECT v.id, CASE WHEN count(*) = 1 THEN min(class) ELSE 'unassigned' END AS label FROM v JOIN m ON m.id = v.id AND round(v.p, 9) = m.top GROUP BY v.id")
def model_predict(spark, d):
    return _sign_model(spark, d).predict(rules(spark))


_RUN_PAIRS = _PAIRWISE.replace(f"{P}, {CODES}", _RUNS3.replace(", r AS (", ", r0 AS (")).replace("FROM lab a JOIN lab b", "FROM (SELECT rep AS res_id, id, cluster FROM r0) a JOIN (SELECT rep AS res_id, id, cluster FROM r0) b")


@query(f"WITH {_RUN_PAIRS} SELECT 3::BIGINT AS n_repetitions, 'ari' AS consistency_metric, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std, count(*) AS n_scores, (SELECT count(DISTINCT cluster) FROM r0) AS n_tracks FROM r")
def consistency_summary(spark, d):
    out = MR.consistency_summary(_runs3(spark, d)).withColumn("n_scores", F.size("scores").cast("bigint")).withColumn("n_tracks", F.size("clusters").cast("bigint"))
    return rounded(out.drop("scores", "clusters"), "mean", "std")


@query(f"WITH {_FUZZY.format(_SUM)} SELECT q.src AS id, round(sum(q.p * pt.x[1]) / sum(q.p), 5) AS u, round(sum(q.p * pt.x[2]) / sum(q.p), 5) AS v FROM q JOIN p pt ON pt.id = q.dst GROUP BY q.src")
def umap_transform(spark, d):
    """Each point placed by the others, in a layout that is known: the first two dimensions."""
    p = points(spark, d)
    out = DE.umap_transform(p, p, p.select("id", F.slice("features", 1, 2).alias("position")))
    return out.select("id", F.round(F.col("position")[0], 5).alias("u"), F.round(F.col("position")[1], 5).alias("v"))


@query(f"WITH {_FUZZY.format(_SUM)}, g AS (SELECT q.src AS id, i, sum(q.p * pt.x[i]) / sum(q.p) AS v FROM q JOIN p pt ON pt.id = q.dst, range(1, 65) t(i) GROUP BY ALL) SELECT id, count(*) AS width, round(sum(v), 4) AS total FROM g GROUP BY id")
def umap_inverse(spark, d):
    """Each point's features from the others, in a layout that is the features themselves."""
    p = points(spark, d)
    layout = p.select("id", F.col("features").alias("position"))
    out = DE.umap_inverse(layout, layout, p)
    return out.select("id", F.size("features").cast("bigint").alias("width"), F.round(F.aggregate("features", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


def _covariances(rows: DataFrame, width: int) -> DataFrame:
    cells = [F.struct(F.lit(i).cast("bigint").alias("i"), F.lit(j).cast("bigint").alias("j"), (F.round(F.covar_samp(F.col("features")[i], F.col("features")[j]), 5) + 0.0).alias("value")) for i in range(width) for j in range(i, width)]
    return rows.agg(F.array(*cells).alias("all")).select(F.inline("all"))


@query("SELECT i, j, CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS value FROM range(5) a(i), range(5) b(j) WHERE i <= j")
def pca_whitened_covariance(spark, d):
    """Whitened components are uncorrelated and have variance 1."""
    p = points(spark, d)
    return _covariances(DE.pca(p, 5, whiten=True).transform(p), 5)


@query("SELECT count(*) AS n_points, 10::BIGINT AS n_clusters, 0::BIGINT AS n_misplaced FROM embeddings")
def kmeans_nearest(spark, d):
    """At the end of k-means every point is nearest to the mean of its own cluster."""
    p = points(spark, d)
    own = cut(DE.kmeans(p, 10, max_iter=100, settle=True), "kmeans")
    means = p.join(own, "id").select("cluster", F.posexplode("features").alias("i", "v")).groupBy("cluster", "i").agg(F.avg("v").alias("v"))
    means = means.groupBy("cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("mean"))
    gap = F.aggregate(F.zip_with("features", "mean", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x)
    near = p.join(own, "id").join(F.broadcast(means.withColumnRenamed("cluster", "c"))).select("id", "cluster", "c", gap.alias("gap"))  # ten means
    out = near.groupBy("id", "cluster").agg(F.min("gap").alias("least"), F.min(F.when(F.col("c") == F.col("cluster"), F.col("gap"))).alias("own"))
    return out.agg(F.count(F.lit(1)).alias("n_points"), F.count_distinct("cluster").alias("n_clusters"), F.count_if(F.col("own") > F.col("least") + 1e-9).alias("n_misplaced"))


@query("WITH c AS (SELECT l, i FROM (VALUES (1, 2), (2, 4), (3, 8)) t(l, n), range(8) r(i) WHERE i < n) SELECT CAST(l AS INTEGER) AS level, CAST(i AS INTEGER) AS cluster, round((i + 0.5) / count(*) OVER (PARTITION BY l), 6) AS x, -l::DOUBLE AS y FROM c")
def hierarchy_grid(spark, d):
    return rounded(H.grid_layout(H.hierarchy_nodes(_levels(spark, d))), "x")


@query("SELECT count(*) AS n_points, 0::BIGINT AS n_wrong, TRUE AS recalled FROM embeddings")
def knn_lsh_recall(spark, d):
    """Approximate neighbours against exact ones: no found distance is wrong, and nine in ten of the ten nearest are found."""
    p = points(spark, d)
    exact = N.knn(p, 10).select("src", "dst", F.col("distance").alias("d"))
    found = N.lsh_knn(p, 10, bucket_length=4.0).select("src", "dst", "distance")
    both = exact.join(found, ["src", "dst"], "left").agg(F.count_distinct("src").alias("n_points"), F.count_if(F.abs(F.col("distance") - F.col("d")) > 1e-6).alias("n_wrong"), F.avg(F.col("distance").isNotNull().cast("double")).alias("recall"))
    return both.select("n_points", "n_wrong", (F.col("recall") >= 0.9).alias("recalled"))
