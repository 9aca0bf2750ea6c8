"""Community detection: Leiden and Louvain over a grid of resolutions and repetitions, and a distributed Louvain.

The grid form ships one undirected graph of at most MAX_EDGES edges to the executors and runs one (resolution,
repetition) a task; beyond that limit louvain_distributed moves nodes by joins and aggregations. Sources of the methods:
Blondel et al. 2008; Reichardt and Bornholdt 2006; Traag et al. 2011, 2015; Traag, Waltman and van Eck 2019.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.durable import cut
from tessera.operators.edges import undirected
from tessera.schema import require_choice, require_columns

MAX_EDGES = 5_000_000
PARTITIONS = ("rb", "cpm", "rber", "modularity", "surprise")


class Graph:
    """Undirected graph in compressed rows; loops apart; nodes carry the number of points they stand for."""

    def __init__(self, n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, count: np.ndarray | None = None, loops: np.ndarray | None = None):
        self.n, self.count = n, np.ones(n) if count is None else count
        self.loops = np.zeros(n) if loops is None else loops
        src, dst, ww = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([w, w])
        order = np.lexsort((dst, src))
        self.src, self.dst, self.w = src[order], dst[order], ww[order]
        self.start = np.searchsorted(self.src, np.arange(n + 1))
        self.degree = np.bincount(self.src, self.w, n) + 2 * self.loops
        self.total = float(w.sum() + self.loops.sum())

    def around(self, v: int) -> tuple[np.ndarray, np.ndarray]:
        s = slice(self.start[v], self.start[v + 1])
        return self.dst[s], self.w[s]

    def merged(self, label: np.ndarray) -> Graph:
        """One node a community; label is 0..k-1."""
        k = int(label.max()) + 1 if len(label) else 0
        half = self.src < self.dst
        x, y, w = label[self.src[half]], label[self.dst[half]], self.w[half]
        loops = np.bincount(label, self.loops, k) + np.bincount(x[x == y], w[x == y], k)
        x, y, w = np.minimum(x, y)[x != y], np.maximum(x, y)[x != y], w[x != y]
        key, where = np.unique(x * k + y, return_inverse=True)
        return Graph(k, key // k if k else key, key % k if k else key, np.bincount(where, w, len(key)), np.bincount(label, self.count, k), loops)


class Quality:
    """What a move gains. The linear ones weigh links to a community against scale * size(v) * size(community)."""

    def __init__(self, graph: Graph, kind: str, resolution: float):
        self.kind, n, m = kind, graph.count.sum(), graph.total
        self.by_degree = kind in ("rb", "modularity")
        gamma = 1.0 if kind in ("modularity", "surprise") else resolution
        pairs = n * (n - 1) / 2
        self.scale = gamma / (2 * m) if self.by_degree and m else gamma * m / pairs if kind == "rber" and pairs else gamma
        self.m, self.pairs = m, pairs

    def sizes(self, graph: Graph) -> np.ndarray:
        return graph.degree if self.by_degree else graph.count

    def surprise(self, inside: float, inside_pairs: float) -> float:
        """m times the divergence between the shares of weight and of pairs that lie inside."""
        if not self.m or not self.pairs:
            return 0.0
        q, e = inside / self.m, inside_pairs / self.pairs
        part = lambda x, y: 0.0 if x <= 0 else x * np.log(x / max(y, 1e-300))
        return self.m * (part(q, e) + part(1 - q, 1 - e))


def _dense(label: np.ndarray) -> np.ndarray:
    return np.unique(label, return_inverse=True)[1].ravel()


class _Mover:
    """State of a partition while nodes move."""

    def __init__(self, g: Graph, q: Quality, label: np.ndarray):
        self.g, self.q, self.label = g, q, label.copy()
        self.size = np.bincount(label, q.sizes(g), g.n)
        self.members = np.bincount(label, minlength=g.n)
        if q.kind == "surprise":
            same = label[g.src] == label[g.dst]
            self.inside = float(g.w[same].sum() / 2 + g.loops.sum())
            self.inside_pairs = float((self.size * (self.size - 1) / 2).sum())

    def gains(self, v: int, links: dict[int, float]) -> tuple[int, float]:
        """The best community for v and what it gains over staying; ties stay."""
        g, q, own = self.g, self.q, int(self.label[v])
        s = float(q.sizes(g)[v])
        if q.kind == "surprise":
            base = self.q.surprise(self.inside, self.inside_pairs)
            out_w, out_p = links.get(own, 0.0), s * (self.size[own] - s)
            best, top = own, 0.0
            for c, w in links.items():
                if c != own:
                    x = q.surprise(self.inside - out_w + w, self.inside_pairs - out_p + s * self.size[c]) - base
                    if x > top + 1e-10:
                        best, top = c, x
            return best, top
        stay = links.get(own, 0.0) - q.scale * s * (self.size[own] - s)
        best, top = own, 0.0
        for c, w in links.items():
            if c != own:
                x = w - q.scale * s * self.size[c] - stay
                if x > top + 1e-10:
                    best, top = c, x
        if -stay > top + 1e-10 and self.members[own] > 1:  # on its own
            free = np.flatnonzero(self.members == 0)
            if len(free):
                best, top = int(free[0]), -stay
        return best, top

    def move(self, v: int, to: int, links: dict[int, float]) -> None:
        own, s = int(self.label[v]), float(self.q.sizes(self.g)[v])
        if self.q.kind == "surprise":
            self.inside += links.get(to, 0.0) - links.get(own, 0.0)
            self.inside_pairs += s * self.size[to] - s * (self.size[own] - s)
        self.size[own] -= s
        self.size[to] += s
        self.members[own] -= 1
        self.members[to] += 1
        self.label[v] = to

    def links(self, v: int) -> dict[int, float]:
        near, w = self.g.around(v)
        out: dict[int, float] = {}
        for c, x in zip(self.label[near].tolist(), w.tolist(), strict=True):
            out[c] = out.get(c, 0.0) + x
        return out

    def sweep(self, rng: np.random.Generator) -> bool:
        """Moves nodes from a queue until none gains; a move wakes the neighbours outside the new community."""
        queue, waiting, at, moved = rng.permutation(self.g.n).tolist(), np.ones(self.g.n, bool), 0, False
        while at < len(queue):
            v = queue[at]
            at += 1
            waiting[v] = False
            links = self.links(v)
            to, gain = self.gains(v, links)
            if gain > 1e-10:
                self.move(v, to, links)
                moved = True
                for u in self.g.around(v)[0].tolist():
                    if not waiting[u] and self.label[u] != to:
                        waiting[u] = True
                        queue.append(u)
        return moved


def _refine(g: Graph, q: Quality, coarse: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Splits communities into well-connected parts: single nodes join a part of their own community at random, by how
    much that gains."""
    fine = _Mover(g, q, np.arange(g.n))
    sizes = q.sizes(g)
    whole = np.bincount(coarse, sizes, g.n)
    inner = np.bincount(g.src[coarse[g.src] == coarse[g.dst]], g.w[coarse[g.src] == coarse[g.dst]], g.n)
    linear = q.kind != "surprise"
    for v in rng.permutation(g.n).tolist():
        if fine.members[fine.label[v]] != 1:
            continue
        s = sizes[v]
        if linear and inner[v] < q.scale * s * (whole[coarse[v]] - s):
            continue
        near, w = g.around(v)
        inside = coarse[near] == coarse[v]
        links: dict[int, float] = {}
        for c, x in zip(fine.label[near[inside]].tolist(), w[inside].tolist(), strict=True):
            links[c] = links.get(c, 0.0) + x
        own = int(fine.label[v])
        options = [(c, (x - q.scale * s * fine.size[c]) if linear else x) for c, x in links.items() if c != own]
        options = [(c, x) for c, x in options if x > 0]
        if options:
            gain = np.array([x for _, x in options])
            p = np.exp((gain - gain.max()) / 0.01 / max(gain.max(), 1e-12))
            fine.move(v, options[int(rng.choice(len(options), p=p / p.sum()))][0], links)
    return _dense(fine.label)


def leiden_labels(g: Graph, kind: str, resolution: float, seed: int, refine: bool = True, iterations: int = 10) -> np.ndarray:
    """Communities 0..k-1, largest first. Without refinement this is Louvain."""
    rng = np.random.Generator(np.random.Philox(seed))
    q = Quality(g, kind, resolution)
    label = np.arange(g.n)
    for _ in range(iterations if refine else 1):
        level, of, start = g, np.arange(g.n), _dense(label)
        changed = False
        while True:
            mover = _Mover(level, q, start)
            moved = mover.sweep(rng)
            changed |= moved
            coarse = _dense(mover.label)
            label = coarse[of]
            if not moved and level is not g or coarse.max(initial=-1) + 1 == level.n:
                break
            part = _refine(level, q, coarse, rng) if refine else coarse
            if part.max(initial=-1) + 1 == level.n:
                break
            first = np.zeros(int(part.max()) + 1, np.int64)
            first[part] = coarse
            of, level = part[of], level.merged(part)
            start = _dense(first) if refine else np.arange(level.n)
        if not changed:
            break
    if refine:
        label = _connected(g, label)
    order = np.argsort(-np.bincount(label), kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank[label]


def _connected(g: Graph, label: np.ndarray) -> np.ndarray:
    """Splits what is not connected within its community."""
    inside = label[g.src] == label[g.dst]
    part = np.arange(g.n)
    while True:
        new = part.copy()
        np.minimum.at(new, g.src[inside], part[g.dst[inside]])
        new = new[new]
        if (new == part).all():
            return _dense(part)
        part = new


def _graph_of(edges: DataFrame, weighted: bool) -> tuple[np.ndarray, Graph]:
    und = undirected(require_columns(edges, "src", "dst", "weight").where("weight > 0"))
    if not weighted:
        und = und.withColumn("weight", F.lit(1.0))
    und = cut(und, "graph")
    n = und.count()
    if n > MAX_EDGES:
        raise ValueError(f"{n} edges; above {MAX_EDGES} use louvain_distributed")
    pdf = und.orderBy("src", "dst").toPandas()
    ids = np.unique(np.concatenate([pdf["src"], pdf["dst"]])) if len(pdf) else np.zeros(0, np.int64)
    a, b, w = np.searchsorted(ids, pdf["src"]), np.searchsorted(ids, pdf["dst"]), pdf["weight"].to_numpy(float)
    loops = np.bincount(a[a == b], w[a == b], len(ids)) if len(ids) else None
    return ids, Graph(len(ids), a[a != b], b[a != b], w[a != b], None, loops)


def communities(edges: DataFrame, resolutions: list[float], n_repetitions: int = 1, method: str = "leiden", partition_type: str = "rb", seed: int = 0, weighted: bool = True, scale: float = 1.0) -> DataFrame:
    """labels(res_id, rep, id, cluster, error): every resolution and repetition in a task of its own, seeded by seed + rep. A
    failed one has one row with a null id and its message; the others go on."""
    method, kind = require_choice(method, "leiden", "louvain"), require_choice(partition_type, *PARTITIONS)
    spark = edges.sparkSession
    ids, graph = _graph_of(edges, weighted)
    shared = spark.sparkContext.broadcast((ids, graph))
    grid = [(i, float(r), k) for i, r in enumerate(resolutions) for k in range(n_repetitions)]
    rows = spark.createDataFrame(grid, "res_id int, resolution double, rep int").repartition(max(1, len(grid)), "res_id", "rep")
    columns = ["res_id", "rep", "id", "cluster", "error"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own, g = shared.value
        r = pdf.iloc[0]
        try:
            label = leiden_labels(g, kind, r["resolution"] * scale, seed + int(r["rep"]), method == "leiden")
            return pd.DataFrame({"res_id": int(r["res_id"]), "rep": int(r["rep"]), "id": own, "cluster": label, "error": None}, columns=columns)
        except Exception as e:
            return pd.DataFrame([[int(r["res_id"]), int(r["rep"]), None, None, str(e)[:500]]], columns=columns)

    return cut(rows.groupBy("res_id", "rep").applyInPandas(run, "res_id int, rep int, id bigint, cluster int, error string"), "communities")


def louvain_scale(edges: DataFrame) -> float:
    """Points over stored entries, by which Louvain's resolutions are scaled."""
    r = edges.agg(F.count(F.lit(1)).alias("nnz")).join(edges.select(F.col("src").alias("id")).union(edges.select("dst")).agg(F.count_distinct("id").alias("n"))).first()
    return r["n"] / max(r["nnz"], 1)


def modularity(edges: DataFrame, labels: DataFrame, keys: list[str] | None = None, resolution: float = 1.0) -> DataFrame:
    """keys and modularity of labels(keys, id, cluster): within / m - resolution * sum (degree / 2 m)^2 over undirected
    weights. Two joins and two aggregations; 0 for a graph without weight."""
    keys = keys or []
    und = undirected(edges)
    m = und.agg(F.sum("weight").alias("m"))
    a = labels.select(*keys, F.col("id").alias("src"), F.col("cluster").alias("a"))
    b = labels.select(*keys, F.col("id").alias("dst"), F.col("cluster").alias("b"))
    e = und.join(a, "src").join(b, ["dst", *keys])
    inner = e.groupBy(*keys).agg(F.sum(F.when(F.col("a") == F.col("b"), F.col("weight")).otherwise(0.0)).alias("inside"))
    ends = e.select(*keys, F.col("a").alias("c"), "weight").unionByName(e.select(*keys, F.col("b").alias("c"), "weight"))
    degree = ends.groupBy(*keys, "c").agg(F.sum("weight").alias("d")).join(m).groupBy(*keys).agg(F.sum(F.pow(F.col("d") / (2 * F.col("m")), 2)).alias("expected"))
    out = (inner.join(degree, keys) if keys else inner.join(degree)).join(m)
    q = F.when(F.coalesce("m", F.lit(0.0)) == 0, 0.0).otherwise(F.col("inside") / F.col("m") - resolution * F.col("expected"))
    return out.select(*keys, q.alias("modularity"))


def clustering_metrics(edges: DataFrame, labels: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, n_clusters (labels from 0 up), n_noise (label -1), modularity."""
    keys = keys or []
    agg = [F.count_distinct(F.when(F.col("cluster") >= 0, F.col("cluster"))).alias("n_clusters"), F.count_if(F.col("cluster") == -1).alias("n_noise")]
    counts = labels.groupBy(*keys).agg(*agg) if keys else labels.agg(*agg)
    q = modularity(edges, labels, keys)
    return counts.join(q, keys, "left") if keys else counts.join(q)


def louvain_distributed(edges: DataFrame, resolution: float = 1.0, max_moves: int = 12, max_levels: int = 6) -> DataFrame:
    """labels(id, cluster) by synchronous moves for graphs of any size. A round lets half of the nodes (by a hash of node
    and round, which stops two nodes from swapping) join the neighbouring community of greatest modularity gain; then
    communities become nodes. Every step is a join and a partial aggregation, cut from its lineage."""
    und = cut(undirected(edges.where("weight > 0")), "level")
    m2 = 2 * (und.agg(F.sum("weight")).first()[0] or 0.0)
    nodes = und.select(F.col("src").alias("id")).union(und.select("dst")).distinct()
    labels = cut(nodes.select("id", F.col("id").alias("cluster")), "labels")
    if not m2:
        return labels
    for _ in range(max_levels):
        both = und.where("src <> dst").select("src", "dst", "weight")
        both = both.unionByName(both.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
        ends = both.select(F.col("src").alias("v"), "weight").unionByName(und.where("src = dst").select(F.col("src").alias("v"), (2 * F.col("weight")).alias("weight")))
        degree = cut(ends.groupBy("v").agg(F.sum("weight").alias("k")), "degree")
        comm, moved_any = cut(degree.select("v", F.col("v").alias("c")), "comm"), False
        for turn in range(max_moves):
            tot = comm.join(degree, "v").groupBy("c").agg(F.sum("k").alias("s"))
            links = both.join(comm.select(F.col("v").alias("dst"), "c"), "dst").groupBy(F.col("src").alias("v"), "c").agg(F.sum("weight").alias("w"))
            own = comm.select("v", F.col("c").alias("own")).join(degree, "v")
            links = links.unionByName(comm.select("v", "c", F.lit(0.0).alias("w"))).groupBy("v", "c").agg(F.sum("w").alias("w"))
            rated = links.join(own, "v").join(tot, "c")
            gain = F.col("w") - resolution * F.col("k") * (F.col("s") - F.when(F.col("c") == F.col("own"), F.col("k")).otherwise(0.0)) / m2
            best = rated.groupBy("v", "own").agg(F.max_by("c", F.struct(F.round(gain, 9), (F.col("c") == F.col("own")), -F.col("c"))).alias("c"))
            turn_of = F.pmod(F.xxhash64("v", F.lit(turn)), F.lit(2)) == 0
            new = cut(best.select("v", "own", F.when(turn_of, F.col("c")).otherwise(F.col("own")).alias("c")), "comm")
            moved = new.where("own <> c").count()
            moved_any |= moved > 0
            comm = new.select("v", "c")
            if not moved and turn:
                break
        if not moved_any:
            break
        labels = cut(labels.join(comm, F.col("cluster") == F.col("v")).select("id", F.col("c").alias("cluster")), "labels")
        a, b = comm.select(F.col("v").alias("src"), F.col("c").alias("a")), comm.select(F.col("v").alias("dst"), F.col("c").alias("b"))
        und = cut(undirected(und.join(a, "src").join(b, "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight")), "level")
    return labels


def empty_labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "res_id int, rep int, id bigint, cluster int, error string")
