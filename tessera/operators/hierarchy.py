"""Hierarchies: agglomerative linkage and its cuts, and the graph of clusters between consecutive levels.

Linkage needs all distances and is sequential, so it runs as one numpy task with a stated limit of points. Points that are
the same to the distance can be given as members of one, and then only the ones count. Everything after linkage works on
labels tables of any size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.labels import level_name
from tessera.schema import require_choice

MAX_POINTS = 10_000
METHODS = ("complete", "average", "single", "ward")


def linkage_matrix(d: np.ndarray, method: str, counts: np.ndarray | None = None) -> np.ndarray:
    """(n - 1) x 4 merges of a square distance matrix: the two nodes (new nodes count on from n), height, size. Nearest
    neighbour chains for all methods; the update rule is Lance and Williams'. With counts, a row stands for so many points
    at distance 0 of each other, which are merged already; sizes are those of the points."""
    n = len(d)
    d = d.astype(float).copy()
    size = np.ones(n) if counts is None else np.asarray(counts, float)
    if method == "ward" and counts is not None:
        d *= np.sqrt(2 * size[:, None] * size[None, :] / (size[:, None] + size[None, :]))
    np.fill_diagonal(d, np.inf)
    size, alive, merges, chain = size.copy(), np.ones(n, bool), [], []
    while len(merges) < n - 1:
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        while True:
            a = chain[-1]
            row = d[a]
            b = int(row.argmin())
            if len(chain) > 1 and row[chain[-2]] <= row[b]:
                b = chain[-2]
                break
            chain.append(b)
        chain = chain[:-2]
        h, na, nb = d[a, b], size[a], size[b]
        merges.append((a, b, h))
        others = np.flatnonzero(alive)
        others = others[(others != a) & (others != b)]
        x, y = d[a, others], d[b, others]
        if method == "single":
            new = np.minimum(x, y)
        elif method == "complete":
            new = np.maximum(x, y)
        elif method == "average":
            new = (na * x + nb * y) / (na + nb)
        else:
            nk = size[others]
            new = np.sqrt(np.maximum(((na + nk) * x**2 + (nb + nk) * y**2 - nk * h**2) / (na + nb + nk), 0))
        d[b, others] = d[others, b] = new
        alive[a] = False
        d[a, :] = d[:, a] = np.inf
        size[b] = na + nb
    # merges in order of height, nodes renamed as they grow
    merges = [merges[i] for i in np.argsort([m[2] for m in merges], kind="stable")]
    parent, node, count, out = np.arange(n), np.arange(n), np.ones(n, int) if counts is None else np.array(counts, int), []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for step, (a, b, h) in enumerate(merges):
        a, b = root(a), root(b)
        x, y = sorted((int(node[a]), int(node[b])))
        parent[a] = b
        count[b] += count[a]
        node[b] = n + step
        out.append((x, y, h, int(count[b])))
    return np.array(out, float).reshape(-1, 4)


def with_members(merges: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The merges of all points, from those of their groups: the points of a group merge first, at height 0. group has the
    number of each point's group; all merges of groups that are at 0 as well come after these."""
    n, k = len(group), len(merges) + 1
    order = np.argsort(group, kind="stable")
    node, out = np.full(k, -1), []
    size = np.zeros(k, int)
    for i in order.tolist():
        g = group[i]
        if node[g] < 0:
            node[g], size[g] = i, 1
        else:
            size[g] += 1
            out.append((*sorted((int(node[g]), i)), 0.0, size[g]))
            node[g] = n + len(out) - 1
    first = n + len(out)
    name = lambda x: int(node[int(x)]) if x < k else first + int(x) - k
    out += [(*sorted((name(a), name(b))), h, s) for a, b, h, s in merges]
    return np.array(out, float).reshape(-1, 4)


def cut_at(merges: np.ndarray, n: int, height: float) -> np.ndarray:
    """Labels of the clusters whose merges are at most this high; numbered from 1 by their first point."""
    return _flat(merges[merges[:, 2] <= height], n)


def cut_into(merges: np.ndarray, n: int, k: int) -> np.ndarray:
    """Labels of at most k clusters: the lowest cut that gives no more."""
    heights = np.concatenate([[-np.inf], np.unique(merges[:, 2])])
    lo, hi = 0, len(heights) - 1
    while lo < hi:
        mid = (lo + hi) // 2
        if n - (merges[:, 2] <= heights[mid]).sum() <= k:
            hi = mid
        else:
            lo = mid + 1
    return cut_at(merges, n, heights[lo])


def _flat(merges: np.ndarray, n: int) -> np.ndarray:
    # nodes are numbered in order of height, so a prefix of the merges has consecutive names
    top = np.arange(n + len(merges))
    for node in range(n + len(merges) - 1, n - 1, -1):
        a, b = merges[node - n, :2].astype(int)
        top[a] = top[b] = top[node]
    _, first, group = np.unique(top[:n], return_index=True, return_inverse=True)
    return np.argsort(np.argsort(first))[group] + 1


def level_cuts(merges: np.ndarray, n: int, strategy: str = "natural", max_levels: int | None = None, min_size: int = 2) -> list[np.ndarray]:
    """Labels of each level, coarse to fine. natural: cuts at the merge heights from the top, leaving out repeats of a
    number of clusters and cuts with tiny clusters once there are more than ten, until n // 2 clusters. linear: level + 1
    clusters. powers_of_2: 2^level clusters; the first level with fewer than asked for is the last. Both have the levels 0
    to max_levels, and go on to n clusters without it."""
    strategy = require_choice(strategy, "natural", "linear", "powers_of_2")
    levels: list[np.ndarray] = []
    if n < 2:
        return [np.ones(n, int)]
    if strategy == "natural":
        seen: set[int] = set()
        for h in np.unique(merges[:, 2])[::-1]:
            if max_levels is not None and len(levels) >= max_levels:
                break
            label = cut_at(merges, n, h)
            k = int(label.max())
            if k in seen or (k > 10 and np.bincount(label)[1:].min() < min_size):
                continue
            seen.add(k)
            levels.append(label)
            if k >= max(n // 2, 1):
                break
        return levels
    last = n - 1 if max_levels is None else min(max_levels, n - 1)
    for level in range(last + 1):
        want = level + 1 if strategy == "linear" else 2**level
        if want > n:
            break
        levels.append(cut_into(merges, n, want))
        if strategy == "powers_of_2" and levels[-1].max() < want:
            break
    return levels


def leaf_order(merges: np.ndarray, n: int) -> np.ndarray:
    """Points from left to right in the dendrogram."""
    if n < 2:
        return np.arange(n)
    out, stack = [], [2 * n - 2]
    while stack:
        x = stack.pop()
        if x < n:
            out.append(x)
        else:
            stack += [int(merges[x - n, 1]), int(merges[x - n, 0])]
    return np.array(out)


def _square(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    ids = np.unique(np.concatenate([pdf["src"], pdf["dst"]]))
    d = np.zeros((len(ids), len(ids)))
    i, j = np.searchsorted(ids, pdf["src"]), np.searchsorted(ids, pdf["dst"])
    np.maximum.at(d, (i, j), pdf["distance"])
    return ids, np.maximum(d, d.T)


def refuse_more(ids: DataFrame, most: int, what: str) -> None:
    """Raises if there are more distinct ids than one task may take; counts no further than that."""
    if ids.distinct().limit(most + 1).count() > most:
        raise ValueError(f"{what} takes at most {most} points")


def _one_task(distances: DataFrame, members: DataFrame | None, method: str, run, schema: str) -> DataFrame:
    """run(ids, merges) over all pairs in one task; more than MAX_POINTS points, or groups of points, are refused before any
    are gathered. members(id, rep): the points that each of them stands for, at distance 0 of each other."""
    ends = distances.select("src").unionAll(distances.select("dst"))
    refuse_more(ends if members is None else members.select("rep"), MAX_POINTS, "linkage")
    pairs = distances.select("src", "dst", "distance")
    if members is None:
        return pairs.groupBy(F.lit(0).alias("one")).applyInPandas(lambda key, pdf: run(*(lambda ids, d: (ids, linkage_matrix(d, method)))(*_square(pdf))), schema)

    def grouped(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf["distance"].isna()].sort_values("src", ignore_index=True)  # id, rep
        reps, group = np.unique(own["dst"], return_inverse=True)
        d = np.zeros((len(reps), len(reps)))
        pdf = pdf[pdf["distance"].notna()]
        d[np.searchsorted(reps, pdf["src"]), np.searchsorted(reps, pdf["dst"])] = pdf["distance"]
        merges = linkage_matrix(np.maximum(d, d.T), method, np.bincount(group))
        return run(own["src"].to_numpy(), with_members(merges, group))

    rows = pairs.unionByName(members.select(F.col("id").alias("src"), F.col("rep").alias("dst"), F.lit(None).cast("double").alias("distance")))
    return rows.groupBy(F.lit(0).alias("one")).applyInPandas(lambda key, pdf: grouped(pdf), schema)


def linkage(distances: DataFrame, method: str = "complete", members: DataFrame | None = None) -> DataFrame:
    """linkage(step, left, right, distance, size) from distances(src, dst, distance) of all pairs. With members(id, rep),
    the distances are those of reps, and the merges are those of all ids."""
    method = require_choice(method, *METHODS)

    def run(ids, m):
        return pd.DataFrame({"step": np.arange(len(m)), "left": m[:, 0].astype(int), "right": m[:, 1].astype(int), "distance": m[:, 2], "size": m[:, 3].astype(int)})

    return _one_task(distances, members, method, run, "step int, left bigint, right bigint, distance double, size bigint")


def hierarchical(distances: DataFrame, method: str = "complete", strategy: str = "natural", max_levels: int | None = None, min_size: int = 2, members: DataFrame | None = None) -> DataFrame:
    """levels(level, id, cluster)."""
    method, strategy = require_choice(method, *METHODS), require_choice(strategy, "natural", "linear", "powers_of_2")

    def run(ids, m):
        cuts = level_cuts(m, len(ids), strategy, max_levels, min_size)
        return pd.concat([pd.DataFrame({"level": k, "id": ids, "cluster": c}) for k, c in enumerate(cuts)])

    return _one_task(distances, members, method, run, "level int, id bigint, cluster int")


def dendrogram_order(distances: DataFrame, method: str = "average", members: DataFrame | None = None) -> DataFrame:
    """id, position of the leaves."""

    def run(ids, m):
        return pd.DataFrame({"id": ids[leaf_order(m, len(ids))], "position": np.arange(len(ids))})

    return _one_task(distances, members, method, run, "id bigint, position int")


def single_linkage_forest(distances: DataFrame, rounds: int = 40) -> DataFrame:
    """Minimum spanning forest (src, dst, distance) of a sparse distance graph by Boruvka's rounds, all as joins: single
    linkage for graphs of any size. Ties are broken by the pair of ids."""
    from tessera.durable import cut

    edges = cut(distances.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "distance").where("src <> dst"), "edges")
    nodes = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    comp, forest = cut(nodes.withColumn("comp", F.col("id")), "comp"), None
    for _ in range(rounds):
        live = edges.join(comp.select(F.col("id").alias("src"), F.col("comp").alias("a")), "src").join(comp.select(F.col("id").alias("dst"), F.col("comp").alias("b")), "dst").where("a <> b")
        both = live.select("a", "b", F.struct("distance", "src", "dst").alias("e")).unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b"), F.struct("distance", "src", "dst").alias("e")))
        best = cut(both.groupBy("a").agg(F.min_by("b", "e").alias("b"), F.min("e").alias("e")), "best")
        if best.isEmpty():
            break
        new = best.select("e.*").distinct().select("src", "dst", "distance")
        forest = cut(new if forest is None else forest.unionByName(new).distinct(), "forest")
        comp = cut(_hook(comp, best.select("a", "b")), "comp")
    empty = edges.select("src", "dst", "distance").limit(0)
    return forest if forest is not None else empty


def _hook(comp: DataFrame, links: DataFrame) -> DataFrame:
    """Each component takes the name of the least component it can reach along the links."""
    from tessera.durable import cut

    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    name = cut(both.select("a").distinct().withColumn("to", F.col("a")), "name")
    while True:
        near = both.join(name.select(F.col("a").alias("b"), F.col("to").alias("t")), "b").groupBy("a").agg(F.min("t").alias("t"))
        new = name.join(near, "a").select("a", "to", F.least("to", "t").alias("t"))
        jump = new.join(new.select(F.col("a").alias("t"), F.col("t").alias("u")), "t").select("a", "to", F.least("t", "u").alias("t"))
        jump = cut(jump, "name")
        if jump.where("t <> `to`").isEmpty():
            break
        name = jump.select("a", F.col("t").alias("to"))
    return comp.join(name, F.col("comp") == F.col("a"), "left").select("id", F.coalesce("to", "comp").alias("comp"))


# --- graphs between levels --------------------------------------------------------------------------------------------


def hierarchy_nodes(levels: DataFrame, stability: DataFrame | None = None, members: bool = False) -> DataFrame:
    """level, cluster, name, size, and stability(level, cluster, stability) if given; member lists only on request."""
    agg = [F.count(F.lit(1)).alias("size")] + ([F.sort_array(F.collect_list("id")).alias("members")] if members else [])
    out = levels.groupBy("level", "cluster").agg(*agg).withColumn("name", level_name(F.col("level"), F.col("cluster")))
    return out.join(stability, ["level", "cluster"], "left") if stability is not None else out


def hierarchy_edges(levels: DataFrame) -> DataFrame:
    """level, parent, next_level, child, overlap, weight = overlap / size of the parent, between consecutive levels."""
    a = levels.select("id", "level", F.col("cluster").alias("parent"))
    b = levels.select("id", (F.col("level") - 1).alias("level"), F.col("cluster").alias("child"))
    over = a.join(b, ["id", "level"]).groupBy("level", "parent", "child").agg(F.count(F.lit(1)).alias("overlap"))
    sizes = levels.groupBy("level", F.col("cluster").alias("parent")).agg(F.count(F.lit(1)).alias("size"))
    return over.join(sizes, ["level", "parent"]).select("level", "parent", (F.col("level") + 1).alias("next_level"), "child", "overlap", (F.col("overlap") / F.col("size")).alias("weight"))


def jaccard_edges(levels: DataFrame, min_overlap: float = 0.0) -> DataFrame:
    """level, parent, child, weight: Jaccard similarity of all pairs of clusters of consecutive levels that reach
    min_overlap; at 0 the pairs without overlap are there too."""
    a = levels.select("id", "level", F.col("cluster").alias("parent"))
    b = levels.select("id", (F.col("level") - 1).alias("level"), F.col("cluster").alias("child"))
    over = a.join(b, ["id", "level"]).groupBy("level", "parent", "child").agg(F.count(F.lit(1)).alias("n"))
    size_a = levels.groupBy("level", F.col("cluster").alias("parent")).agg(F.count(F.lit(1)).alias("sa"))
    size_b = levels.groupBy((F.col("level") - 1).alias("level"), F.col("cluster").alias("child")).agg(F.count(F.lit(1)).alias("sb"))
    out = size_a.join(size_b, "level").join(over, ["level", "parent", "child"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    w = F.col("n") / (F.col("sa") + F.col("sb") - F.col("n"))
    return out.select("level", "parent", "child", w.alias("weight")).where(F.col("weight") >= min_overlap)


def attach_consistency(nodes: DataFrame, tracks: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """nodes(level, cluster, size) with the consistency of a track (level, mean_size, mean_consistency) whose mean size is
    within the tolerance; the nearest, then the most consistent."""
    near = F.abs(F.col("mean_size") - F.col("size"))
    pairs = nodes.join(tracks, "level").where(near <= tolerance * F.col("size"))
    best = pairs.groupBy("level", "cluster").agg(F.min_by("mean_consistency", F.struct(near, -F.col("mean_consistency"))).alias("consistency"))
    return nodes.join(best, ["level", "cluster"], "left")


def level_labels(levels: DataFrame, level: int) -> DataFrame:
    out = levels.where(F.col("level") == level)
    if out.isEmpty():
        raise ValueError(f"no level {level}")
    return out.select("id", "cluster")


def level_list(levels: DataFrame, order: str = "coarse_to_fine") -> list[int]:
    order = require_choice(order, "coarse_to_fine", "fine_to_coarse")
    found = sorted(r["level"] for r in levels.select("level").distinct().collect())
    return found if order == "coarse_to_fine" else found[::-1]


def cluster_members(levels: DataFrame, level: int, cluster: int) -> DataFrame:
    out = level_labels(levels, level).where(F.col("cluster") == cluster)
    if out.isEmpty():
        raise ValueError(f"no cluster {cluster} in level {level}")
    return out.select("id")


def level_clusters(levels: DataFrame, level: int) -> list[int]:
    return sorted(r["cluster"] for r in level_labels(levels, level).select("cluster").distinct().collect())


def tree_layout(nodes: DataFrame, edges: DataFrame) -> list[tuple[int, int, float, float]]:
    """(level, cluster, x, y) for drawing: parents spread evenly, children placed by the mean position of their parents
    weighted by the edges, then evenly in that order; neighbours are swapped while that lowers the crossings. Works on
    the driver, on one row a cluster."""
    levels: dict[int, list[int]] = {}
    for r in nodes.select("level", "cluster").orderBy("level", "cluster").collect():
        levels.setdefault(r["level"], []).append(r["cluster"])
    links: dict[int, list[tuple[int, int, float]]] = {}
    for r in edges.select("level", "parent", "child", "weight").where("weight > 0").collect():
        links.setdefault(r["level"], []).append((r["parent"], r["child"], r["weight"]))
    place: dict[int, dict[int, int]] = {}
    for i, level in enumerate(sorted(levels)):
        order = levels[level]
        if i:
            before, own = place[level - 1], links.get(level - 1, [])
            mean = {c: (sum(before[p] * w for p, k, w in own if k == c) / s if (s := sum(w for _, k, w in own if k == c)) else 0) for c in order}
            order = sorted(order, key=lambda c: (mean[c], c))
            up = {c: [before[p] for p, k, _ in own if k == c] for c in order}
            better = True
            while better:
                better = False
                for k in range(len(order) - 1):
                    x, y = up[order[k]], up[order[k + 1]]
                    if sum(a > b for a in x for b in y) > sum(b > a for a in x for b in y):
                        order[k], order[k + 1] = order[k + 1], order[k]
                        better = True
        place[level] = {c: k for k, c in enumerate(order)}
    return [(level, c, (k + 0.5) / len(own), -float(level)) for level, own in place.items() for c, k in own.items()]


def grid_layout(nodes: DataFrame) -> DataFrame:
    """level, cluster, x, y: each level a row, its clusters evenly spread in order of their numbers."""
    own = Window.partitionBy("level")
    x = (F.row_number().over(own.orderBy("cluster")) - 0.5) / F.count(F.lit(1)).over(own)
    return nodes.select("level", "cluster", x.alias("x"), (-F.col("level").cast("double")).alias("y"))


def spaced(rows: DataFrame, gap: float, keys: list[str], value: str = "x", tie: str = "id") -> DataFrame:
    """rows with position: along each key, values moved up no more than needed to be a gap apart. The k-th value (from 0)
    may not lie below the j-th plus (k - j) gaps for any j < k, so it is k gaps above the greatest value j less j gaps."""
    order = Window.partitionBy(*keys).orderBy(value, tie)
    step = (F.row_number().over(order) - 1) * gap
    out = rows.withColumn("__step", step)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("position", F.col("__step") + F.max(F.col(value) - F.col("__step")).over(upto)).drop("__step")
