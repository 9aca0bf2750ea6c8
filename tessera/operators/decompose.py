"""Decompositions of points by their moments, which are d x d however many rows there are; and small-data embeddings."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.hierarchy import refuse_more
from tessera.operators.knn import _matrix

#: What one task of a layout can hold: all points, and the edges.
MAX_LAYOUT = 1_000_000
#: Steps of a k-means fit that is to settle before single steps take over.
SETTLING = 10_000


def _summed(parts: DataFrame, fan_in: int = 32) -> np.ndarray | None:
    """Sum of the vectors of all tasks (task int, v binary), added as a tree."""

    def add(table: pa.Table) -> pa.Table:
        return pa.table({"task": table.column("task")[:1], "v": pa.array([sum(np.frombuffer(x.as_py()) for x in table.column("v")).tobytes()], pa.binary())})

    parts = parts.withColumn("task", F.floor(F.col("task") / fan_in).cast("int")).groupBy("task").applyInArrow(add, "task int, v binary")
    rows = parts.collect()  # one vector for fan_in tasks
    return sum(np.frombuffer(r["v"]) for r in rows) if rows else None


def _per_task(points: DataFrame, f) -> np.ndarray | None:
    """f(matrix) summed over all rows; f returns a flat vector of fixed length."""

    def run(batches):
        from pyspark import TaskContext

        total = None
        for batch in batches:
            if batch.num_rows:
                v = f(_matrix(batch.column(0)))
                total = v if total is None else total + v
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["task", "v"])

    return _summed(points.select("features").where("features is not null").mapInArrow(run, "task int, v binary"))


def moments(points: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of rows, mean, and second moments about zero (d x d)."""
    total = _per_task(points, lambda x: np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()]))
    if total is None:
        raise ValueError("no points")
    d = int(np.sqrt(len(total)))
    return int(total[0]), total[1 : d + 1] / total[0], total[d + 1 :].reshape(d, d)


def _project(points: DataFrame, mean: np.ndarray, basis: np.ndarray) -> DataFrame:
    """id, features of (x - mean) @ basis."""

    def run(batches):
        for batch in batches:
            y = (_matrix(batch.column(1)) - mean) @ basis if batch.num_rows else np.zeros((0, basis.shape[1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(y), pa.list_(pa.float64()))], ["id", "features"])

    return points.select("id", "features").where("features is not null").mapInArrow(run, "id bigint, features array<double>")


class Linear:
    """A fitted projection: transform() maps points."""

    def __init__(self, mean: np.ndarray, basis: np.ndarray, **extra):
        self.mean, self.basis = mean, basis
        self.__dict__.update(extra)

    def transform(self, points: DataFrame) -> DataFrame:
        return _project(points, self.mean, self.basis)


def _signed(vectors: np.ndarray) -> np.ndarray:
    """Columns turned so that their largest entry is positive."""
    return vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])


def pca(points: DataFrame, n_components: int = 2, whiten: bool = False) -> Linear:
    """Principal components of the centred points; whitened, every component has variance 1."""
    n, mean, second = moments(points)
    cov = (second - n * np.outer(mean, mean)) / max(n - 1, 1)
    value, vector = np.linalg.eigh(cov)
    order = np.argsort(-value)[:n_components]
    value, vector = np.maximum(value[order], 0), _signed(vector[:, order])
    basis = vector / np.sqrt(np.maximum(value, 1e-300)) if whiten else vector
    return Linear(mean, basis, explained_variance=value, components=vector.T, explained_variance_ratio=value / max(np.trace(cov), 1e-300))


def bootstrap_pca(points: DataFrame, n_components: int = 2, n_splits: int = 10, train: float = 0.8, seed: int = 0) -> tuple[DataFrame, list[Linear]]:
    """Principal components of the training part of each split: the transformed parts (split_id, id, features), and the
    fitted decomposition of each split."""
    from tessera.operators.resample import Resampler

    fitted: list[Linear] = []

    def fit(part: DataFrame, split: int):
        fitted.append(pca(part, n_components))
        return lambda rows, own=fitted[-1]: own.transform(rows).select("id", "features")

    return Resampler(n_splits, train, seed).fit_transform(points, fit), fitted


def truncated_svd(points: DataFrame, n_components: int = 2) -> Linear:
    """Singular vectors of the points as they are, not centred."""
    _, mean, second = moments(points)
    value, vector = np.linalg.eigh(second)
    order = np.argsort(-value)[:n_components]
    return Linear(np.zeros_like(mean), _signed(vector[:, order]), singular_values=np.sqrt(np.maximum(value[order], 0)), components=_signed(vector[:, order]).T)


def fast_ica(points: DataFrame, n_components: int = 2, max_iter: int = 200, tolerance: float = 1e-4, seed: int = 0) -> Linear:
    """Independent components by parallel fixed-point steps with tanh. Each step is one pass whose sums are as small as
    the components."""
    white = pca(points, n_components, whiten=True)
    k = white.basis.shape[1]
    rng = np.random.Generator(np.random.Philox(seed))
    even = lambda w: (lambda u, _, v: u @ v)(*np.linalg.svd(w))
    w = even(rng.standard_normal((k, k)))
    mean, basis = white.mean, white.basis
    for _ in range(max_iter):

        def f(x, w=w):
            z = (x - mean) @ basis
            g = np.tanh(z @ w.T)
            return np.concatenate([[len(x)], (g.T @ z).ravel(), (1 - g * g).sum(0)])

        s = _per_task(points, f)
        new = even(s[1 : k * k + 1].reshape(k, k) / s[0] - (s[k * k + 1 :] / s[0])[:, None] * w)
        change = np.max(np.abs(np.abs((new * w).sum(1)) - 1))
        w = new
        if change < tolerance:
            break
    return Linear(mean, basis @ w.T, components=(basis @ w.T).T)


def kmeans(points: DataFrame, k: int = 10, seed: int = 42, max_iter: int = 20, settle: bool = False) -> DataFrame:
    """labels(id, cluster). The fit ends after max_iter steps, or when the means move little; with settle it goes on until no
    point changes its cluster, however many steps that takes."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    v = points.select("id", array_to_vector("features").alias("features"))
    fit = KMeans(k=k, seed=seed, maxIter=max_iter, predictionCol="cluster")
    model = (fit.setMaxIter(SETTLING).setTol(1e-9) if settle else fit).fit(v)
    if settle:
        return _nearest(points, _settled(points, np.array(model.clusterCenters())))
    return model.transform(v).select("id", "cluster")


def _gaps(x: np.ndarray, means: np.ndarray) -> np.ndarray:
    return np.stack([((x - m) ** 2).sum(1) for m in means], axis=1)


def _settled(points: DataFrame, means: np.ndarray) -> np.ndarray:
    """The means, moved until every point is nearest to the mean of its own cluster. Only ties that rounding decides can move
    points without lowering the sum of squares; five such steps in a row are the end too."""
    before, least, idle = means, np.inf, 0
    while True:

        def f(x, means=means, before=before):
            gap = _gaps(x, means)
            own = gap.argmin(1)
            sums = np.zeros_like(means)
            np.add.at(sums, own, x)
            moved = (own != _gaps(x, before).argmin(1)).sum() if before is not means else len(x)
            return np.concatenate([[moved, gap.min(1).sum()], np.bincount(own, minlength=len(means)), sums.ravel()])

        total = _per_task(points, f)
        if total is None or not total[0]:
            return means
        idle = 0 if total[1] < least else idle + 1
        if idle == 5:
            return means
        least = min(least, total[1])
        n = total[2 : 2 + len(means), None]
        before, means = means, np.where(n > 0, total[2 + len(means) :].reshape(means.shape) / np.maximum(n, 1), means)


def _nearest(points: DataFrame, means: np.ndarray) -> DataFrame:
    def run(batches):
        for batch in batches:
            own = _gaps(_matrix(batch.column(1)), means).argmin(1) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.astype(np.int32))], ["id", "cluster"])

    return points.select("id", "features").where("features is not null").mapInArrow(run, "id bigint, cluster int")


def _layout(points_or_edges: DataFrame, run, schema: str) -> DataFrame:
    return points_or_edges.groupBy(F.lit(0).alias("one")).applyInPandas(lambda key, pdf: run(pdf), schema)


def _added(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """n rows: the sums of the rows with each number."""
    return np.stack([np.bincount(at, rows[:, j], n) for j in range(rows.shape[1])], axis=1)


def umap_layout(edges: DataFrame, dims: int = 2, epochs: int = 200, seed: int = 0, negatives: int = 5, a: float = 1.577, b: float = 0.895) -> DataFrame:
    """id, position: attraction along the edges of a fuzzy graph and repulsion from random points, in one task that holds the
    edges, of at most MAX_LAYOUT points."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["src", "dst"], ignore_index=True)
        ids = np.unique(np.concatenate([pdf["src"], pdf["dst"]]))
        i, j, w = np.searchsorted(ids, pdf["src"]), np.searchsorted(ids, pdf["dst"]), pdf["weight"].to_numpy()
        rng = np.random.Generator(np.random.Philox(seed))
        y = rng.uniform(-10, 10, (len(ids), dims))
        w = w / w.max()
        for e in range(epochs):
            rate = 1 - e / epochs
            use = rng.random(len(w)) < w
            x, z = i[use], j[use]
            gap = y[x] - y[z]
            d = (gap * gap).sum(1)
            pull = np.clip((-2 * a * b * np.power(np.maximum(d, 1e-12), b - 1) / (1 + a * np.power(d, b)))[:, None] * gap, -4, 4)
            push = np.zeros_like(pull)
            for _ in range(negatives):
                gap = y[x] - y[rng.integers(len(ids), size=len(x))]
                d = (gap * gap).sum(1)
                push += np.clip((2 * b / ((0.001 + d) * (1 + a * np.power(d, b))))[:, None] * gap, -4, 4)
            y += rate * np.clip(_added(x, pull + push, len(ids)) - _added(z, pull, len(ids)), -8, 8)
        return pd.DataFrame({"id": ids, "position": list(y)})

    refuse_more(edges.select("src").unionAll(edges.select("dst")), MAX_LAYOUT, "a layout")
    return _layout(edges.select("src", "dst", "weight"), run, "id bigint, position array<double>")


def _by_neighbours(new: DataFrame, known: DataFrame, values: DataFrame, k: int, metric: str) -> DataFrame:
    """id, value: the mean of the values (arrays) of a new point's nearest known points, weighted by local probability."""
    from tessera.operators.fuzzy import local_probabilities
    from tessera.operators.knn import knn

    near = knn(known, k - 1, metric, queries=new).select("src", "dst", F.col("distance").alias("weight"))
    rows = local_probabilities(near, k).join(values.select(F.col("id").alias("dst"), "value"), "dst")
    rows = rows.select(F.col("src").alias("id"), "weight", F.posexplode("value").alias("place", "v"))
    means = rows.groupBy("id", "place").agg((F.sum(F.col("weight") * F.col("v")) / F.sum("weight")).alias("v"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("place", "v"))), lambda x: x["v"])
    return means.groupBy("id").agg(listed.alias("value"))


def umap_transform(new: DataFrame, known: DataFrame, layout: DataFrame, k: int = 15, metric: str = "euclidean") -> DataFrame:
    """id, position of new points in the layout(id, position) of known ones: where the optimisation of a layout starts a
    point, without its random steps. k counts the point itself."""
    return _by_neighbours(new, known, layout.select("id", F.col("position").alias("value")), k, metric).withColumnRenamed("value", "position")


def umap_inverse(places: DataFrame, layout: DataFrame, known: DataFrame, k: int = 15) -> DataFrame:
    """id, features of places(id, position) in a layout: the same with layout and features in each other's part."""
    at = lambda df: df.select("id", F.col("position").alias("features"))
    return _by_neighbours(at(places), at(layout), known.select("id", F.col("features").alias("value")), k, "euclidean").withColumnRenamed("value", "features")


#: Numbers of a slab of rows of tsne(), and of the probabilities that a task keeps; beyond, it computes them anew each time.
SLAB, KEPT = 1 << 17, 1 << 25


def _bandwidths(x: np.ndarray, rows: np.ndarray, start: float, perplexity: float) -> tuple[np.ndarray, np.ndarray]:
    """The precision at which a row's neighbourhood has the perplexity, and the sum of its kernel."""
    n = len(x)
    beta, norm = np.zeros(len(rows)), np.zeros(len(rows))
    goal = np.log(min(perplexity, max((n - 1) / 3, 1)))
    for at in _slabs(len(rows), n):
        d = _squares(x[rows[at]], x)
        own = np.arange(len(d)), rows[at]
        d[own] = 0
        lo, hi, now = np.zeros(len(d)), np.full(len(d), np.inf), np.full(len(d), start)
        for _ in range(50):
            p = np.exp(-d * now[:, None])
            p[own] = 0
            s = np.maximum(p.sum(1), 1e-300)
            h = np.log(s) + now * (d * p).sum(1) / s
            beta[at], norm[at] = now, s
            lo, hi = np.where(h > goal, now, lo), np.where(h > goal, hi, now)
            now = np.where(np.isinf(hi), now * 2, (lo + hi) / 2)
    return beta, norm


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T, 0)


def _exchange(context):
    """A function of a barrier task that gives the arrays of all tasks, one below the other. They meet at the first task over
    sockets, as Spark's own gathering waits about a second each time; its one use here tells where and by which key."""
    import hmac
    import secrets
    import socket

    def read(link: socket.socket, n: int) -> bytes:
        parts = bytearray()
        while len(parts) < n:
            got = link.recv(min(n - len(parts), 1 << 20))
            if not got:
                raise ConnectionError("another task of the layout has ended")
            parts += got
        return bytes(parts)

    def send(link: socket.socket, data: bytes) -> None:
        link.sendall(len(data).to_bytes(8, "little") + data)

    def take(link: socket.socket) -> bytes:
        return read(link, int.from_bytes(read(link, 8), "little"))

    rank, infos = context.partitionId(), context.getTaskInfos()
    host = infos[0].address.rsplit(":", 1)[0]
    door = socket.create_server(("", 0), backlog=len(infos)) if rank == 0 else None
    port, key = context.allGather(f"{door.getsockname()[1]} {secrets.token_hex(16)}" if door else "")[0].split()
    links: dict[int, socket.socket] = {}
    if door:
        door.settimeout(120)
        while len(links) < len(infos) - 1:
            link, _ = door.accept()
            link.settimeout(600)
            hello = read(link, 36)
            if hmac.compare_digest(hello[:32], key.encode()):
                links[int.from_bytes(hello[32:], "little")] = link
            else:
                link.close()
        door.close()
    else:
        links[0] = socket.create_connection((host, int(port)), timeout=600)
        links[0].sendall(key.encode() + rank.to_bytes(4, "little"))
    for link in links.values():
        link.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)

    def shared(own: np.ndarray) -> np.ndarray:
        if rank:
            send(links[0], own.tobytes())
            whole = take(links[0])
        else:
            whole = b"".join([own.tobytes(), *(take(links[r]) for r in range(1, len(infos)))])
            for link in links.values():
                send(link, whole)
        return np.frombuffer(whole).reshape(-1, own.shape[1])

    return shared


def _slabs(rows: int, n: int):
    step = max(1, SLAB // max(n, 1))
    return [slice(a, min(a + step, rows)) for a in range(0, rows, step)]


def tsne(points: DataFrame, dims: int = 2, perplexity: float = 30.0, epochs: int = 300, seed: int = 0) -> DataFrame:
    """id, position by exact t-SNE: every pair counts in each epoch. The rows are dealt to as many tasks as run at once, which
    hold all points, work through slabs of their rows, and exchange the sums of each epoch; at most MAX_LAYOUT points. There is
    no transform for new points."""
    refuse_more(points.select("id"), MAX_LAYOUT, "a layout")
    spark = points.sparkSession
    table = points.select("id", "features").where("features is not null").orderBy("id").toArrow()
    ids = np.asarray(table.column("id").combine_chunks(), np.int64)
    x = _matrix(table.column("features"))
    context = spark.sparkContext._jsc.sc()
    at_once = context.maxNumConcurrentTasks(context.resourceProfileManager().defaultResourceProfile())
    n, tasks = len(ids), max(1, min(len(ids), at_once))

    def run(batches):
        from pyspark import BarrierTaskContext

        for _ in batches:
            pass
        context = BarrierTaskContext.get()
        rows = np.arange(context.partitionId() * n // tasks, (context.partitionId() + 1) * n // tasks)

        shared = _exchange(context)
        some = x[np.random.Generator(np.random.Philox(seed)).choice(n, min(n, 500), replace=False)]  # for where the search starts
        start = 1 / max(np.median(_squares(some, some)[~np.eye(len(some), dtype=bool)]) if n > 1 else 1, 1e-12)
        beta, norm = shared(np.stack(_bandwidths(x, rows, start, perplexity), axis=1)).T

        def probabilities(at: slice) -> np.ndarray:
            d = _squares(x[rows[at]], x)
            p = np.exp(-d * beta[rows[at], None]) / norm[rows[at], None] + np.exp(-d * beta[None]) / norm[None]
            p[np.arange(len(p)), rows[at]] = 0
            return np.maximum(p / (2 * n), 1e-12)

        kept = {at.start: probabilities(at) for at in _slabs(len(rows), n)} if len(rows) * n <= KEPT else None
        y = np.random.Generator(np.random.Philox(seed)).standard_normal((n, dims)) * 1e-4
        move = np.zeros_like(y)
        for e in range(epochs):
            sums = np.zeros((len(rows), 2 * dims + 1))
            square, one = (y * y).sum(1)[:, None], np.ones((n, 1))
            right, ends = np.concatenate([y, square, one], axis=1).T, np.concatenate([y, one], axis=1)
            left = np.concatenate([-2 * y, one, square + 1], axis=1)[rows]
            for at in _slabs(len(rows), n):
                q = left[at] @ right  # 1 + the square of the distance
                np.reciprocal(q, out=q)
                q[np.arange(len(q)), rows[at]] = 0
                own, pull = y[rows[at]], ((kept[at.start] if kept else probabilities(at)) * q) @ ends
                sums[at, :dims] = pull[:, dims:] * own - pull[:, :dims]
                sums[at, 2 * dims] = q.sum(1)
                q *= q
                push = q @ ends
                sums[at, dims : 2 * dims] = push[:, dims:] * own - push[:, :dims]
            sums = shared(sums)
            grad = 4 * ((12 if e < 100 else 1) * sums[:, :dims] - sums[:, dims : 2 * dims] / max(sums[:, 2 * dims].sum(), 1e-300))
            move = (0.5 if e < 100 else 0.8) * move - 200 * grad
            y = y + move
            y -= y.mean(0)
        yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(list(y[rows]), pa.list_(pa.float64()))], ["id", "position"])

    schema = "id bigint, position array<double>"
    if not n:
        return spark.createDataFrame([], schema)
    return spark.range(0, tasks, 1, tasks).mapInArrow(run, schema, barrier=True)


ALGORITHMS = {
    "neighbors": ("exact blocks", "random-projection hashing"),
    "decomposition": ("pca", "truncated_svd", "fast_ica", "tsne", "umap"),
    "community": ("leiden", "louvain", "distributed louvain"),
}
