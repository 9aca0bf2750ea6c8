"""Exact top-k search by tiled matrix products.

Queries are taken in blocks of a fixed number; of one block, every task multiplies its tiles of candidates with the
query matrix and keeps, for each query, the best k of the tile and of what it has kept so far. The lists of the tasks
are merged as a tree: groups of `fan_in` lists become one, until one is left. The driver holds one block of queries at
a time (block_rows x dimensions numbers), never the candidates.

Components become floor(scale * x), and scores are sums of integer products, exact: in float64 while no partial sum can
pass 2^53, else in Python integers.

Defined results: rows whose vector is null, or holds a null or non-finite component, take no part; shorter vectors
count as filled up with zeros; an empty vector scores 0 with all; rows without id take no part; rows that repeat a
query's id count as the query itself, whose vector is the least of theirs; ties go to the smaller id. With fewer than k candidates all are returned. Empty
tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialise

LISTS = "query_id long, task int, vec_id long, score long"


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """id and the integer vector of the rows that take part."""
    x = F.col(vec_col)
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    rows = vectors.where(x.isNotNull() & F.col(id_col).isNotNull() & ~F.exists(x, bad))
    return rows.select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda v: F.floor(v.cast("double") * scale)).alias("v"))


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Rows of a list column as int64, filled up with zeros to the width or cut to it."""
    flat, off = np.asarray(column.values, np.int64), np.asarray(column.offsets, np.int64)
    lengths = np.diff(off)
    if len(lengths) and (lengths == width).all():
        return flat[off[0] : off[-1]].reshape(-1, width)
    out = np.zeros((len(lengths), width), np.int64)
    for i, (a, n) in enumerate(zip(off[:-1], np.minimum(lengths, width), strict=True)):
        out[i, :n] = flat[a : a + n]
    return out


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, id, score) of each row's k best; ids are in rising order along the columns, so the first of a tie wins.
    Masked entries are below the least integer score and are left out."""
    rows, n = scores.shape
    if n > k:
        kth = np.partition(scores, n - k, axis=1)[:, n - k, None]
        above, equal = scores > kth, scores == kth
        chosen = above | (equal & (np.cumsum(equal, axis=1) <= k - above.sum(axis=1, keepdims=True)))
    else:
        chosen = np.ones_like(scores, bool)
    r, c = np.nonzero(chosen & (scores > -np.inf))
    return r, ids[c], scores[r, c]


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 64, block_rows: int = 8192, tile_rows: int = 2048, fan_in: int = 16) -> DataFrame:
    """query_id, rank, vec_id, score for the rows that is_query (on the id column) marks, against all rows but the
    query's own."""
    rows = materialise(quantised(vectors, id_col, vec_col, scale), "vectors")
    marked = rows.withColumnRenamed("id", id_col).where(is_query).withColumnRenamed(id_col, "id")
    marked = marked.groupBy("id").agg(F.min("v").alias("v"))
    width, least, most, n = rows.agg(F.max(F.size("v")), F.min(F.array_min("v")), F.max(F.array_max("v")), F.count(F.lit(1))).first()
    parts = None
    blocks = max(1, -(-marked.count() // block_rows))
    for block in range(blocks):
        own = marked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).toArrow()
        part = _merged(_lists(rows, own, k, width or 0, max(abs(least or 0), abs(most or 0)), tile_rows), k, fan_in)
        parts = part if parts is None else parts.unionByName(part)
    return parts


def _lists(rows: DataFrame, queries: pa.Table, k: int, width: int, largest: int, tile_rows: int) -> DataFrame:
    """Each task's best k for each query of a block."""
    kind = np.float64 if largest * largest * max(width, 1) < 1 << 53 else object
    q_ids = np.asarray(queries.column("id"), np.int64)
    chunks = queries.column("v").combine_chunks()
    q = _matrix(chunks if isinstance(chunks, pa.ListArray) else chunks.chunk(0), width).astype(kind) if len(q_ids) else np.zeros((0, width))

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def shrink() -> None:
            r, i, s = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((i, -s, r))
            r, i, s = r[order], i[order], s[order]
            place = np.arange(len(r)) - np.searchsorted(r, r)
            held[:] = [(r[place < k], i[place < k], s[place < k])]

        for batch in batches:
            ids, values = np.asarray(batch.column(0), np.int64), _matrix(batch.column(1), width).astype(kind)
            order = np.argsort(ids, kind="stable")
            for a in range(0, len(order), tile_rows):
                tile = order[a : a + tile_rows]
                own = ids[tile]
                for b in range(0, len(q_ids), tile_rows):
                    scores = (q[b : b + tile_rows] @ values[tile].T).astype(float if kind is np.float64 else object)
                    scores[q_ids[b : b + tile_rows, None] == own] = -np.inf
                    r, i, s = best_of(scores, own, k)
                    held.append((r + b, i, s))
                if len(held) > 8:
                    shrink()
        if held:
            shrink()
            r, i, s = held[0]
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[r]), pa.array(np.full(len(r), task, np.int32)), pa.array(i), pa.array(s.astype(np.int64))], ["query_id", "task", "vec_id", "score"])

    return rows.mapInArrow(run, LISTS)


def _merged(lists: DataFrame, k: int, fan_in: int) -> DataFrame:
    """The lists of all tasks merged level by level; a merge sees fan_in lists of k at most."""
    lists = materialise(lists, "lists")
    last = lists.agg(F.max("task")).first()[0] or 0
    best = lambda keys: Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    while last >= fan_in:
        lists = lists.withColumn("task", F.floor(F.col("task") / fan_in).cast("int"))
        lists = lists.withColumn("rank", F.row_number().over(best(["query_id", "task"]))).where(F.col("rank") <= k).drop("rank")
        last //= fan_in
    return lists.withColumn("rank", F.row_number().over(best(["query_id"]))).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
