"""Fitting a classifier on labelled documents: on a bounded sample in one task, or on all of them, dealt into parts of
bounded size that are trained on side by side and whose results are added as a tree."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import bloom
from tessera.llm.common import discard, materialise, partitions, uniform

FAN_IN = 16


def known_labels(labels: DataFrame, label: str, allowed: Column, id_col: str) -> DataFrame:
    """id and label 0 or 1. Labels that contradict each other or are null don't count."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull() & allowed)
    return known.groupBy(id_col).agg(F.min(label).alias("label"), F.max(label).alias("most")).where("label = most").drop("most")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, per_class: int, seed: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """text and label of at most per_class documents of each label 0 and 1, chosen by a hash of the id. The ids are
    chosen first, so only the sample's texts move; of several rows with one id the least text counts."""
    known = known_labels(labels, label, allowed, id_col)
    order = uniform(F.col(id_col), F.lit(seed))
    chosen = None
    for value in (0, 1):
        part = known.where(F.col("label") == value).orderBy(order, id_col).limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    # at most 2 * per_class rows of an id and a label
    rows = docs.select(id_col, F.col(text_col).alias("text")).join(F.broadcast(chosen), id_col)
    return rows.groupBy(id_col).agg(F.min("text").alias("text"), F.min("label").alias("label")).select(id_col, "text", "label")


def fit_once(sample: DataFrame, fit: Callable[[pa.Table], object]) -> object:
    """Runs fit on the whole sample in one task and brings the model to the driver. The sample is bounded by its maker;
    rows are sorted, so the model doesn't depend on how they were dealt."""
    columns = sample.columns
    empty = pa.table({c: pa.array([], pa.string()) for c in columns})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        table = pa.Table.from_batches(got) if got else empty
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(table))], pa.binary())], ["model"])

    one = sample.repartition(1).sortWithinPartitions(*[c for c in columns if c != "text"])
    row = one.mapInArrow(run, "model binary").first()
    return pickle.loads(row["model"]) if row else fit(empty)


def labelled_parts(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, make: Callable[[pa.Table], pa.Table], schema: str, part_bytes: int, seed: int, id_col: str, text_col: str, lang_col: str) -> tuple[DataFrame, int]:
    """All documents with a label 0 or 1, dealt by a hash of the id into parts of about part_bytes of text, and the number
    of parts. make(part long, id, text, label long, lang string; a row for each id, in order) gives the one row of a part,
    in schema; the parts are a stored table with a file each. Of several rows with one id the least text and the least
    language count. Texts move once, and only those that a filter of the labelled ids lets through."""
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType
    known = known_labels(labels, label, allowed, id_col).select(F.col(id_col).cast(id_type).alias("id"), F.col("label").cast("long").alias("label"))
    known = materialise(known, "labels")
    rows = docs.where(F.col(id_col).isNotNull())
    lang = F.col(lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    size = rows.select(F.col(id_col).alias("id"), F.octet_length(text_col).cast("long").alias("size")).join(known, "id").agg(F.sum("size")).first()[0]
    parts = max(1, -(-(size or 0) // part_bytes))
    part = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(parts)).alias("part")
    bits = spark.sparkContext.broadcast(bloom.of_column(known.select(F.xxhash64("id").alias("h")), bloom.leading_bits(partitions(spark))))

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = bloom.maybe(np.asarray(batch.column(0), np.int64).view(np.uint64), bits.value)
            yield pa.RecordBatch.from_arrays(batch.filter(pa.array(hit)).columns[1:], ["id", "text", "lang"])

    texts = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), lang.alias("lang"))
    texts = texts.select(F.xxhash64("id").alias("h"), "id", "text", "lang").mapInArrow(labelled, texts.schema).select(part, "id", "text", "lang")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        of_id = dict(zip(right.column("id").to_pylist(), right.column("label").to_pylist(), strict=True))
        left = left.filter(pa.array([i in of_id for i in left.column("id").to_pylist()], pa.bool_()))
        ids, langs = left.column("id").to_pylist(), left.column("lang").to_pylist()
        least: dict = {}
        for i, x in zip(ids, langs, strict=True):
            if x is not None:
                least[i] = min(x, least.get(i, x))
        left = left.sort_by([("id", "ascending"), ("text", "ascending")])  # nulls last
        ids = left.column("id").to_pylist()
        first = [k for k, i in enumerate(ids) if not k or i != ids[k - 1]]
        left, ids = left.take(pa.array(first, pa.int64())), [ids[k] for k in first]
        return make(left.select(["part", "id", "text"]).append_column("label", pa.array([of_id[i] for i in ids], pa.int64())).append_column("lang", pa.array([least.get(i) for i in ids], pa.string())))

    dealt = texts.groupBy("part").cogroup(known.select(part, "id", "label").groupBy("part")).applyInArrow(run, schema)
    dealt = materialise(dealt, "labelled", options={"maxRecordsPerFile": 1, "compression": "zstd"})
    discard(known)
    bits.unpersist()
    return dealt, parts


def summed(found: DataFrame, parts: int, shape: tuple[int, int]) -> np.ndarray:
    """Adds matrices of one shape as a tree, in an order that depends on their numbers only. found(part long, at binary, v
    binary): of each its rows that are not zero, as sparse() has them."""

    def into(total: np.ndarray, at: bytes, v: bytes) -> None:
        rows = np.frombuffer(at, np.int64)
        if len(rows):
            total[rows] += np.frombuffer(v, f"f{len(v) // (len(rows) * shape[1])}").reshape(-1, shape[1])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(shape)
        for i in np.argsort(np.asarray(table.column("part").combine_chunks()), kind="stable").tolist():
            into(total, table.column("at")[i].as_py(), table.column("v")[i].as_py())
        return pa.table({"part": pa.array([table.column("part")[0].as_py() // FAN_IN]), **{k: pa.array([x], pa.binary()) for k, x in sparse(total).items()}})

    while parts > 1:
        found = found.withColumn("group", F.floor(F.col("part") / FAN_IN)).groupBy("group").applyInArrow(lambda table: add(table.drop_columns(["group"])), "part long, at binary, v binary")
        parts = -(-parts // FAN_IN)
    total = np.zeros(shape)
    for r in found.collect():  # one row at most
        into(total, r["at"], r["v"])
    return total


def sparse(matrix: np.ndarray) -> dict[str, bytes]:
    """The rows of a matrix that are not zero, by number (int64) and content (float32, or else float64)."""
    at = np.flatnonzero(matrix.any(axis=1))
    return {"at": at.astype(np.int64).tobytes(), "v": matrix[at].astype(matrix.dtype if matrix.dtype == np.float32 else np.float64).tobytes()}
