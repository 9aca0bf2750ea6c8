"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on everything that its predecessor kept, and returns a DataFrame that is
written before the next stage reads it. All but the last return the columns of documents. Defined results: null texts
count as empty and null sources are a source; rows equal in id and text count as copies of each other and one stays;
rows that repeat an id with other texts are documents of their own; a null id is an id like any other; empty tables stay
empty; extra columns pass through up to the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import exactdup, mixing, neardup, packing, quality
from tessera.llm.common import documents, id_bucket, materialise
from tessera.llm.queries import tokenizer_path


def _keep(docs: DataFrame, rows: DataFrame, key: Column) -> DataFrame:
    """The rows of docs that are kept, given rows(doc_id, kept, key) for each row of docs; key of a column `text` tells
    rows of one id apart. Of rows equal in id and key the first by text stays, then by a hash of all columns. The join is a
    merge join at every size, so what it shuffles is in proportion to the input."""
    names, own = docs.columns, [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*own)
    doc_id, text = (F.col(own[names.index(c)]) for c in ("doc_id", "text"))
    ids = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.max("kept").alias("kept"))
    ids = materialise(ids.where("kept"), "kept")
    match = doc_id.eqNullSafe(F.col("doc_id"))
    once = plain.join(ids.where("rows = 1").hint("merge"), match, "left_semi")
    several = ids.where("rows > 1").select("doc_id")
    if several.isEmpty():
        return once.toDF(*names)
    chosen = rows.where("kept").select(F.col("doc_id").alias("id"), "key").distinct()
    more = plain.join(several.hint("merge"), match, "left_semi").withColumn("text", text).withColumn("own_key", key).drop("text")
    more = more.join(chosen.hint("merge"), doc_id.eqNullSafe(F.col("id")) & (F.col("own_key") == F.col("key")), "left_semi")
    order = Window.partitionBy(doc_id, "own_key").orderBy(text, F.xxhash64(*[F.col(c).cast("string") for c in own]))
    more = more.withColumn("place", F.row_number().over(order)).where("place = 1")
    return once.unionByName(more.select(*own)).toDF(*names)


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. It learns from the labels outside the held-out fifth."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs, labels, F.coalesce(id_bucket("doc_id", 5) != 0, F.lit(False)))
    return quality.accepted(docs, model)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest id."""
    rows = exactdup.exact_groups(docs, keep="max").select("doc_id", "kept", F.col("digest").alias("key"))
    return _keep(docs, rows, F.sha2(exactdup.normalised(F.col("text")), 256))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a similarity of 0.8 or more on shingles of five words, the row with the least id; of
    several rows with that id, the one with the least hash of its text. A text without words is linked with nothing."""
    rows = materialise(neardup.near_groups(docs), "near")
    named = rows.where("kept and n_shingles > 0")
    several = named.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("id"))
    if not several.isEmpty():
        least = named.join(several, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi").groupBy("component").agg(F.min("text_hash").alias("least"))
        rows = rows.join(least, "component", "left").withColumn("kept", F.col("kept") & F.coalesce(F.col("text_hash") == F.col("least"), F.lit(True)))
    return _keep(docs, rows.select("doc_id", "kept", F.col("text_hash").alias("key")), F.xxhash64(F.coalesce("text", F.lit(""))))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at weights 1, 2, 3, repeating; a document comes up to three times."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens: a row for each piece."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality classifier", filter_quality),
    ("exact dedup", drop_exact_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: The quality classifier is a trained model, which SQL cannot express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)
