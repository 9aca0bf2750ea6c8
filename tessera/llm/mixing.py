"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Documents are shuffled by a seeded hash of their id. A document's virtual finish time is the number of its source's
tokens up to and including it, divided by the source's target; a source whose target exceeds its size goes round again,
up to max_repeats times. The mix is the documents in order of finish time, cut at the total budget.

Running totals never gather a source in one task: the shuffled order is cut into cells of a hash prefix (a source with
more rows gets more cells), cells are summed first, and only rows of one cell meet. The global order is a range sort by
finish time: partitions are summed, one row each, and only the partition in which the budget ends is cut row by row.

Defined results: null text has size 0; rows of size 0 stay in their place and add nothing; a source of size 0 has target
0 and nothing is taken; with no tokens at all all targets are 0. Rows that repeat an id and source are ordered by size.
A null source is a source of its own. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialise, partitions

#: Rows that a partition of the global order is meant to have.
RANGE_ROWS = 500_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def shuffle_key(column: str, seed: int) -> Column:
    """32 hex digits that depend on the id and the seed only."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(column).cast("string"), F.lit("-"))))


def rank_weights(sizes: DataFrame, cycle: int = 3) -> DataFrame:
    """Weights 1, 2, .. cycle for the sources in code point order, null last. sizes has one row a source."""
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    return sizes.withColumn("weight", F.pmod(F.row_number().over(order) - 1, F.lit(cycle)).cast("long") + 1)


def fill_targets(sizes: DataFrame, budget: int, max_repeats: int = 3) -> DataFrame:
    """sizes(source, source_size, weight) with target: the budget by weight, at most max_repeats times a source's size,
    the excess given to the others by weight. Every round caps at least one source or is the last; a round is one
    small aggregate, and two numbers come back to the driver."""
    if budget == 0:
        return sizes.withColumn("target", F.lit(0.0))
    cap, weight = F.col("source_size") * max_repeats, F.col("weight")
    level = -1.0
    while True:
        full = F.lit(False) if level < 0 else cap < F.lit(level) * weight
        used, rest = sizes.agg(F.sum(F.when(full, cap).otherwise(0)), F.sum(F.when(full, 0).otherwise(weight))).first()
        new = (budget - used) / rest if rest else level
        if new <= level or not rest:
            break
        level = new
    return sizes.withColumn("target", F.when(cap < F.lit(level) * weight, cap.cast("double")).otherwise(F.lit(level) * weight))


def _running(rows: DataFrame, cell_rows: int) -> DataFrame:
    """Adds ahead: the tokens of the rows of the same source that come earlier in shuffled order, this one included."""
    counts = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    cells = F.greatest(F.lit(1), F.least(F.lit(1 << 28), F.ceil(F.col("n") / cell_rows)))
    rows = rows.join(counts, rows["source"].eqNullSafe(counts["source"])).drop(counts["source"])
    prefix = F.conv(F.substring("shuffled", 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("cell", F.floor(prefix * cells / (1 << 32))).drop("n")
    rows = rows.withColumn("source_key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    sums = rows.groupBy("source_key", "cell").agg(F.sum("size").alias("cell_size"))
    before = Window.partitionBy("source_key").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("start", F.coalesce(F.sum("cell_size").over(before), F.lit(0))).drop("cell_size")
    within = Window.partitionBy("source_key", "cell").orderBy("shuffled", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(sums, ["source_key", "cell"])
    return rows.withColumn("ahead", F.col("start") + F.sum("size").over(within)).drop("start", "cell", "source_key")


def fair_queue(docs: DataFrame, weights: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_repeats: int = 3, seed: int = 13, cell_rows: int = 2_000, budget: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Two tables: the documents (id, source, size, source_size, target, ahead) and the mix (id, source, size, epoch,
    finish, and the rank columns shuffled and ahead), both without text. weights(source, weight) are whole numbers;
    None gives 1, 2, 3, 1, .. by rank. budget None means the size of the whole input."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), shuffle_key(id_col, seed).alias("shuffled"))
    rows = materialise(rows, "sizes")
    sizes = materialise(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    total = sizes.agg(F.sum("source_size")).first()[0] or 0
    budget = total if budget is None else min(budget, total * max_repeats)
    if weights is None:
        sizes = rank_weights(sizes)
    else:
        sizes = sizes.join(weights.select(F.col("source").alias("s"), F.col("weight").cast("long").alias("weight")), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    targets = materialise(fill_targets(sizes, budget, max_repeats), "targets")
    rows = _running(rows, cell_rows)
    rows = rows.join(targets, rows["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    rows = materialise(rows, "queue")

    copies = rows.where("size > 0 and target > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))))
    copies = copies.withColumn("finish", (F.col("epoch") * F.col("source_size") + F.col("ahead")) / F.col("target"))
    parts = max(partitions(docs.sparkSession), -(-max_repeats * rows.count() // RANGE_ROWS))
    copies = in_order(copies.select("id", "source", "size", "epoch", "finish", "shuffled", "ahead"), parts)
    copies = materialise(copies.withColumn("range", F.spark_partition_id()), "order")
    sums = copies.groupBy("range").agg(F.sum("size").alias("range_size"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = materialise(sums.withColumn("start", F.coalesce(F.sum("range_size").over(before), F.lit(0))), "ranges")
    whole = copies.join(sums.where(F.col("start") + F.col("range_size") <= budget).select("range"), "range", "left_semi")
    cut = copies.join(sums.where((F.col("start") < budget) & (F.col("start") + F.col("range_size") > budget)), "range")
    upto = Window.partitionBy("range").orderBy("finish", "shuffled", "id", "epoch").rowsBetween(Window.unboundedPreceding, 0)
    cut = cut.withColumn("upto", F.col("start") + F.sum("size").over(upto)).where(F.col("upto") <= budget)
    keep = ["id", "source", "size", "epoch", "finish", "shuffled", "ahead"]
    return rows, whole.select(keep).unionByName(cut.select(keep))


def in_order(mix: DataFrame, parts: int) -> DataFrame:
    """The mix in global order of finish time: range-partitioned, then sorted inside the partitions."""
    order = ["finish", "shuffled", "id", "epoch"]
    return mix.repartitionByRange(parts, *order).sortWithinPartitions(*order)


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """A row for each document: doc_id, size, source_size, target, taken."""
    rows, mix = fair_queue(docs, **options)
    taken = mix.groupBy("id", "source", "shuffled", "size", "ahead").agg(F.sum("size").alias("taken"))
    key = F.struct(F.coalesce(F.col("source"), F.lit("")).alias("a"), F.col("source").isNull().alias("b"), F.coalesce(F.col("id").cast("string"), F.lit("")).alias("c"), "size", "ahead")
    taken = taken.select(key.alias("key"), "taken")
    rows = rows.withColumn("key", key)
    return rows.join(taken, "key", "left").select(F.col("id").alias("doc_id"), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", ordered: bool = False, **options) -> DataFrame:
    """The rows of docs that the mix takes, each as often as it is taken; columns as in docs, whatever their names. An id
    that repeats in docs counts once for each of its rows. ordered sorts the rows themselves by finish time, which moves
    the texts a second time; what comes next here, packing, doesn't ask for an order."""
    _, mix = fair_queue(docs, id_col=id_col, **options)
    taken = mix.groupBy("id", "epoch").agg(F.min("finish").alias("finish"), F.min("shuffled").alias("shuffled"))
    own = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*own)
    if ordered:
        out = rows.join(taken.hint("merge"), F.col(own[docs.columns.index(id_col)]).eqNullSafe(F.col("id")))
        return in_order(out, partitions(docs.sparkSession)).select(*own).toDF(*docs.columns)
    times = taken.groupBy("id").agg(F.count(F.lit(1)).alias("times"))
    out = rows.join(times.hint("merge"), F.col(own[docs.columns.index(id_col)]).eqNullSafe(F.col("id")))
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*own).toDF(*docs.columns)
