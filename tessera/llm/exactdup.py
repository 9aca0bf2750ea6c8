"""Exact deduplication with a log-structured merge index, in DataFrame operations only.

Each scan partition is a memtable: its (digest, id) rows are sorted and flushed into one of a few level-0 runs, which
are Parquet tables whose digest column carries Bloom filters, by which find() leaves row groups unread. Compaction merges
the runs by digest, all in one level, and keeps one identifier of each. The digests that occur twice or more make a second, size-bounded filter; documents that hit it get
their bytes verified: of each digest the smallest and the largest text must be the same bytes. Digests that fail are
split by their text, so even colliding digests give right groups.

Defined results: null text counts as empty; every input row gives one output row; rows that repeat an id with the same
text count in group_size, and each of them is marked kept if its id is the group's; a null id stays only if the group
has no other. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of 64 bits in the filter of hits: at most 4 MB when broadcast, whatever the input.
MAX_FILTER_WORDS = 1 << 18


def normalised(text: Column) -> Column:
    """A-Z in lower case, everything else as it is; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def _digest(text: Column, bits: int) -> Column:
    return F.unhex(F.substring(F.sha2(text, 256), 1, bits // 4))


def _slots(digest: Column, words: int) -> tuple[Column, Column]:
    """The filter word of a digest, and its three bits there."""
    h = F.xxhash64(digest)
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, k).bitwiseAND(F.lit(63)).cast("int"))
    return F.pmod(F.xxhash64(digest, F.lit(7)), F.lit(words)), bit(0).bitwiseOR(bit(6)).bitwiseOR(bit(12))


class MergeIndex:
    """The index: flush() appends level-0 runs, compact() merges them, lookup() finds the survivor of each digest."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", runs: int = 4, digest_bits: int = 256):
        if keep not in ("min", "max") or digest_bits % 8 or not 8 <= digest_bits <= 256:
            raise ValueError("keep is min or max; digest_bits is a multiple of 8 up to 256")
        self.keep, self.runs, self.bits = keep, runs, digest_bits
        self.docs = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("body"))
        self.level0: DataFrame | None = None
        self.level1: DataFrame | None = None

    def flush(self) -> DataFrame:
        """Sorted runs of (digest, id): one scan, no shuffle. The run number is the memtable's partition modulo runs."""
        rows = self.docs.select(_digest(F.col("body"), self.bits).alias("digest"), "id", F.pmod(F.spark_partition_id(), F.lit(self.runs)).alias("run"))
        rows = rows.sortWithinPartitions("run", "digest")
        self.level0 = materialise(rows, "runs", ["run"], {"parquet.bloom.filter.enabled#digest": "true"})
        return self.level0

    def compact(self) -> DataFrame:
        """One entry a digest: the kept id, and the number of rows. Partial aggregation runs before the shuffle."""
        best = F.min("id") if self.keep == "min" else F.max("id")
        self.level1 = self.level0.groupBy("digest").agg(best.alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        return self.level1

    def find(self, texts: list[str]) -> DataFrame:
        """The rows (digest, id, run) of a few texts. Their digests go down to the runs, whose sorted row groups and Bloom
        filters leave most of them unread."""
        fold = str.maketrans(UPPER, LOWER)
        digests = [hashlib.sha256(t.translate(fold).encode()).digest()[: self.bits // 8] for t in texts]
        return self.level0.where(F.col("digest").isin(digests) if digests else F.lit(False))

    def verify(self) -> DataFrame:
        """Digests shared by different texts. Texts are read for the hits of the filter only, and each task passes on
        two texts a digest at most, so a group of any size meets in one small aggregate."""
        hits = self.level1.where("group_size > 1").select("digest")
        n = hits.count()
        words = 64
        while words < MAX_FILTER_WORDS and words * 4 < n:
            words *= 2
        word, bits = _slots(F.col("digest"), words)
        bloom = hits.select(word.alias("word"), bits.alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("mask"))
        docs = self.docs.withColumn("digest", _digest(F.col("body"), self.bits))
        docs = docs.withColumn("word", word).withColumn("bits", bits).join(F.broadcast(bloom), "word")
        docs = docs.where(F.col("mask").bitwiseAND(F.col("bits")) == F.col("bits"))
        ends = docs.groupBy("digest").agg(F.min("body").alias("low"), F.max("body").alias("high"))
        return ends.where("low <> high").select("digest")

    def lookup(self) -> DataFrame:
        """Each row with its kept id: columns id, keep_id, group_size, digest."""
        clashes = materialise(self.verify(), "clashes")
        if clashes.isEmpty():
            return self.level0.select("id", "digest").join(self.level1, "digest")
        best = F.min("id") if self.keep == "min" else F.max("id")
        split = self.docs.withColumn("digest", _digest(F.col("body"), self.bits)).join(clashes, "digest", "left_semi")
        groups = split.groupBy("digest", "body").agg(best.alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        split = split.join(groups, ["digest", "body"]).select("digest", "id", "keep_id", "group_size")
        clear = self.level0.join(clashes, "digest", "left_anti").select("id", "digest").join(self.level1, "digest")
        return clear.unionByName(split)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", runs: int = 4, digest_bits: int = 256) -> DataFrame:
    """Each row's id, the id that stays of its equal texts, their number, and whether this row stays."""
    index = MergeIndex(docs, id_col, text_col, keep, runs, digest_bits)
    index.flush()
    merged = index.compact()
    index.level1 = materialise(merged, "merged")
    found = index.lookup()
    return found.select(
        F.col("id").alias(id_col), "keep_id", "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("digest"),
    )


__all__ = ["MergeIndex", "exact_groups", "normalised", "discard"]
