"""A Bloom filter of 64-bit hashes that executors build in stretches; its size has a fixed upper bound."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernels as K

#: 32 MB, whatever the input; beyond it the filter only lets more through.
MAX_BITS = 1 << 28


def places(h: np.ndarray, size: int) -> list[np.ndarray]:
    """Two places of each hash, both within the stretch that its leading bits name."""
    shift = 64 - size.bit_length() + 1
    first = (h >> np.uint64(shift)).astype(np.int64)
    return [first, first ^ (K.mix(h) & np.uint64(0x3FF)).astype(np.int64)]


def maybe(h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """False where a hash is not in the filter."""
    out = np.ones(len(h), bool)
    for x in places(h, len(bits) * 8):
        out &= (bits[x >> 3] >> (x & 7).astype(np.uint8)) & 1 == 1
    return out


def build(parts: DataFrame, lead: int) -> np.ndarray:
    """The filter as bytes, from parts(part int, n long, hashes binary): part is a hash's `lead` leading bits."""
    n = parts.agg(F.sum("n")).first()[0] or 0
    least = 1024 << lead
    size = least
    while size < 16 * n and size < max(MAX_BITS, least):
        size *= 2
    stretch = size >> lead

    def run(batches):
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.zeros(stretch, bool)
                for x in places(np.frombuffer(blob.as_py(), np.uint64), size):
                    own[x & (stretch - 1)] = True
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())], ["part", "bits"])

    whole = np.zeros(size // 8, np.uint8)
    for r in parts.select("part", "hashes").mapInArrow(run, "part int, bits binary").collect():
        whole[r["part"] * stretch // 8 : (r["part"] + 1) * stretch // 8] = np.frombuffer(r["bits"], np.uint8)
    return whole


def of_column(hashes: DataFrame, lead: int) -> np.ndarray:
    """The filter of the one long column h of a table."""

    def run(table: pa.Table) -> pa.Table:
        h = np.unique(np.asarray(table.column("h").combine_chunks(), np.int64).view(np.uint64))
        return pa.table({"part": table.column("part")[:1], "n": pa.array([len(h)]), "hashes": pa.array([h.tobytes()], pa.binary())})

    part = F.shiftrightunsigned("h", 64 - lead).cast("int").alias("part")
    return build(hashes.select(part, "h").groupBy("part").applyInArrow(run, "part int, n long, hashes binary"), lead)


def leading_bits(partitions: int) -> int:
    """Enough stretches for every partition to have one."""
    return max(4, (partitions - 1).bit_length())
