"""Count splitting: a count is thinned into a training and a test part that add up to it.

Each entry's draw is the quantile of a uniform number that depends on the seed, row and feature only, so the result is
the same however the rows are partitioned. Entries with equal counts share one table of the distribution.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.schema import require_columns


def binomial_table(n: int, p: float) -> np.ndarray:
    """Cumulative distribution of Binomial(n, p)."""
    k = np.arange(n + 1)
    lf = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, n + 1)))])
    return np.cumsum(np.exp(lf[n] - lf[k] - lf[n - k] + k * np.log(p) + (n - k) * np.log1p(-p)))


def beta_binomial_table(n: int, a: float, b: float) -> np.ndarray:
    """Cumulative distribution of a binomial whose p is Beta(a, b): ratios of neighbouring terms, then scaled."""
    k = np.arange(n)
    ratio = (k + a) * (n - k) / ((k + 1) * (n - k - 1 + b))
    logs = np.concatenate([[0.0], np.cumsum(np.log(ratio))])
    w = np.exp(logs - logs.max())
    return np.cumsum(w) / w.sum()


def _draw(counts: DataFrame, seed: int, table: Callable[[int], np.ndarray] | None) -> DataFrame:
    require_columns(counts, "id", "feature", "count")
    bad = F.col("count").isNull() | (F.col("count") < 0) | (F.col("count").cast("double") != F.floor(F.col("count").cast("double")))
    whole = F.when(bad, F.raise_error(F.lit("counts must be whole numbers from 0 up")).cast("bigint")).otherwise(F.col("count").cast("bigint"))
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "id", "feature"), 11).cast("double") / float(1 << 53)
    rows = counts.select("id", "feature", whole.alias("count"), u.alias("u"))
    if table is None:
        return rows.select("id", "feature", "count", F.col("count").alias("train"), F.lit(0).cast("bigint").alias("test"))
    kinds = {f.name: f.dataType.simpleString() for f in counts.schema.fields}

    def run(batches):
        tables: dict[int, np.ndarray] = {}
        for batch in batches:
            n, x = np.asarray(batch.column(2), np.int64), np.asarray(batch.column(3), np.float64)
            train = np.zeros(len(n), np.int64)
            for value in np.unique(n).tolist():
                if value:
                    if len(tables) > 4096:
                        tables.clear()
                    if value not in tables:
                        tables[value] = table(value)
                    own = n == value
                    train[own] = np.minimum(np.searchsorted(tables[value], x[own], "right"), value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(train), pa.array(n - train)], ["id", "feature", "count", "train", "test"])

    return rows.mapInArrow(run, f"id {kinds['id']}, feature {kinds['feature']}, count bigint, train bigint, test bigint")


def _checked(epsilon: float) -> float:
    if not 0 < epsilon <= 1:
        raise ValueError("epsilon is in (0, 1]")
    return epsilon


def poisson_split(counts: DataFrame, epsilon: float = 0.8, seed: int = 0) -> DataFrame:
    """counts with train ~ Binomial(count, epsilon) and test = count - train."""
    _checked(epsilon)
    return _draw(counts, seed, None if epsilon == 1 else lambda n: binomial_table(n, epsilon))


def negative_binomial_split(counts: DataFrame, epsilon: float = 0.8, seed: int = 0) -> DataFrame:
    """As poisson_split with a share of its own for each entry, p ~ Beta(epsilon, 1 - epsilon)."""
    _checked(epsilon)
    return _draw(counts, seed, None if epsilon == 1 else lambda n: beta_binomial_table(n, epsilon, 1 - epsilon))
