"""Distances between vectors: as column expressions for single pairs, and as numpy kernels for blocks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("euclidean", "manhattan", "cosine", "chebyshev", "minkowski", "hamming")
ALIASES = {"l2": "euclidean", "l1": "manhattan", "cityblock": "manhattan"}


def metric_name(metric: str) -> str:
    name = ALIASES.get(metric.lower(), metric.lower())
    if name not in METRICS:
        raise ValueError(f"{metric!r} is none of {', '.join(METRICS)}")
    return name


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def distance(a: Column, b: Column, metric: str = "euclidean", p: float = 2.0) -> Column:
    """Distance of two array columns."""
    metric = metric_name(metric)
    gap = F.zip_with(a, b, lambda x, y: F.abs(x - y))
    if metric == "euclidean":
        return F.sqrt(_sum(F.transform(gap, lambda x: x * x)))
    if metric == "manhattan":
        return _sum(gap)
    if metric == "chebyshev":
        return F.array_max(gap)
    if metric == "minkowski":
        return F.pow(_sum(F.transform(gap, lambda x: F.pow(x, F.lit(p)))), F.lit(1 / p))
    if metric == "hamming":
        return _sum(F.transform(gap, lambda x: F.when(x != 0, 1.0).otherwise(0.0))) / F.size(a)
    return 1 - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def block(x: np.ndarray, y: np.ndarray, metric: str, p: float = 2.0) -> np.ndarray:
    """Distances of all rows of x to all rows of y. For euclidean and cosine a matrix product, so values carry the
    rounding of a difference of squares; exact() has the values of single pairs."""
    if metric == "euclidean":
        return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T), 0))
    if metric == "cosine":
        return 1 - (x @ y.T) / np.maximum(np.sqrt((x * x).sum(1)[:, None] * (y * y).sum(1)[None, :]), 1e-300)
    out = np.zeros((len(x), len(y)))
    for j in range(x.shape[1]):  # one column at a time: memory stays at one block
        gap = np.abs(x[:, j, None] - y[None, :, j])
        if metric == "manhattan":
            out += gap
        elif metric == "chebyshev":
            np.maximum(out, gap, out=out)
        elif metric == "minkowski":
            out += gap**p
        else:
            out += gap != 0
    return out ** (1 / p) if metric == "minkowski" else out / x.shape[1] if metric == "hamming" else out


#: Rows and columns of a tile of screen(), whose three float32 arrays stay in the processor's cache.
TILE = (8, 4096)


def screen(x: np.ndarray, y: np.ndarray, metric: str, p: float = 2.0) -> tuple[np.ndarray, np.ndarray] | None:
    """Distances of all rows of x to all rows of y in float32, as multiples of the largest number, and how far each may be
    from the true one. For metrics without a matrix product; None where float32 has no such bound or nothing is gained."""
    top = max(np.abs(x).max(initial=0.0), np.abs(y).max(initial=0.0))
    if metric not in ("manhattan", "chebyshev", "minkowski") or (metric == "minkowski" and not 1 <= p <= 4) or not 0 < top < np.inf or min(x.shape) == 0 or len(y) == 0:
        return None
    a, b = (np.ascontiguousarray((v / top).T, np.float32) for v in (x, y))
    out = np.zeros((len(x), len(y)), np.float32)
    for r in range(0, len(x), TILE[0]):
        for c in range(0, len(y), TILE[1]):
            total = np.zeros_like(out[r : r + TILE[0], c : c + TILE[1]])
            gap, power = np.empty_like(total), np.empty_like(total)
            for u, v in zip(a[:, r : r + TILE[0], None], b[:, None, c : c + TILE[1]], strict=True):
                np.abs(np.subtract(u, v, out=gap), out=gap)
                if metric == "chebyshev":
                    np.maximum(total, gap, out=total)
                    continue
                if metric == "minkowski":
                    if p == int(p):
                        np.copyto(power, gap)
                        for _ in range(int(p) - 1):
                            power *= gap
                        gap, power = power, gap
                    else:
                        np.power(gap, np.float32(p), out=gap)
                total += gap
            out[r : r + TILE[0], c : c + TILE[1]] = total
    if metric == "minkowski":
        np.power(out, np.float32(1 / p), out=out)
    # rounding of the numbers, of gaps, powers and sums, and powers that are too small for float32
    unit = 2.0**-24
    size = [np.abs(v / top).sum(1) for v in (x, y)]
    lost = (x.shape[1] * 1e-37) ** (1 / (p if metric == "minkowski" else 1))
    slack = (4 * unit * size[0])[:, None].astype(np.float32) + (4 * unit * size[1] + lost)[None, :].astype(np.float32)
    slack += np.float32(unit * (4 * x.shape[1] + 64)) * out
    return out, slack


def exact(x: np.ndarray, y: np.ndarray, metric: str, p: float = 2.0) -> np.ndarray:
    """Distances of rows of x to the rows of y at the same place; y may have a leading axis more."""
    gap = np.abs(x - y)
    if metric == "euclidean":
        return np.sqrt((gap * gap).sum(-1))
    if metric == "cosine":
        return 1 - (x * y).sum(-1) / np.maximum(np.sqrt((x * x).sum(-1) * (y * y).sum(-1)), 1e-300)
    return {"manhattan": lambda: gap.sum(-1), "chebyshev": lambda: gap.max(-1), "minkowski": lambda: (gap**p).sum(-1) ** (1 / p), "hamming": lambda: (gap != 0).mean(-1)}[metric]()
