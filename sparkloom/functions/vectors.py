"""Distances of vectors as column expressions, and in numpy for Arrow batches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def negative_inner_product(a: Column, b: Column) -> Column:
    return -inner_product(a, b)


def angular(a: Column, b: Column) -> Column:
    """1 - cosine."""
    return 1 - inner_product(a, b) / F.sqrt(inner_product(a, a) * inner_product(b, b))


def distances(queries: np.ndarray, rows: np.ndarray, metric: str = "l2") -> np.ndarray:
    """(queries, rows): squared l2, ip (negative inner product) or angular."""
    dot = queries @ rows.T
    if metric == "ip":
        return -dot
    q, r = (queries * queries).sum(1)[:, None], (rows * rows).sum(1)[None]
    return 1 - dot / np.sqrt(np.maximum(q * r, 1e-300)) if metric == "angular" else np.maximum(q + r - 2 * dot, 0)
