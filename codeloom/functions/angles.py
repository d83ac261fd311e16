"""Angles of vectors to reference directions, and the bounds on products of two vectors that follow.

For unit vectors u and v and a direction r, the angle between u and v lies between
|angle(u, r) - angle(v, r)| and min(angle(u, r) + angle(v, r), 2 pi - both): the triangle inequality
on the sphere. Angles are kept as doubles; SLACK covers the rounding of the products and of arccos.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLACK = 1e-6


def finite(vector: Column) -> Column:
    """False for a null or empty vector and for one with a null or non-finite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad, F.lit(False))


def sampled(df: DataFrame, key: str, vector: str, n: int) -> np.ndarray:
    """At most n unit vectors of one length as reference directions: those whose keys have the smallest hashes. The bound n is all that reaches the driver."""
    rows = df.orderBy(F.xxhash64(F.col(key)), F.col(key)).select(F.col(vector).cast("array<double>").alias("v")).limit(4 * n).collect()
    found = [np.asarray(r["v"], float) for r in rows]
    found = [v / norm for v in found if np.isfinite(norm := np.linalg.norm(v)) and norm > 0]
    return np.stack([v for v in found if len(v) == len(found[0])][:n]) if found else np.zeros((0, 0))


def to_directions(vectors: np.ndarray, directions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norms, and the angles to each direction; a vector of another length than the directions has none, and a zero vector right angles."""
    norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
    if directions.shape[1:] != vectors.shape[1:]:
        return norms, np.zeros((len(vectors), 0))
    cosines = (vectors @ directions.T) / np.where(norms > 0, norms, 1)[:, None]
    return norms, np.arccos(np.clip(cosines, -1, 1))


def cosine_bounds(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest cosine of every row of a with every row of b, from their angles to the directions."""
    low = np.zeros((len(a), len(b)))
    high = np.full((len(a), len(b)), np.pi)
    for i in range(a.shape[1]):
        x, y = a[:, i][:, None], b[:, i][None, :]
        np.maximum(low, np.abs(x - y), out=low)
        both = x + y
        np.minimum(high, np.minimum(both, 2 * np.pi - both), out=high)
    return np.cos(np.minimum(high + SLACK, np.pi)), np.cos(np.maximum(low - SLACK, 0))


def cap_bounds(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Largest cosine of every row of a with any vector whose angles lie in [low, high] (rows: groups of vectors)."""
    gap = np.zeros((len(a), len(low)))
    for i in range(a.shape[1]):
        x = a[:, i][:, None]
        np.maximum(gap, np.maximum(low[:, i][None, :] - x, x - high[:, i][None, :]), out=gap)
    return np.cos(np.maximum(gap - SLACK, 0))
