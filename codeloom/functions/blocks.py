"""Cosines of blocks of vectors inside a task: a matrix product finds candidates, plain sums decide."""

from __future__ import annotations

import numpy as np

#: More than the matrix product's rounding; candidates within it are looked at again.
SLACK = 1e-9


def _by_width(vectors) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Row numbers and matrix of the vectors of each length."""
    widths = np.array([len(v) for v in vectors], np.int64)
    return {int(w): (at, np.stack([vectors[i] for i in at]).astype(np.float64)) for w in np.unique(widths) if w for at in [np.flatnonzero(widths == w)]}


class Block:
    """Vectors of one block, by their lengths."""

    def __init__(self, vectors):
        vectors = list(vectors)
        self.n = len(vectors)
        self.parts = {w: (at, m, np.sqrt(np.cumsum(m * m, 1)[:, -1])) for w, (at, m) in _by_width(vectors).items()}


def rough(left: Block, right: Block) -> np.ndarray:
    """Cosine of every vector of one block with every one of the other; unequal lengths and zero norms give 0."""
    out = np.zeros((left.n, right.n))
    for width in left.parts.keys() & right.parts.keys():
        (i, a, na), (j, b, nb) = left.parts[width], right.parts[width]
        out[np.ix_(i, j)] = (a / np.where(na == 0, 1, na)[:, None]) @ (b / np.where(nb == 0, 1, nb)[:, None]).T
    return out


def exact(left: Block, right: Block, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Cosine of the pairs (i, j), summed in order, so that equal vectors score alike wherever they lie."""
    out = np.zeros(len(i))
    for width in left.parts.keys() & right.parts.keys():
        (at, a, na), (bt, b, nb) = left.parts[width], right.parts[width]
        x, y = np.full(left.n, -1), np.full(right.n, -1)
        x[at], y[bt] = np.arange(len(at)), np.arange(len(bt))
        for pairs in np.array_split(np.arange(len(i)), len(i) // 65_536 + 1):
            p, q = x[i[pairs]], y[j[pairs]]
            own = (p >= 0) & (q >= 0)
            p, q = p[own], q[own]
            n = na[p] * nb[q]
            out[pairs[own]] = np.where(n == 0, 0.0, np.cumsum(a[p] * b[q], 1)[:, -1] / np.where(n == 0, 1, n))
    return out
