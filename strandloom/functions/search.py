"""Search of the best haplotype pair for one window, in numpy, for all samples of a block at once.

The (weighted) squared error of x against h_j + h_k is M[j, k] - N[j] - N[k] + |x|^2 with M[j, k] = |h_j + h_k|^2 and N = 2 x H.
Scores are compared after rounding to DIGITS, so that ties mean the same in every summation order; the
first pair in the order (k, j), j <= k, wins. Only pairs near the least are rounded.
"""

from __future__ import annotations

import numpy as np

DIGITS = 6
TOLERANCE, KEEP_PAIRS = 3.0, 100  # fixed values of the rescreen strategy


def sums(h: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    """M of haplotypes h (one per row)."""
    gram = (h if weight is None else h * weight) @ h.T
    norm = np.diag(gram)
    return 2 * gram + norm[:, None] + norm[None, :]


def linear(x: np.ndarray, h: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """N and |x|^2 of samples x (one per row)."""
    scaled = x if weight is None else x * weight
    return 2 * scaled @ h.T, (scaled * x).sum(axis=1)


class Pairs:
    """All pairs j <= k of some haplotypes; `nearest` goes over them for one sample in place."""

    def __init__(self, m: np.ndarray):
        self.lower = np.where(np.tri(len(m), dtype=bool), m, np.inf)
        self.room = np.empty_like(self.lower)

    def nearest(self, n: np.ndarray, constant: float, within: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """Flat places k * d + j, ascending, of the pairs whose rounded error is within `within` of the least, and their errors."""
        np.subtract(self.lower, n[:, None], out=self.room)
        self.room -= n
        flat = self.room.reshape(-1)
        at = np.flatnonzero(flat <= flat.min() + within + 4 * 10.0**-DIGITS)
        errors = np.round(flat[at] + constant, DIGITS) + 0.0
        keep = errors <= errors.min() + within
        return at[keep], errors[keep]


def best_pairs(x: np.ndarray, h: np.ndarray, weight: np.ndarray | None = None):
    """(j, k, error) of the first least pair of each sample."""
    pairs, (n, constant) = Pairs(sums(h, weight)), linear(x, h, weight)
    for row, c in zip(n, constant):
        at, errors = pairs.nearest(row, c)
        yield int(at[0] % len(h)), int(at[0] // len(h)), float(errors[0])


def rescreened(x: np.ndarray, h: np.ndarray, observed: np.ndarray):
    """Of the first least pair and later ones within TOLERANCE of it (KEEP_PAIRS at most), the first with the least error on observed entries; without weights."""
    pairs, (n, constant) = Pairs(sums(h)), linear(x, h)
    for sample, seen, row, c in zip(x, observed, n, constant):
        at, errors = pairs.nearest(row, c, TOLERANCE)
        at = at[int(errors.argmin()) :][:KEEP_PAIRS]
        ks, js = at // len(h), at % len(h)
        exact = ((sample[seen] - h[js][:, seen] - h[ks][:, seen]) ** 2).sum(axis=1)
        best = int(exact.argmin())
        yield int(js[best]), int(ks[best]), float(exact[best])


def stepwise(x: np.ndarray, h: np.ndarray, r: int = 1, weight: np.ndarray | None = None):
    """Partners of the r haplotypes of largest N, taken from the smallest of those upward; the first least error wins. All pairs, if there are no more than r haplotypes."""
    if r >= len(h):
        yield from best_pairs(x, h, weight)
        return
    m, (n, constant) = sums(h, weight), linear(x, h, weight)
    for row, c in zip(n, constant):
        top = np.argsort(-np.round(row, DIGITS), kind="stable")[:r][::-1]
        errors = np.round(m[top] - row[top][:, None] - row[None, :] + c, DIGITS) + 0.0
        at, partner = divmod(int(errors.argmin()), len(h))
        yield int(top[at]), partner, float(errors[at, partner])


def thinned(x: np.ndarray, h: np.ndarray, keep: int, weight: np.ndarray | None = None):
    """Search of all pairs of the `keep` haplotypes nearest to a sample, in order of distance; weights bear on the distance only."""
    n, constant = linear(x, h, weight)
    norm = (h * h if weight is None else h * h * weight).sum(axis=1)
    distance = np.round(constant[:, None] - n + norm, DIGITS) + 0.0
    for sample, row in zip(x, distance):
        near = np.argsort(row, kind="stable")[:keep]
        (j, k, score), = best_pairs(sample[None, :], h[near])
        yield int(near[j]), int(near[k]), score


def frequency_weight(p: np.ndarray) -> np.ndarray:
    """1.98 below a frequency of 0.15, else 1 / sqrt(2 p (1 - p)); frequencies above 0.85 count as 0.85, for the weight has no bound there."""
    p = np.minimum(p, 0.85)
    return np.where(p < 0.15, 1.98, 1 / np.sqrt(np.maximum(2 * p * (1 - p), 1e-12)))
