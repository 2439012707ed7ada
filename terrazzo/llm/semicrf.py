"""A semi-Markov conditional random field: whole spans carry features, boundaries and types are chosen together."""

from __future__ import annotations

import numpy as np


class Lattice:
    """A window of ``n`` positions with candidate spans: starts, ends (exclusive) and a feature row each.

    Positions outside every chosen span are outside, with score 0; no two spans overlap.
    """

    def __init__(self, n: int, starts: list[int], ends: list[int], features: np.ndarray):
        self.n, self.features = n, features
        self.by_end: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]
        for k, (a, b) in enumerate(zip(starts, ends, strict=True)):
            self.by_end[b].append((a, k))


def decode(lattice: Lattice, weights: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, type) of the best segmentation; ``weights`` is features x types."""
    scores = lattice.features @ weights
    best, back = [0.0] * (lattice.n + 1), [(-1, -1)] * (lattice.n + 1)
    for end in range(1, lattice.n + 1):
        best[end], back[end] = best[end - 1], (-1, -1)
        for start, k in lattice.by_end[end]:
            kind = int(scores[k].argmax())
            if best[start] + scores[k, kind] > best[end]:
                best[end], back[end] = best[start] + scores[k, kind], (start, kind)
    out, at = [], lattice.n
    while at:
        start, kind = back[at]
        if kind >= 0:
            out.append((start, at, kind))
            at = start
        else:
            at -= 1
    return out[::-1]


def marginals(lattice: Lattice, weights: np.ndarray) -> tuple[np.ndarray, float]:
    """The probability of each (span, type), and the log partition function, by forward and backward sums."""
    scores = lattice.features @ weights
    forward, backward = np.zeros(lattice.n + 1), np.zeros(lattice.n + 1)
    for end in range(1, lattice.n + 1):
        forward[end] = np.logaddexp.reduce([forward[end - 1], *(forward[a] + s for a, k in lattice.by_end[end] for s in scores[k])])
    by_start: list[list[tuple[int, int]]] = [[] for _ in range(lattice.n + 1)]
    for end in range(lattice.n + 1):
        for a, k in lattice.by_end[end]:
            by_start[a].append((end, k))
    for start in range(lattice.n - 1, -1, -1):
        backward[start] = np.logaddexp.reduce([backward[start + 1], *(backward[b] + s for b, k in by_start[start] for s in scores[k])])
    p = np.zeros_like(scores)
    for end in range(lattice.n + 1):
        for a, k in lattice.by_end[end]:
            p[k] = np.exp(forward[a] + scores[k] + backward[end] - forward[-1])
    return p, float(forward[-1])


def fit(rows: list[tuple[Lattice, np.ndarray]], types: int, steps: int = 60, rate: float = 0.15, decay: float = 0.002) -> np.ndarray:
    """Maximum likelihood by Adam; each row is a lattice with the true (span, type) indicator."""
    w = np.zeros((rows[0][0].features.shape[1], types))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        g = decay * w
        for lattice, truth in rows:
            g += lattice.features.T @ (marginals(lattice, w)[0] - truth) / len(rows)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w
