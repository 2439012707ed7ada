"""A linear-chain conditional random field over binary features, in numpy."""

from __future__ import annotations

import numpy as np


class ChainCRF:
    """``emit`` (features x labels), ``move`` (labels x labels), all finite."""

    def __init__(self, emit: np.ndarray, move: np.ndarray):
        self.emit, self.move = np.asarray(emit, dtype=float), np.asarray(move, dtype=float)

    def decode(self, features: np.ndarray, edge: int) -> np.ndarray:
        """The best labels of a sequence (length x features) whose neighbours on both sides carry label ``edge``."""
        scores = features @ self.emit
        n, labels = scores.shape
        best, back = self.move[edge] + scores[0], np.zeros((n, labels), dtype=np.int64)
        for t in range(1, n):
            all_ways = best[:, None] + self.move
            back[t] = all_ways.argmax(axis=0)
            best = all_ways.max(axis=0) + scores[t]
        out = np.zeros(n, dtype=np.int64)
        out[-1] = int((best + self.move[:, edge]).argmax())
        for t in range(n - 1, 0, -1):
            out[t - 1] = back[t, out[t]]
        return out

    def certain(self, always: list[int], perhaps: list[int], label: int) -> bool:
        """True if a token with features ``always`` and any of ``perhaps`` has ``label`` on every best path.

        Replacing another label y there by ``label`` gains the difference of emissions and loses at
        most the largest difference of the two moves; if the gain is larger whatever the optional
        features are, no best path has y.
        """
        for y in range(self.emit.shape[1]):
            if y == label:
                continue
            gap = self.emit[:, label] - self.emit[:, y]
            gain = gap[always].sum() + np.minimum(gap[perhaps], 0).sum()
            loss = (self.move[:, [y]] - self.move[:, [label]]).max() + (self.move[y] - self.move[label]).max()
            if gain <= loss:
                return False
        return True


def fit(sequences: list[tuple[np.ndarray, np.ndarray]], labels: int, steps: int = 300, rate: float = 0.1, decay: float = 0.002) -> ChainCRF:
    """Maximum likelihood by full-batch Adam; sequences are (length x features, labels), padded together."""
    size, width = max(len(y) for _, y in sequences), sequences[0][0].shape[1]
    x = np.zeros((len(sequences), size, width))
    y = np.zeros((len(sequences), size), dtype=np.int64)
    on = np.zeros((len(sequences), size), dtype=bool)
    for k, (f, label) in enumerate(sequences):
        x[k, : len(label)], y[k, : len(label)], on[k, : len(label)] = f, label, True
    onehot = np.eye(labels)[y] * on[..., None]
    pairs = on[:, 1:] & on[:, :-1]
    seen_emit = np.einsum("ntf,ntl->fl", x, onehot)
    seen_move = np.einsum("nta,ntb->ab", onehot[:, :-1] * pairs[..., None], onehot[:, 1:])
    params = [np.zeros((width, labels)), np.zeros((labels, labels))]
    m = [np.zeros_like(p) for p in params]
    v = [np.zeros_like(p) for p in params]

    def lse(a: np.ndarray, axis: int) -> np.ndarray:
        top = a.max(axis=axis, keepdims=True)
        return np.squeeze(top, axis) + np.log(np.exp(a - top).sum(axis=axis))

    for step in range(1, steps + 1):
        emit, move = params
        s = x @ emit
        forward, backward = np.zeros_like(s), np.zeros_like(s)
        forward[:, 0] = s[:, 0]
        for t in range(1, size):
            go = lse(forward[:, t - 1, :, None] + move, 1) + s[:, t]
            forward[:, t] = np.where(on[:, t, None], go, forward[:, t - 1])
        for t in range(size - 2, -1, -1):
            go = lse(move + (s[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
            backward[:, t] = np.where(on[:, t + 1, None], go, backward[:, t + 1])
        total = lse(forward[:, -1], 1)
        node = np.exp(forward + backward - total[:, None, None]) * on[..., None]
        edge = np.exp(forward[:, :-1, :, None] + move + (s[:, 1:] + backward[:, 1:])[:, :, None, :] - total[:, None, None, None]) * pairs[..., None, None]
        n = len(sequences)
        grads = [(np.einsum("ntf,ntl->fl", x, node) - seen_emit) / n + decay * emit, (edge.sum(axis=(0, 1)) - seen_move) / n + decay * move]
        for k, g in enumerate(grads):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            params[k] = params[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return ChainCRF(*params)
