"""A linear-chain conditional random field over hashed features, trained and decoded with numpy.

An item of a sequence is a row of feature numbers (0 pads and has no weight). Training maximises the
likelihood with AdaGrad, from a fixed seed, so that the same labelled rows give the same model everywhere.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np


def feature_rows(items: list[list[str]], size: int, width: int | None = None) -> np.ndarray:
    """Feature names as numbers from 1 to size - 1, a row for each item, padded with 0."""
    width = width or max([1, *map(len, items)])
    out = np.zeros((len(items), width), dtype=np.int32)
    for i, names in enumerate(items):
        for k, name in enumerate(names[:width]):
            out[i, k] = 1 + crc32(name.encode()) % (size - 1)
    return out


class LinearChainCRF:
    """weights: a row of label scores for each feature; moves: scores of label pairs; first, last: of the ends."""

    def __init__(self, labels: int, size: int = 1 << 14, forbidden: tuple[tuple[int, int], ...] = (), not_first: tuple[int, ...] = ()) -> None:
        self.labels, self.size = labels, size
        self.weights = np.zeros((size, labels))
        self.moves = np.zeros((labels, labels))
        self.first, self.last = np.zeros(labels), np.zeros(labels)
        self.barred = np.zeros((labels, labels))
        self.barred_first = np.zeros(labels)
        for a, b in forbidden:
            self.barred[a, b] = -1e4
        for a in not_first:
            self.barred_first[a] = -1e4

    def emissions(self, rows: np.ndarray) -> np.ndarray:
        return self.weights[rows].sum(axis=1)

    def decode(self, emit: np.ndarray, first: np.ndarray | None = None, last: np.ndarray | None = None) -> list[int]:
        """Viterbi: the likeliest labels of a sequence with these emissions; ``first`` and ``last`` replace the scores of its ends."""
        n = len(emit)
        if not n:
            return []
        moves = self.moves + self.barred
        score = emit[0] + (self.first + self.barred_first if first is None else first)
        back = np.zeros((n, self.labels), dtype=np.int64)
        for i in range(1, n):
            step = score[:, None] + moves
            back[i] = step.argmax(axis=0)
            score = step.max(axis=0) + emit[i]
        at = int((score + (self.last if last is None else last)).argmax())
        out = [at]
        for i in range(n - 1, 0, -1):
            at = int(back[i, at])
            out.append(at)
        return out[::-1]

    def fit(self, sequences: list[tuple[np.ndarray, np.ndarray]], epochs: int = 6, rate: float = 0.3, l2: float = 1e-4, seed: int = 7, batch: int = 16) -> LinearChainCRF:
        """Train on (feature rows, labels) pairs, ``batch`` sequences of about one length a step."""
        order = np.random.default_rng(seed)
        sums = [np.full_like(p, 1e-6) for p in (self.weights, self.moves, self.first, self.last)]
        sequences = sorted(((r, t) for r, t in sequences if len(t)), key=lambda x: len(x[1]))
        batches = [sequences[k : k + batch] for k in range(0, len(sequences), batch)]

        def step(p: np.ndarray, g: np.ndarray, s: np.ndarray, at=slice(None)) -> None:
            s[at] += g * g
            p[at] += rate * g / np.sqrt(s[at])

        for _ in range(epochs):
            for i in order.permutation(len(batches)):
                rows, diff, g = self._gradient(batches[i])
                used, where = np.unique(rows, return_inverse=True)
                where = where.reshape(rows.shape)
                gw = np.stack([np.bincount(where.ravel(), np.broadcast_to(diff[:, :, None, k], rows.shape).ravel(), len(used)) for k in range(self.labels)], axis=1)
                gw[used == 0] = 0
                step(self.weights, gw - l2 * self.weights[used] * (used > 0)[:, None], sums[0], used)
                step(self.moves, g, sums[1])
                step(self.first, diff[:, 0].sum(axis=0), sums[2])
                ends = np.array([len(t) for _, t in batches[i]]) - 1
                step(self.last, diff[np.arange(len(ends)), ends].sum(axis=0), sums[3])
        return self

    def _gradient(self, some: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Feature rows (padded), and the log likelihood's derivatives by emissions and by moves, for a batch."""
        size, n, width = len(some), max(len(t) for _, t in some), max(r.shape[1] for r, _ in some)
        rows = np.zeros((size, n, width), dtype=np.int32)
        gold, there = np.zeros((size, n, self.labels)), np.zeros((size, n), dtype=bool)
        for k, (r, t) in enumerate(some):
            rows[k, : len(t), : r.shape[1]] = r
            gold[k, np.arange(len(t)), t] = 1
            there[k, : len(t)] = True
        emit = self.weights[rows].sum(axis=2)
        moves = self.moves + self.barred
        f, b = np.zeros((n, size, self.labels)), np.zeros((n, size, self.labels))
        f[0] = emit[:, 0] + self.first + self.barred_first
        for t in range(1, n):
            f[t] = np.where(there[:, t, None], emit[:, t] + _log_sum(f[t - 1][:, :, None] + moves, 1), f[t - 1])
        b[n - 1] = self.last
        for t in range(n - 2, -1, -1):
            b[t] = np.where(there[:, t + 1, None], _log_sum(moves + (emit[:, t + 1] + b[t + 1])[:, None, :], 2), self.last)
        z = _log_sum(f[n - 1] + self.last, 1)[:, None]
        diff = (gold - np.exp(np.minimum(f + b - z, 0)).transpose(1, 0, 2)) * there[:, :, None]
        g = np.zeros_like(self.moves)
        if n > 1:
            pair = np.exp(np.minimum(f[:-1, :, :, None] + moves + (emit.transpose(1, 0, 2)[1:] + b[1:])[:, :, None, :] - z[None, :, :, None], 0))
            both = there.T[1:, :, None, None]
            g = (gold.transpose(1, 0, 2)[:-1, :, :, None] * gold.transpose(1, 0, 2)[1:, :, None, :] * both - pair * both).sum(axis=(0, 1))
        return rows, diff, g


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - m).sum(axis=axis)) + m.squeeze(axis)
