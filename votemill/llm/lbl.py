"""A log-bilinear model of word classes, trained with noise-contrastive estimation in numpy.

The score of class w after classes u (one back) and v (two back) is
``(A[u] + C[v]) . R[w] + b[w]``.  Training compares each observed class with a
set of noise classes shared by its batch.  Because the score is a sum over the
two context words, the normaliser of every pair of contexts is one matrix
product, ``exp(S1) @ exp(S2).T``, and a normalised log-probability three table
look-ups.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Settings:
    #: most frequent words with a class of their own; the others share ``groups`` classes by their last letters
    words: int = 2_000
    groups: int = 32
    dim: int = 16
    noise: int = 48
    batch: int = 4_096
    rate: float = 0.25
    seed: int = 5

    @property
    def classes(self) -> int:
        return self.words + self.groups


@dataclass
class Parameters:
    """Context tables have one more row, for what stands before a text."""

    one_back: np.ndarray
    two_back: np.ndarray
    output: np.ndarray
    bias: np.ndarray

    def arrays(self) -> list[np.ndarray]:
        return [self.one_back, self.two_back, self.output, self.bias[:, None]]

    @staticmethod
    def of(arrays: list[np.ndarray]) -> Parameters:
        return Parameters(*arrays[:3], arrays[3][:, 0])


def start(share: np.ndarray, settings: Settings) -> Parameters:
    """Untrained parameters: the class frequencies alone."""
    rng = np.random.default_rng(settings.seed)
    n, d = settings.classes, settings.dim
    return Parameters(np.zeros((n + 1, d), np.float32), np.zeros((n + 1, d), np.float32), rng.normal(0, 0.5, (n, d)).astype(np.float32), np.log(share).astype(np.float32))


def _gather(ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids and the sums of their rows."""
    order = np.argsort(ids.astype(np.uint16), kind="stable")
    ordered = ids[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    return ordered[first], np.add.reduceat(rows[order], first, axis=0)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Trainer:
    """Adagrad over the batches that one task sees."""

    def __init__(self, begin: Parameters, share: np.ndarray, settings: Settings, seed: int):
        self.p = Parameters.of([a.copy() for a in begin.arrays()])
        self.squares = [np.full(a.shape, 1e-2, np.float32) for a in begin.arrays()]
        self.settings, self.rng = settings, np.random.default_rng(seed)
        self.level = np.log(settings.noise * share).astype(np.float32)
        self.edges = np.cumsum(share)
        self.tokens = 0

    def _update(self, k: int, ids: np.ndarray, slope: np.ndarray) -> None:
        ids, slope = _gather(ids, slope)
        table = (self.p.one_back, self.p.two_back, self.p.output, self.p.bias[:, None])[k]
        square = self.squares[k]
        square[ids] += slope * slope
        table[ids] -= self.settings.rate * slope / np.sqrt(square[ids])

    def batch(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> None:
        p, s = self.p, self.settings
        noise = np.minimum(np.searchsorted(self.edges, self.rng.random(s.noise) * self.edges[-1]), s.classes - 1)
        context = p.one_back[u] + p.two_back[v]
        seen, other = p.output[w], p.output[noise]
        g_seen = _sigmoid((context * seen).sum(axis=1) + p.bias[w] - self.level[w]) - 1
        g_noise = _sigmoid(context @ other.T + (p.bias[noise] - self.level[noise]))
        scale = np.float32(16 / len(w))
        g_seen, g_noise = g_seen * scale, g_noise * scale
        to_context = g_seen[:, None] * seen + g_noise @ other
        self._update(0, u, to_context)
        self._update(1, v, to_context)
        ids = np.concatenate([w, noise])
        self._update(2, ids, np.concatenate([g_seen[:, None] * context, g_noise.T @ context]))
        self._update(3, ids, np.concatenate([g_seen, g_noise.sum(axis=0)])[:, None])
        self.tokens += len(w)

    def train(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> None:
        order = self.rng.permutation(len(w))
        for at in range(0, len(w), self.settings.batch):
            pick = order[at:at + self.settings.batch]
            self.batch(u[pick], v[pick], w[pick])


class Scorer:
    """Normalised log10 probabilities of classes after any two contexts."""

    def __init__(self, p: Parameters):
        one = (p.one_back @ p.output.T + p.bias).astype(np.float64)
        two = (p.two_back @ p.output.T).astype(np.float64)
        top_one, top_two = one.max(axis=1, keepdims=True), two.max(axis=1, keepdims=True)
        total = np.exp(one - top_one) @ np.exp(two - top_two).T
        unit = np.log(10)
        self.norm = ((np.log(total) + top_one + top_two.T) / unit).astype(np.float32)
        self.one, self.two = (one / unit).astype(np.float32), (two / unit).astype(np.float32)

    def __call__(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        n = self.one.shape[1]
        return (self.one.ravel()[u * n + w] + self.two.ravel()[v * n + w] - self.norm.ravel()[u * (n + 1) + v]).astype(np.float64)


def contexts(classes: np.ndarray, row: np.ndarray, before: int) -> tuple[np.ndarray, np.ndarray]:
    """The classes one and two back of each position; ``before`` stands in front of each text."""
    u, v = np.full(len(classes), before), np.full(len(classes), before)
    same = row[1:] == row[:-1]
    u[1:][same] = classes[:-1][same]
    same = row[2:] == row[:-2]
    v[2:][same] = classes[:-2][same]
    return u, v
