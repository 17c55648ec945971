"""Follow-the-regularised-leader with elastic-net penalties, per coordinate, for sparse rows (proximal form)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Penalties:
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.002
    l2: float = 0.001
    epochs: int = 4


class Leader:
    """Weights of `models` linear models over `size` features."""

    def __init__(self, size: int, models: int, penalties: Penalties):
        self.p = penalties
        self.z = np.zeros((size, models))
        self.n = np.zeros((size, models))

    def weights(self, idx: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n, p = self.z[idx], self.n[idx], self.p
        w = -(z - np.sign(z) * p.l1) / ((p.beta + np.sqrt(n)) / p.alpha + p.l2)
        return np.where(np.abs(z) <= p.l1, 0.0, w)

    def learn(self, idx: np.ndarray, values: np.ndarray, wanted: np.ndarray, predict) -> None:
        """One row: `predict` maps the linear scores to probabilities, `wanted` holds the true ones."""
        w = self.weights(idx)
        g = values[:, None] * (predict(values @ w) - wanted)[None, :]
        n = self.n[idx]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.p.alpha
        self.z[idx] += g - sigma * w
        self.n[idx] = n + g * g


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def sigmoid(s: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(s, -60, 60)))


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], size: int, classes: int, penalties: Penalties, seed: int = 7) -> np.ndarray:
    """Weights (size, models) from rows (feature numbers, values, class number), in a fixed shuffled order."""
    leader = Leader(size, classes, penalties)
    truth = np.eye(classes)
    order = np.random.default_rng(seed)
    for _ in range(penalties.epochs):
        for i in order.permutation(len(rows)):
            idx, values, label = rows[i]
            leader.learn(idx, values, truth[label], softmax)
    return leader.weights()


def temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The T that makes softmax(scores / T) most likely for the labels, by golden-section search over its logarithm."""
    if not len(labels):
        return 1.0

    def loss(log_t: float) -> float:
        p = softmax(scores / np.exp(log_t))
        return -np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-12)).mean()

    a, b, ratio = -3.0, 3.0, (np.sqrt(5) - 1) / 2
    for _ in range(60):
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))
