"""Logistic regression on sparse rows, in numpy."""

from __future__ import annotations

import numpy as np


class Sparse:
    """Rows of (column, value); add() appends dense columns."""

    def __init__(self, row: np.ndarray, col: np.ndarray, val: np.ndarray, shape: tuple[int, int]):
        self.row, self.col, self.val, self.shape = row, col, val.astype(np.float64), shape

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.val * w[self.col], self.shape[0])

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, self.val * r[self.row], self.shape[1])

    def take(self, mask: np.ndarray) -> "Sparse":
        to = np.cumsum(mask) - 1
        some = mask[self.row]
        return Sparse(to[self.row[some]], self.col[some], self.val[some], (int(mask.sum()), self.shape[1]))

    def only(self, columns: np.ndarray) -> "Sparse":
        """The same with zeros in all other columns."""
        some = columns[self.col]
        return Sparse(self.row[some], self.col[some], self.val[some], self.shape)

    def add(self, dense: np.ndarray) -> "Sparse":
        n, k = dense.shape
        row = np.concatenate((self.row, np.repeat(np.arange(n), k)))
        col = np.concatenate((self.col, np.tile(self.shape[1] + np.arange(k), n)))
        return Sparse(row, col, np.concatenate((self.val, dense.ravel())), (n, self.shape[1] + k))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit(x: Sparse, y: np.ndarray, l2: float = 1.0, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise log loss plus l2 / 2 of the weights' square, by limited-memory BFGS; y is 0 or 1."""
    n, d = x.shape
    w = np.zeros(d + 1)
    if not n:
        return w[:-1], 0.0

    def loss(w):
        z = x.dot(w[:-1]) + w[-1]
        p = sigmoid(z)
        value = np.sum(np.logaddexp(0, z) - y * z) + l2 / 2 * w[:-1] @ w[:-1]
        g = np.append(x.back(p - y) + l2 * w[:-1], np.sum(p - y))
        return value, g

    value, g = loss(w)
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        q, kept = g.copy(), []
        for s, t, rho in reversed(steps):
            a = rho * (s @ q)
            kept.append(a)
            q -= a * t
        if steps:
            s, t, _ = steps[-1]
            q *= (s @ t) / (t @ t)
        else:
            q /= max(1.0, np.linalg.norm(q))
        for (s, t, rho), a in zip(steps, reversed(kept)):
            q += (a - rho * (t @ q)) * s
        rate, slope = 1.0, g @ q
        while rate > 1e-6:
            new = w - rate * q
            v, h = loss(new)
            if v <= value - 1e-4 * rate * slope:
                break
            rate /= 2
        else:
            break
        s, t = new - w, h - g
        if s @ t > 1e-12:
            steps = [*steps[-7:], (s, t, 1 / (s @ t))]
        done = value - v < 1e-7 * max(1.0, abs(v))
        w, value, g = new, v, h
        if done:
            break
    return w[:-1], float(w[-1])


def kinds(x: Sparse, k: int, rounds: int = 20) -> np.ndarray:
    """Rows in k groups by the cosine of their columns with the groups' sums, from rows far apart; ties go to the first."""
    n = x.shape[0]
    if not n:
        return np.zeros(0, int)
    length = np.sqrt(np.maximum(np.bincount(x.row, x.val * x.val, n), 1e-12))
    unit = Sparse(x.row, x.col, x.val / length[x.row], x.shape)
    chosen = [int(np.argmax(length))]
    own = lambda i: np.bincount(unit.col[unit.row == i], unit.val[unit.row == i], x.shape[1])
    near = unit.dot(own(chosen[0]))
    while len(chosen) < k:
        chosen.append(int(np.argmin(near)))
        near = np.maximum(near, unit.dot(own(chosen[-1])))
    centres = [own(i) for i in chosen]
    group = np.full(n, -1)
    for _ in range(rounds):
        new = np.argmax(np.stack([unit.dot(c / max(np.linalg.norm(c), 1e-12)) for c in centres]), axis=0)
        if (new == group).all():
            break
        group = new
        centres = [unit.back((group == j).astype(float)) if (group == j).any() else centres[j] for j in range(k)]
    return group
