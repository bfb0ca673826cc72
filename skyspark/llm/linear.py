"""Linear models fitted by the driver on a bounded sample: one-versus-one support vector machines."""

from __future__ import annotations

from itertools import combinations

import numpy as np


def fit_svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, steps: int = 200) -> np.ndarray:
    """Weights and, last, the bias of a linear SVM with squared hinge loss; y is -1 or 1. Accelerated gradient descent, both classes weighing alike; x isn't copied."""
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = v = np.zeros(x.shape[1] + 1, np.float32)
    rate = 1 / (2 * float(share @ (np.einsum("ij,ij->i", x, x) + 1)) + penalty)
    t = 1.0
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (x @ v[:-1] + v[-1])).astype(np.float32)
        pull = share * slack * y
        grad = -2 * np.append(x.T @ pull, pull.sum()) + penalty * v
        new = v - rate * grad
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = (new + (t - 1) / s * (new - w)).astype(np.float32), new, s
    return w


def fit_slope(margin: np.ndarray, y: np.ndarray) -> float:
    """Slope of the logistic curve that turns margins into probabilities; at most 20, so that no score is blindly certain."""
    grid = np.linspace(1, 20, 39)
    loss = [np.logaddexp(0, -a * margin * y).mean() + 1e-4 * a for a in grid]
    return float(grid[int(np.argmin(loss))])


class OneVersusOne:
    """A machine for every pair of classes; a class's score is the mean of its pairwise probabilities, and scores sum to 1."""

    def __init__(self, x: np.ndarray, labels: list[str]):
        self.classes = sorted(set(labels))
        self.at = {c: i for i, c in enumerate(self.classes)}
        k = np.array([self.at[c] for c in labels])
        self.pairs, w, slope = list(combinations(range(len(self.classes)), 2)), [], []
        for a, b in self.pairs:
            on = (k == a) | (k == b)
            y = np.where(k[on] == a, 1, -1).astype(np.float32)
            rows = x if on.all() else x[on]
            one = fit_svm(rows, y)
            w.append(one)
            slope.append(fit_slope(rows @ one[:-1] + one[-1], y))
        self.w, self.slope = np.array(w, np.float32).reshape(len(w), x.shape[1] + 1), np.array(slope)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """x: a matrix, one row of features each. A row of scores each, the same whatever rows are beside it (margins are rounded beyond what the order of summation can change)."""
        n = len(self.classes)
        if n == 1:
            return np.ones((len(x), 1))
        p = 1 / (1 + np.exp(-self.slope * np.round(x.astype(np.float64) @ self.w[:, :-1].T.astype(np.float64) + self.w[:, -1], 9)))
        out = np.zeros((len(x), n))
        for k, (a, b) in enumerate(self.pairs):
            out[:, a] += p[:, k]
            out[:, b] += 1 - p[:, k]
        return out / len(self.pairs)

    def certainty(self, scores: np.ndarray) -> np.ndarray:
        """The winner's mean probability against each other class, by row: from 0.5 to 1 whatever their number, and 1 where it has no rival."""
        return scores.max(1) * max(1.0, len(self.classes) / 2)
