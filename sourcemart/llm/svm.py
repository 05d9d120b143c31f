"""Linear support vector machines, one against one, in a few lines of numpy."""

from dataclasses import dataclass
from itertools import combinations

import numpy as np


def train(x: np.ndarray, y: np.ndarray, c: float = 4.0, epochs: int = 12, seed: int = 7) -> np.ndarray:
    """Weights of an L2-regularised squared-hinge machine by dual coordinate descent; ``y`` is -1 or 1."""
    rng = np.random.default_rng(seed)
    alpha, w = np.zeros(len(y)), np.zeros(x.shape[1])
    diagonal = np.einsum("ij,ij->i", x, x) + 0.5 / c
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            slope = y[i] * (w @ x[i]) - 1 + alpha[i] * 0.5 / c
            if alpha[i] > 0 or slope < 0:
                new = max(alpha[i] - slope / diagonal[i], 0.0)
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w


@dataclass
class OneVersusOne:
    """Duels between all pairs of classes; most wins, then the largest sum of margins, then the first name."""

    names: list[str]
    pairs: list[tuple[int, int]]
    weights: np.ndarray  # one row per pair: positive for the first of the pair

    @classmethod
    def fit(cls, x: np.ndarray, labels: list[str]) -> "OneVersusOne":
        names = sorted(set(labels))
        marks = np.array([names.index(v) for v in labels])
        pairs = list(combinations(range(len(names)), 2))
        rows = []
        for a, b in pairs:
            at = np.flatnonzero((marks == a) | (marks == b))
            rows.append(train(x[at], np.where(marks[at] == a, 1.0, -1.0)))
        return cls(names, pairs, np.array(rows, dtype=np.float32).reshape(len(rows), x.shape[1]))

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(class, smallest margin of its duels) per row; a single class has an infinite margin."""
        n = len(x)
        if len(self.names) == 1:
            return np.zeros(n, dtype=int), np.full(n, np.inf)
        margins = x @ self.weights.T
        wins, sums = np.zeros((n, len(self.names))), np.zeros((n, len(self.names)))
        least = np.full((n, len(self.names)), np.inf)
        for k, (a, b) in enumerate(self.pairs):
            m = margins[:, k]
            wins[:, a] += m > 0
            wins[:, b] += m <= 0
            for side, value in ((a, m), (b, -m)):
                sums[:, side] += value
                least[:, side] = np.minimum(least[:, side], value)
        best = np.argmax(wins + 1e-3 * np.tanh(sums / len(self.names)), axis=1)
        return best, least[np.arange(n), best]
