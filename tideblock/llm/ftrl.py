"""Follow-the-regularised-leader (proximal form) for logistic and multinomial models over sparse rows."""

from __future__ import annotations

import numpy as np


class Learner:
    """Weights of ``classes`` logits over ``size`` features; L1 keeps them sparse, L2 small, steps fall per coordinate.

    One class: logistic regression (labels 0 and 1). More: multinomial (labels 0 .. classes - 1). The last feature is the bias.
    """

    def __init__(self, size: int, classes: int = 1, alpha: float = 0.5, beta: float = 0.1, l1: float = 0.01, l2: float = 0.01):
        self.z = np.zeros((size + 1, classes))
        self.n = np.zeros((size + 1, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        z = self.z[rows]
        return -np.sign(z) * np.maximum(np.abs(z) - self.l1, 0) / ((self.beta + np.sqrt(self.n[rows])) / self.alpha + self.l2)

    def learn(self, index: np.ndarray, value: np.ndarray, label: int) -> None:
        """One update; ``index`` has no repeats and not the bias."""
        index, value = np.append(index, len(self.z) - 1), np.append(value, 1.0)
        w = self.weights(index)
        p = chances(value @ w)
        p[0 if p.size == 1 else label] -= label if p.size == 1 else 1
        g = value[:, None] * p[None, :]
        n = self.n[index]
        self.z[index] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[index] = n + g * g


def chances(logits: np.ndarray) -> np.ndarray:
    """Sigmoid over one logit, softmax over several (last axis)."""
    if logits.shape[-1] == 1:
        return 0.5 * (1 + np.tanh(0.5 * logits))
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)
