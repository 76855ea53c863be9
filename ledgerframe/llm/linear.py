"""Logistic regression on rows of bounded number, solved on the driver."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * np.asarray(x, np.float64)))


def fit_dense(x: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Weights and intercept by Newton steps; the intercept bears no penalty."""
    full = np.c_[x, np.ones(len(x))]
    shrink = np.full(full.shape[1], penalty)
    shrink[-1] = 1e-6
    w = np.zeros(full.shape[1])
    for _ in range(rounds):
        p = sigmoid(full @ w)
        step = np.linalg.solve((full * (p * (1 - p))[:, None]).T @ full + np.diag(shrink), full.T @ (p - y) + shrink * w)
        w -= step * min(1.0, 10.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def fit_sparse(rows: np.ndarray, columns: np.ndarray, scale: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 500) -> tuple[np.ndarray, float]:
    """For binary features (places rows, columns) scaled by `scale`: accelerated gradient steps on the mean loss, each
    weight with the step that a diagonal bound of the curvature allows it."""
    n, m = len(y), len(scale)
    value = np.abs(scale[columns])
    sign = np.sign(scale)
    norm = np.bincount(rows, value, n) + 1
    rate = 1.0 / (0.25 * np.bincount(columns, value * norm[rows], m) / n + penalty)
    rate0 = 1.0 / (0.25 * norm.mean())
    w, b = np.zeros(m), 0.0
    w0, b0 = w, b
    for k in range(rounds):
        speed = k / (k + 3)
        wv, bv = w + speed * (w - w0), b + speed * (b - b0)
        error = (sigmoid(np.bincount(rows, value * wv[columns], n) + bv) - y) / n
        w0, b0 = w, b
        w = wv - rate * (np.bincount(columns, value * error[rows], m) + penalty * wv)
        b = bv - rate0 * error.sum()
    return w * sign, b
