"""A linear hinge-loss model by dual coordinate descent, and the calibration of its margins."""

from __future__ import annotations

import numpy as np


def dual_coordinate_descent(
    rows: list[tuple[np.ndarray, np.ndarray]],
    y: np.ndarray,
    size: int,
    cost: float = 1.0,
    epochs: int = 12,
    seed: int = 7,
    balance: bool = True,
    weight: np.ndarray | None = None,
    positive: bool = False,
) -> tuple[np.ndarray, float]:
    """Weights and bias of an L1-loss support vector machine over sparse rows (indices, values).

    Each step solves one dual variable in closed form and clips it to [0, C]; C is scaled by the ``weight`` of a row, and with
    ``balance`` by class so that both classes weigh alike. The bias is an extra feature that is always 1. With ``positive`` the weights
    (not the bias) are held at 0 or more: the step is then the one that the row's norm bounds.
    """
    w, bias = np.zeros(size), 0.0
    n = len(rows)
    sign = np.where(y > 0, 1.0, -1.0)
    weight = np.ones(n) if weight is None else weight
    share = max(1e-9, float(weight[sign > 0].sum())), max(1e-9, float(weight[sign < 0].sum()))
    c = weight * cost * (np.where(sign > 0, n / (2 * share[0]), n / (2 * share[1])) if balance else 1.0)
    norm = np.array([float(v @ v) + 1.0 for _, v in rows])
    alpha = np.zeros(n)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(n):
            at, v = rows[i]
            now = np.maximum(w[at], 0.0) if positive else w[at]
            grad = sign[i] * (float(now @ v) + bias) - 1.0
            new = min(max(alpha[i] - grad / norm[i], 0.0), c[i])
            step = (new - alpha[i]) * sign[i]
            if step:
                w[at] += step * v
                bias += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return np.maximum(w, 0.0) if positive else w, bias


def margins(rows: list[tuple[np.ndarray, np.ndarray]], w: np.ndarray, bias: float) -> np.ndarray:
    return np.array([float(w[at] @ v) + bias for at, v in rows])


def platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, b) of P(y = 1) = 1 / (1 + exp(-(a * margin + b))), fitted by Newton steps on smoothed targets."""
    pos, neg = float((y > 0).sum()), float((y <= 0).sum())
    if not pos or not neg:
        return 1.0, 0.0
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.stack([margin, np.ones_like(margin)], axis=1)
    coef = np.array([1.0 / (np.std(margin) + 1e-9), 0.0])

    def loss(c: np.ndarray) -> float:
        z = x @ c
        return float((np.logaddexp(0, z) - t * z).sum())

    now = loss(coef)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ coef, -35, 35)))
        grad = x.T @ (p - t)
        hess = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-9 * np.eye(2)
        step, scale = np.linalg.solve(hess, grad), 1.0
        while scale > 1e-6 and loss(coef - scale * step) > now:
            scale /= 2
        new = loss(coef - scale * step)
        if now - new < 1e-9:
            break
        coef, now = coef - scale * step, new
    return float(max(coef[0], 1e-6)), float(coef[1])


def probability(margin: np.ndarray, ab: tuple[float, float]) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(ab[0] * margin + ab[1], -35, 35)))
