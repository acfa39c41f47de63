"""Dense kernels for one small training matrix: they run inside tasks, one fold or replicate each."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

RIDGE_ALPHAS = np.logspace(-3, 3, 13)
TREE_DEPTH, TREE_LEAF = 2, 5


def impute(train: np.ndarray, *others: np.ndarray) -> list[np.ndarray]:
    """Missing values become the training median of their column, 0 in a column without values."""
    fill = np.array([np.median(c[~np.isnan(c)]) if (~np.isnan(c)).any() else 0.0 for c in train.T]) if train.shape[1] else np.zeros(0)
    return [np.where(np.isnan(x), fill, x) for x in (train, *others)]


def standardise(train: np.ndarray, *others: np.ndarray) -> list[np.ndarray]:
    """Zero mean and unit deviation (population) by the training rows; constant columns are only centred."""
    mu, sd = train.mean(0), train.std(0)
    sd = np.where(sd > 10 * np.finfo(float).eps * np.maximum(1, np.abs(mu)), sd, 1.0)
    return [(x - mu) / sd for x in (train, *others)]


@dataclass
class Ridge:
    coef: np.ndarray
    intercept: float
    alpha: float

    def predict(self, x: np.ndarray) -> np.ndarray:
        return x @ self.coef + self.intercept


def fit_ridge(x: np.ndarray, y: np.ndarray, alphas: np.ndarray = RIDGE_ALPHAS) -> Ridge:
    """Ridge with a free intercept; the penalty is the one with the least mean squared leave-one-out error, in closed form."""
    mx, my = x.mean(0), y.mean()
    u, s, vt = np.linalg.svd(x - mx, full_matrices=False)
    uy, best = u.T @ (y - my), None
    for a in alphas:
        shrink = np.divide(s * s, s * s + a)
        residual = (y - my) - u @ (shrink * uy)
        leverage = 1 / len(y) + (u * u) @ shrink
        loss = float(np.mean((residual / np.maximum(1 - leverage, 1e-12)) ** 2))
        if best is None or loss < best[0]:
            best = (loss, a)
    a = best[1]
    coef = vt.T @ (s / (s * s + a) * uy)
    return Ridge(coef, float(my - mx @ coef), float(a))


@dataclass
class Tree:
    value: float
    feature: int = -1
    threshold: float = 0.0
    left: Tree | None = None
    right: Tree | None = None

    def predict_one(self, x: np.ndarray) -> float:
        node = self
        while node.feature >= 0:
            node = node.left if x[node.feature] <= node.threshold else node.right
        return node.value


def fit_tree(x: np.ndarray, y: np.ndarray, depth: int = TREE_DEPTH, leaf: int = TREE_LEAF) -> Tree:
    """Exact regression tree by squared error; of equal splits the first feature and the lowest threshold win."""
    node = Tree(float(y.mean()))
    n = len(y)
    if depth == 0 or n < 2 * leaf or np.ptp(y) == 0:
        return node
    best = (np.sum((y - y.mean()) ** 2) * (1 - 1e-12), -1, 0.0)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, t = x[order, f], y[order]
        c, q = np.cumsum(t), np.cumsum(t * t)
        k = np.arange(leaf, n - leaf + 1)
        k = k[v[k - 1] < v[k]] if len(k) else k
        if not len(k):
            continue
        cost = q[k - 1] - c[k - 1] ** 2 / k + (q[-1] - q[k - 1]) - (c[-1] - c[k - 1]) ** 2 / (n - k)
        i = int(np.argmin(cost))
        if cost[i] < best[0] - 1e-12 * abs(best[0]):
            best = (cost[i], f, (v[k[i] - 1] + v[k[i]]) / 2)
    if best[1] < 0:
        return node
    go = x[:, best[1]] <= best[2]
    node.feature, node.threshold = best[1], float(best[2])
    node.left, node.right = fit_tree(x[go], y[go], depth - 1, leaf), fit_tree(x[~go], y[~go], depth - 1, leaf)
    return node


def boost_stumps(x: np.ndarray, y: np.ndarray, rounds: int = 50, rate: float = 0.05, leaf: int = 5, penalty: float = 10.0) -> tuple[float, list[Tree]]:
    """Boosted stumps on squared error with shrunken leaves (deterministic: no row or column sampling)."""
    base, trees = float(y.mean()), []
    f = np.full(len(y), base)
    for _ in range(rounds):
        r = y - f
        t = fit_tree(x, r, 1, leaf)
        if t.feature < 0:
            break
        go = x[:, t.feature] <= t.threshold
        t.left.value, t.right.value = (float(r[m].sum() / (m.sum() + penalty)) for m in (go, ~go))
        f += rate * np.where(go, t.left.value, t.right.value)
        trees.append(t)
    return base, trees


def average_ranks(x: np.ndarray) -> np.ndarray:
    _, inverse, k = np.unique(x, return_inverse=True, return_counts=True)
    last = np.cumsum(k)
    return (last - (k - 1) / 2)[inverse]


def rank_z(x: np.ndarray) -> np.ndarray | None:
    r = average_ranks(x) / len(x)
    sd = r.std()
    return None if sd == 0 else (r - r.mean()) / sd


def spearman(x: np.ndarray, y: np.ndarray) -> float | None:
    a, b = average_ranks(x), average_ranks(y)
    if a.std() == 0 or b.std() == 0:
        return None
    return float(np.corrcoef(a, b)[0, 1])


def t_tail(r: float, nu: int) -> float:
    """Two-sided p value of a correlation with ``nu`` degrees of freedom (the finite series)."""
    s = min(1.0, abs(r))
    if s >= 1:
        return 0.0
    c2, total = 1 - s * s, 0.0
    if nu == 1:
        return 1 - 2 / math.pi * math.asin(s)
    if nu % 2 == 0:
        t = 1.0
        for k in range(1, nu // 2 + 1):
            total, t = total + t, t * (2 * k - 1) / (2 * k) * c2
        return max(0.0, 1 - s * total)
    t = math.sqrt(c2)
    for k in range(1, (nu - 1) // 2 + 1):
        total, t = total + t, t * 2 * k / (2 * k + 1) * c2
    return max(0.0, 1 - 2 / math.pi * (math.asin(s) + s * total))


def _bisect(f, lo: float, hi: float) -> float:
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) > 0 else (lo, mid)
    return (lo + hi) / 2


def rho_for_p(n: int, p: float) -> float:
    """The least correlation over n pairs that is significant at p."""
    return _bisect(lambda r: t_tail(r, n - 2) - p, 0.0, 1.0)


def normal_quantile(q: float) -> float:
    return _bisect(lambda z: q - 0.5 * math.erfc(-z / math.sqrt(2)), -40.0, 40.0)


def rho_for_power(n: int, alpha: float, power: float) -> float:
    """The correlation found with the given power, by Fisher's transformation."""
    return math.tanh((normal_quantile(1 - alpha / 2) + normal_quantile(power)) / math.sqrt(n - 3))


def ols_predict(x: np.ndarray, y: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Standardised least squares on the columns that vary in training."""
    live = x.std(0) > 0
    if not live.any():
        return np.full(len(new), y.mean())
    a, b = standardise(x[:, live], new[:, live])
    return np.column_stack([np.ones(len(b)), b]) @ np.linalg.lstsq(np.column_stack([np.ones(len(a)), a]), y, rcond=None)[0]


def predict(family: str, x: np.ndarray, y: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, float, np.ndarray | None]:
    """Predictions of one model family for new rows, the penalty and the coefficients (ridge only)."""
    if family == "mean" or not x.shape[1]:
        return np.full(len(new), y.mean()), float("nan"), None
    if family == "ols":
        return ols_predict(*_filled(x, y, new)), float("nan"), None
    a, b = impute(x, new)
    if family == "ridge":
        a, b = standardise(a, b)
        m = fit_ridge(a, y)
        return m.predict(b), m.alpha, m.coef
    if family == "tree":
        m = fit_tree(a, y)
        return np.array([m.predict_one(r) for r in b]), float("nan"), None
    if family == "stumps":
        base, trees = boost_stumps(a, y)
        return np.array([base + 0.05 * sum(t.predict_one(r) for t in trees) for r in b]), float("nan"), None
    raise ValueError(f"unknown model family {family!r}")


def _filled(x: np.ndarray, y: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a, b = impute(x, new)
    return a, y, b
