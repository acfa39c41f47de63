"""Plain versions of models on one matrix, to hold the distributed ones against."""

import math

import numpy as np

from splitscope.operators.kernels import rank_z, t_tail


def fit_rank_ols(x: np.ndarray, y: np.ndarray, min_n: int = 30):
    """Least squares on rank z-scores: coefficients by column (constant ones are left out) and the condition number."""
    n, p = x.shape
    if n < min_n or n <= p + 2:
        return None
    zy, cols = rank_z(y), {k: z for k in range(p) if (z := rank_z(x[:, k])) is not None}
    if zy is None or not cols or n <= len(cols) + 2:
        return None
    m = np.column_stack([np.ones(n), *cols.values()])
    coef = np.linalg.lstsq(m, zy, rcond=None)[0]
    return dict(zip(cols, coef[1:].tolist(), strict=True)), float(np.linalg.cond(m))


def ols(x: np.ndarray, y: np.ndarray) -> dict:
    """Least squares with intercept: coefficients, classical and HC3 errors, p values, R2 and adjusted R2."""
    n = len(y)
    m = np.column_stack([np.ones(n), x])
    inverse = np.linalg.pinv(m.T @ m)
    b = inverse @ m.T @ y
    e = y - m @ b
    dof = n - m.shape[1]
    h = np.clip(np.einsum("ij,jk,ik->i", m, inverse, m), 0, 1 - 1e-12)
    se = np.sqrt(np.maximum(0, np.diag(inverse) * (e @ e) / max(1, dof)))
    hc3 = np.sqrt(np.maximum(0, np.diag(inverse @ (m.T * (e / (1 - h)) ** 2) @ m @ inverse)))
    t = np.divide(b, se, out=np.full_like(b, np.inf), where=se > 0)
    total = ((y - y.mean()) ** 2).sum()
    r2 = 1 - (e @ e) / total if total > 0 else float("nan")
    p = [t_tail(float(v / math.sqrt(v * v + dof)), dof) if np.isfinite(v) else 0.0 for v in t]
    return {"coef": b[1:], "intercept": float(b[0]), "se": se[1:], "hc3": hc3[1:], "p": np.array(p[1:]), "r2": float(r2), "adjusted_r2": float(1 - (1 - r2) * (n - 1) / dof), "residual": e, "dof": dof}
