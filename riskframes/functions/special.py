"""Special functions in numpy: distributions and their quantiles, and a linear-programming solver.

Small dense kernels for use within Arrow batches and on the driver, on sizes that don't grow with the data.
"""

from __future__ import annotations

import math

import numpy as np


def log_sum_exp(x: np.ndarray, axis: int) -> np.ndarray:
    top = np.max(x, axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    return np.squeeze(top, axis) + np.log(np.sum(np.exp(x - top), axis=axis))


def incomplete_beta(a: float, b: float, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function, by Lentz's continued fraction on the side where it converges fast."""
    x = np.asarray(x, float)
    flip = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    tiny = 1e-300
    c, d = np.ones_like(z), 1 - (p + q) * z / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    out = d.copy()
    for m in range(1, 300):
        for even in (True, False):
            k = m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)) if even else -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))
            d = 1 + k * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + k / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            out = out * c * d
        if np.all(np.abs(c * d - 1) < 1e-15):
            break
    lead = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    with np.errstate(divide="ignore", invalid="ignore"):
        value = np.exp(lead + p * np.log(z) + q * np.log1p(-z)) * out / p
    value = np.where(z <= 0, 0.0, value)
    return np.where(flip, 1 - value, value)


def t_cdf(x: np.ndarray, df: float) -> np.ndarray:
    x = np.asarray(x, float)
    tail = 0.5 * incomplete_beta(df / 2, 0.5, df / (df + x * x))
    return np.where(x > 0, 1 - tail, tail)


def t_quantile(p: np.ndarray, df: float) -> np.ndarray:
    """By bisection on the distribution, then Newton steps; p in (0, 1)."""
    p = np.asarray(p, float)
    low, high = np.full(p.shape, -1.0), np.full(p.shape, 1.0)
    for _ in range(200):
        wide = t_cdf(low, df) > p
        if not wide.any():
            break
        low = np.where(wide, low * 2, low)
    for _ in range(200):
        wide = t_cdf(high, df) < p
        if not wide.any():
            break
        high = np.where(wide, high * 2, high)
    for _ in range(60):
        mid = (low + high) / 2
        above = t_cdf(mid, df) > p
        low, high = np.where(above, low, mid), np.where(above, mid, high)
    return (low + high) / 2


@np.errstate(all="ignore")  # steps that overflow end the search; what is reached is checked
def solve_lp(c: np.ndarray, a: np.ndarray, b: np.ndarray, tolerance: float = 1e-8, most: int = 100, normal=None) -> np.ndarray:
    """Minimise c.x with a.x = b and x >= 0 by Mehrotra's predictor-corrector steps on the normal equations.

    ``normal``: takes a vector d and gives a function that solves a diag(d) a' y = r; for programs whose structure makes that cheap.
    """
    n = a.shape[1]
    normal = normal or (lambda d: _solver((a * d) @ a.T))
    scale = max(1.0, np.abs(b).max(initial=0), np.abs(c).max(initial=0))
    first = normal(np.ones(n))
    x = a.T @ first(b)
    y = first(a @ c)
    s = c - a.T @ y
    x += max(-1.5 * x.min(), 0)
    s += max(-1.5 * s.min(), 0)
    mu = x @ s
    x += 0.5 * mu / max(s.sum(), 1e-12) + 1e-8
    s += 0.5 * mu / max(x.sum(), 1e-12) + 1e-8
    for _ in range(most):
        rp, rd, gap = b - a @ x, c - a.T @ y - s, x @ s / n
        if np.abs(rp).max() < tolerance * scale and np.abs(rd).max() < tolerance * scale and gap < tolerance * scale:
            return x
        d = np.clip(x / s, 1e-16, 1e16)
        solve = normal(d)

        def step(rc: np.ndarray, d=d, rp=rp, rd=rd, solve=solve, x=x, s=s):
            dy = solve(rp + (a * d) @ (rd - rc / x))
            ds = rd - a.T @ dy
            return (rc - x * ds) / s, dy, ds

        dx, dy, ds = step(-x * s)
        if not np.isfinite(dx).all() or not np.isfinite(ds).all():
            break  # as far as the precision goes; what is reached is checked below
        px, pd = _reach(x, dx), _reach(s, ds)
        sigma = ((x + px * dx) @ (s + pd * ds) / (n * gap)) ** 3
        dx, dy, ds = step(sigma * gap - x * s - dx * ds)
        if not np.isfinite(dx).all() or not np.isfinite(ds).all():
            break
        px, pd = 0.995 * _reach(x, dx), 0.995 * _reach(s, ds)
        x, y, s = np.maximum(x + px * dx, 1e-15), y + pd * dy, np.maximum(s + pd * ds, 1e-15)
    if not (np.abs(b - a @ x).max() <= 1e-5 * scale and x @ s / n <= 1e-5 * scale):
        raise ValueError("the linear program has no feasible solution, or none was found")
    return x


def _solver(matrix: np.ndarray):
    """Solves with a symmetric matrix, by least squares where it is singular."""
    size = np.sqrt(np.maximum(np.diag(matrix), 1e-300))
    scaled = matrix / np.outer(size, size)
    try:
        inverse = np.linalg.inv(np.linalg.cholesky(scaled))
        if np.isfinite(inverse).all():
            return lambda right: (inverse.T @ (inverse @ (right / size))) / size
    except np.linalg.LinAlgError:
        pass
    return lambda right: np.linalg.lstsq(scaled, right / size, rcond=1e-14)[0] / size


def _reach(x: np.ndarray, dx: np.ndarray) -> float:
    """The longest step in (0, 1] that keeps x positive."""
    down = dx < 0
    return min(1.0, float(np.min(-x[down] / dx[down]))) if down.any() else 1.0


def gpd_fit(excess: np.ndarray) -> tuple[float, float]:
    """Shape and scale of a generalised Pareto distribution by maximum likelihood.

    Along theta = shape / scale the likelihood has one dimension: shape is the mean of log(1 + theta x). The best of a grid is refined.
    """
    x = np.asarray(excess, float)
    if len(x) < 2 or x.min() <= 0:
        raise ValueError("excesses must be positive")
    top, mean = x.max(), x.mean()

    def value(theta: float) -> float:
        if abs(theta) < 1e-12:
            return -math.log(mean) - 1
        inside = 1 + theta * x
        if inside.min() <= 0:
            return -math.inf
        shape = np.log(inside).mean()
        if shape / theta <= 0:
            return -math.inf
        return -math.log(shape / theta) - shape - 1

    low = -1 / top * (1 - 1e-6)
    grid = np.concatenate([low * np.linspace(1, 1e-4, 200), np.geomspace(1e-6, 50, 400) / mean])
    best = grid[np.argmax([value(t) for t in grid])]
    at = np.searchsorted(np.sort(grid), best)
    order = np.sort(grid)
    a, b = order[max(at - 1, 0)], order[min(at + 1, len(order) - 1)]
    ratio = (math.sqrt(5) - 1) / 2
    for _ in range(100):
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        a, b = (a, d) if value(c) > value(d) else (c, b)
    theta = (a + b) / 2
    if abs(theta) < 1e-12:
        return 0.0, mean
    shape = float(np.log(1 + theta * x).mean())
    return shape, shape / theta
