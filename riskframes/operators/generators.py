"""Scenario generators behind one protocol: fit on (time, assets) returns, sample (scenarios, horizon, assets) paths.

One fit and sample a task: ``run`` groups history slices by model and origin, so models and origins spread over the cluster. Randomness is
keyed by seed, model and origin, whatever the partition. A failure becomes a row with its message.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.special import t_cdf, t_quantile


class Generator(Protocol):
    def fit(self, returns: np.ndarray) -> Generator: ...

    def sample(self, scenarios: int, horizon: int, rng: np.random.Generator) -> np.ndarray: ...


def guarded(returns: np.ndarray) -> np.ndarray:
    returns = np.asarray(returns, float)
    if returns.ndim != 2 or min(returns.shape) == 0:
        raise ValueError("returns are a matrix of time by assets")
    if not np.isfinite(returns).all() or (returns <= -1).any():
        raise ValueError("returns are finite and above -1")
    return returns


def shrunk(cov: np.ndarray, weight: float, floor: float = 1e-10) -> np.ndarray:
    return (1 - weight) * cov + weight * np.diag(np.diag(cov)) + floor * np.eye(len(cov))


def back(x: np.ndarray) -> np.ndarray:
    """Simple returns of log returns, above -1 even where the exponential underflows."""
    return np.maximum(np.expm1(x), -1 + 1e-15)


@dataclass
class Historical:
    """Days at random, all assets of a day together."""

    def fit(self, returns):
        self.r = guarded(returns)
        return self

    def sample(self, scenarios, horizon, rng):
        return self.r[rng.integers(len(self.r), size=(scenarios, horizon))]


@dataclass
class MovingBlock:
    """Contiguous blocks of days, cut to the horizon."""

    block: int = 20

    def fit(self, returns):
        self.r = guarded(returns)
        if not 1 <= self.block <= len(self.r):
            raise ValueError("a block is as long as the history at most")
        return self

    def sample(self, scenarios, horizon, rng):
        starts = rng.integers(len(self.r) - self.block + 1, size=(scenarios, -(-horizon // self.block)))
        days = (starts[:, :, None] + np.arange(self.block)).reshape(scenarios, -1)[:, :horizon]
        return self.r[days]


@dataclass
class Gaussian:
    """Independent normal log returns with a covariance shrunk to its diagonal."""

    shrinkage: float = 0.05

    def fit(self, returns):
        x = np.log1p(guarded(returns))
        self.mean, self.root = x.mean(0), np.linalg.cholesky(shrunk(np.atleast_2d(np.cov(x.T)), self.shrinkage))
        return self

    def sample(self, scenarios, horizon, rng):
        return back(self.mean + rng.standard_normal((scenarios, horizon, len(self.mean))) @ self.root.T)


def kurtosis(x: np.ndarray) -> np.ndarray:
    """Bias-corrected excess kurtosis of columns."""
    n, d = len(x), x - x.mean(0)
    g = n * (d**4).sum(0) / np.maximum((d**2).sum(0) ** 2, 1e-300) - 3
    return (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g + 6)


@dataclass
class StudentT:
    """Elliptical t log returns; degrees of freedom from the median positive excess kurtosis unless given."""

    df: float | None = None
    shrinkage: float = 0.05

    def fit(self, returns):
        x = np.log1p(guarded(returns))
        if self.df is None:
            k = kurtosis(x)
            k = k[k > 0]
            self.nu = float(np.clip(6 / np.median(k) + 4, 4.1, 30)) if len(k) else 30.0
        else:
            self.nu = self.df
        if self.nu <= 2:
            raise ValueError("more than two degrees of freedom are needed")
        cov = shrunk(np.atleast_2d(np.cov(x.T)), self.shrinkage)
        self.mean, self.root = x.mean(0), np.linalg.cholesky(cov * (self.nu - 2) / self.nu)
        return self

    def sample(self, scenarios, horizon, rng):
        z = rng.standard_normal((scenarios, horizon, len(self.mean))) @ self.root.T
        mixing = rng.chisquare(self.nu, (scenarios, horizon, 1)) / self.nu
        return back(self.mean + z / np.sqrt(mixing))


@dataclass
class FilteredHistorical:
    """Residuals of an EWMA variance, drawn by day, scaled by a variance that the path updates."""

    decay: float = 0.94

    def fit(self, returns):
        x = np.log1p(guarded(returns))
        v = np.maximum(x.var(0, ddof=1), 1e-12)
        z = np.empty_like(x)
        for t in range(len(x)):
            z[t] = x[t] / np.sqrt(v)
            v = self.decay * v + (1 - self.decay) * x[t] ** 2
        self.z, self.v = z - z.mean(0), v
        return self

    def sample(self, scenarios, horizon, rng):
        days, v = rng.integers(len(self.z), size=(scenarios, horizon)), np.tile(self.v, (scenarios, 1))
        out = np.empty((scenarios, horizon, len(self.v)))
        for h in range(horizon):
            out[:, h] = self.z[days[:, h]] * np.sqrt(v)
            v = self.decay * v + (1 - self.decay) * out[:, h] ** 2
        return back(out)


@dataclass
class TCopula:
    """Ranks through a t copula, then each asset's empirical simple returns, interpolated within their range."""

    df: float = 6.0
    shrinkage: float = 0.05

    def fit(self, returns):
        r = guarded(returns)
        n = len(r)
        ranks = pd.DataFrame(r).rank(method="average").to_numpy()
        scores = t_quantile((ranks - 0.5) / n, self.df)
        corr = np.corrcoef(scores.T) if r.shape[1] > 1 else np.ones((1, 1))
        corr = (1 - self.shrinkage) * corr + (self.shrinkage + 1e-10) * np.eye(len(corr))
        self.root, self.sorted, self.grid = np.linalg.cholesky(corr), np.sort(r, 0), (np.arange(n) + 0.5) / n
        return self

    def sample(self, scenarios, horizon, rng):
        z = rng.standard_normal((scenarios, horizon, len(self.root))) @ self.root.T
        u = t_cdf(z / np.sqrt(rng.chisquare(self.df, (scenarios, horizon, 1)) / self.df), self.df)
        return np.stack([np.interp(u[..., k], self.grid, self.sorted[:, k]) for k in range(len(self.root))], -1)


@dataclass
class VarBootstrap:
    """A ridge VAR(1) of log returns with joint residuals drawn by day; the intercept isn't penalised."""

    ridge: float = 1e-6

    def fit(self, returns):
        x = np.log1p(guarded(returns))
        if len(x) < 3:
            raise ValueError("a regression needs more rows")
        design = np.column_stack([np.ones(len(x) - 1), x[:-1]])
        penalty = self.ridge * np.eye(design.shape[1])
        penalty[0, 0] = 0
        self.beta = np.linalg.solve(design.T @ design + penalty, design.T @ x[1:])
        residual = x[1:] - design @ self.beta
        self.residual, self.last = residual - residual.mean(0), x[-1]
        return self

    def sample(self, scenarios, horizon, rng):
        days, state = rng.integers(len(self.residual), size=(scenarios, horizon)), np.tile(self.last, (scenarios, 1))
        out = np.empty((scenarios, horizon, len(self.last)))
        for h in range(horizon):
            state = self.beta[0] + state @ self.beta[1:] + self.residual[days[:, h]]
            out[:, h] = state
        return back(out)


KINDS = {
    "historical": Historical,
    "moving_block": MovingBlock,
    "gaussian": Gaussian,
    "student_t": StudentT,
    "filtered_historical": FilteredHistorical,
    "t_copula": TCopula,
    "var_bootstrap": VarBootstrap,
}


def build(spec: dict) -> Generator:
    """A generator from ``kind`` and its parameters; an unknown kind is an error."""
    spec = {k: v for k, v in spec.items() if k != "model_id"}
    kind = spec.pop("kind")
    if kind not in KINDS:
        raise ValueError(f"unknown generator {kind}")
    return KINDS[kind](**spec)


SCHEMA = "model_id string, origin_pos bigint, scenario int, asset string, g double, error string"


def run(panel: DataFrame, origins: DataFrame, specs: list[dict], lookback: int, scenarios: int, horizon: int, seed: int) -> DataFrame:
    """(model_id, origin_pos, scenario, asset, g, error): cumulative returns of every model at every origin.

    ``panel``: (pos, asset, r). Slices come by an equi-join on blocks of positions and are exchanged once by model and origin.
    """
    from .windows import history_slices

    names = [s.get("model_id", s["kind"]) for s in specs]
    slices = history_slices(panel.select("pos", "asset", "r"), origins, lookback)
    slices = slices.select("origin_pos", "offset", "asset", "r").withColumn("model", F.explode(F.array(*[F.lit(k) for k in range(len(specs))])))

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        origin, model = int(key[0]), int(key[1])
        try:
            wide = rows.pivot(index="offset", columns="asset", values="r").sort_index()
            rng = np.random.Generator(np.random.Philox(key=[seed, model * 1_000_003 + origin]))
            paths = build(dict(specs[model])).fit(wide.to_numpy()).sample(scenarios, horizon, rng)
            g = np.expm1(np.log1p(np.maximum(paths, -1 + 1e-15)).sum(1))
            out = pd.DataFrame({"scenario": np.repeat(np.arange(scenarios), wide.shape[1]), "asset": np.tile(wide.columns, scenarios), "g": g.ravel(), "error": None})
        except (ValueError, np.linalg.LinAlgError) as failure:
            out = pd.DataFrame({"scenario": [None], "asset": [None], "g": [None], "error": [f"{type(failure).__name__}: {failure}"]})
        out.insert(0, "origin_pos", origin)
        out.insert(0, "model_id", names[model])
        return out

    return slices.groupBy("origin_pos", "model").applyInPandas(one, SCHEMA)


def fitted(panel: DataFrame, origins: DataFrame, lookback: int) -> DataFrame:
    """(origin_pos, asset, other, mean, covariance, freedom): what the Gaussian and the t model fit to the log returns of each origin's window; windows with gaps are left out."""
    from .windows import history_slices

    slices = history_slices(panel.select("pos", "asset", "r"), origins, lookback).select("origin_pos", "offset", "asset", "r")

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        wide = rows.pivot(index="offset", columns="asset", values="r").sort_index()
        names = ["origin_pos", "asset", "other", "mean", "covariance", "freedom"]
        if wide.isna().any().any() or len(wide) < lookback:
            return pd.DataFrame(columns=names)
        gaussian, student = Gaussian().fit(wide.to_numpy()), StudentT().fit(wide.to_numpy())
        cov = gaussian.root @ gaussian.root.T
        return pd.DataFrame([(int(key[0]), a, b, gaussian.mean[i], cov[i, j], student.nu) for i, a in enumerate(wide.columns) for j, b in enumerate(wide.columns)], columns=names)

    return slices.groupBy("origin_pos").applyInPandas(one, "origin_pos bigint, asset string, other string, mean double, covariance double, freedom double")


def batches(paths: np.ndarray, rows: int) -> Iterator[np.ndarray]:
    for i in range(0, len(paths), rows):
        yield paths[i : i + rows]
