"""Factors, regimes and their dynamics: sufficient statistics by aggregation, small dense algebra on the driver.

Moment sums over rows are one distributed aggregate whatever the number of rows; what comes to the driver is a square of the number of
columns. The recursive filter is an ordered aggregate a series; EM restarts are independent rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import dot
from ..functions.special import log_sum_exp
from .windows import equal_bins


def gram(frame: DataFrame, columns: list[str], weight: Column | None = None) -> tuple[float, np.ndarray, np.ndarray]:
    """Sum of weights, weighted sums and weighted sums of products, in one pass: a matrix product a batch, added up a task and then by cell.

    Nulls add nothing. What comes to the driver is a square of the number of columns.
    """
    n = len(columns)
    w = (weight if weight is not None else F.lit(1.0)).cast("double")
    rows = frame.select(w.alias("_w"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"_x{k}") for k, c in enumerate(columns)])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n + 1, n + 1))
        for batch in batches:
            w = batch.column(0).to_numpy(zero_copy_only=False)
            x = np.column_stack([np.ones(len(w)), *[batch.column(k + 1).to_numpy(zero_copy_only=False) for k in range(n)]])
            total += (x * w[:, None]).T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["cell", "s"])

    sums = rows.mapInArrow(add_up, "cell bigint, s double").groupBy("cell").agg(F.sum("s").alias("s")).toArrow()
    total = np.zeros((n + 1) ** 2)
    total[sums.column("cell").to_numpy()] = sums.column("s").to_numpy()
    total = total.reshape(n + 1, n + 1)
    return float(total[0, 0]), total[0, 1:], total[1:, 1:]


def covariance(frame: DataFrame, columns: list[str], ddof: int = 1, shrinkage: float = 0.0, floor: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance, shrunk to its diagonal."""
    n, s, m = gram(frame, columns)
    mean = s / n
    cov = (m - n * np.outer(mean, mean)) / (n - ddof)
    return mean, (1 - shrinkage) * cov + shrinkage * np.diag(np.diag(cov)) + floor * np.eye(len(cov))


def positive(matrix: np.ndarray, floor: float) -> np.ndarray:
    """The symmetric part with eigenvalues held above a floor."""
    values, vectors = np.linalg.eigh((matrix + matrix.T) / 2)
    return (vectors * np.maximum(values, floor)) @ vectors.T


@dataclass(frozen=True)
class FactorModel:
    """Centre, scale and loadings of standardised columns, frozen at the fit."""

    columns: list[str]
    centre: np.ndarray
    scale: np.ndarray
    loadings: np.ndarray  # columns x factors
    explained: np.ndarray
    log: bool

    def values(self) -> list[Column]:
        return [F.log1p(c) if self.log else F.col(c) for c in self.columns]

    def project(self, frame: DataFrame, prefix: str = "f") -> DataFrame:
        """``frame`` with factor columns; no refit. Missing or reordered columns are an error."""
        if [c for c in frame.columns if c in self.columns] != self.columns:
            raise ValueError("columns must be those of the fit, in order")
        z = F.array(*[(x - float(m)) / float(s) for x, m, s in zip(self.values(), self.centre, self.scale, strict=True)])
        return frame.withColumns({f"{prefix}{k}": dot(z, F.array(*[F.lit(float(v)) for v in self.loadings[:, k]])) for k in range(self.loadings.shape[1])})

    def restore(self, frame: DataFrame, prefix: str = "f", to: str = "fit__") -> DataFrame:
        """``frame`` with the columns that its factors stand for."""
        out = {}
        for i, c in enumerate(self.columns):
            z = F.lit(0.0)
            for k in range(self.loadings.shape[1]):
                z = z + F.col(f"{prefix}{k}") * float(self.loadings[i, k])
            x = z * float(self.scale[i]) + float(self.centre[i])
            out[to + c] = F.greatest(F.expm1(x), F.lit(-1.0)) if self.log else x
        return frame.withColumns(out)


def fit_factors(frame: DataFrame, columns: list[str], count: int, log: bool = True, floor: float = 1e-12) -> FactorModel:
    """Principal factors of standardised columns; each axis points where its largest loading is positive."""
    names = [f"_x{k}" for k in range(len(columns))]
    rows = frame.select(*[(F.log1p(c) if log else F.col(c)).alias(n) for c, n in zip(columns, names, strict=True)])
    n, s, m = gram(rows, names)
    centre = s / n
    cov = m / n - np.outer(centre, centre)
    scale = np.maximum(np.sqrt(np.maximum(np.diag(cov), 0)), floor)
    values, vectors = np.linalg.eigh(cov / np.outer(scale, scale))
    order = np.argsort(values)[::-1]
    values, vectors = np.maximum(values[order], 0), vectors[:, order]
    loadings = vectors[:, :count]
    pivot = np.abs(loadings).argmax(0)
    loadings = loadings * np.where(loadings[pivot, np.arange(count)] < 0, -1, 1)
    return FactorModel(columns, centre, scale, loadings, values[:count] / values.sum(), log)


def standardizer(frame: DataFrame, columns: list[str], floor: float = 1e-12) -> DataFrame:
    """(name, mean, scale, n_fit_rows): population deviation with a floor."""
    out = frame.unpivot([], columns, "name", "x")
    return out.groupBy("name").agg(F.avg("x").alias("mean"), F.greatest(F.stddev_pop("x"), F.lit(floor)).alias("scale"), F.count("x").alias("n_fit_rows"))


@dataclass(frozen=True)
class Standardizer:
    """Mean and scale of columns, frozen at the fit."""

    columns: list[str]
    mean: np.ndarray
    scale: np.ndarray
    n_fit_rows: int

    def transform(self, frame: DataFrame) -> DataFrame:
        return frame.withColumns({c: (F.col(c) - float(m)) / float(s) for c, m, s in zip(self.columns, self.mean, self.scale, strict=True)})

    def inverse(self, frame: DataFrame) -> DataFrame:
        return frame.withColumns({c: F.col(c) * float(s) + float(m) for c, m, s in zip(self.columns, self.mean, self.scale, strict=True)})


def fit_standardizer(frame: DataFrame, columns: list[str], floor: float = 1e-12) -> Standardizer:
    """Fitted on the rows of ``frame``; without a row it is an error."""
    found = {r["name"]: r for r in standardizer(frame, columns, floor).collect()}  # one row a column
    if set(found) != set(columns) or not all(found[c]["n_fit_rows"] for c in columns):
        raise ValueError("a standardizer needs rows with values")
    return Standardizer(list(columns), np.array([found[c]["mean"] for c in columns]), np.array([found[c]["scale"] for c in columns]), int(max(found[c]["n_fit_rows"] for c in columns)))


# --- regimes ---------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Regimes:
    """A Gaussian hidden Markov model; states in order of the first feature's mean."""

    start: np.ndarray
    transitions: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    objective: float
    iterations: int


def log_density(x: np.ndarray, means: np.ndarray, covariances: np.ndarray) -> np.ndarray:
    """(time, states) log densities; a covariance that isn't positive definite is an error."""
    out = np.empty((len(x), len(means)))
    for k, (mean, cov) in enumerate(zip(means, covariances, strict=True)):
        root = np.linalg.cholesky(cov)
        z = np.linalg.solve(root, (x - mean).T)
        out[:, k] = -0.5 * (z**2).sum(0) - np.log(np.diag(root)).sum() - 0.5 * len(mean) * np.log(2 * np.pi)
    return out


def forward_backward(density: np.ndarray, start: np.ndarray, transitions: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Log likelihood, filtered and smoothed probabilities, and expected transition counts, in log space."""
    floor = 1e-300
    la, lp = np.log(np.maximum(transitions, floor)), np.log(np.maximum(start, floor))
    steps, states = density.shape
    forward, backward = np.empty((steps, states)), np.zeros((steps, states))
    forward[0] = lp + density[0]
    for t in range(1, steps):
        forward[t] = density[t] + log_sum_exp(forward[t - 1][:, None] + la, 0)
    for t in range(steps - 2, -1, -1):
        backward[t] = log_sum_exp(la + (density[t + 1] + backward[t + 1])[None, :], 1)
    total = float(log_sum_exp(forward[-1], 0))
    filtered = np.exp(forward - log_sum_exp(forward, 1)[:, None])
    smoothed = np.exp(forward + backward - total)
    counts = np.zeros((states, states))
    for t in range(steps - 1):
        counts += np.exp(forward[t][:, None] + la + (density[t + 1] + backward[t + 1])[None, :] - total)
    return total, filtered, smoothed / smoothed.sum(1, keepdims=True), counts


def _initial(x: np.ndarray, states: int, sticky: float, rng: np.random.Generator):
    """Means at random rows of bins along the first principal direction."""
    d = x - x.mean(0)
    order = np.argsort(d @ np.linalg.svd(d, full_matrices=False)[2][0], kind="stable")
    means = np.array([x[rng.choice(part)] for part in np.array_split(order, states)])
    transitions = 1 + sticky * np.eye(states) + rng.uniform(0, 0.25, (states, states))
    return np.full(states, 1 / states), transitions / transitions.sum(1, keepdims=True), means


def em(x: np.ndarray, states: int, rng: np.random.Generator, iterations: int = 300, tolerance: float = 1e-6, pseudo: float = 0.5, sticky: float = 8.0, least_eigenvalue: float = 1e-6, least_weight: float = 1e-3) -> Regimes:
    """Penalised EM from one start; a state that loses its weight is seeded anew."""
    common = positive(np.atleast_2d(np.cov(x.T)), least_eigenvalue)
    start, transitions, means = _initial(x, states, sticky, rng)
    covariances = np.array([common] * states)
    last, steps = -np.inf, 0
    for steps in range(1, iterations + 1):
        total, _, gamma, counts = forward_backward(log_density(x, means, covariances), start, transitions)
        value = total + ((pseudo + sticky * np.eye(states)) * np.log(np.maximum(transitions, 1e-300))).sum()
        if np.isfinite(last) and abs(value - last) <= tolerance * (1 + abs(last)):
            last = value
            break
        last = value
        start = gamma[0] + 1 / states
        start = start / start.sum()
        transitions = counts + pseudo + sticky * np.eye(states)
        transitions = transitions / transitions.sum(1, keepdims=True)
        for k in range(states):
            weight = gamma[:, k].sum()
            if weight < max(least_weight * len(x), x.shape[1] + 1):
                means[k], covariances[k] = x[rng.integers(len(x))], common
                continue
            means[k] = gamma[:, k] @ x / weight
            d = x - means[k]
            covariances[k] = positive((gamma[:, k][:, None] * d).T @ d / weight, least_eigenvalue)
    order = np.argsort(means[:, 0], kind="stable")
    return Regimes(start[order], transitions[np.ix_(order, order)], means[order], covariances[order], last, steps)


def series_rows(frame: DataFrame, columns: list[str], order: str = "date", most: int = 2_000_000) -> pd.DataFrame:
    """The rows of one fitted series on the driver, in order. A series is a window of days; more than ``most`` rows are an error, not a longer wait."""
    rows = frame.orderBy(order).select(*columns).limit(most + 1).toPandas()
    if len(rows) > most:
        raise ValueError(f"a fit takes {most} rows of a series at most")
    return rows


def fit_regimes(frame: DataFrame, columns: list[str], states: int, restarts: int, seed: int, **options) -> Regimes:
    """The best of several EM starts, one a task. Each sees the whole training series, which is a fitted window's length."""
    spark = frame.sparkSession
    rows = series_rows(frame, columns).to_numpy(float)
    sent = spark.sparkContext.broadcast(rows)

    def one(batches):
        for batch in batches:
            for k in batch["restart"]:
                m = em(sent.value, states, np.random.Generator(np.random.Philox(key=[seed, int(k)])), **options)
                yield pd.DataFrame({"restart": [k], "objective": [m.objective], "iterations": [m.iterations], "start": [m.start.tolist()], "transitions": [m.transitions.ravel().tolist()], "means": [m.means.ravel().tolist()], "covariances": [m.covariances.ravel().tolist()]})

    schema = "restart bigint, objective double, iterations int, start array<double>, transitions array<double>, means array<double>, covariances array<double>"
    found = spark.range(0, restarts, 1, restarts).withColumnRenamed("id", "restart").mapInPandas(one, schema)
    best = found.orderBy(F.desc("objective"), "restart").first()
    d = len(columns)
    return Regimes(np.array(best["start"]), np.array(best["transitions"]).reshape(states, states), np.array(best["means"]).reshape(states, d), np.array(best["covariances"]).reshape(states, d, d), best["objective"], best["iterations"])


def filter_regimes(frame: DataFrame, columns: list[str], model: Regimes, start: np.ndarray | None = None) -> DataFrame:
    """(series, date, pi): beliefs given the past, one pass over a series, which is one task's group; a prefix gives the same beliefs.

    ``start``: another prior, such as the last belief moved one step on.
    """
    prior = model.start if start is None else start
    kinds = dict(frame.dtypes)

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("date")
        density = log_density(rows[columns].to_numpy(float), model.means, model.covariances)
        out, now = np.empty(density.shape), np.asarray(prior, float)
        for t, logs in enumerate(density):
            weight = np.exp(logs - logs.max()) * np.maximum(now, 1e-300)
            out[t] = weight / weight.sum()
            now = out[t] @ model.transitions
        return pd.DataFrame({"series": rows["series"], "date": rows["date"], "pi": out.tolist()})

    return frame.select("series", "date", *columns).groupBy("series").applyInPandas(one, f"series {kinds['series']}, date {kinds['date']}, pi array<double>")


def binned_regimes(frame: DataFrame, columns: list[str], states: int, stay: float = 0.9, floor: float = 1e-12) -> Regimes:
    """Regimes without a fit: moments of equal bins of the first column, each state kept with probability ``stay``. A deterministic start for EM and a yardstick for filters."""
    binned = equal_bins(frame.select(F.lit(0).alias("all"), *columns), [F.col(c) for c in columns], states, ("all",))
    means, covariances = [], []
    for k in range(states):
        n, s, m = gram(binned.filter(F.col("bin") == k), columns)
        means.append(s / n)
        covariances.append(positive(m / n - np.outer(s / n, s / n), floor))
    transitions = np.full((states, states), (1 - stay) / max(states - 1, 1)) + (stay - (1 - stay) / max(states - 1, 1)) * np.eye(states)
    return Regimes(np.full(states, 1 / states), transitions, np.array(means), np.array(covariances), float("nan"), 0)


def em_step(x: np.ndarray, model: Regimes, pseudo: float = 0.5, sticky: float = 8.0, least_eigenvalue: float = 1e-6) -> tuple[Regimes, np.ndarray]:
    """One penalised EM step from a model: the new model (its objective is that of the old one) and the smoothed beliefs."""
    states = len(model.means)
    total, _, gamma, counts = forward_backward(log_density(x, model.means, model.covariances), model.start, model.transitions)
    value = total + ((pseudo + sticky * np.eye(states)) * np.log(np.maximum(model.transitions, 1e-300))).sum()
    start = gamma[0] + 1 / states
    transitions = counts + pseudo + sticky * np.eye(states)
    weight = gamma.sum(0)
    means = gamma.T @ x / weight[:, None]
    covariances = np.array([positive((gamma[:, k][:, None] * (x - means[k])).T @ (x - means[k]) / weight[k], least_eigenvalue) for k in range(states)])
    return Regimes(start / start.sum(), transitions / transitions.sum(1, keepdims=True), means, covariances, float(value), model.iterations + 1), gamma


def regime_diagnostics(smoothed: np.ndarray, model: Regimes) -> dict:
    """Occupancy, persistence and conditioning of a fit."""
    return {"occupancy": smoothed.mean(0).tolist(), "persistence": np.diag(model.transitions).tolist(), "least_eigenvalue": float(min(np.linalg.eigvalsh(c).min() for c in model.covariances))}


def state_paths(belief: np.ndarray, transitions: np.ndarray, paths: int, horizon: int, rng: np.random.Generator) -> np.ndarray:
    """(paths, horizon) states; the first is one step after the belief's time."""
    cumulative = np.cumsum(transitions, 1)
    state = np.minimum((rng.random(paths)[:, None] > np.cumsum(belief)[None, :]).sum(1), len(belief) - 1)
    out = np.empty((paths, horizon), int)
    for h in range(horizon):
        state = np.minimum((rng.random(paths)[:, None] > cumulative[state]).sum(1), len(belief) - 1)
        out[:, h] = state
    return out


# --- dynamics and mapping -----------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class RegimeVar:
    intercept: np.ndarray  # states x factors
    matrix: np.ndarray  # states x factors x factors
    root: np.ndarray


def fit_regime_var(factors: np.ndarray, belief: np.ndarray, ridge: float = 1e-4, floor: float = 1e-8, radius: float = 0.995) -> RegimeVar:
    """A VAR(1) by state, weighted with the belief at the target's time; states with too little weight take the pooled fit."""
    x, y, w = np.column_stack([np.ones(len(factors) - 1), factors[:-1]]), factors[1:], belief[1:]
    penalty = ridge * np.eye(x.shape[1])
    penalty[0, 0] = 0

    def solve(weight: np.ndarray):
        beta = np.linalg.solve((x * weight[:, None]).T @ x + penalty, (x * weight[:, None]).T @ y)
        phi = beta[1:].T
        size = np.abs(np.linalg.eigvals(phi)).max()
        phi = phi * min(1.0, radius / max(size, 1e-300))
        residual = y - beta[0] - x[:, 1:] @ phi.T
        return beta[0], phi, np.linalg.cholesky(positive((residual * weight[:, None]).T @ residual / weight.sum(), floor))

    pooled = solve(np.ones(len(y)))
    parts = [solve(w[:, k]) if w[:, k].sum() > factors.shape[1] + 1 else pooled for k in range(w.shape[1])]
    return RegimeVar(*(np.array(p) for p in zip(*parts, strict=True)))


def factor_paths(model: RegimeVar, last: np.ndarray, states: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    out, f = np.empty((*states.shape, len(last))), np.tile(last, (len(states), 1))
    for h in range(states.shape[1]):
        z = states[:, h]
        f = model.intercept[z] + np.einsum("pij,pj->pi", model.matrix[z], f) + np.einsum("pij,pj->pi", model.root[z], rng.standard_normal(f.shape))
        out[:, h] = f
    return out


@dataclass(frozen=True)
class Mapping:
    """Observations by state: intercept, loadings, scales and a residual correlation's root; states are picked, never averaged."""

    intercept: np.ndarray
    loadings: np.ndarray
    scale: np.ndarray
    root: np.ndarray

    def expected(self, factors: np.ndarray, states: np.ndarray) -> np.ndarray:
        return self.intercept[states] + np.einsum("...ij,...j->...i", self.loadings[states], factors)

    def sample(self, factors: np.ndarray, states: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        noise = rng.standard_normal((*states.shape, self.intercept.shape[1]))
        return self.expected(factors, states) + self.scale[states] * np.einsum("...ij,...j->...i", self.root[states], noise)


def fit_mapping(observed: np.ndarray, factors: np.ndarray, belief: np.ndarray, ridge: float = 1e-4, shrinkage: float = 0.20, floor: float = 1e-6) -> Mapping:
    x = np.column_stack([np.ones(len(factors)), factors])
    penalty = ridge * np.eye(x.shape[1])
    penalty[0, 0] = 0

    def solve(w: np.ndarray):
        beta = np.linalg.solve((x * w[:, None]).T @ x + penalty, (x * w[:, None]).T @ observed)
        residual = observed - x @ beta
        cov = (residual * w[:, None]).T @ residual / w.sum()
        scale = np.maximum(np.sqrt(np.maximum(np.diag(cov), 0)), floor)
        corr = (1 - shrinkage) * cov / np.outer(scale, scale) + shrinkage * np.eye(len(scale))
        corr = positive(corr, 1e-10)
        size = np.sqrt(np.diag(corr))
        return beta[0], beta[1:].T, scale, np.linalg.cholesky(corr / np.outer(size, size))

    pooled = solve(np.ones(len(x)))
    parts = [solve(belief[:, k]) if belief[:, k].sum() > x.shape[1] else pooled for k in range(belief.shape[1])]
    return Mapping(*(np.array(p) for p in zip(*parts, strict=True)))


@dataclass(frozen=True)
class Switching:
    """Factors, regimes, dynamics and mapping fitted together on training rows."""

    factors: FactorModel
    regimes: Regimes
    dynamics: RegimeVar
    mapping: Mapping
    belief: np.ndarray
    last: np.ndarray

    def sample(self, belief: np.ndarray, last: np.ndarray, paths: int, horizon: int, rng: np.random.Generator) -> np.ndarray:
        """(paths, horizon, assets) simple returns from a belief and a last factor."""
        states = state_paths(belief, self.regimes.transitions, paths, horizon, rng)
        y = self.mapping.sample(factor_paths(self.dynamics, last, states, rng), states, rng)
        return np.maximum(np.expm1(y), -1 + 1e-15)


@dataclass(frozen=True)
class SwitchingSpec:
    """All parameters of the integrated model; none has a default."""

    factors: int
    states: int
    restarts: int
    iterations: int
    tolerance: float
    pseudo: float
    sticky: float
    seed: int

    @classmethod
    def of(cls, config: dict) -> SwitchingSpec:
        """From a mapping with exactly these keys; a missing or unknown one is an error."""
        names = set(cls.__dataclass_fields__)
        if set(config) != names:
            raise ValueError(f"missing: {sorted(names - set(config))}, unknown: {sorted(set(config) - names)}")
        return cls(**config)

    def fit(self, frame: DataFrame, columns: list[str]) -> Switching:
        return fit_switching(frame, columns, self.factors, self.states, self.restarts, self.seed, iterations=self.iterations, tolerance=self.tolerance, pseudo=self.pseudo, sticky=self.sticky)


def fit_switching(frame: DataFrame, columns: list[str], count: int, states: int, restarts: int, seed: int, **options) -> Switching:
    """Training uses smoothed beliefs; forecasts start from the filtered one."""
    model = fit_factors(frame, columns, count)
    scored = model.project(frame).select("date", *columns, *[f"f{k}" for k in range(count)])
    regimes = fit_regimes(scored, [f"f{k}" for k in range(count)], states, restarts, seed, **options)
    rows = series_rows(scored, [*columns, *[f"f{k}" for k in range(count)]])
    f, y = rows[[f"f{k}" for k in range(count)]].to_numpy(float), np.log1p(rows[columns].to_numpy(float))
    _, filtered, smoothed, _ = forward_backward(log_density(f, regimes.means, regimes.covariances), regimes.start, regimes.transitions)
    return Switching(model, regimes, fit_regime_var(f, smoothed), fit_mapping(y, f, smoothed), filtered[-1], f[-1])


def state_profiles(rows: DataFrame, values: list[str], belief: str = "pi") -> DataFrame:
    """(state, effective_observations, occupancy, mean and volatility of each value) weighted with beliefs."""
    each = rows.select(*values, F.posexplode(belief).alias("state", "w"))
    n = rows.count()
    out = [F.sum("w").alias("effective_observations"), (F.sum("w") / n).alias("occupancy")]
    for v in values:
        mean = F.sum(F.col("w") * F.col(v)) / F.sum("w")
        second = F.sum(F.col("w") * F.col(v) * F.col(v)) / F.sum("w")
        out += [mean.alias(f"mean__{v}"), F.sqrt(F.greatest(second - mean * mean, F.lit(0.0))).alias(f"volatility__{v}")]
    return each.groupBy("state").agg(*out)
