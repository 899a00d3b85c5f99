"""One-shot diffusion of whole future windows: schedule and noising in the engine, a small denoiser in numpy.

The denoiser sees a noised window, the diffusion time, a recurrent summary of the past and the state belief: a gated recurrent encoder, then
dilated convolution blocks with group norms whose scale and shift the condition sets. Gradients are by hand (reverse mode over a
short tape), so training needs numpy alone; it runs on the driver on windows that a fit holds, and sampling on batches of scenarios.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def schedule(spark: SparkSession, steps: int, first: float = 1e-4, last: float = 0.02) -> DataFrame:
    """(t, beta, alpha, alpha_bar, posterior_variance) of a linear schedule."""
    beta = F.lit(first) + (F.lit(last) - F.lit(first)) * F.col("t") / max(steps - 1, 1)
    rows = spark.range(steps).select(F.col("id").cast("int").alias("t")).withColumn("beta", beta).withColumn("alpha", 1 - F.col("beta"))
    w = Window.orderBy("t").rowsBetween(Window.unboundedPreceding, 0)  # as many rows as diffusion steps
    rows = rows.withColumn("alpha_bar", F.exp(F.sum(F.log("alpha")).over(w)))
    before = F.coalesce(F.lag("alpha_bar").over(Window.orderBy("t")), F.lit(1.0))
    return rows.withColumn("posterior_variance", F.greatest(F.col("beta") * (1 - before) / (1 - F.col("alpha_bar")), F.lit(1e-20)))


def q_sample(cells: DataFrame, times: DataFrame) -> DataFrame:
    """``cells`` (t, x, noise, ...) with ``noised`` = sqrt(alpha_bar) x + sqrt(1 - alpha_bar) noise."""
    out = cells.join(F.broadcast(times.select("t", "alpha_bar")), "t")
    return out.withColumn("noised", F.sqrt("alpha_bar") * F.col("x") + F.sqrt(1 - F.col("alpha_bar")) * F.col("noise")).drop("alpha_bar")


def weighted_loss(cells: DataFrame, weights: DataFrame) -> DataFrame:
    """One row: mean squared error a sample (w, predicted, noise), weighted with weights of mean one."""
    each = cells.groupBy("w").agg(F.avg(F.pow(F.col("predicted") - F.col("noise"), F.lit(2))).alias("mse"))
    joined = each.join(weights.select("w", "weight"), "w")
    return joined.agg((F.sum(F.col("weight") * F.col("mse")) / F.sum("weight")).alias("loss"))


def clipped(frame: DataFrame, value: str, bound: float) -> DataFrame:
    """``frame`` with values held within the bound, and the share of rows that were beyond as ``clip_fraction``."""
    share = frame.agg(F.avg((F.abs(value) > bound).cast("double")).alias("clip_fraction"))
    return frame.withColumn(value, F.greatest(F.least(F.col(value), F.lit(bound)), F.lit(-bound))).crossJoin(F.broadcast(share))  # one row


# --- a tape of array operations ----------------------------------------------------------------------------------------


class Node:
    """An array with the operation that made it."""

    def __init__(self, value: np.ndarray, parents=(), pull=None) -> None:
        self.value, self.parents, self.pull, self.grad = value, parents, pull, None

    def __add__(self, other):
        other = wrap(other)
        return Node(self.value + other.value, (self, other), lambda g: (fold(g, self.value.shape), fold(g, other.value.shape)))

    def __mul__(self, other):
        other = wrap(other)
        return Node(self.value * other.value, (self, other), lambda g: (fold(g * other.value, self.value.shape), fold(g * self.value, other.value.shape)))

    def __sub__(self, other):
        return self + wrap(other) * -1.0

    def __matmul__(self, other):
        a, b = self.value, other.value
        return Node(a @ b, (self, other), lambda g: (g @ np.swapaxes(b, -1, -2), fold(np.swapaxes(a, -1, -2) @ g, b.shape)))

    def apply(self, f, df):
        return Node(f(self.value), (self,), lambda g: (g * df(self.value),))

    def backward(self) -> None:
        order, seen, todo = [], set(), [(self, False)]
        while todo:
            node, done = todo.pop()
            if done:
                order.append(node)
            elif id(node) not in seen:
                seen.add(id(node))
                todo.append((node, True))
                todo += [(p, False) for p in node.parents]
        self.grad = np.ones_like(self.value)
        for node in reversed(order):
            if node.pull is None or node.grad is None:
                continue
            for parent, g in zip(node.parents, node.pull(node.grad), strict=True):
                parent.grad = g if parent.grad is None else parent.grad + g


def wrap(x) -> Node:
    return x if isinstance(x, Node) else Node(np.asarray(x, float))


def fold(g: np.ndarray, shape: tuple) -> np.ndarray:
    """A gradient summed over axes that broadcasting added."""
    while g.ndim > len(shape):
        g = g.sum(0)
    for axis, n in enumerate(shape):
        if n == 1 and g.shape[axis] != 1:
            g = g.sum(axis, keepdims=True)
    return g


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def sigmoid(x: Node) -> Node:
    return x.apply(_sigmoid, lambda v: _sigmoid(v) * (1 - _sigmoid(v)))


def tanh(x: Node) -> Node:
    return x.apply(np.tanh, lambda v: 1 - np.tanh(v) ** 2)


def silu(x: Node) -> Node:
    return x.apply(lambda v: v * _sigmoid(v), lambda v: _sigmoid(v) * (1 + v * (1 - _sigmoid(v))))


def convolve(x: Node, kernel: Node, dilation: int) -> Node:
    """(batch, time, in) with (width, in, out), same length, zeros beyond the ends."""
    width, half = len(kernel.value), len(kernel.value) // 2
    n = x.value.shape[1]
    pad = half * dilation
    padded = np.pad(x.value, ((0, 0), (pad, pad), (0, 0)))
    parts = [padded[:, k * dilation : k * dilation + n] for k in range(width)]

    def pull(g):
        gx = np.zeros_like(padded)
        gk = np.empty_like(kernel.value)
        for k in range(width):
            gx[:, k * dilation : k * dilation + n] += g @ kernel.value[k].T
            gk[k] = np.einsum("bti,bto->io", parts[k], g)
        return gx[:, pad : pad + n] if pad else gx, gk

    return Node(sum(p @ kernel.value[k] for k, p in enumerate(parts)), (x, kernel), pull)


def group_norm(x: Node, groups: int) -> Node:
    """Each group of channels over all times of a sample, to mean zero and variance one."""
    b, n, c = x.value.shape
    v = x.value.reshape(b, n, groups, c // groups)
    mean, var = v.mean((1, 3), keepdims=True), v.var((1, 3), keepdims=True)
    inv = 1 / np.sqrt(var + 1e-5)
    z = (v - mean) * inv

    def pull(g):
        g = g.reshape(v.shape)
        out = inv * (g - g.mean((1, 3), keepdims=True) - z * (g * z).mean((1, 3), keepdims=True))
        return (out.reshape(x.value.shape),)

    return Node(z.reshape(x.value.shape), (x,), pull)


def part(x: Node, low: int, high: int) -> Node:
    def pull(g):
        out = np.zeros_like(x.value)
        out[..., low:high] = g
        return (out,)

    return Node(x.value[..., low:high], (x,), pull)


def over_time(x: Node) -> Node:
    return Node(x.value[:, None, :], (x,), lambda g: (g[:, 0, :],))


def time_features(t: np.ndarray, width: int) -> np.ndarray:
    half = width // 2
    rate = np.exp(-np.log(1e4) * np.arange(half) / max(half - 1, 1))
    return np.concatenate([np.sin(t[:, None] * rate), np.cos(t[:, None] * rate)], 1)


@dataclass
class Denoiser:
    """Noise of a window (batch, horizon, factors) from its noised form, time, past (batch, length, features) and belief."""

    factors: int
    features: int
    states: int
    channels: int = 32
    blocks: int = 2
    groups: int = 4
    seed: int = 0

    def __post_init__(self) -> None:
        rng = np.random.default_rng(self.seed)
        c = self.channels
        self.weights: dict[str, np.ndarray] = {}

        def dense(name: str, rows: int, columns: int, gain: float = 1.0) -> None:
            self.weights[name] = rng.normal(0, gain / np.sqrt(rows), (rows, columns))
            self.weights[name + "_b"] = np.zeros(columns)

        dense("gru_x", self.features, 3 * c)
        dense("gru_h", c, 3 * c)
        dense("time", c, c)
        dense("past", c, c)
        dense("belief", self.states, c)
        dense("into", self.factors, c)
        dense("out", c, self.factors, 0.1)
        for k in range(self.blocks):
            self.weights[f"conv{k}a"] = rng.normal(0, 1 / np.sqrt(3 * c), (3, c, c))
            self.weights[f"conv{k}b"] = rng.normal(0, 1 / np.sqrt(3 * c), (3, c, c))
            dense(f"film{k}", c, 2 * c, 0.1)

    def forward(self, w: dict[str, Node], noised: np.ndarray, t: np.ndarray, past: np.ndarray, belief: np.ndarray) -> Node:
        c = self.channels
        line = lambda x, n: x @ w[n] + w[n + "_b"]
        h = Node(np.zeros((len(past), c)))
        for k in range(past.shape[1]):
            a, b = line(wrap(past[:, k]), "gru_x"), line(h, "gru_h")
            r, z = sigmoid(part(a, 0, c) + part(b, 0, c)), sigmoid(part(a, c, 2 * c) + part(b, c, 2 * c))
            n = tanh(part(a, 2 * c, 3 * c) + r * part(b, 2 * c, 3 * c))
            h = n + z * (h - n)
        belief = belief / np.maximum(belief.sum(1, keepdims=True), 1e-12)
        condition = silu(line(wrap(time_features(t.astype(float), c)), "time")) + line(h, "past") + line(wrap(belief), "belief")
        x = line(wrap(noised), "into")
        for k in range(self.blocks):
            y = convolve(silu(group_norm(x, self.groups)), w[f"conv{k}a"], 2 ** (k % 4))
            film = line(condition, f"film{k}")
            y = group_norm(y, self.groups) * over_time(part(film, 0, c) + 1.0) + over_time(part(film, c, 2 * c))
            y = convolve(silu(y), w[f"conv{k}b"], 1)
            x = (x + y) * (1 / np.sqrt(2))
        return line(silu(x), "out")

    def predict(self, *inputs: np.ndarray) -> np.ndarray:
        return self.forward({k: Node(v) for k, v in self.weights.items()}, *inputs).value

    def loss(self, noise: np.ndarray, weight: np.ndarray, *inputs: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Weighted mean of each sample's mean squared error, and its gradient."""
        w = {k: Node(v) for k, v in self.weights.items()}
        error = self.forward(w, *inputs) - noise
        scale = (weight / weight.sum())[:, None, None] / noise[0].size
        total = error * error * scale
        out = Node(total.value.sum(), (total,), lambda g: (np.full_like(total.value, g),))
        out.backward()
        return float(out.value), {k: n.grad if n.grad is not None else np.zeros_like(n.value) for k, n in w.items()}


def alphas(steps: int, first: float = 1e-4, last: float = 0.02) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    beta = np.linspace(first, last, steps)
    return beta, 1 - beta, np.cumprod(1 - beta)


def train(model: Denoiser, past: np.ndarray, future: np.ndarray, belief: np.ndarray, weight: np.ndarray, steps: int, epochs: int, seed: int, tuning: tuple | None = None, batch: int = 64, rate: float = 1e-3, decay: float = 1e-4, clip: float = 1.0) -> pd.DataFrame:
    """AdamW with clipped gradients; the weights of the epoch with the least tuning loss (same noise each time) are kept."""
    rng = np.random.default_rng(seed)
    bar = alphas(steps)[2]
    m = {k: np.zeros_like(v) for k, v in model.weights.items()}
    v2 = {k: np.zeros_like(v) for k, v in model.weights.items()}
    best, kept, history, count = np.inf, None, [], 0
    for epoch in range(epochs):
        order, total = rng.permutation(len(past)), 0.0
        for i in range(0, len(order), batch):
            k = order[i : i + batch]
            t, noise = rng.integers(steps, size=len(k)), rng.standard_normal(future[k].shape)
            a = bar[t][:, None, None]
            loss, grads = model.loss(noise, weight[k], np.sqrt(a) * future[k] + np.sqrt(1 - a) * noise, t, past[k], belief[k])
            total += loss * len(k)
            norm = np.sqrt(sum((g**2).sum() for g in grads.values()))
            count += 1
            for name, g in grads.items():
                g = g * min(1.0, clip / max(norm, 1e-12))
                m[name] = 0.9 * m[name] + 0.1 * g
                v2[name] = 0.999 * v2[name] + 0.001 * g * g
                step = (m[name] / (1 - 0.9**count)) / (np.sqrt(v2[name] / (1 - 0.999**count)) + 1e-8)
                model.weights[name] = model.weights[name] * (1 - rate * decay) - rate * step
        check = tuning_loss(model, *tuning, steps=steps, seed=seed + 1) if tuning else total / len(past)
        chosen = check < best
        if chosen:
            best, kept = check, {k: x.copy() for k, x in model.weights.items()}
        history.append((epoch, total / len(past), check, chosen))
    model.weights = kept or model.weights
    return pd.DataFrame(history, columns=["epoch", "training_loss", "validation_denoising_loss", "selected_checkpoint"])


def tuning_loss(model: Denoiser, past, future, belief, steps: int, seed: int) -> float:
    rng = np.random.default_rng(seed)
    t, noise = rng.integers(steps, size=len(past)), rng.standard_normal(future.shape)
    a = alphas(steps)[2][t][:, None, None]
    return float(((model.predict(np.sqrt(a) * future + np.sqrt(1 - a) * noise, t, past, belief) - noise) ** 2).mean())


def sample(model: Denoiser, past: np.ndarray, belief: np.ndarray, horizon: int, steps: int, rng: np.random.Generator) -> np.ndarray:
    """(batch, horizon, factors): the reverse chain over diffusion time, all of the horizon at once."""
    beta, alpha, bar = alphas(steps)
    x = rng.standard_normal((len(past), horizon, model.factors))
    for t in range(steps - 1, -1, -1):
        noise = model.predict(x, np.full(len(past), t), past, belief)
        x = (x - beta[t] / np.sqrt(1 - bar[t]) * noise) / np.sqrt(alpha[t])
        if t:
            x = x + np.sqrt(max(beta[t] * (1 - bar[t - 1]) / (1 - bar[t]), 1e-20)) * rng.standard_normal(x.shape)
    return x


def sample_scenarios(spark: SparkSession, model: Denoiser, past: np.ndarray, belief: np.ndarray, scenarios: int, horizon: int, steps: int, seed: int, batch: int = 64) -> DataFrame:
    """(scenario, step, factor, value): batches of scenarios spread over tasks, each with its own random key."""

    def run(batches):
        for frame in batches:
            for k in frame["id"]:
                n = min(batch, scenarios - int(k) * batch)
                rng = np.random.Generator(np.random.Philox(key=[seed, int(k)]))
                x = sample(model, np.repeat(past[None], n, 0), np.repeat(belief[None], n, 0), horizon, steps, rng)
                s, h, f = np.meshgrid(np.arange(n) + int(k) * batch, np.arange(horizon), np.arange(model.factors), indexing="ij")
                yield pd.DataFrame({"scenario": s.ravel(), "step": h.ravel(), "factor": f.ravel(), "value": x.ravel()})

    tasks = -(-scenarios // batch)
    return spark.range(0, tasks, 1, tasks).mapInPandas(run, "scenario bigint, step bigint, factor bigint, value double")
