"""Portfolio decisions: CVaR and Wasserstein-robust CVaR programs, realised arithmetic, and the sequential holdings of strategies."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import solve_lp


@dataclass(frozen=True)
class Decision:
    weights: np.ndarray
    cvar: float
    penalty: float
    cost: float
    turnover: float
    objective: float


def checked_bounds(assets: int, lower, upper, previous, cap) -> tuple[np.ndarray, np.ndarray]:
    lower, upper = np.broadcast_to(np.asarray(lower, float), assets).copy(), np.broadcast_to(np.asarray(upper, float), assets).copy()
    if (lower < 0).any() or (lower > upper).any() or lower.sum() > 1 + 1e-12 or upper.sum() < 1 - 1e-12:
        raise ValueError("bounds must be long-only and allow weights that sum to one")
    if cap is not None and previous is None:
        raise ValueError("a turnover cap needs previous weights")
    return lower, upper


def solve_cvar(returns: np.ndarray, level: float, lower=0.0, upper=1.0, previous: np.ndarray | None = None, cap: float | None = None, cost: float = 0.0, radius: float = 0.0) -> Decision:
    """Weights of least CVaR of losses, plus linear costs of trades and a penalty radius * max |w| / (1 - level).

    Variables: weights above their lower bound, the quantile, excess losses, trades up and down, the largest weight, and slacks.
    Trades and the largest weight are there only where costs, a cap or a radius ask for them.
    """
    returns = np.asarray(returns, float)
    if returns.ndim != 2 or not np.isfinite(returns).all():
        raise ValueError("scenario returns are a finite matrix")
    s, n = returns.shape
    lower, upper = checked_bounds(n, lower, upper, previous, cap)
    trades = previous is not None and (cap is not None or cost > 0)
    names: dict[str, slice] = {}
    total = 0
    for name, size in (("w", n), ("q", 1), ("u", s), ("up", n if trades else 0), ("down", n if trades else 0), ("top", 1 if radius > 0 else 0), ("slack_u", s), ("slack_w", n), ("slack_cap", 1 if cap is not None else 0), ("slack_top", n if radius > 0 else 0)):
        names[name] = slice(total, total + size)
        total += size
    c = np.zeros(total)
    c[names["q"]], c[names["u"]] = 1, 1 / (s * (1 - level))
    if trades:
        c[names["up"]] = c[names["down"]] = cost
    if radius > 0:
        c[names["top"]] = radius / (1 - level)
    rows, right = [], []

    def row(parts: dict[str, np.ndarray], value: np.ndarray) -> None:
        block = np.zeros((len(value), total))
        for name, part in parts.items():
            block[:, names[name]] = part
        rows.append(block)
        right.append(value)

    least = -np.abs(returns).max() - 1e-6  # no loss is below this, so the quantile counts from here
    row({"w": returns, "q": np.ones((s, 1)), "u": np.eye(s), "slack_u": -np.eye(s)}, -returns @ lower - least)  # u >= -r.w - q
    row({"w": np.ones((1, n))}, np.array([1 - lower.sum()]))
    row({"w": np.eye(n), "slack_w": np.eye(n)}, upper - lower)
    if trades:
        row({"w": np.eye(n), "up": -np.eye(n), "down": np.eye(n)}, previous - lower)
    if cap is not None:
        row({"up": np.ones((1, n)), "down": np.ones((1, n)), "slack_cap": np.ones((1, 1))}, np.array([cap]))
    if radius > 0:
        row({"w": -np.eye(n), "top": np.ones((n, 1)), "slack_top": -np.eye(n)}, lower)
    a = np.vstack(rows)
    try:
        x = solve_lp(c, a, np.concatenate(right), normal=_by_scenario(a, s, names))
    except (ValueError, np.linalg.LinAlgError):  # degenerate programs need the full equations
        x = solve_lp(c, a, np.concatenate(right))
    w = np.clip(x[names["w"]] + lower, lower, upper)
    w = w / w.sum()
    return decomposed(returns, w, level, previous, cost, radius)


def _by_scenario(a: np.ndarray, s: int, names: dict[str, slice]):
    """Normal equations with the scenarios' own excess and slack eliminated: what is left has the size of the assets."""
    own = np.zeros(a.shape[1], bool)
    own[names["u"]] = own[names["slack_u"]] = True
    g, h = a[:s, ~own], a[s:, ~own]
    p, m = g.shape[1], len(h)

    def normal(d: np.ndarray):
        single, rest = d[names["u"]] + d[names["slack_u"]], d[~own]
        size = np.sqrt(rest)
        block = np.eye(p) + (size[:, None] * g.T / single) @ (g * size)
        border = h * size
        system = np.block([[block, -border.T], [border, 1e-14 * np.eye(m)]])

        def solve(r: np.ndarray) -> np.ndarray:
            out = np.linalg.solve(system, np.concatenate([size * (g.T @ (r[:s] / single)), r[s:]]))
            return np.concatenate([(r[:s] - g @ (size * out[:p])) / single, out[p:]])

        def refined(r: np.ndarray) -> np.ndarray:
            y = solve(r)
            for _ in range(2):
                y = y + solve(r - a @ (d * (a.T @ y)))
            return y

        return refined

    return normal


def decomposed(returns: np.ndarray, w: np.ndarray, level: float, previous: np.ndarray | None, cost: float, radius: float) -> Decision:
    """The parts of the objective at given weights; CVaR at its own best quantile."""
    losses = np.sort(-returns @ w)
    n = len(losses)
    edges = np.arange(n + 1) / n
    share = np.maximum(edges[1:] - np.maximum(edges[:-1], level), 0)
    cvar = float(share @ losses / (1 - level))
    turnover = float(np.abs(w - previous).sum()) if previous is not None else 0.0
    penalty = float(radius * np.abs(w).max() / (1 - level))
    return Decision(w, cvar, penalty, cost * turnover, turnover, cvar + penalty + cost * turnover)


def objective_parts(scenarios: DataFrame, weights: DataFrame, level: float, radius: float, cost: float, by: list[str]) -> DataFrame:
    """(by..., strategy, eta, cvar, penalty, turnover, cost, objective) of given weights.

    scenarios: (by..., scenario, asset, g); weights: (by..., strategy, asset, weight, previous). CVaR is recomputed at its quantile eta; the penalty is
    radius * max|w| / (1 - level); turnover is the sum of absolute trades, not halved.
    """
    own = [*by, "strategy"]
    loss = scenarios.join(weights, [*by, "asset"]).groupBy(*own, "scenario").agg((-F.sum(F.col("g") * F.col("weight"))).alias("loss"))
    w = Window.partitionBy(*own)
    ranked = loss.withColumn("i", F.row_number().over(w.orderBy("loss", "scenario"))).withColumn("n", F.count("*").over(w))
    eta = ranked.groupBy(*own).agg(F.min(F.when(F.col("i") >= F.ceil(F.col("n") * F.lit(level) - F.lit(1e-12)), F.col("loss"))).alias("eta"))
    tail = loss.join(eta, own).groupBy(*own).agg(F.first("eta").alias("eta"), (F.first("eta") + F.avg(F.greatest(F.col("loss") - F.col("eta"), F.lit(0.0))) / (1 - level)).alias("cvar"))
    held = weights.groupBy(*own).agg((radius * F.max(F.abs("weight")) / (1 - level)).alias("penalty"), F.sum(F.abs(F.col("weight") - F.col("previous"))).alias("turnover"))
    out = tail.join(held, own).withColumn("cost", cost * F.col("turnover"))
    return out.withColumn("objective", F.col("cvar") + F.col("penalty") + F.col("cost"))


def realized(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by..., asset, drifted, gross, turnover, cost, net) of rows (by..., asset, target, previous, g, rate).

    Costs are on absolute trades; the drifted weights are those after the block's returns.
    """
    w = Window.partitionBy(*by)
    out = rows.withColumn("gross", F.sum(F.col("target") * F.col("g")).over(w)).withColumn("turnover", F.sum(F.abs(F.col("target") - F.col("previous"))).over(w))
    out = out.withColumn("cost", F.sum(F.col("rate") * F.abs(F.col("target") - F.col("previous"))).over(w)).withColumn("net", F.col("gross") - F.col("cost"))
    grown = F.col("target") * (1 + F.col("g")) / (1 + F.col("gross"))
    out = out.withColumn("_d", grown)
    return out.withColumn("drifted", F.col("_d") / F.sum("_d").over(w)).select(*by, "asset", "drifted", "gross", "turnover", "cost", "net")


SCHEMA = "strategy string, origin_pos bigint, asset string, previous double, target double, drifted double, gross double, cost double, net double, turnover double, cvar double, penalty double, objective double, error string"


def run_sequence(scenarios: DataFrame, outcomes: DataFrame, strategies: list[dict], level: float, cap: float | None, rate: float, upper: float) -> DataFrame:
    """Holdings of each strategy over the origins in order; a task a strategy, as each origin needs the weights before it.

    scenarios: (origin_pos, source, scenario, asset, g); outcomes: (origin_pos, asset, g). Strategies: name, kind (equal_weight, cvar, robust),
    source, radius. A strategy that fails is off from there on.
    """
    seen = scenarios.groupBy("origin_pos", "source").agg(F.array_sort(F.collect_list(F.struct("scenario", "asset", "g"))).alias("s"))
    came = outcomes.groupBy("origin_pos").agg(F.array_sort(F.collect_list(F.struct("asset", "g"))).alias("y"))
    names = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(x.get("source")).cast("string").alias("want")) for i, x in enumerate(strategies)])).alias("x")
    rows = came.select("origin_pos", "y", names).select("origin_pos", "y", "x.*")
    rows = rows.join(seen, (rows["origin_pos"] == seen["origin_pos"]) & (F.col("want") == F.col("source")), "left").select(rows["origin_pos"], "i", "y", "s")

    def one(key: tuple, table: pd.DataFrame) -> pd.DataFrame:
        spec, held, out = strategies[int(key[0])], None, []
        for _, r in table.sort_values("origin_pos").iterrows():
            assets, y = [a["asset"] for a in r["y"]], np.array([a["g"] for a in r["y"]])
            before = held if held is not None else np.full(len(assets), 1 / len(assets))
            try:
                if spec["kind"] == "equal_weight":
                    w = np.full(len(assets), 1 / len(assets))
                    if cap is not None and np.abs(w - before).sum() > cap + 1e-12:
                        raise ValueError("rebalancing exceeds the turnover cap")
                    plan = Decision(w, float("nan"), 0.0, 0.0, float(np.abs(w - before).sum()), float("nan"))
                else:
                    g = np.array([x["g"] for x in r["s"]]).reshape(-1, len(assets))
                    plan = solve_cvar(g, level, 0.0, upper, before, cap, rate, spec.get("radius", 0.0))
            except (ValueError, TypeError, np.linalg.LinAlgError) as failure:
                out.append((spec["name"], r["origin_pos"], None, *[None] * 10, f"{type(failure).__name__}: {failure}"))
                break
            gross = float(plan.weights @ y)
            charge = rate * float(np.abs(plan.weights - before).sum())
            held = plan.weights * (1 + y)
            held = held / held.sum()
            out += [(spec["name"], r["origin_pos"], a, b, t, d, gross, charge, gross - charge, plan.turnover, plan.cvar, plan.penalty, plan.objective, None) for a, b, t, d in zip(assets, before, plan.weights, held, strict=True)]
        return pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return rows.groupBy("i").applyInPandas(one, SCHEMA)


def summarize(detail: DataFrame, q: float = 0.95) -> DataFrame:
    """One row a strategy of rows (strategy, origin_pos, gross, cost, net, turnover): returns, risk, drawdown, costs and the worst block."""
    from .risk import risk_summary

    w = Window.partitionBy("strategy").orderBy("origin_pos").rowsBetween(Window.unboundedPreceding, 0)
    wealth = detail.withColumn("wealth", F.exp(F.sum(F.log1p("net")).over(w)))
    wealth = wealth.withColumn("fall", 1 - F.col("wealth") / F.greatest(F.lit(1.0), F.max("wealth").over(w)))
    out = wealth.groupBy("strategy").agg(F.count("*").alias("blocks"), F.expm1(F.sum(F.log1p("net"))).alias("cumulative_net_return"), F.expm1(F.sum(F.log1p("gross"))).alias("cumulative_gross_return"),
        F.avg("net").alias("mean_net_return"), F.stddev_samp("net").alias("net_volatility"), F.max("fall").alias("max_drawdown"), F.avg("turnover").alias("mean_turnover"), F.sum("turnover").alias("total_turnover"),
        F.sum("cost").alias("total_cost"), F.min("net").alias("worst_net_return"), F.min_by("origin_pos", F.struct("net", "origin_pos")).alias("worst_block"))
    risk = risk_summary(detail.select("strategy", (-F.col("net")).alias("loss")), q, ["strategy"]).select("strategy", "value_at_risk", "expected_shortfall")
    return out.join(risk, "strategy").orderBy("strategy")
