"""Structural simulator of a small market with regimes, interventions, abduction and causal effects.

A path is one row: arrays of innovations and regime uniforms by step. Regimes and equations are ordered aggregates over the steps, so paths
are independent rows and any number of them spreads over tasks.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rng import normal, uniform
from ..functions.scalars import checked, inverse_softplus, softplus

VARIABLES = ("policy", "yield", "credit", "liquidity", "equity", "volatility")
MEDIATORS = ("yield", "credit", "liquidity", "volatility")
#: The registered parameters.
TRANSITIONS = ((0.965, 0.020, 0.015), (0.055, 0.925, 0.020), (0.045, 0.020, 0.935))
START = (0.80, 0.10, 0.10)
SCALES = {"policy": 0.04, "yield": 0.04, "credit": 0.05, "liquidity": 0.05, "equity": 0.08, "volatility": 0.06}
INITIAL = {"policy": 0.0, "yield": 0.0, "credit": 0.0, "liquidity": 0.0, "equity": 0.0, "volatility": 0.20}
INTERCEPTS = {
    "policy": (0.0, -0.10, 0.25),
    "yield": (0.0, -0.04, 0.20),
    "liquidity": (0.0, 0.28, 0.10),
    "credit": (0.0, 0.38, 0.14),
    "equity": (0.0, -0.22, -0.12),
    "volatility": (-1.55, -1.00, -1.25),
}
#: By equation: (variable, at the step before, coefficient).
EQUATIONS = {
    "policy": (("policy", True, 0.72), ("equity", True, 0.18)),
    "yield": (("yield", True, 0.68), ("policy", False, 0.62)),
    "liquidity": (("liquidity", True, 0.58), ("yield", False, 0.28)),
    "credit": (("credit", True, 0.64), ("yield", False, 0.22), ("liquidity", False, 0.44)),
    "equity": (("equity", True, 0.22), ("credit", False, -0.42), ("liquidity", False, -0.32), ("volatility", True, -0.14)),
    "volatility": (("volatility", True, 0.60), ("equity", False, -0.38), ("credit", False, 0.22), ("liquidity", False, 0.18)),
}


@dataclass(frozen=True)
class Structure:
    """Equations in their causal order, regimes and scales; checked on creation."""

    equations: dict = field(default_factory=lambda: dict(EQUATIONS))
    intercepts: dict = field(default_factory=lambda: dict(INTERCEPTS))
    transitions: tuple = TRANSITIONS
    start: tuple = START
    scales: dict = field(default_factory=lambda: dict(SCALES))
    initial: dict = field(default_factory=lambda: dict(INITIAL))

    def __post_init__(self) -> None:
        for row in (*self.transitions, self.start):
            if min(row) < 0 or abs(sum(row) - 1) > 1e-9:
                raise ValueError("probabilities must sum to one")
        if min(self.scales.values()) < 0 or self.initial["volatility"] <= 0:
            raise ValueError("scales and volatility must be positive")
        if set(self.equations) != set(VARIABLES):
            raise ValueError("every variable needs an equation")

    def scaled(self, variables: tuple[str, ...], factor: float) -> Structure:
        """Transmission between different variables of some equations, times a factor."""
        out = {v: tuple((n, b, c * factor if v in variables and n != v else c) for n, b, c in terms) for v, terms in self.equations.items()}
        return replace(self, equations=out)

    def without(self, variable: str, cause: str) -> Structure:
        out = dict(self.equations)
        out[variable] = tuple(t for t in out[variable] if t[0] != cause)
        return replace(self, equations=out)


@dataclass(frozen=True)
class Intervention:
    """Values by step for the policy, and for mediators that are held."""

    policy: dict[int, float] = field(default_factory=dict)
    mediators: dict[str, dict[int, float]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if set(self.mediators) - set(MEDIATORS):
            raise ValueError("only yield, credit, liquidity and volatility can be held")
        if any(t < 0 for s in (self.policy, *self.mediators.values()) for t in s):
            raise ValueError("steps count from 0")

    @property
    def kind(self) -> str:
        return "controlled" if self.mediators else "total"

    def schedule(self, variable: str) -> dict[int, float]:
        return self.policy if variable == "policy" else self.mediators.get(variable, {})


def exogenous(spark: SparkSession, paths: int, horizon: int, structure: Structure, seed: int) -> DataFrame:
    """(path, e, u, z0): innovations by step and variable, uniforms for regimes, and the initial regime."""
    steps = F.sequence(F.lit(0), F.lit(horizon - 1))
    draw = lambda t: F.struct(*[(normal(seed, F.col("path"), t, F.lit(v)) * structure.scales[v]).alias(v) for v in VARIABLES])
    rows = spark.range(paths).withColumnRenamed("id", "path")
    first = _cut(uniform(seed, F.col("path"), F.lit("start")), structure.start)
    return rows.select("path", F.transform(steps, draw).alias("e"), F.transform(steps, lambda t: uniform(seed, F.col("path"), t, F.lit("regime"))).alias("u"), first.alias("z0"))


def _cut(u: Column, row) -> Column:
    """The number of cumulative probabilities below u, at most the last state."""
    total, out = 0.0, F.lit(0)
    for p in row[:-1]:
        total += p
        out = out + F.when(u > F.lit(total), 1).otherwise(0)
    return out


def regimes(paths: DataFrame, structure: Structure) -> DataFrame:
    """``paths`` with ``z``: states from the first transition on."""

    def move(s, u):
        now = F.lit(None).cast("int")
        for k, row in enumerate(structure.transitions):
            now = F.when(s["z"] == k, _cut(u, row)).otherwise(now)
        return F.struct(now.cast("int").alias("z"), F.concat(s["out"], F.array(now.cast("int"))).alias("out"))

    begin = F.struct(F.col("z0").cast("int").alias("z"), F.array().cast("array<int>").alias("out"))
    return paths.withColumn("z", F.aggregate("u", begin, move, lambda s: s["out"]))


def _scheduled(schedule: dict[int, float], t: Column, value: Column) -> Column:
    out = value
    for step, fixed in schedule.items():
        out = F.when(t == step, F.lit(float(fixed))).otherwise(out)
    return out


def simulate(paths: DataFrame, structure: Structure, intervention: Intervention | None = None) -> DataFrame:
    """(path, x): an array by step of the six variables. Interventions override a variable after its equation."""
    do = intervention or Intervention()
    held = F.array(*[F.struct(*[F.lit(None if (v := do.schedule(n).get(t)) is None else float(v)).cast("double").alias(n) for n in VARIABLES]) for t in range(1 + max([-1, *(t for n in VARIABLES for t in do.schedule(n))]))]) if any(do.schedule(n) for n in VARIABLES) else None
    steps = F.transform(F.arrays_zip("e", "z"), lambda r, t: F.struct(r["e"].alias("e"), r["z"].alias("z"), *([F.get(held, t).alias("d")] if held is not None else [])))

    def advance(s, r):
        def chain(done: dict[str, Column], left: list[str]) -> Column:
            if not left:
                now = F.struct(*[done[n].alias(n) for n in VARIABLES])
                return F.struct(now.alias("last"), F.concat(s["out"], F.array(now)).alias("out"))
            name = left[0]
            total = r["e"][name]
            for cause, before, c in structure.equations[name]:
                total = total + c * (s["last"][cause] if before else done[cause])
            for k, value in enumerate(structure.intercepts[name]):
                total = total + F.when(r["z"] == k, F.lit(value)).otherwise(0.0)
            value = softplus(total) if name == "volatility" else total
            if held is not None and name != "equity":
                value = F.coalesce(r["d"][name], value)
            return F.transform(F.array(value), lambda v: chain(done | {name: v}, left[1:]))[0]  # each value once

        return chain({}, list(structure.equations))

    begin_last = F.struct(*[F.lit(structure.initial[n]).alias(n) for n in VARIABLES])
    kind = f"array<struct<{','.join(f'{n}:double' for n in VARIABLES)}>>"
    begin = F.struct(begin_last.alias("last"), F.array().cast(kind).alias("out"))
    return paths.select("path", F.aggregate(steps, begin, advance, lambda s: s["out"]).alias("x"))


def abduct(observed: DataFrame, structure: Structure) -> DataFrame:
    """(path, e): the innovations that the equations need for observed variables ``x`` and states ``z``."""

    def step(x: Column, t: Column) -> Column:
        last = F.when(t == 0, F.struct(*[F.lit(structure.initial[n]).alias(n) for n in VARIABLES])).otherwise(F.get(F.col("x"), t - 1))
        out = []
        for name, terms in structure.equations.items():
            total = F.lit(0.0)
            for cause, before, c in terms:
                total = total + c * (last[cause] if before else x[cause])
            for k, value in enumerate(structure.intercepts[name]):
                total = total + F.when(F.get(F.col("z"), t) == k, F.lit(value)).otherwise(0.0)
            out.append(((inverse_softplus(x[name]) if name == "volatility" else x[name]) - total).alias(name))
        return F.struct(*out)

    inner = F.transform("x", step)
    return observed.select("path", F.transform(inner, lambda e: F.struct(*[e[n].alias(n) for n in VARIABLES])).alias("e"))


def long_paths(simulated: DataFrame) -> DataFrame:
    """(path, t, the six variables)."""
    return simulated.select("path", F.posexplode("x").alias("t", "v")).select("path", "t", "v.*")


def _shortfall(values: DataFrame, column: str, q: float) -> DataFrame:
    from .risk import expected_shortfall

    return expected_shortfall(values.withColumn("_g", F.lit(1)), q, ["_g"], column)


def paired(factual: DataFrame, counterfactual: DataFrame, regimes_of: tuple[DataFrame, DataFrame], models: tuple[Structure, Structure]) -> DataFrame:
    """(path, t, variable, f, c) of two long simulations that share regimes and initial state.

    regimes_of: (path, z) of each. Other initial values are an error at once; a path whose regimes differ, or that only one has, is an error in its row.
    """
    if models[0].initial != models[1].initial:
        raise ValueError("the simulations begin in different states")
    a, b = regimes_of
    same = a.select("path", F.col("z").alias("za")).join(b.select("path", F.col("z").alias("zb")), "path", "full")
    fine = same.withColumn("ok", checked(F.col("za") == F.col("zb"), F.lit(1.0), "the simulations must share their regimes")).select("path", "ok")
    long = lambda df, x: df.unpivot(["path", "t"], list(VARIABLES), "variable", x)
    both = long(factual, "f").join(long(counterfactual, "c"), ["path", "t", "variable"], "full")
    both = both.withColumn("f", checked(F.col("f").isNotNull() & F.col("c").isNotNull(), F.col("f"), "paths must match one to one"))
    return both.join(fine, "path").filter("ok = 1").select("path", "t", "variable", "f", "c")


def effect(factual: DataFrame, counterfactual: DataFrame, outcome: str, q: float = 0.95, loss_sign: float = -1.0) -> tuple[DataFrame, DataFrame]:
    """(t, mean_effect), and one row (ate_terminal, cumulative_ate, tail_effect) of paired paths in long form.

    The tail effect is the change of the expected shortfall of the signed sums along a path.
    """
    a = factual.select("path", "t", F.col(outcome).alias("f"))
    both = counterfactual.select("path", "t", F.col(outcome).alias("c")).join(a, ["path", "t"])
    path = both.groupBy("t").agg(F.avg(F.col("c") - F.col("f")).alias("mean_effect"))
    totals = both.groupBy("path").agg((loss_sign * F.sum("f")).alias("f"), (loss_sign * F.sum("c")).alias("c"))
    tail = _shortfall(totals, "c", q).select(F.col("expected_shortfall").alias("ec")).crossJoin(_shortfall(totals, "f", q).select(F.col("expected_shortfall").alias("ef")))  # one row each
    ends = path.agg(F.max_by("mean_effect", "t").alias("ate_terminal"), F.sum("mean_effect").alias("cumulative_ate"))
    return path, ends.crossJoin(tail).select("ate_terminal", "cumulative_ate", (F.col("ec") - F.col("ef")).alias("tail_effect"))


def effects(paths: DataFrame, outcomes: tuple[str, ...], q: float = 0.95) -> DataFrame:
    """(model_id, effect_type, outcome, ate_terminal, cumulative_ate, tail_effect) of long paths with model_id, effect_type and arm.

    Arms are ``factual`` and ``counterfactual``; all models, types and outcomes go through one aggregate. Losses are falls, and rises of volatility.
    """
    from .risk import expected_shortfall

    by = ["model_id", "effect_type", "outcome"]
    cells = paths.unpivot([*by[:2], "arm", "path", "t"], list(outcomes), "outcome", "x")
    mean = cells.groupBy(*by, "t").agg(F.avg(F.when(F.col("arm") == "counterfactual", F.col("x"))).alias("c"), F.avg(F.when(F.col("arm") == "factual", F.col("x"))).alias("f"))
    ends = mean.groupBy(*by).agg(F.max_by(F.col("c") - F.col("f"), "t").alias("ate_terminal"), F.sum(F.col("c") - F.col("f")).alias("cumulative_ate"))
    sign = F.when(F.col("outcome") == "volatility", 1.0).otherwise(-1.0)
    totals = cells.groupBy(*by, "arm", "path").agg(F.sum("x").alias("s")).withColumn("loss", sign * F.col("s"))
    tails = expected_shortfall(totals, q, [*by, "arm"]).groupBy(*by).pivot("arm", ["factual", "counterfactual"]).agg(F.first("expected_shortfall"))
    return ends.join(tails, by).select(*by, "ate_terminal", "cumulative_ate", (F.col("counterfactual") - F.col("factual")).alias("tail_effect"))


def effect_error(truth: tuple[DataFrame, DataFrame], model: tuple[DataFrame, DataFrame]) -> DataFrame:
    """One row: absolute error of the terminal effect, RMSE of the mean paths, absolute error of the tail effect."""
    t, m = truth[0].withColumnRenamed("mean_effect", "a"), model[0].withColumnRenamed("mean_effect", "b")
    rmse = t.join(m, "t").agg(F.sqrt(F.avg(F.pow(F.col("a") - F.col("b"), F.lit(2)))).alias("path_rmse"))
    a, b = truth[1].select(F.col("ate_terminal").alias("x"), F.col("tail_effect").alias("y")), model[1].select(F.col("ate_terminal").alias("p"), F.col("tail_effect").alias("q"))
    return rmse.crossJoin(a).crossJoin(b).select(F.abs(F.col("x") - F.col("p")).alias("ate_error"), "path_rmse", F.abs(F.col("y") - F.col("q")).alias("tail_error"))


def registered(steps: int = 5, mediator_steps: int = 20, dose: float = 0.5) -> dict[str, Intervention]:
    """The treated, reference and controlled interventions."""
    on, off = {t: dose for t in range(steps)}, {t: 0.0 for t in range(steps)}
    held = {v: {t: 0.0 for t in range(mediator_steps)} for v in ("yield", "liquidity", "credit")}
    return {"treated": Intervention(on), "reference": Intervention(off), "controlled_treated": Intervention(on, held), "controlled_reference": Intervention(off, held)}


def misspecified(structure: Structure) -> dict[str, Structure]:
    """Half the transmission; no feedback of equity on policy."""
    return {"half_transmission": structure.scaled(("yield", "liquidity", "credit", "equity"), 0.5), "no_feedback": structure.without("policy", "equity")}
