"""Registered evaluations: panel build, rolling baselines, comparison, decisions and counterfactuals, as plans over operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import comparison, counterfactual, features, generators, panel, portfolio, quality, risk, windows
from ..sources.snapshots import sealed


def align_contexts(calendar: DataFrame, contexts: DataFrame, specs: list[dict]) -> DataFrame:
    """(feature, date, value, source_date, available_date, stale): context rows (feature, date, value) as known on each date of the calendar.

    specs: {"name", "transform", "lag_sessions", "stale_days"}; features of one lag and limit go through one as-of alignment.
    """
    out = None
    for lag, stale in sorted({(s["lag_sessions"], s["stale_days"]) for s in specs}):
        same = [s for s in specs if (s["lag_sessions"], s["stale_days"]) == (lag, stale)]
        native = None
        for kind in sorted({s.get("transform", "level") for s in same}):
            names = [s["name"] for s in same if s.get("transform", "level") == kind]
            rows = contexts.filter(F.col("feature").isin(names)).withColumnRenamed("feature", "series")
            one = panel.macro_transform(rows, kind).withColumnRenamed("series", "feature").select("feature", "date", "value")
            native = one if native is None else native.unionByName(one)
        one = panel.asof_align(calendar, native, lag, stale, by=("feature",))
        out = one if out is None else out.unionByName(one)
    return out


def spreads(aligned: DataFrame, specs: list[dict]) -> DataFrame:
    """Aligned rows of derived features, left less right ({"name", "left", "right"}): null where one is; known when both are."""
    out = None
    for s in specs:
        a = aligned.filter(F.col("feature") == s["left"]).select("date", F.col("value").alias("l"), F.col("source_date").alias("ls"), F.col("available_date").alias("la"), F.col("stale").alias("lt"))
        b = aligned.filter(F.col("feature") == s["right"]).select("date", F.col("value").alias("r"), F.col("source_date").alias("rs"), F.col("available_date").alias("ra"), F.col("stale").alias("rt"))
        one = a.join(b, "date").select(F.lit(s["name"]).alias("feature"), "date", (F.col("l") - F.col("r")).alias("value"), F.greatest("ls", "rs").alias("source_date"), F.greatest("la", "ra").alias("available_date"), (F.col("lt") | F.col("rt")).alias("stale"))
        out = one if out is None else out.unionByName(one)
    return out


def build_panel(returns: DataFrame, aligned: DataFrame, series: list[str], contexts: list[str], specs: list[dict]) -> DataFrame:
    """The model matrix: complete rows of targets, aligned context columns and derived features.

    returns: (date, series, r); aligned: (feature, date, value). Features are of the same day as the returns.
    """
    wide = panel.wide(returns, series)
    macro = panel.wide(aligned.filter(F.col("feature").isin(contexts)).withColumnRenamed("feature", "series"), contexts, "value", "macro__")
    made = features.derive(returns.filter("r is not null"), specs)
    names = [s["name"] for s in specs]
    made = made.select("date", *[F.col(n).alias(f"macro__{n}") for n in names])
    joined = wide.join(macro, "date", "left").join(made, "date", "left")
    return panel.complete_cases(joined, [f"asset__{s}" for s in series], [f"macro__{n}" for n in (*contexts, *names)])


def rolling_baselines(rows: DataFrame, origins: DataFrame, specs: list[dict], lookback: int, scenarios: int, horizon: int, seed: int, q: float, fraction: float, train_end: str, crash_q: float = 0.05) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Forecast detail, leaderboard and failures of all models at all origins.

    rows: (pos, date, asset, r). Weights are equal; co-crash thresholds come from training outcomes.
    """
    raw = generators.run(rows, origins, specs, lookback, scenarios, horizon, seed)
    failures = raw.filter("error is not null").select("model_id", "origin_pos", "error")
    cum = raw.filter("error is null").select("model_id", "origin_pos", "scenario", "asset", "g")
    detail = score_scenarios(cum, rows, origins, horizon, q, fraction, train_end, crash_q)
    return detail, comparison.leaderboard(detail), failures


def score_scenarios(cum: DataFrame, rows: DataFrame, origins: DataFrame, horizon: int, q: float, fraction: float, train_end: str, crash_q: float = 0.05) -> DataFrame:
    """One row a model and origin of scenarios (model_id, origin_pos, scenario, asset, g): losses, levels, scores and co-crash against what came true."""
    by = ["model_id", "origin_pos"]
    ahead = windows.forward_cumulative(rows.select("date", F.col("asset").alias("series"), "r"), horizon)
    at = rows.select("date", (F.col("pos") - 1).alias("origin_pos")).distinct()
    outcome = ahead.join(at, "date").select("origin_pos", F.col("series").alias("asset"), "g").join(origins.select("origin_pos"), "origin_pos")
    train = ahead.filter(F.col("date") <= F.lit(train_end).cast("date")).select(F.col("series").alias("asset"), "g")
    thresholds = risk.co_crash_thresholds(train, crash_q)
    weights = rows.select("asset").distinct().withColumn("weight", F.lit(1.0) / F.lit(rows.select("asset").distinct().count()))
    losses = risk.portfolio_losses(cum, weights, by)
    level = risk.risk_summary(losses, q, by).select(*by, "value_at_risk", "expected_shortfall")
    actual = outcome.join(weights, "asset").groupBy("origin_pos").agg((-F.sum(F.col("g") * F.col("weight"))).alias("actual_loss"))
    models = cum.select("model_id").distinct()
    both = outcome.crossJoin(F.broadcast(models))  # a row a model, of which there are a few
    detail = level.join(actual, "origin_pos").join(risk.energy_score(cum, both, by), by).join(risk.variogram_score(cum, both, by), by)
    detail = detail.join(risk.co_crash(cum, thresholds, by, fraction).withColumnRenamed("co_crash", "predicted_co_crash_probability"), by)
    detail = detail.join(risk.realized_co_crash(outcome, thresholds, ["origin_pos"], fraction).withColumnRenamed("realized", "actual_co_crash"), "origin_pos")
    return detail.withColumn("var_violation", F.col("actual_loss") > F.col("value_at_risk")).withColumn("joint_score", risk.joint_score(F.col("actual_loss"), F.col("value_at_risk"), F.col("expected_shortfall"), q))


def paired_comparison(detail: DataFrame, model: str, metrics: list[str], replications: int, block: int, level: float, seed: int) -> DataFrame:
    """(baseline_model_id, metric, ...): intervals of ``model`` less each other model, on the same origins; an origin that only one has, or twice, is an error."""
    own = detail.filter(F.col("model_id") == model)
    base = detail.filter(F.col("model_id") != model)
    own = own.select("origin_pos", *[F.col(x).alias(f"{x}_m") for x in metrics]).crossJoin(F.broadcast(base.select("model_id").distinct()))  # a row a model
    own = own.select(F.struct("model_id", "origin_pos").alias("k"), *[f"{x}_m" for x in metrics])
    base = base.select(F.struct("model_id", "origin_pos").alias("k"), *[F.col(x).alias(f"{x}_b") for x in metrics])
    pairs = panel.exact_join(own, base, "k", ("", "")).select("k.origin_pos", F.col("k.model_id").alias("baseline_model_id"), *[(F.col(f"{x}_m") - F.col(f"{x}_b")).alias(x) for x in metrics])
    long = pairs.unpivot(["origin_pos", "baseline_model_id"], metrics, "metric", "d")
    from pyspark.sql import Window

    by = ["baseline_model_id", "metric"]
    long = long.withColumn("pos", F.row_number().over(Window.partitionBy(*by).orderBy("origin_pos")) - 1)
    return comparison.block_bootstrap(long, by, replications, block, level, seed)


def decision_evaluation(rows: DataFrame, origins: DataFrame, model_scenarios: DataFrame, lookback: int, horizon: int, level: float, radii: list[float], cap: float | None, rate: float, upper: float, split: str = "validation") -> tuple[DataFrame, DataFrame]:
    """Holdings of all strategies and their summary. model_scenarios: (origin_pos, scenario, asset, g)."""
    sealed(split)
    if any(r <= 0 for r in radii) or sorted(set(radii)) != list(radii):
        raise ValueError("radii are positive, distinct and ascending")
    past = historical_scenarios(rows, origins, lookback, horizon)
    both = past.withColumn("source", F.lit("history")).unionByName(model_scenarios.select("origin_pos", "scenario", "asset", "g").withColumn("source", F.lit("model")))
    ahead = windows.forward_cumulative(rows.select("date", F.col("asset").alias("series"), "r"), horizon)
    at = rows.select("date", (F.col("pos") - 1).alias("origin_pos")).distinct()
    outcome = ahead.join(at, "date").select("origin_pos", F.col("series").alias("asset"), "g").join(origins.select("origin_pos"), "origin_pos")
    strategies = [{"name": "equal_weight", "kind": "equal_weight"}, {"name": "historical_cvar", "kind": "cvar", "source": "history"}, {"name": "model_cvar", "kind": "cvar", "source": "model"}]
    strategies += [{"name": f"model_robust_{r:g}", "kind": "robust", "source": "model", "radius": r} for r in radii]
    held = portfolio.run_sequence(both, outcome, strategies, level, cap, rate, upper)
    detail = held.filter("error is null").groupBy("strategy", "origin_pos").agg(*[F.first(c).alias(c) for c in ("gross", "cost", "net", "turnover")])
    return held, portfolio.summarize(detail, level)


def historical_scenarios(rows: DataFrame, origins: DataFrame, lookback: int, horizon: int) -> DataFrame:
    """(origin_pos, scenario, asset, g): overlapping outcomes within the last ``lookback`` rows up to each origin; later rows play no part."""
    ahead = windows.forward_cumulative(rows.select(F.col("pos").alias("date"), F.col("asset").alias("series"), "r"), horizon)
    ahead = ahead.select(F.col("date").alias("pos"), F.col("series").alias("asset"), "g")
    out = windows.history_slices(ahead, origins, lookback)
    return out.filter(F.col("pos") <= F.col("origin_pos") - horizon + 1).select("origin_pos", F.col("offset").cast("int").alias("scenario"), "asset", "g")


def counterfactual_evaluation(spark: SparkSession, paths: int, horizon: int, seed: int, outcomes: tuple[str, ...] = ("equity", "volatility"), steps: int = 5, mediator_steps: int = 20) -> DataFrame:
    """(model_id, outcome, effect_type, ate_terminal, cumulative_ate, tail_effect): truth, oracle and misspecified models."""
    truth = counterfactual.Structure()
    exo = counterfactual.regimes(counterfactual.exogenous(spark, paths, horizon, truth, seed), truth)
    seen = counterfactual.simulate(exo, truth).join(exo.select("path", "z"), "path")
    do = counterfactual.registered(steps, min(mediator_steps, horizon))
    models = {"truth": (truth, exo), "oracle": (truth, None)} | {k: (m, None) for k, m in counterfactual.misspecified(truth).items()}
    out = None
    for name, (model, own) in models.items():
        noise = own if own is not None else counterfactual.abduct(seen, model).join(exo.select("path", "z"), "path")
        for kind, pair in (("total", ("reference", "treated")), ("controlled", ("controlled_reference", "controlled_treated"))):
            for arm, key in zip(("factual", "counterfactual"), pair, strict=True):
                one = counterfactual.long_paths(counterfactual.simulate(noise, model, do[key])).withColumns({"model_id": F.lit(name), "effect_type": F.lit(kind), "arm": F.lit(arm)})
                out = one if out is None else out.unionByName(one)
    return counterfactual.effects(out, outcomes)


def gate(passed: DataFrame) -> None:
    """Stop with the names of gates that failed."""
    quality.require(passed)
