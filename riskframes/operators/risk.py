"""Risk measures, scores and coverage tests of scenario forecasts.

Paths are (by..., scenario, step, asset, r); cumulative scenarios (by..., scenario, asset, g); losses (by..., scenario, loss). ``by`` names the
columns of a forecast, such as the origin. Order statistics rank within a forecast, so forecasts are the unit of work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rng import integer
from ..functions.scalars import checked, chi2_1_tail, chi2_2_tail, xlogy

#: Scenarios up to which all pairs of the energy score are taken; beyond, this many random pairs.
PAIR_LIMIT = 50_000


def aggregate_paths(paths: DataFrame, by: list[str], kind: str = "simple") -> DataFrame:
    """(by..., scenario, asset, g): returns compounded, or log returns summed, over the steps."""
    if kind not in ("simple", "log"):
        raise ValueError(f"unknown return type {kind}")
    g = F.sum("r") if kind == "log" else F.expm1(F.sum(checked(F.col("r") > -1, F.log1p("r"), "simple returns lie above -1")))
    return paths.groupBy(*by, "scenario", "asset").agg(g.alias("g"))


def portfolio_losses(scenarios: DataFrame, weights: DataFrame, by: list[str]) -> DataFrame:
    """(by..., scenario, loss): minus the weighted sum over the assets of ``weights`` (asset, weight)."""
    return scenarios.join(weights, "asset").groupBy(*by, "scenario").agg((-F.sum(F.col("g") * F.col("weight"))).alias("loss"))


def _ranked(losses: DataFrame, by: list[str], value: str) -> DataFrame:
    w = Window.partitionBy(*by)
    return losses.withColumn("_i", F.row_number().over(w.orderBy(value))).withColumn("_n", F.count("*").over(w))


def _var(q: float, value: str) -> Column:
    return F.min(F.when(F.col("_i") >= F.ceil((F.col("_n") - 1) * F.lit(q)) + 1, F.col(value)))


def _shortfall(q: float, value: str) -> Column:
    share = F.greatest(F.col("_i") / F.col("_n") - F.greatest((F.col("_i") - 1) / F.col("_n"), F.lit(q)), F.lit(0.0))
    return F.sum(share * F.col(value)) / (1 - q)


def value_at_risk(losses: DataFrame, q: float, by: list[str], value: str = "loss") -> DataFrame:
    """(by..., value_at_risk): the order statistic at ceil((n - 1) q), counted from 0."""
    return _ranked(losses, by, value).groupBy(*by).agg(_var(q, value).alias("value_at_risk"))


def expected_shortfall(losses: DataFrame, q: float, by: list[str], value: str = "loss") -> DataFrame:
    """(by..., expected_shortfall): the mean of the worst 1 - q of the mass, a part of an observation included."""
    return _ranked(losses, by, value).groupBy(*by).agg(_shortfall(q, value).alias("expected_shortfall"))


def risk_summary(losses: DataFrame, q: float, by: list[str], value: str = "loss") -> DataFrame:
    """(by..., value_at_risk, expected_shortfall, mean, deviation, n) in one pass over ranked losses."""
    return _ranked(losses, by, value).groupBy(*by).agg(_var(q, value).alias("value_at_risk"), _shortfall(q, value).alias("expected_shortfall"),
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("deviation"), F.count("*").alias("n"))


def co_crash_thresholds(outcomes: DataFrame, q: float) -> DataFrame:
    """(asset, threshold): the linear quantile of training outcomes (asset, g)."""
    if not 0 < q < 0.5:
        raise ValueError("the quantile lies in (0, 0.5)")
    return outcomes.groupBy("asset").agg(F.percentile("g", F.lit(q)).alias("threshold"))


def co_crash(scenarios: DataFrame, thresholds: DataFrame, by: list[str], fraction: float) -> DataFrame:
    """(by..., co_crash): share of scenarios in which at least ``fraction`` of the assets are at or below their threshold."""
    hit = scenarios.join(thresholds, "asset").groupBy(*by, "scenario").agg(F.avg((F.col("g") <= F.col("threshold")).cast("double")).alias("_m"))
    return hit.groupBy(*by).agg(F.avg((F.col("_m") >= fraction).cast("double")).alias("co_crash"))


def realized_co_crash(outcomes: DataFrame, thresholds: DataFrame, by: list[str], fraction: float) -> DataFrame:
    hit = outcomes.join(thresholds, "asset").groupBy(*by).agg(F.avg((F.col("g") <= F.col("threshold")).cast("double")).alias("_m"))
    return hit.select(*by, (F.col("_m") >= fraction).alias("realized"))


def energy_score(scenarios: DataFrame, outcomes: DataFrame, by: list[str], beta: float = 1.0, seed: int = 17, most_pairs: int = PAIR_LIMIT) -> DataFrame:
    """(by..., energy_score): mean distance to the outcome less half the mean distance of scenario pairs.

    All pairs, each with itself included, while their number is at most ``most_pairs``; else that many pairs by counter randomness.
    """
    wide = scenarios.groupBy(*by, "scenario").agg(F.array_sort(F.collect_list(F.struct("asset", "g"))).alias("_x"))
    y = outcomes.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("asset", "g"))).alias("_y"))
    power = lambda a, b: F.pow(F.sqrt(F.aggregate(F.zip_with(a, b, lambda p, q: F.pow(p["g"] - q["g"], F.lit(2))), F.lit(0.0), lambda s, v: s + v)), F.lit(beta))
    near = wide.join(y, by).groupBy(*by).agg(F.avg(power(F.col("_x"), F.col("_y"))).alias("_near"))
    numbered = wide.withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy("scenario")) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(*by)))
    counts = numbered.select(*by, "_n").distinct()
    full = F.col("_n") * F.col("_n") <= most_pairs
    k = F.explode(F.sequence(F.lit(0).cast("bigint"), F.when(full, F.col("_n") * F.col("_n") - 1).otherwise(most_pairs - 1).cast("bigint")))
    pairs = counts.withColumn("_k", k)  # bounded a forecast
    pairs = pairs.select(*by, F.when(full, F.floor(F.col("_k") / F.col("_n"))).otherwise(integer("_n", seed, "_k", F.lit("l"))).alias("_l"), F.when(full, F.col("_k") % F.col("_n")).otherwise(integer("_n", seed, "_k", F.lit("r"))).alias("_r"))
    left, right = numbered.select(*by, F.col("_i").cast("bigint").alias("_l"), F.col("_x").alias("_a")), numbered.select(*by, F.col("_i").cast("bigint").alias("_r"), F.col("_x").alias("_b"))
    far = pairs.join(left, [*by, "_l"]).join(right, [*by, "_r"]).groupBy(*by).agg(F.avg(power(F.col("_a"), F.col("_b"))).alias("_far"))
    return near.join(far, by).select(*by, (F.col("_near") - 0.5 * F.col("_far")).alias("energy_score"))


def variogram_score(scenarios: DataFrame, outcomes: DataFrame, by: list[str], p: float = 0.5) -> DataFrame:
    """(by..., variogram_score): over asset pairs, squared difference of |y_i - y_j|^p and its mean over scenarios."""
    i, j = scenarios.select(*by, "scenario", F.col("asset").alias("_i"), F.col("g").alias("_gi")), scenarios.select(*by, "scenario", F.col("asset").alias("_j"), F.col("g").alias("_gj"))
    mean = i.join(j, [*by, "scenario"]).filter("_i < _j").groupBy(*by, "_i", "_j").agg(F.avg(F.pow(F.abs(F.col("_gi") - F.col("_gj")), F.lit(p))).alias("_m"))
    a, b = outcomes.select(*by, F.col("asset").alias("_i"), F.col("g").alias("_yi")), outcomes.select(*by, F.col("asset").alias("_j"), F.col("g").alias("_yj"))
    both = mean.join(a, [*by, "_i"]).join(b, [*by, "_j"])
    return both.groupBy(*by).agg(F.sum(F.pow(F.pow(F.abs(F.col("_yi") - F.col("_yj")), F.lit(p)) - F.col("_m"), F.lit(2))).alias("variogram_score"))


def brier(forecasts: DataFrame, by: list[str]) -> DataFrame:
    """(by..., brier): mean squared difference of probability and outcome 0/1; a probability outside [0, 1] is an error."""
    p = checked(F.col("probability").between(0, 1), F.col("probability"), "probabilities lie in [0, 1]")
    return forecasts.groupBy(*by).agg(F.avg(F.pow(p - F.col("outcome"), F.lit(2))).alias("brier"))


def joint_score(loss: Column, var: Column, es: Column, q: float) -> Column:
    """Joint score of VaR and expected shortfall in return space; a shortfall below the VaR by more than rounding is an error."""
    y, v, e = -loss, -var, -es
    score = F.exp(e) * (e - v + F.when(y <= v, (v - y) / (1 - q)).otherwise(0.0))
    return checked(es >= var - 1e-9 * F.greatest(F.abs(var), F.lit(1.0)), score, "expected shortfall is below the value at risk")


def kupiec(hits: DataFrame, q: float, by: list[str]) -> DataFrame:
    """(by..., n, hits, rate, lr, p_value): unconditional coverage of boolean hits at rate 1 - q."""
    each = hits.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.col("hit").cast("long")).alias("hits"))
    n, x, p = F.col("n"), F.col("hits"), 1 - q
    rate = F.greatest(F.least(x / n, F.lit(1 - 1e-12)), F.lit(1e-12))
    ll0 = x * F.log(F.lit(p)) + (n - x) * F.log(F.lit(1 - p))
    lr = -2 * (ll0 - (x * F.log(rate) + (n - x) * F.log(1 - rate)))
    out = each.withColumn("rate", x / n).withColumn("lr", lr)
    return out.withColumn("p_value", chi2_1_tail(F.col("lr")))


def christoffersen(hits: DataFrame, by: list[str], order: str = "origin_date") -> DataFrame:
    """(by..., n00, n01, n10, n11, lr, p_value): independence of successive hits."""
    before = F.lag("hit").over(Window.partitionBy(*by).orderBy(order))
    pair = hits.withColumn("_b", before).filter("_b is not null")
    each = pair.groupBy(*by).agg(*[F.count_if((F.col("_b") == bool(a)) & (F.col("hit") == bool(b))).alias(f"n{a}{b}") for a in (0, 1) for b in (0, 1)])
    n00, n01, n10, n11 = (F.col(c).cast("double") for c in ("n00", "n01", "n10", "n11"))
    share = lambda a, b: F.coalesce(F.try_divide(b, a + b), F.lit(0.0))
    p0, p1, p = share(n00, n01), share(n10, n11), share(n00 + n10, n01 + n11)
    free = xlogy(n00, 1 - p0) + xlogy(n01, p0) + xlogy(n10, 1 - p1) + xlogy(n11, p1)
    tied = xlogy(n00 + n10, 1 - p) + xlogy(n01 + n11, p)
    out = each.withColumn("lr", F.greatest(-2 * (tied - free), F.lit(0.0)))
    return out.withColumn("p_value", chi2_1_tail(F.col("lr")))


def conditional_coverage(hits: DataFrame, q: float, by: list[str], order: str = "origin_date") -> DataFrame:
    """(by..., lr_uc, lr_ind, lr_cc, p_value): both tests together, two degrees of freedom."""
    a = kupiec(hits, q, by).select(*by, F.col("lr").alias("lr_uc"))
    b = christoffersen(hits, by, order).select(*by, F.col("lr").alias("lr_ind"))
    out = a.join(b, by).withColumn("lr_cc", F.col("lr_uc") + F.col("lr_ind"))
    return out.withColumn("p_value", chi2_2_tail(F.col("lr_cc")))
