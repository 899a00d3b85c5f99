"""Scenario, risk, score and comparison queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.rng import uniform_sql
from ..operators import comparison, risk, scenarios, windows
from .panel import POS, _r
from .proxies import RETURNS, SERIES, TRAIN_END, VALIDATION_END, market, returns, table

H, STRIDE, LOOK, S, Q, BLOCK = 4, 4, 100, 60, 0.95, 3
BY = ["origin_pos"]


def _origins(spark, d):
    return windows.forecast_origins(market(spark, d), TRAIN_END, VALIDATION_END, H, STRIDE)


def _panel(spark, d):
    return scenarios.panel_positions(returns(spark, d))


def _paths(spark, d):
    return scenarios.historical(_panel(spark, d), _origins(spark, d), LOOK, S, H, 11)


def _cum(spark, d):
    out = risk.aggregate_paths(_paths(spark, d), BY)
    return out.withColumn("g", F.round("g", 10))


def _weights(spark):
    return spark.createDataFrame([(s, 1.0 / len(SERIES)) for s in SERIES], "asset string, weight double")


def _losses(spark, d):
    return risk.portfolio_losses(_cum(spark, d), _weights(spark), BY).withColumn("loss", F.round("loss", 10))


def _outcomes(spark, d):
    """(origin_pos, asset, g): the return over the horizon after each origin."""
    ahead = windows.forward_cumulative(returns(spark, d).filter("r is not null"), H)
    at = windows.positions(market(spark, d)).select("date", (F.col("pos") - 1).cast("bigint").alias("origin_pos"))
    return ahead.join(at, "date").join(_origins(spark, d).select(F.col("origin_pos").cast("bigint").alias("origin_pos")), "origin_pos").select("origin_pos", F.col("series").alias("asset"), F.round("g", 10).alias("g"))


def _thresholds(spark, d):
    train = windows.forward_cumulative(returns(spark, d).filter("r is not null"), H).filter(F.col("date") <= F.lit(TRAIN_END).cast("date"))
    return risk.co_crash_thresholds(train.select(F.col("series").alias("asset"), F.round("g", 10).alias("g")), 0.2)


def _detail(spark, d):
    """(origin_pos, loss, value_at_risk, expected_shortfall, hit) of every origin."""
    actual = _outcomes(spark, d).groupBy("origin_pos").agg(F.round(-F.avg("g"), 8).alias("loss"))
    level = risk.risk_summary(_losses(spark, d), 0.8, BY).select("origin_pos", F.round("value_at_risk", 8).alias("value_at_risk"), F.round("expected_shortfall", 8).alias("expected_shortfall"))
    return actual.join(level, "origin_pos").withColumn("hit", F.col("loss") > F.col("value_at_risk"))


def gen_historical(spark, d):
    return _paths(spark, d).select("origin_pos", "scenario", "step", "asset", _r("r"))


def gen_moving_block(spark, d):
    out = scenarios.moving_block(_panel(spark, d), _origins(spark, d), LOOK, S, H, BLOCK, 12)
    return out.select("origin_pos", "scenario", "step", "asset", _r("r"))


def gen_ewma_fhs(spark, d):
    out = scenarios.filtered_historical(_panel(spark, d), _origins(spark, d), LOOK, S, H, 0.94, 13)
    return out.groupBy("origin_pos", "asset", "step").agg(F.count("*").alias("n"), F.round(F.min("r"), 4).alias("least"), F.round(F.avg("r"), 4).alias("mean"))


def path_aggregate_simple(spark, d):
    return risk.aggregate_paths(_paths(spark, d), BY).select("origin_pos", "scenario", "asset", _r("g"))


def path_aggregate_log(spark, d):
    return risk.aggregate_paths(_paths(spark, d), BY, "log").select("origin_pos", "scenario", "asset", _r("g"))


def portfolio_loss(spark, d):
    return _losses(spark, d).select("origin_pos", "scenario", _r("loss"))


def var_higher(spark, d):
    return risk.value_at_risk(_losses(spark, d), Q, BY).select("origin_pos", _r("value_at_risk"))


def es_fractional(spark, d):
    return risk.expected_shortfall(_losses(spark, d), Q, BY).select("origin_pos", _r("expected_shortfall"))


def risk_summary(spark, d):
    """Flagship: value at risk, shortfall and moments of the equal-weight portfolio at every origin."""
    out = risk.risk_summary(_losses(spark, d), Q, BY)
    return out.select("origin_pos", *[_r(c) for c in ("value_at_risk", "expected_shortfall", "mean", "deviation")], "n")


def co_crash_thresholds(spark, d):
    return _thresholds(spark, d).select("asset", _r("threshold"))


def co_crash_prob(spark, d):
    return risk.co_crash(_cum(spark, d), _thresholds(spark, d), BY, 0.4).select("origin_pos", _r("co_crash"))


def realized_co_crash(spark, d):
    return risk.realized_co_crash(_outcomes(spark, d), _thresholds(spark, d), BY, 0.4)


def kupiec(spark, d):
    out = risk.kupiec(_detail(spark, d).withColumn("m", F.lit("hist")), 0.8, ["m"])
    return out.select("m", "n", "hits", _r("rate"), _r("lr", 6), _r("p_value", 6))


def christoffersen_ind(spark, d):
    out = risk.christoffersen(_detail(spark, d).withColumn("m", F.lit("hist")), ["m"], "origin_pos")
    return out.select("m", "n00", "n01", "n10", "n11", _r("lr", 6), _r("p_value", 6))


def conditional_coverage(spark, d):
    out = risk.conditional_coverage(_detail(spark, d).withColumn("m", F.lit("hist")), 0.8, ["m"], "origin_pos")
    return out.select("m", _r("lr_cc", 6), _r("p_value", 6))


def joint_var_es(spark, d):
    score = risk.joint_score(F.col("loss"), F.col("value_at_risk"), F.col("expected_shortfall"), 0.8)
    return _detail(spark, d).select("origin_pos", F.round(score, 6).alias("score"))


def energy_score(spark, d):
    return risk.energy_score(_cum(spark, d), _outcomes(spark, d), BY).select("origin_pos", _r("energy_score"))


def variogram_score(spark, d):
    return risk.variogram_score(_cum(spark, d), _outcomes(spark, d), BY).select("origin_pos", _r("variogram_score"))


def brier(spark, d):
    p = risk.co_crash(_cum(spark, d), _thresholds(spark, d), BY, 0.4).withColumnRenamed("co_crash", "probability")
    y = risk.realized_co_crash(_outcomes(spark, d), _thresholds(spark, d), BY, 0.4).select("origin_pos", F.col("realized").cast("double").alias("outcome"))
    return risk.brier(p.join(y, "origin_pos").withColumn("m", F.lit("hist")), ["m"]).select("m", _r("brier"))


def paired_join(spark, d):
    from ..operators.panel import exact_join

    detail = _detail(spark, d).select("origin_pos", "loss", "value_at_risk")
    return exact_join(detail.select("origin_pos", "loss"), detail.select("origin_pos", "value_at_risk"), "origin_pos", ("_a", "_b"))


def block_bootstrap_ci(spark, d):
    rows = _detail(spark, d).withColumn("pos", F.row_number().over(Window.orderBy("origin_pos")) - 1).withColumn("d", F.round(F.col("loss") - F.col("value_at_risk"), 6)).withColumn("m", F.lit("hist"))
    out = comparison.block_bootstrap(rows.select("m", "pos", "d"), ["m"], 500, 4, 0.95, 21)
    return out.select("m", "n", *[_r(c, 6) for c in ("mean_difference", "ci_lower", "ci_upper", "bootstrap_standard_error")])


def moments(spark, d):
    """Bias-corrected kurtosis and other moments of each series."""
    g2 = F.kurtosis("r")
    n = F.count("r")
    return returns(spark, d).groupBy("series").agg(n.alias("n"), F.round(F.avg("r"), 8).alias("mean"), F.round(F.stddev_pop("r"), 8).alias("sd_pop"), F.round(F.var_samp("r"), 8).alias("var"),
        F.round((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6), 5).alias("kurtosis"), F.round(F.skewness("r"), 6).alias("skewness"))


def worst_block(spark, d):
    """The worst origin of the detail, the first on ties."""
    return _detail(spark, d).agg(F.min_by("origin_pos", F.struct(-F.col("loss"), "origin_pos")).alias("origin_pos"), F.max("loss").alias("loss"))


def quantiles(spark, d):
    return returns(spark, d).groupBy("series").agg(F.round(F.percentile("r", F.lit(0.05)), 8).alias("q05"), F.round(F.median("r"), 8).alias("median"), F.round(F.percentile("r", F.lit(0.95)), 8).alias("q95"))


def boolean_rate(spark, d):
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(F.round(F.avg((F.col("o_totalprice") > 100000).cast("double")), 10).alias("rate"))


NAMES = """gen_historical gen_moving_block gen_ewma_fhs path_aggregate_simple path_aggregate_log portfolio_loss var_higher es_fractional risk_summary co_crash_thresholds co_crash_prob
realized_co_crash kupiec christoffersen_ind conditional_coverage joint_var_es energy_score variogram_score brier paired_join block_bootstrap_ci moments worst_block quantiles boolean_rate""".split()
QUERIES = {n: globals()[n] for n in NAMES}

ORIGINS = POS.replace("placed AS", "placed AS") + f""", orig AS (
  SELECT pos AS origin_pos FROM (SELECT date, pos, lead(date, {H}) OVER (ORDER BY pos) AS e, (SELECT max(pos) FROM placed WHERE date <= '{TRAIN_END}') AS p0 FROM placed)
  WHERE pos >= p0 AND (pos - p0) % {STRIDE} = 0 AND e <= '{VALIDATION_END}'
), pan AS (
  SELECT pos, series AS asset, returns.r FROM returns JOIN placed USING (date) WHERE returns.r IS NOT NULL
), draws AS (
  SELECT origin_pos, scenario, step FROM orig, (SELECT unnest(generate_series(0, {S - 1}))::INTEGER AS scenario), (SELECT unnest(generate_series(0, {H - 1}))::INTEGER AS step)
)"""
PATHS = ORIGINS + f""", paths AS (
  SELECT origin_pos, scenario, step, asset, pan.r FROM draws JOIN pan ON pan.pos = origin_pos - {LOOK} + 1 + CAST(floor({uniform_sql(11, 'origin_pos', 'scenario', 'step')} * {LOOK}) AS BIGINT)
)"""
CUM = PATHS + """, cum AS (SELECT origin_pos, scenario, asset, round(product(1 + r) - 1, 10) AS g FROM paths GROUP BY ALL)"""
LOSSES = CUM + """, losses AS (SELECT origin_pos, scenario, round(-sum(g * 0.2::DOUBLE), 10) AS loss FROM cum GROUP BY ALL)"""
RANKED = LOSSES + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY origin_pos ORDER BY loss) AS i, count(*) OVER (PARTITION BY origin_pos) AS n FROM losses)"""
_FWD = f""", fwd AS (
  SELECT * FROM (SELECT pos, asset, product(1 + r) OVER w - 1 AS g, count(*) OVER w AS n FROM pan WINDOW w AS (PARTITION BY asset ORDER BY pos ROWS BETWEEN CURRENT ROW AND {H - 1} FOLLOWING)) WHERE n = {H}
), outc AS (SELECT origin_pos, asset, round(g, 10) AS g FROM orig JOIN fwd ON fwd.pos = origin_pos + 1),
thr AS (SELECT asset, quantile_cont(round(g, 10), 0.2) AS threshold FROM fwd JOIN placed USING (pos) WHERE date <= '{TRAIN_END}' GROUP BY asset)"""


def _var_sql(q: float) -> str:
    return f"min(loss) FILTER (WHERE i >= ceil((n - 1) * {q}::DOUBLE) + 1)"


def _es_sql(q: float) -> str:
    return f"sum(greatest(i / n - greatest((i - 1) / n, {q}::DOUBLE), 0) * loss) / (1 - {q}::DOUBLE)"


DETAIL = RANKED + _FWD + f""", lev AS (SELECT origin_pos, round({_var_sql(0.8)}, 8) AS v, round({_es_sql(0.8)}, 8) AS e FROM ranked GROUP BY origin_pos),
det AS (SELECT origin_pos, a.loss, v, e, a.loss > v AS hit FROM (SELECT origin_pos, round(-avg(g), 8) AS loss FROM outc GROUP BY origin_pos) a JOIN lev USING (origin_pos))"""
_UC = DETAIL + """, uc AS (SELECT count(*) AS n, CAST(sum(hit::INT) AS BIGINT) AS x, greatest(least(sum(hit::INT) / count(*), 1 - 1e-12::DOUBLE), 1e-12::DOUBLE) AS p FROM det),
lruc AS (SELECT n, x, -2 * (x * ln(0.2::DOUBLE) + (n - x) * ln(0.8::DOUBLE) - (x * ln(p) + (n - x) * ln(1 - p))) AS lr FROM uc)"""
_IND = """, pr AS (SELECT lag(hit) OVER (ORDER BY origin_pos) AS b, hit FROM det), ct AS (SELECT count(*) FILTER (NOT b AND NOT hit) AS n00, count(*) FILTER (NOT b AND hit) AS n01, count(*) FILTER (b AND NOT hit) AS n10, count(*) FILTER (b AND hit) AS n11 FROM pr WHERE b IS NOT NULL),
sh AS (SELECT *, CASE WHEN n00 + n01 > 0 THEN n01 / (n00 + n01) ELSE 0 END AS p0, CASE WHEN n10 + n11 > 0 THEN n11 / (n10 + n11) ELSE 0 END AS p1, (n01 + n11) / (n00 + n01 + n10 + n11) AS p FROM ct),
lrind AS (SELECT *, greatest(-2 * ((CASE WHEN n00 + n10 > 0 THEN (n00 + n10) * ln(1 - p) ELSE 0 END + CASE WHEN n01 + n11 > 0 THEN (n01 + n11) * ln(p) ELSE 0 END)
 - (CASE WHEN n00 > 0 THEN n00 * ln(1 - p0) ELSE 0 END + CASE WHEN n01 > 0 THEN n01 * ln(p0) ELSE 0 END + CASE WHEN n10 > 0 THEN n10 * ln(1 - p1) ELSE 0 END + CASE WHEN n11 > 0 THEN n11 * ln(p1) ELSE 0 END)), 0) + 0 AS lr FROM sh)"""


def _tail1(lr: str) -> str:
    """Upper chi-squared tail with one degree of freedom by Simpson's rule on the normal density."""
    return f"(SELECT 1 - sqrt(2 / pi()) * sum(CASE WHEN k IN (0, 4000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * exp(-pow(sqrt({lr}) * k / 4000, 2) / 2)) * sqrt({lr}) / 12000 FROM (SELECT unnest(generate_series(0, 4000)) AS k))"


_BOOT = DETAIL + f""", df AS (SELECT row_number() OVER (ORDER BY origin_pos) - 1 AS pos, round(loss - v, 6) AS d, count(*) OVER () AS n FROM det),
rp AS (SELECT rep, k, j FROM (SELECT unnest(generate_series(0, 499)) AS rep), (SELECT unnest(generate_series(0, CAST((SELECT ceil(max(n) / 4) FROM df) AS BIGINT) - 1)) AS k), (SELECT unnest(generate_series(0, 3)) AS j)),
ps AS (SELECT rep, (CAST(floor({uniform_sql(21, "'hist'", 'rep', 'k')} * (SELECT max(n) FROM df)) AS BIGINT) + j) % (SELECT max(n) FROM df) AS pos FROM rp WHERE k * 4 + j < (SELECT max(n) FROM df)),
ms AS (SELECT rep, avg(d) AS m FROM ps JOIN df USING (pos) GROUP BY rep)"""

ORACLES = {
    "gen_historical": f"WITH {PATHS} SELECT origin_pos, scenario, step, asset, round(r, 8) AS r FROM paths",
    "gen_moving_block": f"WITH {ORIGINS} SELECT origin_pos, scenario, step, asset, round(pan.r, 8) AS r FROM draws JOIN pan ON pan.pos = origin_pos - {LOOK} + 1 + CAST(floor({uniform_sql(12, 'origin_pos', 'scenario', f'CAST(step // {BLOCK} AS INTEGER)')} * {LOOK - BLOCK + 1}) AS BIGINT) + step % {BLOCK}",
    "path_aggregate_simple": f"WITH {PATHS} SELECT origin_pos, scenario, asset, round(product(1 + r) - 1, 8) AS g FROM paths GROUP BY ALL",
    "path_aggregate_log": f"WITH {PATHS} SELECT origin_pos, scenario, asset, round(sum(r), 8) AS g FROM paths GROUP BY ALL",
    "portfolio_loss": f"WITH {LOSSES} SELECT origin_pos, scenario, round(loss, 8) AS loss FROM losses",
    "var_higher": f"WITH {RANKED} SELECT origin_pos, round({_var_sql(Q)}, 8) AS value_at_risk FROM ranked GROUP BY origin_pos",
    "es_fractional": f"WITH {RANKED} SELECT origin_pos, round({_es_sql(Q)}, 8) AS expected_shortfall FROM ranked GROUP BY origin_pos",
    "risk_summary": f"WITH {RANKED} SELECT origin_pos, round({_var_sql(Q)}, 8) AS value_at_risk, round({_es_sql(Q)}, 8) AS expected_shortfall, round(avg(loss), 8) AS mean, round(stddev_samp(loss), 8) AS deviation, count(*) AS n FROM ranked GROUP BY origin_pos",
    "co_crash_thresholds": f"WITH {ORIGINS}{_FWD} SELECT asset, round(threshold, 8) AS threshold FROM thr",
    "co_crash_prob": f"WITH {CUM}{_FWD}, hit AS (SELECT origin_pos, scenario, avg((g <= threshold)::INT) AS m FROM cum JOIN thr USING (asset) GROUP BY ALL) SELECT origin_pos, round(avg((m >= 0.4)::INT), 8) AS co_crash FROM hit GROUP BY origin_pos",
    "realized_co_crash": f"WITH {ORIGINS}{_FWD} SELECT origin_pos, avg((g <= threshold)::INT) >= 0.4 AS realized FROM outc JOIN thr USING (asset) GROUP BY origin_pos",
    "kupiec": f"WITH {_UC} SELECT 'hist' AS m, n, x AS hits, round(x / n, 8) AS rate, round(lr, 6) AS lr, round({_tail1('lr')}, 6) AS p_value FROM lruc",
    "christoffersen_ind": f"WITH {DETAIL}{_IND} SELECT 'hist' AS m, n00, n01, n10, n11, round(lr, 6) AS lr, round({_tail1('lr')}, 6) AS p_value FROM lrind",
    "conditional_coverage": f"WITH {_UC}{_IND} SELECT 'hist' AS m, round(a.lr + b.lr, 6) AS lr_cc, round(exp(-(a.lr + b.lr) / 2), 6) AS p_value FROM lruc a, lrind b",
    "joint_var_es": f"WITH {DETAIL} SELECT origin_pos, round(exp(-e) * (-e + v + CASE WHEN -loss <= -v THEN (loss - v) / (1 - 0.8::DOUBLE) ELSE 0 END), 6) AS score FROM det",
    "energy_score": f"""WITH {CUM}{_FWD}, a AS (SELECT origin_pos, scenario, sqrt(sum(pow(cum.g - outc.g, 2))) AS d FROM cum JOIN outc USING (origin_pos, asset) GROUP BY ALL),
      b AS (SELECT x.origin_pos, x.scenario AS s, y.scenario AS t, sqrt(sum(pow(x.g - y.g, 2))) AS d FROM cum x JOIN cum y USING (origin_pos, asset) GROUP BY ALL)
      SELECT origin_pos, round(n - 0.5 * f, 8) AS energy_score FROM (SELECT origin_pos, avg(d) AS n FROM a GROUP BY origin_pos) JOIN (SELECT origin_pos, avg(d) AS f FROM b GROUP BY origin_pos) USING (origin_pos)""",
    "variogram_score": f"""WITH {CUM}{_FWD}, m AS (SELECT x.origin_pos, x.asset AS i, y.asset AS j, avg(sqrt(abs(x.g - y.g))) AS m FROM cum x JOIN cum y ON x.origin_pos = y.origin_pos AND x.scenario = y.scenario AND x.asset < y.asset GROUP BY ALL)
      SELECT m.origin_pos, round(sum(pow(sqrt(abs(a.g - b.g)) - m, 2)), 8) AS variogram_score FROM m JOIN outc a ON a.origin_pos = m.origin_pos AND a.asset = i JOIN outc b ON b.origin_pos = m.origin_pos AND b.asset = j GROUP BY m.origin_pos""",
    "brier": f"""WITH {CUM}{_FWD}, hit AS (SELECT origin_pos, scenario, avg((g <= threshold)::INT) AS m FROM cum JOIN thr USING (asset) GROUP BY ALL), p AS (SELECT origin_pos, avg((m >= 0.4)::INT) AS p FROM hit GROUP BY origin_pos),
      y AS (SELECT origin_pos, (avg((g <= threshold)::INT) >= 0.4)::INT AS y FROM outc JOIN thr USING (asset) GROUP BY origin_pos) SELECT 'hist' AS m, round(avg(pow(p - y, 2)), 8) AS brier FROM p JOIN y USING (origin_pos)""",
    "paired_join": f"WITH {DETAIL} SELECT origin_pos, loss AS loss_a, v AS value_at_risk_b FROM det",
    "block_bootstrap_ci": f"WITH {_BOOT} SELECT 'hist' AS m, (SELECT count(*) FROM df) AS n, round((SELECT avg(d) FROM df), 6) AS mean_difference, round(quantile_cont(m, 0.025), 6) AS ci_lower, round(quantile_cont(m, 0.975), 6) AS ci_upper, round(stddev_samp(m), 6) AS bootstrap_standard_error FROM ms",
    "moments": f"WITH {RETURNS} SELECT series, count(r) AS n, round(avg(r), 8) AS mean, round(stddev_pop(r), 8) AS sd_pop, round(var_samp(r), 8) AS var, round(kurtosis(r), 5) AS kurtosis, round(skewness(r) * (count(r) - 2) / sqrt(count(r) * (count(r) - 1)::DOUBLE), 6) AS skewness FROM returns GROUP BY series",
    "worst_block": f"WITH {DETAIL} SELECT origin_pos, loss FROM det ORDER BY loss DESC, origin_pos LIMIT 1",
    "quantiles": f"WITH {RETURNS} SELECT series, round(quantile_cont(r, 0.05), 8) AS q05, round(median(r), 8) AS median, round(quantile_cont(r, 0.95), 8) AS q95 FROM returns GROUP BY series",
    "boolean_rate": "SELECT o_orderstatus, round(avg(CASE WHEN o_totalprice > 100000 THEN 1.0 ELSE 0.0 END), 10) AS rate FROM orders GROUP BY 1",
}
