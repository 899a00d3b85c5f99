"""Fits and recursions with SQL twins: principal factors, regime filter and one EM step, filtered paths, Pareto tails, gates, misspecified models."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.rng import uniform_sql
from ..operators import counterfactual as cf
from ..operators import comparison, factors, generators, portfolio, tail, windows
from ..operators import risk as risk_operators
from ..plans import runners
from . import causal, models, risk
from .models import ASSETS
from .panel import ASOF, CALENDARS, WIDE, _date, _r
from .proxies import MARKET, RETURNS, SERIES, TRAIN_END, VALIDATION_END, market, returns, table
from .risk import _FWD, CUM, DETAIL, LOOK, ORIGINS

FACTORS = 3
RADII = [0.0, 0.01]
PORTFOLIOS = {"equal": [0.2] * 5, "tilted": [0.4, 0.3, 0.2, 0.1, 0.0], "single": [0.0, 0.0, 1.0, 0.0, 0.0]}


def _factor_model(spark, d):
    frame = models._wide(spark, d)
    return frame, factors.fit_factors(frame.filter(F.col("date") <= F.lit(TRAIN_END).cast("date")), ASSETS, FACTORS)


def pca_loadings(spark, d):
    """Loadings and explained shares of the training rows."""
    _, model = _factor_model(spark, d)
    rows = [(c, k, round(float(model.loadings[i, k]), 5), round(float(model.explained[k]), 6)) for i, c in enumerate(ASSETS) for k in range(FACTORS)]
    return spark.createDataFrame(rows, "asset string, factor int, loading double, explained double")


def pca_scores(spark, d):
    """Factors of all rows by the training fit, and the error of the returns that they give back."""
    frame, model = _factor_model(spark, d)
    out = model.restore(model.project(frame))
    error = sum((F.pow(F.col(c) - F.col(f"fit__{c}"), F.lit(2)) for c in ASSETS), F.lit(0.0))
    return out.select(_date(), *[_r(f"f{k}", 4) for k in range(FACTORS)], F.round(F.sqrt(error / len(ASSETS)), 5).alias("rmse"))


def _beliefs(spark, d):
    rows = market(spark, d).withColumn("f0", F.log1p("r")).withColumn("series", F.lit("m"))
    model = factors.binned_regimes(rows.filter(F.col("date") <= F.lit(TRAIN_END).cast("date")), ["f0"], 2)
    return rows, model


def hmm_filter(spark, d):
    """Beliefs given the past, under regimes from the moments of equal bins of the training rows."""
    rows, model = _beliefs(spark, d)
    out = factors.filter_regimes(rows, ["f0"], model)
    return out.select(_date(), F.round(F.get("pi", 0), 6).alias("p0"), F.round(F.get("pi", 1), 6).alias("p1"), F.round(scalars.entropy(F.col("pi")), 6).alias("entropy"))


def regime_em_step(spark, d):
    """One penalised EM step on the training rows: transitions, means, variances and occupancy by state."""
    rows, model = _beliefs(spark, d)
    x = factors.series_rows(rows.filter(F.col("date") <= F.lit(TRAIN_END).cast("date")), ["f0"]).to_numpy(float)
    step, smoothed = factors.em_step(x, model)
    found = factors.regime_diagnostics(smoothed, step)
    out = [(k, *(round(float(v), 6) for v in (step.transitions[k, 0], step.transitions[k, 1], step.means[k, 0], step.covariances[k, 0, 0], found["occupancy"][k], found["persistence"][k]))) for k in range(2)]
    return spark.createDataFrame(out, "state int, to0 double, to1 double, mean double, variance double, occupancy double, persistence double")


def gpd_quantile_es(spark, d):
    out = tail.pareto_by_group(models._order_losses(spark, d), ["o_orderstatus"], [0.9, 0.95], 0.99)
    return out.select("o_orderstatus", "threshold_quantile", "exceedances", _r("shape", 4), _r("scale", 3), _r("quantile", 3), _r("shortfall", 3), "method")


def time_embedding(spark, d):
    """Sines and cosines of diffusion steps."""
    steps = spark.range(12).select(F.col("id").cast("int").alias("t"))
    return steps.select("t", F.posexplode(scalars.sinusoidal(F.col("t"), 8)).alias("k", "x")).select("t", "k", _r("x", 9))


def return_bins(spark, d):
    """Equal bins of each series' returns, with their ends."""
    out = windows.equal_bins(returns(spark, d).filter("r is not null"), [F.col("r"), F.col("date")], 4, ("series",))
    return out.groupBy("series", "bin").agg(F.count("*").alias("n"), F.round(F.min("r"), 8).alias("least"), F.round(F.max("r"), 8).alias("most"))


def regime_switches(spark, d):
    """How often each simulated path changes its regime."""
    paths = causal._exo(spark).select(F.col("path").alias("scenario"), F.posexplode("z").alias("step", "state"))
    return windows.state_switches(paths).select("scenario", F.col("switches").cast("bigint").alias("switches"))


def scm_paired(spark, d):
    """Treated and reference paths side by side, checked to share regimes and initial state: mean difference of each variable and step."""
    exo = causal._exo(spark)
    a, b = (causal._long(spark, causal.DO[k]) for k in ("reference", "treated"))
    both = cf.paired(a, b, (exo.select("path", "z"), exo.select("path", "z")), (causal.MODEL, causal.MODEL))
    return both.groupBy("variable", "t").agg(F.count("*").alias("n"), F.round(F.avg(F.col("c") - F.col("f")), 8).alias("mean_effect")).select("variable", F.col("t").cast("int").alias("t"), "n", "mean_effect")


def objective_parts(spark, d):
    """The parts of the robust CVaR objective of three fixed portfolios at every origin."""
    rows = [(n, a, w, 1.0 / len(SERIES)) for n, ws in PORTFOLIOS.items() for a, w in zip(SERIES, ws, strict=True)]
    weights = spark.createDataFrame(rows, "strategy string, asset string, weight double, previous double")
    scenarios = risk._cum(spark, d)
    origins = scenarios.select("origin_pos").distinct()
    out = portfolio.objective_parts(scenarios, origins.crossJoin(F.broadcast(weights)), 0.9, 0.01, 0.001, ["origin_pos"])
    return out.select("origin_pos", "strategy", *[_r(c) for c in ("eta", "cvar", "penalty", "turnover", "cost", "objective")])


def leaderboard_historical(spark, d):
    """Scores of historical scenarios at all origins, as the leaderboard of the evaluation has them."""
    cum = risk._cum(spark, d).withColumn("model_id", F.lit("historical"))
    detail = runners.score_scenarios(cum, risk._panel(spark, d), risk._origins(spark, d), risk.H, 0.8, 0.4, TRAIN_END, 0.2)
    out = comparison.leaderboard(detail)
    return out.select("model_id", "forecast_origins", *[_r(c, 6) for c in ("mean_energy_score", "mean_variogram_score", "joint_var_es_score", "var_violation_rate", "co_crash_brier_score", "mean_realized_loss")])


def energy_score_sampled(spark, d):
    """The energy score where scenario pairs are drawn."""
    return risk_operators.energy_score(risk._cum(spark, d), risk._outcomes(spark, d), ["origin_pos"], most_pairs=500).select("origin_pos", _r("energy_score"))


def generator_fits(spark, d):
    """Means, shrunk covariances and degrees of freedom that the generators fit at every origin."""
    out = generators.fitted(risk._panel(spark, d), risk._origins(spark, d), LOOK)
    return out.select("origin_pos", "asset", "other", _r("mean"), _r("covariance"), _r("freedom", 5))


def allocation_checks(spark, d):
    """What holds of every optimised portfolio: weights sum to one within bounds, CVaR is that of the weights, and no shift of a hundredth between two assets lowers the objective."""
    cum = risk._cum(spark, d)

    def one(key: tuple, rows):
        import numpy as np
        import pandas as pd

        g = rows.pivot(index="scenario", columns="asset", values="g").sort_index().to_numpy()
        out = []
        for radius in RADII:
            found = portfolio.solve_cvar(g, 0.9, upper=0.6, radius=radius)
            w = found.weights
            bounded = bool(abs(w.sum() - 1) < 1e-8 and w.min() > -1e-8 and w.max() < 0.6 + 1e-8)
            losses = np.sort(-g @ w)
            tail = max(1, round(0.1 * len(losses)))
            consistent = bool(abs(losses[-tail:].mean() - found.cvar) < 1e-9) if abs(0.1 * len(losses) - tail) < 1e-9 else True
            value = lambda v, radius=radius: portfolio.decomposed(g, v, 0.9, None, 0.0, radius).objective
            shifts = [w + 0.01 * (np.eye(len(w))[i] - np.eye(len(w))[j]) for i in range(len(w)) for j in range(len(w)) if i != j]
            best = all(value(v) > value(w) - 1e-7 for v in shifts if v.min() >= 0 and v.max() <= 0.6)
            out.append((int(key[0]), radius, bounded, consistent, best))
        return pd.DataFrame(out, columns=["origin_pos", "radius", "bounded", "consistent", "optimal"])

    return cum.groupBy("origin_pos").applyInPandas(one, "origin_pos bigint, radius double, bounded boolean, consistent boolean, optimal boolean")


def ratings(spark, d):
    """Orders by a label that a map gives to their status; what the map doesn't hold is ``other``."""
    label = F.create_map(*[F.lit(x) for x in ("F", "filled", "O", "open")])
    rows = table(spark, d, "orders").select(F.coalesce(label[F.col("o_orderstatus")], F.lit("other")).alias("label"))
    return rows.groupBy("label").agg(F.count("*").alias("n"))


NAMES = "pca_loadings pca_scores hmm_filter regime_em_step gpd_quantile_es time_embedding return_bins regime_switches scm_paired objective_parts leaderboard_historical energy_score_sampled generator_fits allocation_checks ratings".split()
QUERIES = {n: globals()[n] for n in NAMES}

# --- twins ------------------------------------------------------------------------------------------------------------

_N = len(SERIES)
_X = [f"coalesce(ln(1 + asset__{s}), 0)" for s in SERIES]
_TRACE = "list_sum(list_transform(range(1, " + str(_N + 1) + "), lambda i: q[i][i]))"
_SQUARE = "list_transform(m, lambda a: list_transform(m, lambda b: list_dot_product(a, b)))"


def _eigen(source: str, name: str, turns: int = 18) -> str:
    """The first eigenvector ``v`` and eigenvalue ``l`` of ``c`` in ``source``, and ``c`` without it: powers by repeated squaring."""
    out = [f"{name}0 AS (SELECT c, c AS q FROM {source})"]
    for k in range(turns):
        out.append(f"{name}{k + 1} AS (SELECT c, {_SQUARE} AS q FROM (SELECT c, list_transform(q, lambda a: list_transform(a, lambda b: b / {_TRACE})) AS m FROM {name}{k}))")
    last = f"{name}{turns}"
    pick = f"SELECT c, q[list_position(g, list_max(g))] AS w FROM (SELECT c, q, list_transform(range(1, {_N + 1}), lambda i: q[i][i]) AS g FROM {last})"
    sign = "SELECT c, list_transform(w, lambda x: x / sqrt(list_dot_product(w, w)) * sign(w[list_position(list_transform(w, lambda y: abs(y)), list_max(list_transform(w, lambda y: abs(y))))])) AS v FROM (" + pick + ")"
    value = f"SELECT c, v, list_dot_product(v, list_transform(c, lambda a: list_dot_product(a, v))) AS l FROM ({sign})"
    out.append(f"{name} AS (SELECT list_transform(c, lambda a, i: list_transform(a, lambda b, j: b - l * v[i] * v[j])) AS c, v, l FROM ({value}))")
    return ", ".join(out)


_MOMENTS = (
    f"{WIDE}, lx AS (SELECT date, [{', '.join(_X)}] AS x, [{', '.join('asset__' + s for s in SERIES)}] AS r FROM wide WHERE coalesce({', '.join('asset__' + s for s in SERIES)}) IS NOT NULL), "
    + "tr AS (SELECT * FROM lx WHERE date <= '" + TRAIN_END + "'), mo AS (SELECT "
    + ", ".join(f"avg(x[{i + 1}]) AS m{i}" for i in range(_N)) + ", " + ", ".join(f"avg(x[{i + 1}] * x[{j + 1}]) - avg(x[{i + 1}]) * avg(x[{j + 1}]) AS c{i}{j}" for i in range(_N) for j in range(_N))
    + " FROM tr), sc AS (SELECT *, " + ", ".join(f"greatest(sqrt(greatest(c{i}{i}, 0)), 1e-12) AS s{i}" for i in range(_N)) + " FROM mo), co AS (SELECT ["
    + ", ".join("[" + ", ".join(f"c{i}{j} / (s{i} * s{j})" for j in range(_N)) + "]" for i in range(_N)) + "] AS c, [" + ", ".join(f"m{i}" for i in range(_N)) + "] AS centre, [" + ", ".join(f"s{i}" for i in range(_N)) + "] AS scale FROM sc)"
)
_PCA = f"{_MOMENTS}, {_eigen('co', 'ea')}, {_eigen('ea', 'eb')}, {_eigen('eb', 'ec')}, ld AS (SELECT 0 AS factor, v, l FROM ea UNION ALL SELECT 1, v, l FROM eb UNION ALL SELECT 2, v, l FROM ec)"
_TOTAL = f"(SELECT list_sum(list_transform(range(1, {_N + 1}), lambda i: c[i][i])) FROM co)"

_FILTER = f"""{MARKET}, f AS (SELECT date, ln(1 + r) AS x, row_number() OVER (ORDER BY date) AS k FROM market), t AS (SELECT x, ntile(2) OVER (ORDER BY x) - 1 AS b FROM f WHERE date <= '{TRAIN_END}'),
mo AS (SELECT b, avg(x) AS m, greatest(avg(x * x) - avg(x) * avg(x), 1e-12) AS v FROM t GROUP BY b),
de AS (SELECT f.k, f.date, f.x, max(-0.5 * pow(f.x - m, 2) / v - 0.5 * ln(v)) FILTER (b = 0) AS d0, max(-0.5 * pow(f.x - m, 2) / v - 0.5 * ln(v)) FILTER (b = 1) AS d1 FROM f, mo GROUP BY ALL),
fw AS (SELECT 0::BIGINT AS k, 0.5::DOUBLE AS a0, 0.5::DOUBLE AS a1, 0.5::DOUBLE AS p0, 0.5::DOUBLE AS p1
  UNION ALL SELECT k, 0.9 * w0 / (w0 + w1) + 0.1 * w1 / (w0 + w1), 0.1 * w0 / (w0 + w1) + 0.9 * w1 / (w0 + w1), w0 / (w0 + w1), w1 / (w0 + w1)
  FROM (SELECT de.k, exp(d0 - greatest(d0, d1)) * a0 AS w0, exp(d1 - greatest(d0, d1)) * a1 AS w1 FROM fw JOIN de ON de.k = fw.k + 1))"""
_EM = _FILTER + f""", nt AS (SELECT max(k) AS n FROM f WHERE date <= '{TRAIN_END}'),
bw AS (SELECT fw.k, p0 AS g0, p1 AS g1, 0::DOUBLE AS x00, 0::DOUBLE AS x01, 0::DOUBLE AS x10, 0::DOUBLE AS x11 FROM fw, nt WHERE fw.k = n
  UNION ALL SELECT fw.k, p0 * (0.9 * g0 / a0 + 0.1 * g1 / a1), p1 * (0.1 * g0 / a0 + 0.9 * g1 / a1), p0 * 0.9 * g0 / a0, p0 * 0.1 * g1 / a1, p1 * 0.1 * g0 / a0, p1 * 0.9 * g1 / a1 FROM bw JOIN fw ON fw.k = bw.k - 1 WHERE fw.k >= 1),
ct AS (SELECT sum(x00) + 8.5 AS c00, sum(x01) + 0.5 AS c01, sum(x10) + 0.5 AS c10, sum(x11) + 8.5 AS c11, sum(g0 * x) / sum(g0) AS m0, sum(g1 * x) / sum(g1) AS m1, avg(g0) AS o0, avg(g1) AS o1 FROM bw JOIN f USING (k)),
va AS (SELECT greatest(sum(g0 * pow(x - m0, 2)) / sum(g0), 1e-6) AS v0, greatest(sum(g1 * pow(x - m1, 2)) / sum(g1), 1e-6) AS v1 FROM bw JOIN f USING (k), ct)"""

_EWMA = f"""{ORIGINS}, wx AS (SELECT origin_pos, asset, ln(1 + pan.r) AS x, row_number() OVER (PARTITION BY origin_pos, asset ORDER BY pos) - 1 AS t FROM orig JOIN pan ON pos BETWEEN origin_pos - {LOOK - 1} AND origin_pos),
rv AS (SELECT origin_pos, asset, 0::BIGINT AS t, greatest(var_samp(x), 1e-12) AS v FROM wx GROUP BY ALL UNION ALL SELECT rv.origin_pos, rv.asset, rv.t + 1, 0.94 * v + (1 - 0.94::DOUBLE) * x * x FROM rv JOIN wx USING (origin_pos, asset, t)),
zz AS (SELECT origin_pos, asset, t, x / sqrt(v) - avg(x / sqrt(v)) OVER (PARTITION BY origin_pos, asset) AS z FROM wx JOIN rv USING (origin_pos, asset, t)), vl AS (SELECT origin_pos, asset, arg_max(v, t) AS v FROM rv GROUP BY ALL),
dr AS (SELECT origin_pos, scenario, step, CAST(floor({uniform_sql(13, 'origin_pos', 'scenario', 'step')} * {LOOK}) AS BIGINT) AS t FROM draws), dz AS (SELECT origin_pos, scenario, step, asset, z FROM dr JOIN zz USING (origin_pos, t)),
pt AS (SELECT origin_pos, asset, scenario, -1 AS step, v, 0::DOUBLE AS x FROM vl, (SELECT DISTINCT scenario FROM draws)
  UNION ALL SELECT origin_pos, asset, scenario, pt.step + 1, 0.94 * v + (1 - 0.94::DOUBLE) * pow(z * sqrt(v), 2), z * sqrt(v) FROM pt JOIN (SELECT origin_pos, asset, scenario, step - 1 AS step, z FROM dz) USING (origin_pos, asset, scenario, step))"""


def _likelihood(theta: str) -> str:
    """Profile log likelihood of excesses ``xs`` (smallest lo, largest hi, mean av) at theta."""
    shape = f"list_avg(list_transform(xs, lambda x: ln(1 + ({theta}) * x)))"
    return (
        f"CASE WHEN abs({theta}) < 1e-12 THEN -ln(av) - 1 WHEN 1 + ({theta}) * (CASE WHEN ({theta}) > 0 THEN lo ELSE hi END) <= 0 THEN '-infinity'::DOUBLE "
        f"WHEN {shape} / ({theta}) <= 0 THEN '-infinity'::DOUBLE ELSE -ln({shape} / ({theta})) - {shape} - 1 END"
    )


_GOLD = (math.sqrt(5) - 1) / 2
_PARETO = f"""lo AS (SELECT o_orderstatus, round(o_totalprice / 1000, 3) AS loss FROM orders), us AS (SELECT o_orderstatus, 0.9::DOUBLE AS q, quantile_cont(loss, 0.9) AS u FROM lo GROUP BY 1 UNION ALL SELECT o_orderstatus, 0.95::DOUBLE, quantile_cont(loss, 0.95) FROM lo GROUP BY 1),
ex AS (SELECT o_orderstatus, q, u, count(*) FILTER (loss > u) AS e, count(*) AS n, list(loss - u) FILTER (loss > u) AS xs, min(loss - u) FILTER (loss > u) AS lo, max(loss - u) FILTER (loss > u) AS hi, avg(loss - u) FILTER (loss > u) AS av FROM lo JOIN us USING (o_orderstatus) GROUP BY ALL),
th AS (SELECT o_orderstatus, q, xs, lo, hi, av, unnest(list_concat(list_transform(range(200), lambda k: -1 / hi * (1 - 1e-6) * (1 + k * (1e-4 - 1) / 199)), list_transform(range(400), lambda k: exp(ln(1e-6) + k * (ln(50) - ln(1e-6)) / 399) / av))) AS theta FROM ex WHERE e >= 25),
vl AS (SELECT o_orderstatus, q, xs, lo, hi, av, theta, row_number() OVER (PARTITION BY o_orderstatus, q ORDER BY theta) AS i, {_likelihood('theta')} AS f FROM th),
be AS (SELECT o_orderstatus, q, arg_max(i, f) AS i, max(i) AS n FROM vl GROUP BY ALL),
gs AS (SELECT be.o_orderstatus, be.q, a.xs, a.lo, a.hi, a.av, a.theta AS a, b.theta AS b, 0 AS turn FROM be JOIN vl a ON a.o_orderstatus = be.o_orderstatus AND a.q = be.q AND a.i = greatest(be.i - 1, 1) JOIN vl b ON b.o_orderstatus = be.o_orderstatus AND b.q = be.q AND b.i = least(be.i + 1, be.n)
  UNION ALL SELECT o_orderstatus, q, xs, lo, hi, av, CASE WHEN fc > fd THEN a ELSE c END, CASE WHEN fc > fd THEN d ELSE b END, turn + 1
  FROM (SELECT *, {_likelihood('c')} AS fc, {_likelihood('d')} AS fd FROM (SELECT *, b - {_GOLD!r} * (b - a) AS c, a + {_GOLD!r} * (b - a) AS d FROM gs WHERE turn < 100))),
ft AS (SELECT o_orderstatus, q, list_avg(list_transform(xs, lambda x: ln(1 + (a + b) / 2 * x))) AS shape, list_avg(list_transform(xs, lambda x: ln(1 + (a + b) / 2 * x))) / ((a + b) / 2) AS scale FROM gs WHERE turn = 100),
rk AS (SELECT o_orderstatus, loss, row_number() OVER (PARTITION BY o_orderstatus ORDER BY loss) AS i, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM lo),
eq AS (SELECT o_orderstatus, min(loss) FILTER (i >= ceil((n - 1) * 0.99::DOUBLE) + 1) AS v FROM rk GROUP BY 1), em AS (SELECT o_orderstatus, any_value(v) AS v, avg(loss) FILTER (loss >= v) AS s FROM lo JOIN eq USING (o_orderstatus) GROUP BY 1),
qu AS (SELECT ex.o_orderstatus, ex.q, e, shape, scale, u, u + scale * (pow(0.01::DOUBLE / (e / n), -shape) - 1) / shape AS quantile FROM ex LEFT JOIN ft USING (o_orderstatus, q))"""

_GATES = f"""{WIDE}, {ASOF}, {CALENDARS}, pw AS (SELECT * FROM wide), mx AS (SELECT wide.date, value FROM wide JOIN aligned USING (date) WHERE value IS NOT NULL AND {' AND '.join(f'asset__{s} IS NOT NULL' for s in SERIES)}),
mg AS (SELECT count(*) AS rows, count(date) = count(DISTINCT date) AS uniq, max(gap) AS gap, count(DISTINCT CASE WHEN date <= '{TRAIN_END}' THEN 0 WHEN date <= '{VALIDATION_END}' THEN 1 ELSE 2 END) AS parts FROM (SELECT date, date_diff('day', lag(date) OVER (ORDER BY date), date) AS gap FROM mx)),
pn AS (SELECT count(*) AS rows, least({', '.join(f'avg((asset__{s} IS NOT NULL)::INT)' for s in SERIES)}) AS coverage, count(date) = count(DISTINCT date) AS uniq FROM wide),
sp AS (SELECT date, lag(date) OVER (ORDER BY date) AS start FROM ends), au AS (SELECT s.date, date_diff('day', start, s.date) AS days, c.source, count(*) AS obs, bool_or(c.date = s.date) AS present FROM sp s JOIN sources c ON c.date > start AND c.date <= s.date GROUP BY ALL),
pe AS (SELECT date, bool_and(present) AS present, max(days) AS days, max(obs) - min(obs) AS spread FROM au GROUP BY date), en AS (SELECT bool_and(present) AS present, min(days) AS least_days, max(days) AS most_days, max(spread) AS spread FROM pe),
sg AS (SELECT *, date_diff('day', lag(date) OVER (PARTITION BY source ORDER BY date), date) AS gap FROM sources), se AS (SELECT source, min(date) AS a, max(date) AS b, max(gap) AS gap FROM sg GROUP BY source), ov AS (SELECT max(a) AS lo, min(b) AS hi FROM se),
sn AS (SELECT source, count(*) AS n FROM sources, ov WHERE date BETWEEN lo AND hi GROUP BY source), ca AS (SELECT max(gap) AS gap, max(date_diff('day', DATE '1995-01-01', a)) AS delay, min(n) / max(n) AS density, max((date_diff('day', b, DATE '2002-01-01') NOT BETWEEN 0 AND 180)::INT) AS old FROM se JOIN sn USING (source)),
un AS (SELECT date FROM aligned WHERE value IS NOT NULL UNION SELECT min(date) FROM days UNION SELECT max(date) FROM days), cx AS (SELECT (SELECT count(value) FROM aligned) / (SELECT count(*) FROM days) AS share, max(gap) AS gap FROM (SELECT date_diff('day', lag(date) OVER (ORDER BY date), date) AS gap FROM un)),
la AS (SELECT coalesce(max((source_date > date)::INT), 0) AS src, coalesce(max((available_date > date)::INT), 0) AS avail FROM aligned)"""
_CHECKS = {
    "raw_cache_matches_catalog_allowlist": "true", "minimum_asset_coverage": "pn.coverage >= 0.97", "target_index_unique": "pn.uniq", "target_index_increasing": "true",
    "common_interval_endpoints_aligned": "en.present AND least_days > 0", "target_source_internal_gaps_within_limit": "ca.gap <= 10", "target_source_start_delays_within_limit": "ca.delay <= 10",
    "relative_target_calendar_density": "ca.density >= 0.9", "model_context_source_coverage": "cx.share >= 0.97", "model_context_source_internal_gaps_within_limit": "cx.gap <= 10", "validation_source_coverage": "true",
    "validation_source_internal_gaps_within_limit": "true", "model_index_relative_density": "mg.rows >= 0.97 * pn.rows", "model_index_internal_gap_within_limit": "mg.gap <= 10", "common_interval_calendar_gap_within_limit": "most_days <= 10",
    "interval_source_observation_count_gap_within_limit": "spread <= 5", "model_matrix_finite": "mg.rows > 0", "model_index_unique": "mg.uniq", "source_dates_not_after_model_date": "src = 0",
    "availability_dates_not_after_model_date": "avail = 0", "strict_chronological_splits": "parts = 3", "validation_only_features_excluded": "true", "source_freshness_within_failure_limit": "old = 0",
}


def _noise(name: str, model: cf.Structure) -> str:
    """Innovations that a model needs to give the seen paths."""
    parts = []
    for v in model.equations:
        seen = f'x."{v}"'
        total = f"({seen} + ln(1 - exp(-{seen})))" if v == "volatility" else seen
        total += "".join(f""" - ({c!r}) * {'p' if b else 'x'}."{n}\"""" for n, b, c in model.equations[v])
        parts.append(f"{total} - CASE z WHEN 0 THEN {model.intercepts[v][0]!r} WHEN 1 THEN {model.intercepts[v][1]!r} ELSE {model.intercepts[v][2]!r} END AS e_{v}")
    return f"{name} AS (SELECT x.path, x.t, {', '.join(parts)} FROM seen x JOIN seen p ON p.path = x.path AND p.t = x.t - 1 JOIN st ON st.path = x.path AND st.t = x.t WHERE x.t >= 0)"


def _misspecified() -> str:
    parts, arms = [causal._EXO, causal._sim("seen", None)], []
    for name, model in {"truth": causal.MODEL, **cf.misspecified(causal.MODEL)}.items():
        exo = "exo"
        if name != "truth":
            exo = f"exo_{name}"
            parts.append(_noise(exo, model))
        for arm, key in (("f", "reference"), ("c", "treated")):
            parts.append(causal._sim(f"{arm}_{name}", causal.DO[key], model, exo))
        for v in ("equity", "volatility"):
            arms.append(f"SELECT '{name}' AS model_id, '{v}' AS outcome, {1.0 if v == 'volatility' else -1.0}::DOUBLE AS sgn, path, t, c.\"{v}\" AS c, f.\"{v}\" AS f FROM c_{name} c JOIN f_{name} f USING (path, t) WHERE t >= 0")
    es = lambda x: f"sum(greatest(i{x} / n - greatest((i{x} - 1) / n, 0.95::DOUBLE), 0) * {x}) / (1 - 0.95::DOUBLE)"
    return f"""WITH RECURSIVE {', '.join(parts)}, al AS ({' UNION ALL '.join(arms)}), m AS (SELECT model_id, outcome, t, avg(c - f) AS e FROM al GROUP BY ALL), e AS (SELECT model_id, outcome, arg_max(e, t) AS a, sum(e) AS s FROM m GROUP BY ALL),
      tt AS (SELECT model_id, outcome, path, any_value(sgn) * sum(c) AS c, any_value(sgn) * sum(f) AS f FROM al GROUP BY ALL), rk AS (SELECT *, row_number() OVER (PARTITION BY model_id, outcome ORDER BY c) AS ic, row_number() OVER (PARTITION BY model_id, outcome ORDER BY f) AS if, count(*) OVER (PARTITION BY model_id, outcome) AS n FROM tt),
      te AS (SELECT model_id, outcome, {es('c')} - {es('f')} AS tail FROM rk GROUP BY ALL)
      SELECT model_id, outcome, round(a, 8) AS ate_terminal, round(s, 8) AS cumulative_ate, round(tail, 8) AS tail_effect FROM e JOIN te USING (model_id, outcome)"""


ORACLES = {
    "pca_loadings": f"WITH {_PCA} SELECT 'asset__' || unnest([{', '.join(repr(s) for s in SERIES)}]) AS asset, factor, round(unnest(v), 5) AS loading, round(l / {_TOTAL}, 6) AS explained FROM ld",
    "pca_scores": f"""WITH {_PCA}, z AS (SELECT date, r, list_transform(x, lambda a, i: (a - centre[i]) / scale[i]) AS z, centre, scale FROM lx, co), s AS (SELECT z.*, list_dot_product(z, ea.v) AS f0, list_dot_product(z, eb.v) AS f1, list_dot_product(z, ec.v) AS f2, ea.v AS a, eb.v AS b, ec.v AS c FROM z, ea, eb, ec)
      SELECT CAST(date AS VARCHAR) AS date, CASE WHEN "full" THEN round(f0, 4) END AS f0, CASE WHEN "full" THEN round(f1, 4) END AS f1, CASE WHEN "full" THEN round(f2, 4) END AS f2, CASE WHEN "full" THEN round(sqrt(list_avg(list_transform(r, lambda y, i: pow(y - greatest(exp((f0 * a[i] + f1 * b[i] + f2 * c[i]) * scale[i] + centre[i]) - 1, -1), 2)))), 5) END AS rmse FROM (SELECT *, len(list_filter(r, lambda q: q IS NULL)) = 0 AS "full" FROM s)""",
    "hmm_filter": f"WITH RECURSIVE {_FILTER} SELECT CAST(date AS VARCHAR) AS date, round(p0, 6) AS p0, round(p1, 6) AS p1, round(-(p0 * ln(greatest(p0, 1e-300)) + p1 * ln(greatest(p1, 1e-300))), 6) AS entropy FROM fw JOIN f USING (k)",
    "regime_em_step": f"""WITH RECURSIVE {_EM} SELECT 0 AS state, round(c00 / (c00 + c01), 6) AS to0, round(c01 / (c00 + c01), 6) AS to1, round(m0, 6) AS mean, round(v0, 6) AS variance, round(o0, 6) AS occupancy, round(c00 / (c00 + c01), 6) AS persistence FROM ct, va
      UNION ALL SELECT 1, round(c10 / (c10 + c11), 6), round(c11 / (c10 + c11), 6), round(m1, 6), round(v1, 6), round(o1, 6), round(c11 / (c10 + c11), 6) FROM ct, va""",
    "gen_ewma_fhs": f"WITH RECURSIVE {_EWMA} SELECT origin_pos, asset, step, count(*) AS n, round(min(exp(x) - 1), 4) AS least, round(avg(exp(x) - 1), 4) AS mean FROM pt WHERE step >= 0 GROUP BY ALL",
    "gpd_quantile_es": f"""WITH RECURSIVE {_PARETO} SELECT qu.o_orderstatus, q AS threshold_quantile, e AS exceedances, round(coalesce(shape, 0), 4) AS shape, round(coalesce(scale, 0), 3) AS scale, round(CASE WHEN shape IS NULL THEN v ELSE quantile END, 3) AS quantile,
      round(CASE WHEN shape IS NULL THEN s ELSE (quantile + scale - shape * u) / (1 - shape) END, 3) AS shortfall, CASE WHEN shape IS NULL THEN 'empirical' ELSE 'pareto' END AS method FROM qu JOIN em USING (o_orderstatus)""",
    "quality_gates": f"WITH {_GATES} SELECT unnest([" + ", ".join(f"{{'gate': '{k}', 'passed': coalesce({v}, false)}}" for k, v in _CHECKS.items()) + "], recursive := true) FROM mg, pn, en, ca, cx, la",
    "scm_misspecification": _misspecified(),
    "time_embedding": "SELECT t, k, round(CASE WHEN k < 4 THEN sin(t * exp(-ln(10000) / 3 * k)) ELSE cos(t * exp(-ln(10000) / 3 * (k - 4))) END, 9) AS x FROM (SELECT unnest(generate_series(0, 11))::INT AS t), (SELECT unnest(generate_series(0, 7))::INT AS k)",
    "return_bins": f"WITH {RETURNS}, b AS (SELECT series, r, CAST(ntile(4) OVER (PARTITION BY series ORDER BY r, date) - 1 AS INTEGER) AS bin FROM returns WHERE r IS NOT NULL) SELECT series, bin, count(*) AS n, round(min(r), 8) AS least, round(max(r), 8) AS most FROM b GROUP BY ALL",
    "regime_switches": f"WITH RECURSIVE {causal._EXO}, s AS (SELECT path, z <> lag(z) OVER (PARTITION BY path ORDER BY t) AS c FROM st WHERE t >= 0) SELECT path AS scenario, CAST(coalesce(sum(c::INT), 0) AS BIGINT) AS switches FROM s GROUP BY path",
    "scm_paired": f"WITH RECURSIVE {causal._EXO}, {causal._sim('fa', causal.DO['reference'])}, {causal._sim('co', causal.DO['treated'])} " + " UNION ALL ".join(f"SELECT '{v}' AS variable, t, count(*) AS n, round(avg(co.\"{v}\" - fa.\"{v}\"), 8) AS mean_effect FROM co JOIN fa USING (path, t) WHERE t >= 0 GROUP BY t" for v in cf.VARIABLES),
    "objective_parts": f"""WITH {CUM}, pw AS (SELECT * FROM (VALUES {', '.join(f"('{n}', '{a}', {w!r}::DOUBLE)" for n, ws in PORTFOLIOS.items() for a, w in zip(SERIES, ws, strict=True))}) AS p(strategy, asset, w)),
      ls AS (SELECT origin_pos, strategy, scenario, -sum(g * w) AS loss FROM cum JOIN pw USING (asset) GROUP BY ALL), rk AS (SELECT *, row_number() OVER (PARTITION BY origin_pos, strategy ORDER BY loss, scenario) AS i, count(*) OVER (PARTITION BY origin_pos, strategy) AS n FROM ls),
      et AS (SELECT origin_pos, strategy, min(loss) FILTER (i >= ceil(n * 0.9::DOUBLE - 1e-12)) AS eta FROM rk GROUP BY ALL), tl AS (SELECT origin_pos, strategy, any_value(eta) AS eta, any_value(eta) + avg(greatest(loss - eta, 0)) / (1 - 0.9::DOUBLE) AS cvar FROM ls JOIN et USING (origin_pos, strategy) GROUP BY ALL),
      hd AS (SELECT strategy, 0.01::DOUBLE * max(abs(w)) / (1 - 0.9::DOUBLE) AS penalty, sum(abs(w - 0.2::DOUBLE)) AS turnover FROM pw GROUP BY 1)
      SELECT origin_pos, strategy, round(eta, 8) AS eta, round(cvar, 8) AS cvar, round(penalty, 8) AS penalty, round(turnover, 8) AS turnover, round(0.001::DOUBLE * turnover, 8) AS cost, round(cvar + penalty + 0.001::DOUBLE * turnover, 8) AS objective FROM tl JOIN hd USING (strategy)""",
    "leaderboard_historical": f"""WITH {DETAIL}, ea AS (SELECT origin_pos, scenario, sqrt(sum(pow(cum.g - outc.g, 2))) AS d FROM cum JOIN outc USING (origin_pos, asset) GROUP BY ALL),
      eb AS (SELECT x.origin_pos, x.scenario AS s, y.scenario AS t, sqrt(sum(pow(x.g - y.g, 2))) AS d FROM cum x JOIN cum y USING (origin_pos, asset) GROUP BY ALL),
      en AS (SELECT origin_pos, n - 0.5 * f AS e FROM (SELECT origin_pos, avg(d) AS n FROM ea GROUP BY 1) JOIN (SELECT origin_pos, avg(d) AS f FROM eb GROUP BY 1) USING (origin_pos)),
      vm AS (SELECT x.origin_pos, x.asset AS i, y.asset AS j, avg(sqrt(abs(x.g - y.g))) AS m FROM cum x JOIN cum y ON x.origin_pos = y.origin_pos AND x.scenario = y.scenario AND x.asset < y.asset GROUP BY ALL),
      va AS (SELECT vm.origin_pos, sum(pow(sqrt(abs(a.g - b.g)) - m, 2)) AS s FROM vm JOIN outc a ON a.origin_pos = vm.origin_pos AND a.asset = i JOIN outc b ON b.origin_pos = vm.origin_pos AND b.asset = j GROUP BY 1),
      hc AS (SELECT origin_pos, scenario, avg((g <= threshold)::INT) AS m FROM cum JOIN thr USING (asset) GROUP BY ALL), pc AS (SELECT origin_pos, avg((m >= 0.4)::INT) AS p FROM hc GROUP BY 1), yc AS (SELECT origin_pos, (avg((g <= threshold)::INT) >= 0.4)::INT AS y FROM outc JOIN thr USING (asset) GROUP BY 1)
      SELECT 'historical' AS model_id, count(*) AS forecast_origins, round(avg(en.e), 6) AS mean_energy_score, round(avg(s), 6) AS mean_variogram_score, round(avg(exp(-det.e) * (-det.e + v + CASE WHEN -loss <= -v THEN (loss - v) / (1 - 0.8::DOUBLE) ELSE 0 END)), 6) AS joint_var_es_score,
        round(avg(hit::INT), 6) AS var_violation_rate, round(avg(pow(p - y, 2)), 6) AS co_crash_brier_score, round(avg(loss), 6) AS mean_realized_loss FROM det JOIN en USING (origin_pos) JOIN va USING (origin_pos) JOIN pc USING (origin_pos) JOIN yc USING (origin_pos)""",
    "energy_score_sampled": f"""WITH {CUM}{_FWD}, a AS (SELECT origin_pos, scenario, sqrt(sum(pow(cum.g - outc.g, 2))) AS d FROM cum JOIN outc USING (origin_pos, asset) GROUP BY ALL),
      nm AS (SELECT origin_pos, scenario, row_number() OVER (PARTITION BY origin_pos ORDER BY scenario) - 1 AS i, count(*) OVER (PARTITION BY origin_pos) AS n FROM (SELECT DISTINCT origin_pos, scenario FROM cum)),
      pr AS (SELECT origin_pos, k, CAST(floor({uniform_sql(17, 'k', "'l'")} * n) AS BIGINT) AS l, CAST(floor({uniform_sql(17, 'k', "'r'")} * n) AS BIGINT) AS r FROM (SELECT DISTINCT origin_pos, n FROM nm), (SELECT unnest(generate_series(0, 499)) AS k)),
      pd AS (SELECT origin_pos, k, sqrt(sum(pow(x.g - y.g, 2))) AS d FROM pr JOIN nm nl USING (origin_pos) JOIN nm nr USING (origin_pos) JOIN cum x USING (origin_pos) JOIN cum y USING (origin_pos) WHERE nl.i = l AND nr.i = r AND x.scenario = nl.scenario AND y.scenario = nr.scenario AND x.asset = y.asset GROUP BY ALL)
      SELECT origin_pos, round(m - 0.5 * f, 8) AS energy_score FROM (SELECT origin_pos, avg(d) AS m FROM a GROUP BY 1) JOIN (SELECT origin_pos, avg(d) AS f FROM pd GROUP BY 1) USING (origin_pos)""",
    "generator_fits": f"""WITH {ORIGINS}, wx AS (SELECT origin_pos, pos, asset, ln(1 + pan.r) AS x FROM orig JOIN pan ON pos BETWEEN origin_pos - {LOOK - 1} AND origin_pos),
      fu AS (SELECT origin_pos FROM wx GROUP BY 1 HAVING count(*) = {LOOK * len(SERIES)}), ku AS (SELECT origin_pos, asset, avg(x) AS m, kurtosis(x) AS k FROM wx GROUP BY ALL),
      nu AS (SELECT origin_pos, CASE WHEN count(*) FILTER (k > 0) > 0 THEN least(greatest(6 / (median(k) FILTER (k > 0)) + 4, 4.1), 30) ELSE 30 END AS nu FROM ku GROUP BY 1),
      cv AS (SELECT a.origin_pos, a.asset, b.asset AS other, covar_samp(a.x, b.x) AS c FROM wx a JOIN wx b USING (origin_pos, pos) GROUP BY ALL)
      SELECT origin_pos, cv.asset, other, round(m, 8) AS mean, round(CASE WHEN cv.asset = other THEN c + 1e-10 ELSE 0.95::DOUBLE * c END, 8) AS covariance, round(nu, 5) AS freedom FROM cv JOIN ku USING (origin_pos, asset) JOIN nu USING (origin_pos) JOIN fu USING (origin_pos)""",
    "allocation_checks": f"WITH {ORIGINS} SELECT origin_pos, unnest({RADII})::DOUBLE AS radius, true AS bounded, true AS consistent, true AS optimal FROM orig",
    "ratings": "SELECT CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'O' THEN 'open' ELSE 'other' END AS label, count(*) AS n FROM orders GROUP BY 1",
}
