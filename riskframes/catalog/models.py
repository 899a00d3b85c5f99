"""Queries of models, tails, decisions and diffusion."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.rng import normal, normal_sql
from ..operators import diffusion, factors, generators, panel, portfolio, tail, windows
from ..plans import runners
from .panel import _date, _r
from .proxies import SERIES, TRAIN_END, market, returns, table
from .risk import BY, H, LOOK, ORIGINS, _FWD, _origins, _outcomes, _panel

ASSETS = [f"asset__{s}" for s in SERIES]


def _wide(spark, d):
    return panel.wide(returns(spark, d).filter("r is not null"), SERIES)


def _vectors(spark, d):
    """(vec_id, label, x0, x1, ...) of all elements of the vectors, and the names of these columns."""
    rows = table(spark, d, "embeddings")
    columns = [f"x{k}" for k in range(rows.select(F.max(F.size("embedding"))).first()[0] or 0)]
    return rows.select("vec_id", "label", *[F.round(F.get("embedding", k).cast("double"), 6).alias(c) for k, c in enumerate(columns)]), columns


def _square(spark, matrix, places, name):
    return spark.createDataFrame([(i, j, round(float(x), places)) for i, row in enumerate(matrix) for j, x in enumerate(row)], f"i int, j int, {name} double")


def gram_matrix(spark, d):
    return _square(spark, factors.gram(*_vectors(spark, d))[2], 5, "s")


def covariance_shrinkage(spark, d):
    return _square(spark, factors.covariance(*_vectors(spark, d), 1, 0.05)[1], 7, "c")


def standardizer(spark, d):
    return factors.standardizer(*_vectors(spark, d)).select("name", _r("mean"), _r("scale"), "n_fit_rows")


def standardized(spark, d):
    """Standardised values of all vectors, by the statistics of label 0, and how far the inverse is from the values."""
    rows, columns = _vectors(spark, d)
    fitted = factors.fit_standardizer(rows.filter("label = 0"), columns)
    z = fitted.transform(rows)
    again = fitted.inverse(z)
    both = again.select("vec_id", *[F.col(c).alias(f"again_{c}") for c in columns]).join(rows, "vec_id").join(z.select("vec_id", *[F.col(c).alias(f"z_{c}") for c in columns]), "vec_id")
    worst = F.greatest(*[F.abs(F.col(c) - F.col(f"again_{c}")) for c in columns])
    total = sum((F.col(f"z_{c}") for c in columns), F.lit(0.0))
    return both.select("vec_id", F.round(total, 5).alias("total"), (worst < 1e-9).alias("inverted"))


def weighted_state_profile(spark, d):
    rows, columns = _vectors(spark, d)
    rows = rows.withColumn("p", (F.col("label") + 1) / 11.0).withColumn("pi", F.array(F.col("p"), 1 - F.col("p")))
    out = factors.state_profiles(rows, columns)
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"mean__{c}").alias("mean"), F.col(f"volatility__{c}").alias("volatility")) for c in columns])).alias("v")
    return out.select("state", "effective_observations", "occupancy", each).select("state", _r("effective_observations", 6), _r("occupancy"), "v.name", _r("v.mean", 8, "mean"), _r("v.volatility", 8, "volatility"))


def _hmm(spark, d):
    rows = market(spark, d).filter(F.col("date") <= F.lit(TRAIN_END).cast("date")).withColumn("f0", F.log1p("r"))
    return factors.fit_regimes(rows, ["f0"], 2, 4, 41, iterations=60)


def hmm_transitions(spark, d):
    m = _hmm(spark, d)
    return spark.createDataFrame([(i, j, float(m.transitions[i, j])) for i in range(2) for j in range(2)], "i int, j int, p double")


def switching_paths(spark, d):
    """Scenario paths of the integrated model at the end of training, as cumulative returns."""
    frame = _wide(spark, d).filter(F.col("date") <= F.lit(TRAIN_END).cast("date"))
    model = factors.fit_switching(frame, ASSETS, 2, 2, 3, 42, iterations=40)
    paths = model.sample(model.belief, model.last, 50, H, np.random.Generator(np.random.Philox(key=[42, 1])))
    g = np.expm1(np.log1p(paths).sum(1))
    return spark.createDataFrame([(s, a, float(g[s, k])) for s in range(len(g)) for k, a in enumerate(SERIES)], "scenario int, asset string, g double")


SPECS = [{"model_id": k, "kind": k, **({"block": 4} if k == "moving_block" else {})} for k in generators.KINDS]


def _runs(spark, d, specs=SPECS):
    return generators.run(_panel(spark, d), _origins(spark, d), specs, LOOK, 40, H, 51)


def gen_all_models(spark, d):
    out = _runs(spark, d)
    return out.groupBy("model_id", "origin_pos").agg(F.count("*").alias("n"), F.round(F.avg("g"), 6).alias("mean"), F.round(F.stddev_samp("g"), 6).alias("deviation"), F.count("error").alias("failures"))


def baseline_leaderboard(spark, d):
    specs = [s for s in SPECS if s["kind"] in ("historical", "moving_block", "gaussian", "filtered_historical")]
    detail, board, _ = runners.rolling_baselines(_panel(spark, d), _origins(spark, d), specs, LOOK, 40, H, 52, 0.9, 0.4, TRAIN_END, 0.2)
    return board


def window_severity(spark, d):
    return tail.severity(_cells(spark, d)).select("w", _r("severity"))


def _cells(spark, d):
    """(w, step, feature, x): every element of the vectors as a cell of a window of three steps."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("w"), F.posexplode("embedding").alias("k", "x"))
    return rows.select("w", (F.col("k") % 3).alias("step"), F.floor(F.col("k") / 3).cast("int").alias("feature"), F.round(F.col("x").cast("double"), 6).alias("x"))


def importance_weights(spark, d):
    rows = tail.severity(_cells(spark, d)).withColumn("severity", F.round("severity", 8))
    return tail.importance_weights(rows).select("w", _r("weight", 6))


def _order_losses(spark, d):
    return table(spark, d, "orders").select("o_orderstatus", F.round(F.col("o_totalprice") / 1000, 3).alias("loss"))


def pot_exceedances(spark, d):
    out = tail.exceedances(_order_losses(spark, d), 0.95, ["o_orderstatus"])
    return out.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.max("threshold"), 6).alias("threshold"), F.round(F.avg("excess"), 6).alias("mean_excess"))


def _events(spark, d):
    """Issues and later observations of each user's events, in order."""
    rows = table(spark, d, "events").select(F.col("user_id").cast("string").alias("series"), F.col("event_id").cast("string").alias("forecast_id"), "value", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("k"))
    issue = rows.select("series", (F.col("k") * 10).cast("bigint").alias("seq"), F.lit("issue").alias("kind"), "forecast_id", F.round("value", 2).alias("value"))
    late = F.col("k") * 10 + 5 + F.col("k") % 3 * 10
    seen = rows.select("series", late.cast("bigint").alias("seq"), F.lit("observe").alias("kind"), "forecast_id", F.round(F.col("value") + (F.col("k") % 7) / 10.0, 2).alias("value"))
    return issue.unionByName(seen).withColumn("seq", F.col("seq") * 100000 + F.col("forecast_id").cast("bigint") % 100000)


def conformal_batch(spark, d):
    return tail.conformal(_events(spark, d), 0.9, 10, 3).select("series", "seq", "forecast_id", _r("correction", 6), _r("adjusted", 6))


def historical_scenarios(spark, d):
    out = runners.historical_scenarios(_panel(spark, d), _origins(spark, d), 30, H)
    return out.select(F.col("origin_pos").cast("bigint").alias("origin_pos"), "scenario", "asset", _r("g"))


def _equal(spark, d):
    rows = _outcomes(spark, d)
    return rows.select("origin_pos", "asset", F.lit(0.2).alias("target"), F.lit(0.2).alias("previous"), "g", F.lit(0.001).alias("rate"))


def realized_arithmetic_equal_weight(spark, d):
    return portfolio.realized(_equal(spark, d), BY).select("origin_pos", "asset", *[_r(c) for c in ("drifted", "gross", "turnover", "cost", "net")])


def _equal_detail(spark, d):
    """Equal weight with the trades back from drifted weights, one row an origin."""
    rows = portfolio.realized(_equal(spark, d), BY)
    before = F.coalesce(F.lag("drifted").over(Window.partitionBy("asset").orderBy("origin_pos")), F.lit(0.2))
    rows = rows.withColumn("trade", F.abs(0.2 - before))
    out = rows.groupBy("origin_pos").agg(F.round(F.first("gross"), 10).alias("gross"), F.round(F.sum("trade"), 10).alias("turnover"))
    return out.withColumn("cost", F.round(F.col("turnover") * 0.001, 12)).withColumn("net", F.round(F.col("gross") - F.col("cost"), 10)).withColumn("strategy", F.lit("equal_weight"))


def turnover_cost(spark, d):
    return _equal_detail(spark, d).select("origin_pos", _r("turnover"), _r("cost", 10), _r("net"))


def decision_summary_equal_weight(spark, d):
    out = portfolio.summarize(_equal_detail(spark, d), 0.8)
    return out.select("strategy", "blocks", "worst_block", *[_r(c) for c in ("cumulative_net_return", "mean_net_return", "net_volatility", "max_drawdown", "mean_turnover", "total_cost", "worst_net_return", "value_at_risk", "expected_shortfall")])


def decision_sequence(spark, d):
    model = _runs(spark, d, [SPECS[0]]).select("origin_pos", "scenario", "asset", "g")
    _, summary = runners.decision_evaluation(_panel(spark, d), _origins(spark, d), model, 60, H, 0.9, [0.001], 0.8, 0.001, 0.6)
    return summary


def cvar_weights(spark, d):
    model = _runs(spark, d, [SPECS[0]]).select("origin_pos", "scenario", "asset", "g")
    held, _ = runners.decision_evaluation(_panel(spark, d), _origins(spark, d), model, 60, H, 0.9, [0.001], None, 0.0, 0.6)
    return held.select("strategy", "origin_pos", "asset", F.round("target", 4).alias("target"), F.round("cvar", 6).alias("cvar"))


def beta_schedule(spark, d):
    return diffusion.schedule(spark, 12).select("t", *[F.round(c, 10).alias(c) for c in ("beta", "alpha", "alpha_bar", "posterior_variance")])


def q_sample(spark, d):
    cells = _cells(spark, d).withColumn("t", (F.col("w") % 12).cast("int")).withColumn("noise", normal(61, "w", "step", "feature"))
    return diffusion.q_sample(cells, diffusion.schedule(spark, 12)).select("w", "step", "feature", _r("noised"))


def weighted_loss(spark, d):
    cells = _cells(spark, d).withColumn("noise", normal(61, "w", "step", "feature")).withColumn("predicted", F.col("x"))
    weights = table(spark, d, "embeddings").select(F.col("vec_id").alias("w"), (1 + F.col("label") / 10.0).alias("weight"))
    return diffusion.weighted_loss(cells, weights).select(_r("loss"))


def ddpm_sample(spark, d):
    """Scenarios of a small trained denoiser on the market's windows."""
    rows = market(spark, d).filter(F.col("date") <= F.lit(TRAIN_END).cast("date")).withColumn("series", F.lit("m")).withColumn("pos", F.row_number().over(Window.orderBy("date")) - 1).withColumn("x", F.log1p("r"))
    pairs = factors.series_rows(windows.window_pairs(rows, ["x"], 12, H), ["past", "future"], "pos")
    past, future = (np.array([[list(r) for r in w] for w in pairs[c]], float) for c in ("past", "future"))
    scale = past.std() or 1.0
    belief = np.ones((len(past), 1))
    model = diffusion.Denoiser(1, 1, 1, channels=8, blocks=1, groups=2, seed=3)
    diffusion.train(model, past / scale, future / scale, belief, np.ones(len(past)), 8, 3, 4)
    out = diffusion.sample_scenarios(spark, model, past[-1] / scale, belief[-1], 100, H, 8, 5)
    return out.withColumn("value", F.col("value") * float(scale))


NAMES = """gram_matrix covariance_shrinkage standardizer standardized weighted_state_profile hmm_transitions switching_paths gen_all_models baseline_leaderboard window_severity
importance_weights pot_exceedances conformal_batch historical_scenarios realized_arithmetic_equal_weight turnover_cost decision_summary_equal_weight decision_sequence cvar_weights
beta_schedule q_sample weighted_loss ddpm_sample""".split()
QUERIES = {n: globals()[n] for n in NAMES}

LONG = "l AS (SELECT vec_id, label, k, round(CAST(e AS DOUBLE), 6) AS x FROM (SELECT vec_id, label, unnest(embedding) AS e, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS k FROM embeddings))"
CELLS = LONG + ", cells AS (SELECT vec_id AS w, k % 3 AS step, k // 3 AS feature, x FROM l)"
SEVERITY = CELLS + """, m AS (SELECT feature, median(x) AS m, stddev_pop(x) AS sd FROM cells GROUP BY 1), sc AS (SELECT feature, m, greatest(CASE WHEN 1.4826 * median(abs(x - m)) > 1e-6 THEN 1.4826 * median(abs(x - m)) ELSE sd END, 1e-6) AS s FROM cells JOIN m USING (feature) GROUP BY feature, m, sd),
e AS (SELECT w, step, sqrt(avg(pow(abs(x - m) / s, 2))) AS r FROM cells JOIN sc USING (feature) GROUP BY 1, 2), sev AS (SELECT w, max(r) AS severity FROM e GROUP BY 1)"""
SCHEDULE = "sch AS (SELECT t, 1e-4::DOUBLE + (0.02::DOUBLE - 1e-4::DOUBLE) * t / 11 AS beta FROM (SELECT unnest(generate_series(0, 11))::INT AS t)), bars AS (SELECT t, beta, 1 - beta AS alpha, exp(sum(ln(1 - beta)) OVER (ORDER BY t)) AS alpha_bar FROM sch)"
EVENTS = """ev AS (SELECT CAST(user_id AS VARCHAR) AS series, CAST(event_id AS VARCHAR) AS fid, event_id % 100000 AS tie, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
iss AS (SELECT series, fid, k * 10 * 100000 + tie AS seq, round(value, 2) AS base FROM ev), obs AS (SELECT series, fid, (k * 10 + 5 + k % 3 * 10) * 100000 + tie AS seq, round(value + (k % 7) / 10.0, 2) AS v FROM ev),
sco AS (SELECT obs.series, obs.seq, v - base AS s, row_number() OVER (PARTITION BY obs.series ORDER BY obs.seq) AS n FROM obs JOIN iss USING (series, fid)),
cnt AS (SELECT iss.series, iss.seq, iss.fid, base, count(sco.seq) AS n FROM iss LEFT JOIN sco ON sco.series = iss.series AND sco.seq < iss.seq GROUP BY ALL),
rec AS (SELECT cnt.*, list_sort(list(s)) AS r FROM cnt LEFT JOIN sco ON sco.series = cnt.series AND sco.n > cnt.n - 10 AND sco.n <= cnt.n GROUP BY ALL)"""
REAL = ORIGINS + _FWD + ", re AS (SELECT origin_pos, asset, g, avg(g) OVER (PARTITION BY origin_pos) AS gross FROM outc), dr AS (SELECT origin_pos, asset, 0.2 * (1 + g) / (1 + gross) / sum(0.2 * (1 + g) / (1 + gross)) OVER (PARTITION BY origin_pos) AS drifted, gross FROM re)"
EQUAL = REAL + """, tr AS (SELECT *, abs(0.2 - coalesce(lag(drifted) OVER (PARTITION BY asset ORDER BY origin_pos), 0.2)) AS trade FROM dr),
de AS (SELECT origin_pos, round(any_value(gross), 10) AS gross, round(sum(trade), 10) AS turnover, round(round(sum(trade), 10) * 0.001::DOUBLE, 12) AS cost, round(round(any_value(gross), 10) - round(round(sum(trade), 10) * 0.001::DOUBLE, 12), 10) AS net FROM tr GROUP BY origin_pos)"""

ORACLES = {
    "gram_matrix": f"WITH {LONG} SELECT a.k AS i, b.k AS j, round(sum(a.x * b.x), 5) AS s FROM l a JOIN l b USING (vec_id) GROUP BY 1, 2",
    "covariance_shrinkage": f"WITH {LONG} SELECT a.k AS i, b.k AS j, round(covar_samp(a.x, b.x) * CASE WHEN a.k = b.k THEN 1 ELSE 0.95 END, 7) AS c FROM l a JOIN l b USING (vec_id) GROUP BY 1, 2",
    "standardizer": f"WITH {LONG} SELECT 'x' || k AS name, round(avg(x), 8) AS mean, round(greatest(stddev_pop(x), 1e-12), 8) AS scale, count(x) AS n_fit_rows FROM l GROUP BY k",
    "weighted_state_profile": f"""WITH {LONG}, w AS (SELECT k, x, s AS state, CASE WHEN s = 0 THEN (label + 1) / 11.0::DOUBLE ELSE 1 - (label + 1) / 11.0::DOUBLE END AS w FROM l, (SELECT unnest([0, 1]) AS s))
      SELECT state, round(sum(w), 6) AS effective_observations, round(sum(w) / (SELECT count(*) FROM embeddings), 8) AS occupancy, 'x' || k AS name, round(sum(w * x) / sum(w), 8) AS mean, round(sqrt(sum(w * x * x) / sum(w) - pow(sum(w * x) / sum(w), 2)), 8) AS volatility FROM w GROUP BY state, k""",
    "standardized": f"""WITH {LONG}, s AS (SELECT k, avg(x) AS m, greatest(stddev_pop(x), 1e-12) AS d FROM l WHERE label = 0 GROUP BY k) SELECT vec_id, round(sum((x - m) / d), 5) AS total, true AS inverted FROM l JOIN s USING (k) GROUP BY vec_id""",
    "window_severity": f"WITH {SEVERITY} SELECT w, round(severity, 8) AS severity FROM sev",
    "importance_weights": f"""WITH {SEVERITY}, q AS (SELECT w, round(severity, 8) AS s FROM sev), c AS (SELECT quantile_cont(s, 0.9) AS c, stddev_pop(s) AS sd FROM q), x AS (SELECT w, greatest(s - c, 0) AS e, sd FROM q, c),
      k AS (SELECT greatest(coalesce(median(e) FILTER (WHERE e > 0), 0), max(sd), 1e-6) AS k FROM x), r AS (SELECT w, least(1 + 3 * e / k, 8) AS r FROM x, k), n AS (SELECT w, least(r / avg(r) OVER (), 8) AS r FROM r) SELECT w, round(r / avg(r) OVER (), 6) AS weight FROM n""",
    "pot_exceedances": "WITH o AS (SELECT o_orderstatus, round(o_totalprice / 1000, 3) AS loss FROM orders), t AS (SELECT o_orderstatus, quantile_cont(loss, 0.95) AS u FROM o GROUP BY 1) SELECT o_orderstatus, count(*) AS n, round(max(u), 6) AS threshold, round(avg(loss - u), 6) AS mean_excess FROM o JOIN t USING (o_orderstatus) WHERE loss > u GROUP BY 1",
    "conformal_batch": f"WITH {EVENTS}, c AS (SELECT *, CASE WHEN least(n, 10) < 3 THEN 0 ELSE r[greatest(1, least(least(n, 10), CAST(ceil((least(n, 10) + 1) * 0.9::DOUBLE) AS BIGINT)))] END AS c FROM rec) SELECT series, seq, fid AS forecast_id, round(c, 6) AS correction, round(base + c, 6) AS adjusted FROM c",
    "historical_scenarios": f"WITH {ORIGINS}{_FWD} SELECT origin_pos, CAST(fwd.pos - origin_pos + 29 AS INTEGER) AS scenario, asset, round(g, 8) AS g FROM orig JOIN fwd ON fwd.pos BETWEEN origin_pos - 29 AND origin_pos - {H} + 1",
    "realized_arithmetic_equal_weight": f"WITH {REAL} SELECT origin_pos, asset, round(drifted, 8) AS drifted, round(gross, 8) AS gross, 0.0::DOUBLE AS turnover, 0.0::DOUBLE AS cost, round(gross, 8) AS net FROM dr",
    "turnover_cost": f"WITH {EQUAL} SELECT origin_pos, round(turnover, 8) AS turnover, round(cost, 10) AS cost, round(net, 8) AS net FROM de",
    "decision_summary_equal_weight": f"""WITH {EQUAL}, w AS (SELECT *, exp(sum(ln(1 + net)) OVER (ORDER BY origin_pos)) AS w FROM de), f AS (SELECT *, 1 - w / greatest(1, max(w) OVER (ORDER BY origin_pos)) AS f FROM w),
      k AS (SELECT -net AS x, row_number() OVER (ORDER BY -net) AS i, count(*) OVER () AS n FROM de)
      SELECT 'equal_weight' AS strategy, count(*) AS blocks, arg_min(origin_pos, net) AS worst_block, round(product(1 + net) - 1, 8) AS cumulative_net_return, round(avg(net), 8) AS mean_net_return, round(stddev_samp(net), 8) AS net_volatility, round(max(f), 8) AS max_drawdown,
      round(avg(turnover), 8) AS mean_turnover, round(sum(cost), 8) AS total_cost, round(min(net), 8) AS worst_net_return, (SELECT round(min(x) FILTER (WHERE i >= ceil((n - 1) * 0.8::DOUBLE) + 1), 8) FROM k) AS value_at_risk,
      (SELECT round(sum(greatest(i / n - greatest((i - 1) / n, 0.8::DOUBLE), 0) * x) / (1 - 0.8::DOUBLE), 8) FROM k) AS expected_shortfall FROM f""",
    "beta_schedule": f"WITH {SCHEDULE} SELECT t, round(beta, 10) AS beta, round(alpha, 10) AS alpha, round(alpha_bar, 10) AS alpha_bar, round(greatest(beta * (1 - coalesce(lag(alpha_bar) OVER (ORDER BY t), 1)) / (1 - alpha_bar), 1e-20), 10) AS posterior_variance FROM bars",
    "q_sample": f"WITH {CELLS}, {SCHEDULE} SELECT w, step, feature, round(sqrt(alpha_bar) * x + sqrt(1 - alpha_bar) * {normal_sql(61, 'w', 'step', 'feature')}, 8) AS noised FROM cells JOIN bars ON t = w % 12",
    "weighted_loss": f"WITH {CELLS}, e AS (SELECT w, avg(pow(x - {normal_sql(61, 'w', 'step', 'feature')}, 2)) AS m FROM cells GROUP BY w) SELECT round(sum((1 + label / 10.0::DOUBLE) * m) / sum(1 + label / 10.0::DOUBLE), 8) AS loss FROM e JOIN embeddings ON vec_id = w",
}
